"""Personal data in whole texts, by DataFrame functions only.

The base rules (e-mail, IP address, card, phone) find leftmost spans that do not
overlap within a kind, and drop those that fail their check. On top of them,
generators with high recall propose overlapping candidates of each kind.
Gradient boosted trees of two splits score a candidate by format and context.
The format features leave out the marks that decide a base rule (the plus sign,
the Luhn digit, parts up to 255, the at sign), so the trees carry the look of
confirmed data over to spans without such a mark. Labels are the base spans; the
trees are fitted on exact counts of feature combinations over all documents, a
table of at most ``MAX_COMBINATIONS`` rows whatever the input. A threshold for
each kind is calibrated on held-out documents for a given precision; candidates
above it that overlap no base span are added, best first.

Edge cases: a null text counts as empty; a text without personal data has no
spans and the hash of the empty string. Rows are independent: repeated rows and
null ids give equal rows of their own. ``redact`` keeps every column and
replaces only ``text``; clashing column names cannot occur, because no name of
the input other than ``text`` is read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.llm.scratch import written

KINDS = ("email", "ip", "card", "phone")

# The base rules. Repetitions are possessive and starts are bounded by a
# look-behind where that changes no match; both keep long texts linear and off the stack.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

CANDIDATE_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[({](?:at|AT)[\])}]\x20?)"
    r"[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:[.:,\x20-][0-9]{1,4}+){3,7}+",
    "card": r"(?<![0-9])[0-9]{3,19}+(?:[\x20./-]{1,2}+[0-9]{2,19}+){0,5}+",
    "phone": r"[+(]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,16}+",
}

CUES = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|host|server|address|client",
    "card": r"card|visa|master|credit|payment|account",
    "phone": r"tel|phone|call|fax|mobil|whatsapp",
}

#: Feature names and their numbers of levels.
FEATURES = {"digits": 8, "groups": 6, "separators": 4, "longest": 6, "cue": 2, "before": 3, "after": 3, "letters": 3}
MAX_COMBINATIONS = len(KINDS) * math.prod(FEATURES.values())

_SPAN = "array<struct<start:int,end:int,kind:int>>"
_CANDIDATES = (
    "array<struct<start:int,end:int,kind:int,"
    + ",".join(f"{name}:int" for name in FEATURES)
    + ",label:int>>"
)


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    """start, end and match of every occurrence, in code points, from the pieces between them."""
    found = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["match"])
        span = F.struct(
            start.alias("start"), end.alias("end"), piece["match"].alias("match")
        )
        return F.when(
            piece["match"].isNotNull(),
            F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out")),
        ).otherwise(state)

    empty = F.lit(None).cast("array<struct<start:int,end:int,match:string>>")
    none = F.coalesce(empty, F.array().cast("array<struct<start:int,end:int,match:string>>"))
    walked = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda state: state["out"]
    )
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, walked).otherwise(none)


def _passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _gate(kind: str, text: Column) -> Column:
    """Cheap test that must hold where a span of the kind can be."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike("[0-9][0-9. -]")


def _base_of(kind: str, number: int, text: Column) -> Column:
    found = F.filter(
        _matches(text, BASE_PATTERNS[kind], _gate(kind, text)), lambda m: _passes(kind, m["match"])
    )
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(number).alias("kind")),
    )


def base_spans(text: Column) -> Column:
    """start, end and kind of every base span, by start and kind."""
    spans = [_base_of(kind, number, text) for number, kind in enumerate(KINDS)]
    return F.array_sort(
        F.concat(*spans),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]),
    ).cast(_SPAN)


def _level(value: Column, *bounds: int) -> Column:
    """Number of bounds that the value reaches."""
    return sum((F.when(value >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def _features(kind: str, text: Column, m: Column) -> list[Column]:
    match = m["match"]
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    numbers = F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))
    longest = F.coalesce(F.array_max(F.transform(numbers, lambda x: F.length(x))), F.lit(0))
    marks = F.regexp_replace(match, "[0-9A-Za-z+(@]", "")
    head = F.substring(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24)))
    before = F.substring(text, m["start"], F.lit(1))
    after = F.substring(text, m["end"] + 1, F.lit(1))

    def side(char: Column, outside: Column) -> Column:
        return (
            F.when(outside, 0).when(char.rlike(r"^[\x09-\x0D\x20]$"), 0).when(char.rlike("^[0-9A-Za-z_=@#]$"), 1).otherwise(2)
        )

    return [
        _level(digits, 1, 4, 7, 10, 12, 16, 17).alias("digits"),
        _level(F.size(numbers), 1, 2, 3, 4, 5).alias("groups"),
        _level(F.size(F.array_distinct(F.split(marks, ""))) - F.lit(1), 1, 2, 3).alias("separators"),
        _level(longest, 2, 3, 4, 5, 9).alias("longest"),
        F.when(F.lower(head).rlike(CUES[kind]), 1).otherwise(0).alias("cue"),
        side(before, m["start"] == 0).alias("before"),
        side(after, F.length(after) == 0).alias("after"),
        _level(F.length(F.regexp_replace(match, "[^A-Za-z]", "")), 1, 6).alias("letters"),
    ]


def _candidates_of(kind: str, number: int, text: Column, base: Column) -> Column:
    bracketed = text.rlike(r"[\[({](?:at|AT)[\])}]")
    gate = text.contains("@") | bracketed if kind == "email" else text.rlike("[0-9]{2}")

    def propose(m: Column) -> Column:
        same = F.exists(
            base, lambda b: (b["kind"] == number) & (b["start"] < m["end"]) & (b["end"] > m["start"])
        )
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(number).alias("kind"),
            *_features(kind, text, m),
            same.cast("int").alias("label"),
        )

    return F.transform(_matches(text, CANDIDATE_PATTERNS[kind], gate), propose)


def candidates(text: Column, base: Column) -> Column:
    """Proposed spans with features, and whether a base span of the kind overlaps each."""
    out = [_candidates_of(kind, number, text, base) for number, kind in enumerate(KINDS)]
    return F.concat(*out).cast(_CANDIDATES)


# ------------------------------------------------------------- boosted trees

#: feature, level: rows with feature >= level go right.
Split = tuple[str, int]


@dataclass
class Tree:
    """Two levels of splits and the values of the four leaves."""

    top: Split
    low: Split
    high: Split
    leaves: tuple[float, float, float, float]

    def value(self, row: dict) -> float:
        right = row[self.top[0]] >= self.top[1]
        f, level = self.high if right else self.low
        return self.leaves[2 * right + (row[f] >= level)]

    def column(self, of: Column) -> Column:
        def branch(split: Split, a: float, b: float) -> Column:
            return F.when(of[split[0]] >= split[1], F.lit(b)).otherwise(F.lit(a))

        a, b, c, d = self.leaves
        return F.when(of[self.top[0]] >= self.top[1], branch(self.high, c, d)).otherwise(
            branch(self.low, a, b)
        )


@dataclass
class Scorer:
    """Trees and threshold of each kind; a kind without a threshold adds no spans."""

    bias: dict[int, float] = field(default_factory=dict)
    trees: dict[int, list[Tree]] = field(default_factory=dict)
    thresholds: dict[int, float] = field(default_factory=dict)

    def value(self, kind: int, row: dict) -> float:
        return self.bias[kind] + sum(t.value(row) for t in self.trees[kind])

    def margin(self, of: Column) -> Column:
        """Score above the threshold; null where the kind adds nothing."""
        out = F.lit(None).cast("double")
        for kind, threshold in sorted(self.thresholds.items()):
            total = sum((t.column(of) for t in self.trees[kind]), F.lit(self.bias[kind] - threshold))
            out = F.when(of["kind"] == kind, total).otherwise(out)
        return out


def _best_split(rows: list[tuple[dict, float, float]]) -> tuple[Split, float]:
    """Split with the largest gain from counts of gradient and weight by feature and level."""
    best, gain = (next(iter(FEATURES)), 0), 0.0
    g_all, h_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    for name, levels in FEATURES.items():
        g_at, h_at = [0.0] * levels, [0.0] * levels
        for row, g, h in rows:
            g_at[row[name]] += g
            h_at[row[name]] += h
        g_low = h_low = 0.0
        for level in range(1, levels):
            g_low += g_at[level - 1]
            h_low += h_at[level - 1]
            g_high, h_high = g_all - g_low, h_all - h_low
            if min(h_low, h_high) <= 1e-9:
                continue
            found = g_low**2 / (h_low + 1) + g_high**2 / (h_high + 1) - g_all**2 / (h_all + 1)
            if found > gain + 1e-12:
                best, gain = (name, level), found
    return best, gain


def boost(rows: list[dict], rounds: int = 24, rate: float = 0.3) -> tuple[float, list[Tree]]:
    """Logistic boosting on feature combinations with counts ``n`` and positives ``p``."""
    n, p = sum(r["n"] for r in rows), sum(r["p"] for r in rows)
    bias = math.log((p + 0.5) / (n - p + 0.5))
    margin, trees = [bias] * len(rows), []
    for _ in range(rounds):
        weighted = []
        for row, m in zip(rows, margin, strict=True):
            q = 1 / (1 + math.exp(-max(min(m, 30), -30)))
            weighted.append((row, row["p"] - row["n"] * q, row["n"] * q * (1 - q)))
        top, gain = _best_split(weighted)
        if gain <= 1e-9:
            break
        sides = ([w for w in weighted if w[0][top[0]] < top[1]], [w for w in weighted if w[0][top[0]] >= top[1]])
        splits, leaves = [], []
        for side in sides:
            split, _ = _best_split(side)
            splits.append(split)
            for high in (False, True):
                part = [w for w in side if (w[0][split[0]] >= split[1]) == high]
                leaves.append(rate * sum(w[1] for w in part) / (sum(w[2] for w in part) + 1))
        trees.append(Tree(top, splits[0], splits[1], tuple(leaves)))
        margin = [m + trees[-1].value(row) for row, m in zip(rows, margin, strict=True)]
    return bias, trees


def _threshold(scored: list[tuple[float, int, int]], precision: float) -> float | None:
    """Least score from which on held-out candidates reach the precision; None if nowhere."""
    best, n, p = None, 0, 0
    ordered = sorted(scored, reverse=True)
    for i, (score, count, positive) in enumerate(ordered):
        n, p = n + count, p + positive
        last = i + 1 == len(ordered) or ordered[i + 1][0] < score
        if last and p >= precision * n and p >= 20:
            best = score
    return best


def spans_table(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates of every row, from one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"))
    found = found.withColumn("base", base_spans(F.col("text")))
    found = found.withColumn("candidates", candidates(F.col("text"), F.col("base")))
    held = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    return found.select("doc_id", "base", "candidates", held.alias("held_out"))


def fit_scorer(found: DataFrame, precision: float = 0.98, rounds: int = 24) -> Scorer:
    """Trees and thresholds from the candidates of ``spans_table``."""
    one = found.select("held_out", F.explode("candidates").alias("c")).select("held_out", "c.*")
    counts = (
        one.groupBy("held_out", "kind", *FEATURES)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
        .orderBy("held_out", "kind", *FEATURES)
        .collect()  # at most twice MAX_COMBINATIONS rows
    )
    scorer = Scorer()
    for kind in range(len(KINDS)):
        rows = [r.asDict() for r in counts if r["kind"] == kind]
        learn, test = [r for r in rows if not r["held_out"]], [r for r in rows if r["held_out"]]
        if not learn or not sum(r["p"] for r in learn):
            continue
        scorer.bias[kind], scorer.trees[kind] = boost(learn, rounds)
        threshold = _threshold([(scorer.value(kind, r), r["n"], r["p"]) for r in test], precision)
        # Without a clear margin over an even chance nothing is added.
        if threshold is not None:
            scorer.thresholds[kind] = max(threshold - 1e-9, 1.0)
    return scorer


def all_spans(base: Column, proposed: Column, scorer: Scorer) -> Column:
    """Base spans and the added ones, by start and kind; added spans overlap nothing."""
    clear = F.filter(
        proposed,
        lambda c: (scorer.margin(c) >= 0)
        & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])),
    )
    scored = F.transform(
        clear,
        lambda c: F.struct(
            (-scorer.margin(c)).alias("order"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")
        ),
    )

    def take(chosen: Column, c: Column) -> Column:
        taken = F.exists(chosen, lambda x: (x["start"] < c["end"]) & (x["end"] > c["start"]))
        return F.when(taken, chosen).otherwise(
            F.concat(chosen, F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))).cast(_SPAN))
        )

    added = F.aggregate(F.array_sort(scored), F.array().cast(_SPAN), take)
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return F.when(F.size(clear) > 0, F.array_sort(F.concat(base, added), order)).otherwise(base)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def find_pii(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """doc_id, base spans and all spans (arrays of start, end, kind number) of every row."""
    found = written(spans_table(docs), "spans")
    scorer = fit_scorer(found, precision)
    return found.select("doc_id", "base", all_spans(F.col("base"), F.col("candidates"), scorer).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, their hash, and all spans as text."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        F.size(F.filter(kinds, lambda k: k == F.lit(i))).cast("long").alias(f"n_{kind}")  # noqa: B023
        for i, kind in enumerate(KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def redact_text(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans merge."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        plain = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = F.concat(state["out"], plain, F.element_at(names, s["kind"] + 1))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
        )

    rebuilt = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, rebuilt).otherwise(text)


def redact(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all other columns as they were."""
    found = written(spans_table(docs.select(F.lit(None).alias("doc_id"), "text")).drop("doc_id"), "spans")
    scorer = fit_scorer(found, precision)
    base, proposed = "_base", "_proposed"
    while base in docs.columns or proposed in docs.columns:
        base, proposed = base + "_", proposed + "_"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(base, base_spans(text))
    out = out.withColumn(proposed, candidates(text, F.col(base)))
    clean = redact_text(F.col("text").cast("string"), all_spans(F.col(base), F.col(proposed), scorer))
    return out.withColumn("text", F.when(F.col("text").isNotNull(), clean)).drop(base, proposed)
