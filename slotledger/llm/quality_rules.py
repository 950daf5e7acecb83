"""Quality rules: fixed rules first, then an isolation forest on rule statistics.

``rule_statistics`` counts what the rules need over each whole text. A forest of
random split trees is grown, each tree on 256 rows that a hash of its own draws
from all rows, inside the box all rows span; the path length to the
leaf a document falls into says how easily it is set apart. The path length
below which a document is rejected is calibrated from labelled rows: as high as
the false rejections among good rows allow. Trees are grown on rows labelled
good where there are enough, else on any rows; without labelled rows of both
kinds no document is rejected for its path length.

Edge cases: a null text counts as empty; a text without words has zero counts,
fails the base rules and is not kept. Every input row gives one output row,
repeated rows and null ids included. Columns of the input are never read by
name other than the id and the text; a clashing name is replaced by the
operator's own in ``judge`` and left alone in ``keep_documents``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slotledger.llm.words import Words, as_bytes, chunks, grams
from slotledger.llm.workers import release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: UTF-8 bytes of texts that a Python worker holds as words at once.
PIECE_BYTES = 1 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Counts that only the forest uses.
MORE = ("n_lines", "n_upper", "n_letters", "n_marks", "n_same_next")
STATISTICS = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS + MORE])

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?.,;:\"'()[]{}=+-_/\\^~@`", np.uint8))


def _per_text(marked: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
    return total[ends] - total[starts]


def _duplicate_lines(blob: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    if b"\n" not in blob:
        return 0, int(bool(blob.split(None, 1)))
    lines = [line for line in blob.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines)), len(lines)


def _repeat_words(keys: np.ndarray, words: Words) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in that text."""
    n, k = len(keys), REPEAT_WINDOW
    counts = np.zeros(len(words.counts), np.int64)
    fits = words.fits(k)
    if not fits.any():
        return counts
    at = np.flatnonzero(fits)
    document = words.documents()
    # The text's number is part of the key: windows of other texts never match.
    window = grams(keys, k)[at] ^ (document[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(window, kind="stable")
    same = np.concatenate([[False], window[order][1:] == window[order][:-1]])
    twice = same | np.concatenate([same[1:], [False]])
    begins = at[order[twice]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + k, -1)
    return np.bincount(document, np.cumsum(cover[:-1]) > 0, len(counts)).astype(np.int64)


def count_texts(blobs: list[bytes]) -> np.ndarray:
    """Statistics of each text, a row for each, in the order of ``STATISTICS``."""
    out = np.zeros((len(blobs), len(STATISTICS)), np.int64)
    for start, end in chunks(blobs, PIECE_BYTES):
        part = blobs[start:end]
        words = Words(part)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        stops = np.cumsum(sizes)
        begins = stops - sizes
        raw = np.frombuffer(b"".join(part), np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        keys = words.hashes()
        lines = np.array([_duplicate_lines(b) for b in part], np.int64).reshape(-1, 2)
        row = out[start:end]
        row[:, 0] = words.counts
        row[:, 1] = _per_text(~space & ((raw & 0xC0) != 0x80), begins, stops)
        row[:, 2] = _per_text(_SYMBOL[raw], begins, stops)
        row[:, 3], row[:, 5] = lines[:, 0], lines[:, 1]
        row[:, 4] = _repeat_words(keys, words)
        row[:, 6] = _per_text(_UPPER[raw], begins, stops)
        row[:, 7] = _per_text(_LETTER[raw] | (raw >= 0x80), begins, stops)
        row[:, 8] = _per_text(_MARK[raw], begins, stops)
        if len(keys):
            document = words.documents()
            again = (keys[1:] == keys[:-1]) & (document[1:] == document[:-1])
            row[:, 9] = np.bincount(document[1:], again, len(part))
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """What the trees split on: roots of shares; lengths say nothing about quality."""
    c = dict(zip(STATISTICS.names, counts.T.astype(np.float64), strict=True))
    n = np.maximum(c["n_words"], 1)
    shares = (
        c["n_symbols"] / n,
        c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / n,
        c["n_upper"] / np.maximum(c["n_letters"], 1),
        c["n_marks"] / n,
        c["n_same_next"] / n,
    )
    return np.sqrt(np.column_stack(shares))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, children, path length at a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    depth: np.ndarray

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row over all trees, relative to that of a random row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, child, depth in zip(
            self.feature, self.threshold, self.child, self.depth, strict=True
        ):
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                right = x[rows, np.maximum(feature[at], 0)] >= threshold[at]
                at = np.where(inner, child[at] + right, at)
            total += depth[at]
        return total / max(len(self.feature), 1)


def _mean_path(n: int) -> float:
    """Expected path length of a search among ``n`` random rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow_forest(
    x: np.ndarray, box: np.ndarray | None = None, trees: int = 128, rows: int = 256, seed: int = 7
) -> Forest:
    """Isolation trees, each on ``rows`` random rows of ``x``, split at random places.

    A place is drawn from the node's part of ``box`` (lowest and highest values,
    default those of ``x``), so a feature on which the sample does not vary still
    sets rows apart that differ on it.
    """
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    box = np.array([x.min(axis=0), x.max(axis=0)]) if box is None else np.asarray(box, float)
    return _forest([x[rng.choice(len(x), rows, replace=False)] for _ in range(trees)], box, rng)


def forest_of(samples: list[np.ndarray], box: np.ndarray, seed: int = 7) -> Forest:
    """Isolation trees, one on each of ``samples``, split at random places inside ``box``."""
    return _forest(samples, np.asarray(box, float), np.random.default_rng(seed))


def _forest(samples: list[np.ndarray], box: np.ndarray, rng: np.random.Generator) -> Forest:
    rows = max(len(sample) for sample in samples)
    limit = int(np.ceil(np.log2(max(rows, 2)))) + 6
    scale = _mean_path(rows) or 1.0
    grown = []
    for sample in samples:
        feature, threshold, child, depth = [-1], [0.0], [0], [0.0]
        pending = [(0, sample, box, 0)]
        while pending:
            at, part, room, level = pending.pop()
            usable = np.flatnonzero(room[1] > room[0])
            if level >= limit or len(part) < 2 or not len(usable):
                depth[at] = (level + _mean_path(len(part))) / scale
                continue
            f = int(rng.choice(usable))
            cut = rng.uniform(room[0, f], room[1, f])
            feature[at], threshold[at], child[at] = f, cut, len(feature)
            for side in (0, 1):
                inside = room.copy()
                inside[1 - side, f] = cut
                feature.append(-1), threshold.append(0.0), child.append(0), depth.append(0.0)
                rest = part[(part[:, f] >= cut) == bool(side)]
                pending.append((len(feature) - 1, rest, inside, level + 1))
        grown.append((feature, threshold, child, depth))
    size = max(len(g[0]) for g in grown)

    def table(i: int, fill: float, kind: type) -> np.ndarray:
        return np.array([g[i] + [fill] * (size - len(g[i])) for g in grown], kind)

    return Forest(
        table(0, -1, np.int16), table(1, 0, np.float64), table(2, 0, np.int32), table(3, 0, np.float64)
    )


def _statistics_array(counts: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(counts[:, i]) for i in range(counts.shape[1])], names=STATISTICS.names
    )


def rule_statistics(text: Column) -> Column:
    """Struct of ``STATISTICS`` of a text column."""

    def count(texts: pa.Array) -> pa.Array:
        out = _statistics_array(count_texts(as_bytes(texts)))
        release()
        return out

    return F.arrow_udf(count, STATISTICS)(text)


@dataclass(frozen=True)
class Rules:
    """Forest and the path length below which a document is rejected (None: never)."""

    forest: Forest | None
    threshold: float | None

    def verdicts(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, kept and path length of each row."""
        n = counts[:, 0]
        failed = (n < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * n)
        if self.forest is None or not len(counts):
            return failed, ~failed, np.ones(len(counts))
        path = self.forest.path_lengths(features(counts))
        if self.threshold is None:
            return failed, ~failed, path
        return failed, ~failed & (path >= self.threshold), path


def feature_columns() -> list[Column]:
    """``features`` as Spark columns over the fields of ``STATISTICS``, in the same order."""
    c = {name: F.col(name).cast("double") for name in STATISTICS.names}

    def share(part: str, whole: str) -> Column:
        return F.sqrt(c[part] / F.greatest(c[whole], F.lit(1.0)))

    return [
        share("n_symbols", "n_words"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_upper", "n_letters"),
        share("n_marks", "n_words"),
        share("n_same_next", "n_words"),
    ]


def _path_length(forest: Forest) -> Callable[..., Column]:
    """Column of each row's path length in ``forest``, from the fields of ``STATISTICS``."""

    def lengths(*columns: pa.Array) -> pa.Array:
        counts = np.column_stack([col.to_numpy(zero_copy_only=False) for col in columns])
        return pa.array(forest.path_lengths(features(counts.astype(np.int64))))

    udf = F.arrow_udf(lengths, T.DoubleType())
    return lambda: udf(*[F.col(name) for name in STATISTICS.names])


def _order_statistic(values: DataFrame, index: int) -> float:
    """The value at ``index`` (from 0) of the single column of ``values`` sorted ascending."""
    ranked = values.orderBy(values.columns[0]).rdd.map(lambda row: row[0]).zipWithIndex()
    return float(ranked.filter(lambda pair: pair[1] == index).map(lambda pair: pair[0]).first())


def _threshold(
    bad: DataFrame, good: DataFrame, false_rejections: float
) -> float | None:
    """Path length below which rows are rejected; None if that would reject no bad row.

    The lowest one that rejects nearly as many bad rows as the highest that keeps
    to the share of false rejections. ``bad`` and ``good`` hold one column of path
    lengths each; the quantiles are exact order statistics of all their rows.
    """
    n_good, n_bad = good.count(), bad.count()
    if not n_bad or not n_good:
        return None
    limit = _order_statistic(good, int(np.floor((n_good - 1) * false_rejections)))
    below = bad.where(F.col(bad.columns[0]) < F.lit(limit))
    m = below.count()
    if not m:
        return None
    return _order_statistic(below, int(np.ceil((m - 1) * 0.995))) + 1e-9


def _tree_samples(pool: DataFrame, trees: int, rows: int, seed: int) -> list[np.ndarray]:
    """Features of ``rows`` rows for each tree, those with the smallest hash of that tree.

    Every row of ``pool`` may be drawn; each task keeps its smallest per tree
    before the shuffle, so only ``trees * rows`` rows a task move and reach the driver.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    order = Window.partitionBy("tree").orderBy("key", "doc_id")
    drawn = (
        pool.select("doc_id", "h", *STATISTICS.names, tree)
        .withColumn("key", F.xxhash64("h", "tree", F.lit(seed)))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= rows)
        .select("tree", "key", "doc_id", *feature_columns())
        .toArrow()
    )  # trees * rows rows of six numbers
    table = np.column_stack([drawn.column(i).to_numpy() for i in range(3, drawn.num_columns)])
    order_of = np.lexsort((drawn["doc_id"].to_numpy(), drawn["key"].to_numpy(), drawn["tree"].to_numpy()))
    at = drawn["tree"].to_numpy()[order_of]
    return [table[order_of[at == t]] for t in range(trees)]


def fit_rules(
    docs: DataFrame,
    labels: DataFrame | None,
    false_rejections: float = 0.005,
    seed: int = 7,
    trees: int = 128,
    rows: int = 256,
) -> Rules:
    """Forest and threshold from all labelled (else all) rows.

    ``labels`` has ``doc_id`` and ``quality`` (1: good); ids labelled both ways and
    null labels are left out. Good rows are split in halves by a hash of their id:
    each tree takes ``rows`` of the first half by a hash of its own, so any of them
    may be drawn and a rerun draws the same; the path lengths of all rows of the
    second half and of all bad rows set the threshold. The box that cuts are drawn
    from spans every row.
    """
    hashed = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    # Texts are counted where they are read; only the numbers meet the labels.
    stats = (
        docs.where("doc_id IS NOT NULL")
        .select("doc_id", hashed.alias("h"), rule_statistics(F.col("text").cast("string")).alias("s"))
        .select("doc_id", "h", "s.*")
        .where(F.col("n_words") >= MIN_WORDS)
    )
    if labels is not None:
        marks = (
            labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
            .groupBy("doc_id")
            .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
            .where("low = high")
            .select("doc_id", F.col("low").alias("quality"))
        )
        counted = stats.join(marks, "doc_id")
    else:
        counted = stats.withColumn("quality", F.lit(None).cast("int"))
    counted = counted.persist(StorageLevel.DISK_ONLY)  # numbers only: some hundred bytes a row
    try:
        named = [x.alias(f"f{i}") for i, x in enumerate(feature_columns())]
        spans = counted.select(*named).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.min(f"f{i}") for i in range(len(named))],
            *[F.max(f"f{i}") for i in range(len(named))],
        ).first()
        if spans["n"] < 2:
            return Rules(None, None)
        box = np.array([list(spans)[1 : 1 + len(named)], list(spans)[1 + len(named) :]], float)
        good = counted.where(F.col("quality") == 1)
        if good.count() < 50:
            return Rules(forest_of(_tree_samples(counted, trees, rows, seed), box, seed), None)
        grow = F.pmod(F.col("h"), F.lit(2)) == 0
        forest = forest_of(_tree_samples(good.where(grow), trees, rows, seed), box, seed)
        length = _path_length(forest)
        threshold = _threshold(
            counted.where(F.col("quality") == 0).select(length().alias("p")),
            good.where(~grow).select(length().alias("p")),
            false_rejections,
        )
        return Rules(forest, threshold)
    finally:
        counted.unpersist()


def verdict(text: Column, rules: Rules) -> Column:
    """Struct of ``STATISTICS`` plus base_failed, kept and path_length of a text column."""
    schema = T.StructType(
        STATISTICS.fields
        + [
            T.StructField("base_failed", T.BooleanType()),
            T.StructField("kept", T.BooleanType()),
            T.StructField("path_length", T.DoubleType()),
        ]
    )

    def judge_texts(texts: pa.Array) -> pa.Array:
        counts = count_texts(as_bytes(texts))
        arrays = [pa.array(counts[:, i]) for i in range(counts.shape[1])]
        out = pa.StructArray.from_arrays(
            arrays + [pa.array(v) for v in rules.verdicts(counts)], names=schema.names
        )
        release()
        return out

    return F.arrow_udf(judge_texts, schema)(text)


def judge(docs: DataFrame, rules: Rules) -> DataFrame:
    """One row per document: id, statistics, base verdict, final verdict, path length."""
    judged = docs.select("doc_id", verdict(F.col("text").cast("string"), rules).alias("_verdict"))
    return judged.select("doc_id", "_verdict.*")


def keep_documents(docs: DataFrame, rules: Rules) -> DataFrame:
    """The documents that pass, with all their columns."""
    mark = "_kept"
    while mark in docs.columns:
        mark += "_"
    kept = docs.withColumn(mark, verdict(F.col("text").cast("string"), rules)["kept"])
    return kept.where(F.col(mark)).drop(mark)
