"""Reading assistant transcripts of any size.

A file holds one response, a JSON list of messages, or (``lines``) one response a line.
Files are read in byte ranges by Spark's text reader, from whatever store it reads. A
list may be one line of many gigabytes, so its records are not lines but the pieces
between closing braces, which are short; whether a piece lies inside a string and how
deeply it is nested depends on all that comes before it. Two passes settle that:

1. each range is reduced to a row: whether it turns "inside a string" around, and by
   how much it changes the depth if it starts outside, or inside, a string;
2. running sums of these rows give every range its state at the start, and its pieces
   are cut at the commas of the top level. Messages that cross ranges come together
   afterwards, by their number.

A task holds a batch of pieces and one message at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The helpers travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
OPENING, CLOSING = np.frombuffer(b"[{", np.uint8), np.frombuffer(b"]}", np.uint8)


def _session_id(path: str) -> Column:
    """The file's path below ``path`` without its ending."""
    place = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    below = F.regexp_replace(place, rf"^.*\Q{path.rstrip('/').removeprefix('file://')}\E/", "")
    name = F.when(below != place, below).otherwise(F.col("_metadata.file_name"))
    return F.regexp_replace(name, r"\.jsonl?\z", "")


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``session_id, range_start, place, value``: records of every file in reading order.

    ``place`` orders the records of a range; ``range_start`` orders the ranges of a file.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", separator)
    return reader.text(path).select(
        _session_id(path).alias("session_id"),
        F.col("_metadata.file_block_start").alias("range_start"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


class Scanner:
    """Structure of a JSON text that comes in buffers, each ending outside an escape."""

    def __init__(self, inside: bool = False, depth: int = 0):
        self.inside, self.depth = inside, depth

    def feed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each byte is outside strings, the depth after it, and the step it makes."""
        slash = data == BACKSLASH
        # A run of backslashes escapes what follows if it is odd; runs are rare.
        quotes = data == QUOTE
        if slash.any():
            at = np.flatnonzero(quotes[1:] & slash[:-1]) + 1
            for i in at.tolist():
                run = i
                while run and slash[run - 1]:
                    run -= 1
                quotes[i] = (i - run) % 2 == 0
        inside = (np.cumsum(quotes) + self.inside) % 2 == 1  # after the byte
        outside = ~(inside | quotes)
        steps = np.isin(data, OPENING).astype(np.int64) - np.isin(data, CLOSING)
        steps[~outside] = 0
        depths = np.cumsum(steps) + self.depth
        if len(data):
            self.inside, self.depth = bool(inside[-1]), int(depths[-1])
        return outside, depths, steps


def _buffer(values: pa.Array) -> np.ndarray:
    """Pieces put together again, with the braces that separated them."""
    joined = b"}".join(value or b"" for value in values.cast(pa.binary()).to_pylist()) + b"}"
    return np.frombuffer(joined, np.uint8)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """Consecutive pieces of one range."""
    sessions, starts = batch["session_id"].to_pylist(), batch["range_start"].to_pylist()
    at = 0
    for i in range(1, len(sessions) + 1):
        if i == len(sessions) or (sessions[i], starts[i]) != (sessions[at], starts[at]):
            yield sessions[at], starts[at], batch["value"].slice(at, i - at)
            at = i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: how it changes the state it starts in."""
    key, states = None, ()

    def row() -> pa.RecordBatch:
        out, into = states
        return pa.RecordBatch.from_pydict(
            {
                "session_id": [key[0]], "range_start": [key[1]], "turns": pa.array([int(out.inside)], pa.int32()),
                "depth_outside": [out.depth], "depth_inside": [into.depth],
            }
        )

    for batch in batches:
        for session, start, values in _runs(batch):
            if key != (session, start):
                if key is not None:
                    yield row()
                key, states = (session, start), (Scanner(False), Scanner(True))
            data = _buffer(values)
            for state in states:
                state.feed(data)
    if key is not None:
        yield row()


class _Cutter:
    """Cuts one range at the commas of the top level."""

    def __init__(self, key: tuple[str, int], inside: bool, depth: int):
        self.key, self.scanner = key, Scanner(inside, depth)
        self.begun, self.held = 0, bytearray()  # messages begun in this range; text of the open one
        self.open = depth > 0  # a message of an earlier range goes on
        self.outer = bytearray()  # text outside the list

    def feed(self, data: np.ndarray) -> Iterator[tuple[int, bytes, bool]]:
        """Number in the range (0: begun earlier), text, and whether the message ends here."""
        outside, depths, steps = self.scanner.feed(data)
        top = outside & (
            ((data == COMMA) & (depths == 1)) | ((steps == 1) & (depths == 1)) | ((steps == -1) & (depths == 0))
        )
        raw, start = data.tobytes(), 0
        for i in np.flatnonzero(top).tolist():
            text, start = raw[start:i], i + 1
            if steps[i] == 1:  # the list begins
                self.outer += text + raw[i : i + 1]
                self.open = True
                self.begun += 1
            else:
                yield self.begun, bytes(self.held) + text, True
                self.held.clear()
                self.open = steps[i] == 0
                if self.open:
                    self.begun += 1
                else:
                    self.outer += raw[i : i + 1]
        rest = raw[start:]
        if self.open:
            self.held += rest
        else:
            self.outer += rest


CUT = "session_id string, range_start bigint, nth bigint, fragment binary, ends boolean, outer binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of messages, and for each range what is outside the list."""
    cutter = None

    def rows(cutter: _Cutter, found: list[tuple], last: bool) -> pa.RecordBatch:
        if last and (cutter.open or cutter.held):
            found.append((cutter.begun, bytes(cutter.held), False))
        if last:
            found.append((None, None, None))
        outer = [None] * (len(found) - last) + [bytes(cutter.outer)] * last
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([cutter.key[0]] * len(found), pa.string()), pa.array([cutter.key[1]] * len(found), pa.int64()),
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.bool_()),
                pa.array(outer, pa.binary()),
            ],
            names=["session_id", "range_start", "nth", "fragment", "ends", "outer"],
        )

    for batch in batches:
        insides, depths, at = batch["inside"].to_pylist(), batch["depth"].to_pylist(), 0
        for session, start, values in _runs(batch):
            if cutter is None or cutter.key != (session, start):
                if cutter is not None:
                    yield rows(cutter, [], True)
                cutter = _Cutter((session, start), insides[at], depths[at])
            yield rows(cutter, list(cutter.feed(_buffer(values))), False)
            at += len(values)
    if cutter is not None:
        yield rows(cutter, [], True)


def _earlier(*order: str):
    return Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def message_fragments(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, range_start, nth, fragment, ends, outer`` of files that hold a list each."""
    pieces = _pieces(spark, path, "}")
    summary = pieces.mapInArrow(
        _summaries, "session_id string, range_start bigint, turns int, depth_outside bigint, depth_inside bigint"
    )
    # A row a range: a file of a terabyte has some thousands.
    before = _earlier("range_start")
    turned = F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1
    states = summary.withColumn("inside", turned)
    step = F.when(F.col("inside"), F.col("depth_inside")).otherwise(F.col("depth_outside"))
    states = states.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0))).select(
        "session_id", "range_start", "inside", "depth"
    )
    # Reading order again, should the join have shuffled the pieces.
    return (
        pieces.join(states, ["session_id", "range_start"])
        .sortWithinPartitions("session_id", "range_start", "place")
        .select("session_id", "range_start", "value", "inside", "depth")
        .mapInArrow(_cut, CUT)
    )


def _message_columns(messages: DataFrame) -> DataFrame:
    return messages.select(
        "session_id",
        F.col("seq").cast("bigint").alias("seq"),
        "payload",
        F.get_json_object("payload", "$.content.parts[0].text").alias("text"),
    )


def _list_files(spark: SparkSession, path: str) -> DataFrame:
    cut = message_fragments(spark, path)
    # How many messages earlier ranges began, and the text outside each file's list.
    ranges = cut.groupBy("session_id", "range_start").agg(
        F.coalesce(F.max("nth"), F.lit(0)).alias("begun"), F.max("outer").alias("outer")
    )
    ranges = ranges.withColumn("first", F.coalesce(F.sum("begun").over(_earlier("range_start")), F.lit(0)))
    outer = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("range_start", "outer"))), lambda r: r["outer"].cast("string")), ""
    )
    # A last record has no brace of its own; the splitter added one to the file's end.
    is_list = F.regexp_like(outer, F.lit(r"\A\s*\[\s*\]\s*\}?\s*\z"))
    files = ranges.groupBy("session_id").agg(is_list.alias("is_list"))
    numbered = cut.where("nth IS NOT NULL").join(ranges.drop("outer", "begun"), ["session_id", "range_start"])
    numbered = numbered.select(
        "session_id", (F.col("first") + F.col("nth") - 1).alias("seq"), "range_start", "fragment", "ends", "nth"
    )
    whole = numbered.where("ends AND nth > 0").select("session_id", "seq", F.col("fragment").cast("string").alias("m"))
    crossing = numbered.where("NOT ends OR nth = 0").groupBy("session_id", "seq").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("range_start", "fragment"))), lambda p: p["fragment"].cast("string")
            ),
            "",
        ).alias("m")
    )
    found = whole.unionByName(crossing).join(files.where("is_list"), "session_id")
    # An empty list has one empty message.
    empty = (F.col("seq") == 0) & F.regexp_like("m", F.lit(r"\A\s*\z"))
    payload = F.from_json(F.concat(F.lit("["), "m", F.lit("]")), "array<string>")
    messages = found.where(~empty).select(
        "session_id", "seq", F.when(F.size(payload) == 1, payload[0]).alias("payload")
    )
    broken = files.where("NOT is_list").select(
        "session_id", F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("payload")
    )
    return _message_columns(messages.unionByName(broken))


def _line_files(spark: SparkSession, path: str) -> DataFrame:
    lines = _pieces(spark, path, "\n")
    spans = lines.groupBy("session_id", "range_start").agg(
        F.min("place").alias("from"), F.count(F.lit(1)).alias("lines")
    )
    spans = spans.withColumn("before", F.coalesce(F.sum("lines").over(_earlier("range_start")), F.lit(0)))
    number = F.col("before") + F.col("place") - F.col("from") + 1
    messages = F.coalesce(F.from_json("value", "array<string>"), F.array(F.lit(None).cast("string")))
    rows = (
        lines.join(spans, ["session_id", "range_start"])
        .where(F.trim("value") != "")
        .select(
            F.concat_ws("#", "session_id", number).alias("session_id"),
            F.posexplode(messages).alias("seq", "payload"),
        )
    )
    return _message_columns(rows)


def read_transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``agent_events`` from files that each hold one response, or one a line.

    The session is the file's path below ``path`` without its ending (and ``#`` with the line's
    number), so equal names in different folders stay apart; a message's text is its
    first text part. A file or line that is no JSON list gives one row without a
    payload; a message that is not valid JSON has none either, and its neighbours stay. Spark
    leaves out files without a byte.
    """
    return _line_files(spark, path) if lines else _list_files(spark, path)
