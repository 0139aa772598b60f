"""Records of CSV files whose values may hold line breaks, from lines that many tasks read.

Spark splits text files at line breaks, and a line break can be inside of quotes. Whether a line begins
inside depends on all lines before it, but only through one bit: each range of a file maps that bit at its
beginning to that at its end. So a first pass finds each range's map, a prefix scan over one small row a
range gives every range its bit, and a second pass cuts records. A record that crosses the ends of
ranges comes in fragments, at most two a range, which meet by the range in which the record begins.

Quotes are as Spark's CSV reader takes them: a value is quoted if it begins with a quote, two quotes in it are
one, and what follows a closing quote up to the comma is plain text, as are quotes within other values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_INSIDE = r'(?:[^"]|"")*+'
_FIELD = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'
#: A line that leaves a quoted value open, when it begins outside of one and when it begins inside.
_OPENS = (re.compile(rf'(?:{_FIELD},)*+"{_INSIDE}\Z'), re.compile(rf'{_INSIDE}(?:"[^,]*+,(?:{_FIELD},)*+"{_INSIDE})?\Z'))

RECORD, HEAD, TAIL, THROUGH = range(4)


def opens(line: str, inside: bool) -> bool:
    """Whether the next line begins inside of quotes."""
    return _OPENS[inside].match(line) is not None


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): the lines of files, with the range of the file that they are read in."""
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch, bool]]:
    """(file, block, some rows of that range, whether it goes on from the batch before)."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        file, block = batch.column("file"), batch.column("block")
        names, at = file.dictionary_encode(), block.to_numpy()
        ids = names.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(at) != 0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = names.dictionary[int(ids[a])].as_py(), int(at[a])
            yield *key, batch.slice(a, b - a), key == last
            last = key


def _quoted(lines: pa.Array) -> list[int]:
    """Where quotes are: all other lines leave the bit as it is."""
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit at the end of each range for either bit at its beginning, and a file's first line."""
    now: list = []
    for file, block, rows, more in _ranges(batches):
        lines = rows.column("value")
        if not more:
            if now:
                yield _map(*now)
            now = [file, block, False, True, lines[0].as_py() if block == 0 else None]
        for i in _quoted(lines):
            line = lines[i].as_py()
            now[2:4] = opens(line, now[2]), opens(line, now[3])
    if now:
        yield _map(*now)


def _map(file: str, block: int, outside: bool, inside: bool, first: str | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([outside]), pa.array([inside]), pa.array([first], pa.string())], names=["file", "block", "outside", "inside", "first"])


def file_ranges(lines: DataFrame) -> DataFrame:
    """(file, block, enters, first) a range: whether it begins inside of quotes, and a file's first line.

    A map is constant, or keeps the bit, or turns it: the bit is that of the last constant map before,
    turned as often as maps have turned it since.
    """
    maps = lines.mapInArrow(_maps, "file string, block long, outside boolean, inside boolean, first string")
    by = Window.partitionBy("file").orderBy("block")
    turns = F.sum((F.col("outside") & ~F.col("inside")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    counted = maps.withColumn("turns", turns)
    flat = F.when(F.col("outside") == F.col("inside"), (F.col("outside").cast("long") + F.col("turns")) % 2)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.last(flat, ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.lag("turns").over(by), F.lit(0))
    return counted.select("file", "block", (at % 2 == 1).alias("enters"), "first")


class _Cutter:
    """Cuts the lines of one range after the other into records and fragments."""

    def __init__(self) -> None:
        self.file, self.block, self.at, self.inside, self.head, self.held = "", 0, 0, False, False, []
        self.out: list[tuple[str, int, int, int, str]] = []

    def begin(self, file: str, block: int, enters: bool) -> None:
        self.end()
        self.file, self.block, self.at, self.inside, self.head, self.held = file, block, 0, enters, enters, []

    def put(self, kind: int, record: str) -> None:
        self.out.append((self.file, self.block, -1 if kind in (HEAD, THROUGH) else self.at, kind, record))
        self.at += kind in (RECORD, TAIL)

    def end(self) -> None:
        if self.held:
            self.put(THROUGH if self.head else TAIL, "\n".join(self.held))

    def add(self, lines: pa.Array) -> None:
        done = 0
        for i in [*_quoted(lines), len(lines)]:
            plain = lines[done:i].to_pylist()  # all of these begin and end with the same bit
            if self.inside:
                self.held += plain
            else:
                for line in plain:
                    self.put(RECORD, line)
            if i < len(lines):
                line = lines[i].as_py()
                self.held.append(line)
                self.inside = opens(line, self.inside)
                if not self.inside:
                    self.put(HEAD if self.head else RECORD, "\n".join(self.held))
                    self.head, self.held = False, []
            done = i + 1

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [()] * 5
        self.out = []
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "block", "at", "kind", "record"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = _Cutter()
    for file, block, rows, more in _ranges(batches):
        if not more:
            cutter.begin(file, block, rows.column("enters")[0].as_py())
        cutter.add(rows.column("value"))
        if len(cutter.out) >= 10_000:
            yield cutter.batch()
    cutter.end()
    yield cutter.batch()


def csv_records(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, block, at, record) from ``text_lines`` and their ``file_ranges``; blank records are left out.

    Records are in the order of file, block and at. What an open quote at the end of a file leaves is one record.
    """
    met = lines.join(F.broadcast(ranges.select("file", "block", "enters")), ["file", "block"])  # a row a range of the input
    parts = met.select("value", "file", "block", "enters").mapInArrow(_cut, "file string, block long, at long, kind int, record string")
    broken = parts.where(f"kind <> {RECORD}")
    by = Window.partitionBy("file").orderBy("block", "at")  # a head's and a passing one's number is -1
    owner = F.last(F.when(F.col("kind") == TAIL, F.struct("block", "at")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    piece = F.struct(F.col("block").alias("b"), F.col("at").alias("a"), "record")
    # a tail begins a record, so the fragment of its own range before it belongs to the tail before
    whole = broken.withColumn("o", owner).groupBy("file", F.col("o.block").alias("block"), F.col("o.at").alias("at")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    whole = whole.select("file", "block", "at", F.array_join(F.col("p.record"), "\n").alias("record"))
    every = parts.where(f"kind = {RECORD}").select("file", "block", "at", "record").unionByName(whole)
    return every.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")
