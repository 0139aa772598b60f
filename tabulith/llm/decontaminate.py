"""Benchmark decontamination: find, and remove, passages of benchmark items in documents.

A window is ``size`` consecutive words of an item; a shorter item with words is one window. The windows
are made once; their hash set, with words and items in packed arrays, is broadcast in blocks of at most
about ``block`` bytes: a benchmark within the bound takes one scan of the documents, a larger one a scan
per block, and the hits are put together by document. The driver holds one block at a time. A hash hit
counts only after its words equal those of the window. Documents are not shuffled for the scan.

Defined cases: null text has no words; the windows of an item with a null id are hit like others, but
the id is not listed; an item without words has no windows; items of equal ids are one item; a document
without words is not contaminated; repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table, text_batches
from .tokens import LOWERED, WORD_LIKE, Slice, buffers, slices, windows

#: Bytes that one broadcast holds at most, by this count: words and ids as they are, and for each window and id so many more.
BLOCK = 128 << 20
_EXTRA = 24

#: Windows of items that a task hands on together.
WINDOWS = 20_000

_SPANS = "array<struct<word:bigint,word_end:bigint,start:bigint,end:bigint>>"
_SCAN = f"n_words long, n_hit long, items array<string>, spans {_SPANS}"
_SPAN = pa.struct([(k, pa.int64()) for k in ("word", "word_end", "start", "end")])


def benchmark_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(words, n, items): each distinct window of the benchmark with the ids of its items that aren't null."""

    def made(item: list, text: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int32())], names=["item", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1), WORD_LIKE):
                item, text, n = [], [], []
                data = LOWERED[s.data].tobytes()
                for d in range(len(s)):
                    lo, hi = s.first[d], s.first[d + 1]
                    words = [data[a:b].decode() for a, b in zip(s.starts[lo:hi], s.ends[lo:hi], strict=True)]
                    k = min(size, len(words))
                    for i in range(len(words) - k + 1 if k else 0):
                        item.append(batch.column(0)[s.row + d].as_py())
                        text.append(" ".join(words[i : i + k]))
                        n.append(k)
                        if len(n) >= WINDOWS:
                            yield made(item, text, n)
                            item, text, n = [], [], []
                yield made(item, text, n)

    slim = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].alias("text"))
    return slim.mapInArrow(run, "item string, words string, n int").groupBy("words", "n").agg(F.collect_set("item").alias("items"))


class _Windows:
    """A block of windows, ready to be looked up: by length the sorted hashes with their words and items, packed."""

    def __init__(self, block: pa.Table):
        items = block.column("items").combine_chunks()
        named = items.flatten().dictionary_encode()  # as wide as the ids are, not as the widest
        self.names, place = named.dictionary, named.indices.to_numpy()
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64))])
        sizes = block.column("n").to_numpy()
        words = block.column("words").combine_chunks()
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            data, at = buffers(words.take(pa.array(own)))
            h = np.empty(len(own), dtype=np.uint64)
            for s in slices(words.take(pa.array(own))):
                h[s.row : s.row + len(s)] = windows(s.hashes(lowered=False), n)[s.first[:-1]]
            order = np.argsort(h, kind="stable")
            self.bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[n] = (h[order], at[:-1][order], at[1:][order], data, own[order])
        self.first, self.place = first, place.astype(np.int32)

    def items(self, window: int) -> list[str]:
        return self.names.take(pa.array(self.place[self.first[window] : self.first[window + 1]])).to_pylist()


def _find(s: Slice, known: _Windows) -> tuple[np.ndarray, dict[int, set[str]]]:
    """For each word of the slice whether it is in a window's occurrence; the items found, by text."""
    words = s.hashes(lowered=True)
    lowered = LOWERED[s.data].tobytes()
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for n, (hashes, begin, end, data, window) in known.by_size.items():
        w = windows(words, n)
        at = np.flatnonzero(known.bits[(w >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(hashes, w[at]), np.searchsorted(hashes, w[at], side="right")
        found = np.flatnonzero(hi > lo)
        doc = np.searchsorted(s.first, at[found], side="right") - 1
        inside = at[found] + n <= s.first[doc + 1]
        for i, a, b, d in zip(at[found][inside].tolist(), lo[found][inside].tolist(), hi[found][inside].tolist(), doc[inside].tolist(), strict=True):
            text = b" ".join(lowered[s.starts[j] : s.ends[j]] for j in range(i, i + n))
            for k in range(a, b):
                if data[begin[k] : end[k]].tobytes() == text:
                    depth[i] += 1
                    depth[i + n] -= 1
                    items.setdefault(d, set()).update(known.items(window[k]))
    return np.cumsum(depth[:-1]) > 0, items


def _scan(known, text: str, keep: list[str]) -> Callable:
    """The columns ``keep`` of each row with n_words, n_hit, items and spans (code points) of its ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for s in slices(batch.column(text), WORD_LIKE):
                hit, found = _find(s, known.value)
                n_words += np.diff(s.first).tolist()
                total = np.concatenate([[0], np.cumsum(hit)])
                hits = total[s.first[1:]] - total[s.first[:-1]]
                n_hit += hits.tolist()
                for d in range(len(s)):
                    items.append(sorted(found.get(d, ())))
                    spans.append(_spans(s, hit, d) if hits[d] else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep]
                + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))],
                names=[*keep, "n_words", "n_hit", "items", "spans"],
            )

    return run


def _spans(s: Slice, hit: np.ndarray, d: int) -> list[dict[str, int]]:
    """The ranges of runs of hit words in text d, in words and in code points."""
    lo, hi = int(s.first[d]), int(s.first[d + 1])
    flags = np.concatenate([[False], hit[lo:hi], [False]])
    change = np.flatnonzero(flags[1:] != flags[:-1])
    base = int(s.offsets[d])
    # a code point begins at every byte that does not continue one
    points = np.concatenate([[0], np.cumsum((s.data[base : int(s.offsets[d + 1])] & 0xC0) != 0x80)])
    return [{"word": int(a), "word_end": int(b), "start": int(points[s.starts[lo + a] - base]), "end": int(points[s.ends[lo + b - 1] - base])} for a, b in zip(change[::2], change[1::2], strict=True)]


def scan_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, item_col: str = "item_id", item_text: str = "text", text_col: str = "text", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The columns ``keep`` of ``docs``, with n_words, n_hit, items (sorted ids) and spans."""
    spark = docs.sparkSession
    text_batches(spark)
    keep = keep or ["doc_id"]
    meant = stage(benchmark_windows(benchmark, size, item_col, item_text))
    weight = F.octet_length("words") + F.lit(_EXTRA) + F.aggregate("items", F.lit(0), lambda t, x: t + F.octet_length(x) + _EXTRA)
    blocks = max(1, -(-int(meant.agg(F.sum(weight)).first()[0] or 0) // block))
    slim = docs.select(*dict.fromkeys([text_col, *keep]))  # the text goes to the tasks once
    if blocks > 1:  # rows of equal ids but other texts stay apart
        slim = slim.withColumn("__t", F.xxhash64(text_col))
        keep = [*keep, "__t"]
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keep], _SCAN])
    parts = []
    for b in range(blocks):
        own = meant if blocks == 1 else meant.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        known = spark.sparkContext.broadcast(_Windows(own.toArrow()))  # bounded by ``block``; it is kept in a file from here on
        parts.append(slim.mapInArrow(_scan(known, text_col, keep), schema))
    if blocks == 1:
        return parts[0]
    return _put_together(parts, keep).drop("__t")


def _put_together(parts: list[DataFrame], keep: list[str]) -> DataFrame:
    """Hits of several blocks: spans are merged again, so each word counts once; equal rows stay as many."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy(*keep).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _merge(F.flatten(F.collect_list("spans"))).alias("spans"), (F.count("*") / len(parts)).cast("int").alias("rows")
    )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["word_end"] - x["word"])
    return merged.withColumn("rows", F.explode(F.array_repeat(F.lit(1), F.col("rows")))).select(*keep, "n_words", hit.alias("n_hit"), "items", "spans")


def _merge(spans: Column) -> Column:
    """Spans in order, with those that touch or overlap made one."""

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(*[last[k].alias(k) for k in ("word",)], *[F.greatest(last["word_end"], x["word_end"]).alias("word_end")], last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (last["word_end"] >= x["word"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, mode: str = "documents", least_hit: int = 1, text_col: str = "text", **names) -> DataFrame:
    """``docs`` without benchmark passages.

    ``mode`` "documents" leaves out documents with at least ``least_hit`` hit words; "spans" cuts the
    hit passages out of their texts instead. Columns stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode: {mode}")
    # other names, so that those of the results can't clash
    named = {f"c{i}": c for i, c in enumerate(docs.columns)}
    text = next(k for k, c in named.items() if c.lower() == text_col.lower())
    scanned = scan_documents(docs.select(*[docs[c].alias(k) for k, c in named.items()]), benchmark, size, text_col=text, keep=list(named), **names)
    if mode == "documents":
        return scanned.where(F.col("n_hit") < max(least_hit, 1)).select(*[F.col(k).alias(c) for k, c in named.items()])
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda x: x["end"]))
    starts = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.length(text).cast("long")))
    cut = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int"))), "")
    left = F.when((F.size("spans") > 0) & (F.col("n_hit") >= least_hit), cut).otherwise(F.col(text))
    return scanned.select(*[(left if k == text else F.col(k)).alias(c) for k, c in named.items()])


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = scan_documents(docs, table(spark, sf_dir, "benchmark"), size=10, keep=["doc_id"])
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM wins
), dwins AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, wins.n, item_id FROM dwins JOIN wins ON dwins.g = wins.g AND dwins.n = wins.n
), hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
