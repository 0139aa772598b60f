"""Secret scans: candidates in texts, judged by how many owners and repositories in the corpus hold them.

Base kinds (assign, access, hex) are reported wherever they match. Further candidates (vendor tokens,
JSON web tokens, private key blocks, long mixed tokens) are common in documentation, so their spans are
added only where the corpus says that they look live: a value held by at most ``max_owners`` owners and
``max_repos`` repositories is owner-specific, one that is spread wider is a copied example.

Texts are scanned once; only hashes of candidates go through shuffles. The distinct counts combine
before theirs, and their join back is a plain shuffled join that adaptive execution splits when one
value is in a third of all documents. Values never leave the scan, only 128 bits of their SHA-256.

Defined cases: null text is empty; a null owner or repository counts as one of its own; repeated rows
get equal spans and count once as repository (by id); ids are numbers; offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table, text_batches

# Fixed values of the base kinds, in their listed order: pattern, group, least length of the group.
BASE = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Runs shorter than this can't match, so the hex scan may skip them; the kept matches are the same.
_HEX = re.compile(r"[0-9a-f]{32,}")
# Further candidates; listed order also orders spans of equal start.
MORE = (
    ("vendor", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})")),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}")),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]|-(?!----))+-----END [A-Z ]*PRIVATE KEY-----")),
    ("mixed", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])")),
)
_KINDS = [k for k, *_ in BASE] + [k for k, _ in MORE]
_ENTROPY = 3.5
_SCHEMA = (
    "id long, owner string, repo string, row_key long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,kind:int,end:long,h1:long,h2:long,added:boolean>>"
)


def entropy(s: str) -> float:
    """Bits per character of the characters' own distribution."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _live_like(s: str) -> bool:
    """A long token with upper case, lower case and digits, without much repetition."""
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s) and entropy(s) >= _ENTROPY


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, by start and kind."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "access" and "AKIA" not in text:
            continue
        for m in (_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end(), m[group]))
    return sorted(out)


def _apart(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of spans in order, those that overlap made one."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def more_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates that don't overlap base spans or earlier ones."""
    out: list[tuple[int, int, int, str]] = []
    for k, (kind, pattern) in enumerate(MORE, len(BASE)):
        starts, ends = _apart([(a, b) for a, _, b, _ in [*taken, *out]])
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end()) - 1  # the last span that begins before the end
            if (before < 0 or ends[before] <= m.start()) and (kind != "mixed" or _live_like(m[0])):
                out.append((m.start(), k, m.end(), m[0]))
    return out


def _h(value: str) -> tuple[int, int]:
    d = hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)


def joined(spans) -> str:
    return ",".join(f"{_KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(4).to_pylist():
            text = text or ""
            base = base_spans(text)
            more = more_spans(text, base)
            n = Counter(k for _, k, *_ in base)
            found = [dict(zip(("start", "kind", "end", "h1", "h2", "added"), (a, k, b, *_h(v), k >= len(BASE)), strict=True)) for a, k, b, v in [*base, *more]]
            rows.append((n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), [{"start": a, "kind": k, "end": b} for a, k, b, _ in base], found))
        own = list(zip(*rows, strict=True)) if rows else [()] * 6
        span = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("h1", pa.int64()), ("h2", pa.int64()), ("added", pa.bool_())]))]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(4)], *[pa.array(list(v), t) for v, t in zip(own, types, strict=True)]],
            names=["id", "owner", "repo", "row_key", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"],
        )


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, max_owners: int = 1, max_repos: int = 20, id_col: str = "doc_id", owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied) of each row of ``docs``.

    ``owner_col`` names who holds a document and ``repo_col`` the repository; for a corpus of documents
    these are its source and the document itself. ``spans`` are all base spans and those further
    candidates whose value at most ``max_owners`` owners and ``max_repos`` repositories hold. ``n_live``
    and ``n_copied`` count all candidates of a row, base ones too, on either side of that line.
    """
    text_batches(docs.sparkSession)
    slim = docs.select(
        docs[id_col].cast("long").alias("id"), docs[owner_col].cast("string").alias("owner"), docs[repo_col].cast("string").alias("repo"), F.xxhash64(docs[id_col], docs[repo_col], docs[text_col]).alias("row_key"), docs[text_col].alias("text")
    )
    scanned = stage(slim.mapInArrow(_scan, _SCHEMA))
    each = scanned.where(F.size("found") > 0).select("id", "row_key", "owner", "repo", F.explode("found").alias("f")).select("id", "row_key", "owner", "repo", "f.*")
    values = each.select("h1", "h2", "owner", "repo").distinct()
    spread = values.groupBy("h1", "h2").agg(F.count_distinct(F.struct("owner")).alias("owners"), F.count_distinct(F.struct("repo")).alias("repos"))
    judged = each.drop("owner", "repo").join(spread, ["h1", "h2"]).withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    per_row = judged.groupBy("row_key").agg(
        F.collect_set(F.when(F.col("live") & F.col("added"), F.struct("start", "kind", "end"))).alias("added"),
        F.count_distinct(F.when(F.col("live"), F.struct("start", "kind"))).alias("n_live"),
        F.count_distinct(F.when(~F.col("live"), F.struct("start", "kind"))).alias("n_copied"),
    )
    zero = F.lit(0).cast("long")
    out = scanned.drop("found").join(per_row, "row_key", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))
    return out.select("id", "n_assign", "n_access", "n_hex", "base_sha256", _text(spans).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
