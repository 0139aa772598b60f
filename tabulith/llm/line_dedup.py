"""Line deduplication across documents, with DataFrame functions only.

Lines are exploded, normalised and hashed; a hash found in ``min_docs`` distinct documents loses all
its lines. Only hashes and positions go through the counting shuffles, the texts are shuffled once:
the positions to drop meet them by document.

Hot lines: the count combines before each of its two shuffles. The frequent hashes are a table of their
own, so the semi join with them is one of two plain shuffles, which adaptive execution splits when a
line is in a third of all documents (or replaces by a broadcast when that table turns out small).

Defined cases: null text is one empty line and stays null in the operator's text; the empty key is
never counted; rows with the same id are one document for the count; a null id is one document of its
own; columns of the input that carry an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, lower_ascii, replaced, stage, table


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct_texts: bool = False) -> DataFrame:
    """``docs`` with the common lines cut out of the text, plus ``n_lines`` and ``n_dropped``.

    With ``distinct_texts`` documents of equal texts count as one.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    keyed = slim.select("id", "t", "pos", F.btrim(lower_ascii(F.col("line")), F.lit(BLANK)).alias("key"))
    # two seeds, so 128 independent bits stand for a line
    hashed = keyed.where(F.length("key") >= max(min_chars, 1)).select("id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    common = hashed.groupBy("h1", "h2").agg(F.count_distinct(F.col("t") if distinct_texts else F.struct("id")).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    drops = hashed.join(stage(common), ["h1", "h2"], "left_semi").groupBy("id", "t").agg(F.collect_set("pos").alias("drop"))

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("row_id"), F.xxhash64(docs[text_col]).alias("row_t"), docs[text_col].alias("row_text"))
    met = rows.join(drops.hint("shuffle_hash"), rows.row_id.eqNullSafe(drops.id) & (rows.row_t == drops.t), "left")
    lines = _lines(F.col("row_text"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop")), lambda p: F.get(F.col("lines"), p)), "\n")
    cut = met.select("row", "row_text", "drop", lines.alias("lines")).select(
        "row",
        F.when(F.col("drop").isNull(), F.col("row_text")).otherwise(kept).alias("kept"),
        F.size("lines").cast("long").alias("n_lines_"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped_"),
    )
    flat = cut.select("row.*", F.col("kept").alias("__kept"), F.col("n_lines_").alias("__lines"), F.col("n_dropped_").alias("__dropped"))
    out = replaced(flat, **{text_col: F.col("__kept"), "n_lines": F.col("__lines"), "n_dropped": F.col("__dropped")})
    return out.drop("__kept", "__lines", "__dropped")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
