"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the expected number of copies of each of its documents. The
whole part is given to every document; the fractional parts are rounded by the pivotal method: two
documents with fractional probabilities trade mass (in words, so that the source's words stay as they
are) until one of them is certain, and the other goes on. Documents are dealt into bounded groups
within their source; a group leaves at most one residual, and residuals meet in a reduction tree of
bounded fan-in until one is left per source, which is rounded by its own probability. So a source's
taken words differ from its target by less than one document, and each document is taken with its
own probability.

A source that holds a third of all rows has more groups, not larger ones. Random numbers depend on
the seed, the group and the order by id, size and text only: reruns agree.

Defined cases: null text has size 0; null is a source like others, last in order; documents of size 0
are taken no word of; repeated rows are rounded each, in one group; ids are numbers and may be null; no source is taken above ``cap`` times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

#: Documents that a group rounds at most about; residuals that meet in one node of the tree.
GROUP = 8192
FAN_IN = 256
#: Runs of sources, ordered by name, that are numbered side by side.
RANGES = 64
_ROW = "id long, t long, size long, source string, copies long, p double, node long"


def n_words(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+ of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with a rank from 0 in code point order, null last, without one window over all."""
    dealt = stage(sources.repartitionByRange(RANGES, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    w = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    before = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()}  # RANGES rows at most
    start, offsets = 0, []
    for k in sorted(before):
        offsets.append((k, start))
        start += before[k]
    first = dealt.sparkSession.createDataFrame(offsets, "range int, start long")
    return dealt.join(F.broadcast(first), "range").select("source", "source_size", (F.col("start") + F.row_number().over(w) - 1).alias("rank"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code point order, null last, get ``weights`` in turn of ``share`` of all words; a target
    over ``cap`` times its source's size stops there and the rest goes to the others by weight, until
    none is above. Each round is one aggregate over the table of sources; a round fixes all that are
    above, so rounds are few.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(_numbered(sources).withColumn("weight", turn).withColumn("most", F.lit(float(cap)) * F.col("source_size")))
    level, done = None, 0
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > F.col("most")
        t = ranked.select(F.sum("source_size"), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        if not t[0] or not t[2]:
            level = 0.0 if not t[0] else level
            break
        if level is not None and t[3] == done:
            break
        done = t[3] if level is not None else -1
        level = (t[0] * share - t[1]) / t[2]
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("most")).alias("target"))


def pivot(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round probabilities in turn; the 0/1 outcomes, and the place of the one left fractional or -1.

    The words sizes @ p stay the same but for the residual.
    """
    p = p.copy()
    left = -1
    draws = rng.random(len(p))
    for k in range(len(p)):
        if p[k] <= 0.0 or p[k] >= 1.0:
            continue
        if left < 0:
            left = k
            continue
        i, j = left, k
        up = min((1 - p[i]) * sizes[i], p[j] * sizes[j])  # words that i can take from j
        down = min(p[i] * sizes[i], (1 - p[j]) * sizes[j])
        moved = up if draws[k] * (up + down) < down else -down
        pi, pj = p[i] + moved / sizes[i], p[j] - moved / sizes[j]
        # which of the two the move makes certain is known without comparing floats
        if moved > 0:
            certain_i = (1 - p[i]) * sizes[i] <= p[j] * sizes[j]
            pi, pj = (1.0, pj) if certain_i else (pi, 0.0)
        else:
            certain_i = p[i] * sizes[i] <= (1 - p[j]) * sizes[j]
            pi, pj = (0.0, pj) if certain_i else (pi, 1.0)
        p[i], p[j] = min(max(pi, 0.0), 1.0), min(max(pj, 0.0), 1.0)
        left = j if certain_i else i
        if p[left] in (0.0, 1.0):
            left = -1
    return p, left


def _round_groups(level: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "size", "t"], kind="stable", na_position="last")
        name = [0] if key[0] is None else [1, *str(key[0]).encode()]
        rng = np.random.default_rng([seed, level, int(key[1]), *name])
        p, left = pivot(rows["size"].to_numpy(dtype=float), rows["p"].to_numpy(dtype=float), rng)
        done = np.ones(len(rows), dtype=bool)
        if left >= 0:
            done[left] = False
        copies = rows["copies"].to_numpy() + np.where(done, p, 0).astype(np.int64)
        return rows.assign(copies=copies, p=np.where(done, 0.0, p), node=key[1] // FAN_IN)

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, share: float = 1.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of each row of ``docs``."""
    sized = stage(docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("t"), n_words(docs[text_col]).alias("size"), docs[source_col].cast("string").alias("source")))
    targets = stage(source_targets(sized, weights, cap, share).join(sized.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    meant = targets.withColumnRenamed("source", "s")
    # every document of a source has the same expected copies; targets is one row per source
    rows = sized.join(meant, sized.source.eqNullSafe(meant.s)).drop("s")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    groups = F.ceil(F.col("n") / GROUP).cast("long")
    start = rows.select(
        "id", "t", "size", "source", F.floor(expected).cast("long").alias("copies"), F.when(F.col("size") > 0, expected - F.floor(expected)).otherwise(0.0).alias("p"), F.pmod(F.xxhash64("id", "size", "t"), groups).alias("node")
    )
    # groups of one source that hold the most rows set the height of the tree
    most = targets.agg(F.max("n")).first()[0] or 0
    nodes, level = max(1, -(-most // GROUP)), 0
    now = stage(start.groupBy("source", "node").applyInPandas(_round_groups(level, seed), _ROW))
    decided = [now.where("p = 0")]
    while nodes > 1:
        nodes, level = -(-nodes // FAN_IN), level + 1
        now = stage(now.where("p > 0").groupBy("source", "node").applyInPandas(_round_groups(level, seed), _ROW))
        decided.append(now.where("p = 0"))
    last = (F.pmod(F.xxhash64(F.lit(seed), "id", "source"), F.lit(1 << 30)) / float(1 << 30)) < F.col("p")
    decided.append(now.where("p > 0").withColumn("copies", F.col("copies") + last.cast("long")))
    every = decided[0]
    for d in decided[1:]:
        every = every.unionByName(d)
    return every.join(meant.drop("n"), every.source.eqNullSafe(meant.s)).select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")
