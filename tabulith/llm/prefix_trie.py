"""Prefix trie of conversations, from composable fingerprints of their turns.

A conversation c is rebuilt from a head, the first h turns of its base, and its own turns after its
first h. No rebuilt text is made. Turn number i with hash t has the weight t * r^i modulo a prime, and the
fingerprint of a sequence is the sum of its weights: sequences compose by a shift (a power of r) and an
addition, so the fingerprint of a rebuilt prefix is that of the base's head, plus the difference of two
running sums of c's own turns, shifted. Four such sums with different r stand for a sequence.

1. *Running sums.* Turns are dealt over ranges of (conversation, turn), so a conversation with a third of
   all turns lies in many ranges. Sums run within a range; what the ranges before hold of the same
   conversation is added from a table with a row for each range and conversation that crosses a border
   (at most two a range, hence broadcast).
2. *Nodes.* Every turn of a rebuilt conversation names the node it leads to by depth and fingerprint; a
   node is an aggregate, combined before its shuffle. Equality is verified, not assumed: turns of one
   hash must have one role and text, and the turns that lead to a node must be equal and come from one
   parent (so, by induction, do whole prefixes). If not, all is hashed anew with another seed.
3. *Subtrees.* Nodes with the same smallest member form a chain, for a prefix's smallest member stays the
   smallest as long as it is one. Chains hang on chains; their totals are added up the tree by pointer
   doubling, in logarithmically many rounds. Inside a chain sums run from the end, as in step 1.
4. *Ends.* Ids of conversations that end in a node are joined in bounded runs of ids, which a task hashes
   one after the other.

Defined cases: turns are in the order of ``turn``, null first, then role, then a hash of role and text;
null role or text is empty; rows without a conversation id belong to none and are left out; repeated
rows are turns of their own; a base without rows lends an empty head; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC32_SQL, crc32_sql, stage, table

#: The largest prime below 2^31, so products fit a long, and the bases of the four sums.
PRIME = 2147483647
BASES = (1103515245, 214013269, 1664525077, 69069161)
#: Ids in a run: an id and its digits take under 30 bytes.
RUN = 8192


def _power(base: int, exponent: Column) -> Column:
    """base^exponent modulo PRIME, from tables of a byte of the exponent each (it is below 2^32)."""
    out = None
    for byte in range(4):
        step = pow(base, 256**byte, PRIME)
        powers = F.expr(f"array({', '.join(f'{pow(step, i, PRIME)}L' for i in range(256))})")
        factor = F.get(powers, F.shiftright(exponent, 8 * byte).bitwiseAND(255).cast("int"))
        out = factor if out is None else out * factor % PRIME
    return out


def _dealt(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` in ranges of key and order, written down so that ranges stay as they are; ``pid`` is the range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, F.col(key), *order).withColumn("pid", F.spark_partition_id()))


def running_sums(dealt: DataFrame, key: str, order: list[Column], terms: dict[str, Column], bases: tuple[int, ...] = ()) -> DataFrame:
    """``dealt`` (from ``_dealt``) with ``pos``, a row's number in its key, and the running sums of some terms over each key.

    With ``bases``, one for each term, terms are weights below PRIME that use ``pos`` as if the range were
    the whole key; what earlier ranges hold moves them by a power of the base. ``<name>_term`` is the row's own term.
    """
    part = Window.partitionBy("pid", key).orderBy(*order)

    def local(df: DataFrame) -> DataFrame:
        placed = df.withColumn("pos", F.row_number().over(part).cast("long"))
        own = placed.select("*", *[c.alias(f"{k}_term") for k, c in terms.items()])
        return own.select("*", *[F.sum(f"{k}_term").over(part.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in terms])

    def prime(c: Column) -> Column:
        return F.pmod(c, F.lit(PRIME)) if bases else c

    # a key of several ranges is the first or the last of each: two rows a range at most
    ends = dealt.groupBy("pid").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    border = dealt.join(F.broadcast(ends), "pid").where((F.col(key) == F.col("lo")) | (F.col(key) == F.col("hi"))).drop("lo", "hi")
    totals = local(border).groupBy("pid", key).agg(F.max("pos").alias("n"), *[F.sum(f"{k}_term").alias(k) for k in terms])
    before = Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    powers = [_power(b, F.col("off")) for b in bases] or [F.lit(1).cast("long")] * len(terms)
    moved = moved.select("*", *[p.alias(f"{k}_by") for k, p in zip(terms, powers, strict=True)])
    moved = moved.select("*", *[F.coalesce(F.sum(prime(prime(F.col(k)) * F.col(f"{k}_by"))).over(before), F.lit(0)).alias(f"{k}_off") for k in terms])
    offsets = moved.select(F.col("pid").alias("o_pid"), F.col(key).alias("o_key"), "off", *[F.col(f"{k}_{x}") for k in terms for x in ("by", "off")])

    met = local(dealt).join(F.broadcast(offsets), (F.col("pid") == F.col("o_pid")) & (F.col(key) == F.col("o_key")), "left").fillna(0, ["off", *[f"{k}_off" for k in terms]]).fillna(1, [f"{k}_by" for k in terms])
    place = {f"{k}{x}": prime(prime(F.col(f"{k}{x}")) * F.col(f"{k}_by") + (F.col(f"{k}_off") if not x else F.lit(0))) for k in terms for x in ("", "_term")}
    return met.select(*dealt.columns, (F.col("pos") + F.col("off")).alias("pos"), *[c.alias(k) for k, c in place.items()])


def hash_turns(conversations: DataFrame) -> tuple[DataFrame, int]:
    """(conv, turn, role, h1, h2, words) of every turn, and the seed for which equal hashes are equal turns."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv IS NOT NULL")
    for seed in range(8):
        hashed = turns.select("*", F.xxhash64(F.lit(seed), "role", "text").alias("h1"), F.xxhash64(F.lit(seed + 100), "text", "role").alias("h2"))
        per = hashed.groupBy("h1", "h2").agg(*[f(c).alias(f"{c}{f.__name__}") for c in ("role", "text") for f in (F.min, F.max)])
        if per.where("rolemin <> rolemax OR textmin <> textmax").limit(1).count() == 0:
            return hashed.select("conv", "turn", "role", "h1", "h2", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")), seed
    raise ValueError("turns collide under every seed")


def _sums(prefix: str) -> list[str]:
    return [f"{prefix}{j}" for j in range(len(BASES))]


def _terms(h1: Column, h2: Column, at: Column) -> list[Column]:
    """The weights of a turn at position ``at``, one for each base."""
    parts = [h1, F.shiftrightunsigned(h1, 32), h2, F.shiftrightunsigned(h2, 32)]
    return [F.pmod(x, F.lit(PRIME)) * _power(b, at) % PRIME for x, b in zip(parts, BASES, strict=True)]


def memberships(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, f0-f3, p0-p3, h1, h2, words, ends) of every turn of every rebuilt conversation, and (conv, size) of these."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]
    terms = dict(zip(_sums("s"), _terms(F.col("h1"), F.col("h2"), F.col("pos")), strict=True))
    own = stage(running_sums(_dealt(turns, "conv", order), "conv", order, terms, BASES).drop("pid", "turn", "role"))

    first = F.when(F.col("pos") < heads, F.struct("pos", "h1", "h2", "words", *_sums("s"), *[f"{k}_term" for k in _sums("s")]))
    short = own.groupBy("conv").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(first)).alias("top"))
    base = short.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("top").alias("base_top"))
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(heads))
    at = lambda top, i, j: F.coalesce(F.get(top, (i - 1).cast("int")).getField(f"s{j}"), F.lit(0))
    met = short.withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("h", h).join(base, "base", "left").withColumn("hb", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stage(met.select(
        "conv", "h", "hb", F.slice(F.coalesce("base_top", F.array().cast(short.schema["top"].dataType)), F.lit(1), F.col("hb").cast("int")).alias("head"), (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"),
        *[at(F.col("base_top"), F.col("hb"), j).alias(f"b{j}") for j in range(4)], *[at(F.col("top"), F.least("h", "n"), j).alias(f"o{j}") for j in range(4)],
    ))

    in_head = convs.select("conv", "size", F.explode("head").alias("t")).select("conv", F.col("t.pos").alias("depth"), *[F.col(f"t.s{j}").alias(f"f{j}") for j in range(4)], *[F.pmod(F.col(f"t.s{j}") - F.col(f"t.s{j}_term"), F.lit(PRIME)).alias(f"p{j}") for j in range(4)], "t.h1", "t.h2", "t.words", "size")
    # the own turns move by hb - h places, which is 0 unless the base is short
    later = own.join(convs.drop("head").withColumnRenamed("conv", "c"), (F.col("conv") == F.col("c")) & (F.col("pos") > F.col("h")))
    shift = [F.get(F.lit([pow(b, -k, PRIME) for k in range(heads)]).cast("array<long>"), (F.col("h") - F.col("hb")).cast("int")) for b in BASES]
    moved = [F.pmod(F.col(f"b{j}") + F.pmod(s - F.col(f"o{j}"), F.lit(PRIME)) * shift[j], F.lit(PRIME)).alias(f"{k}{j}") for k in "fp" for j in range(4) for s in [F.col(f"s{j}") - F.col(f"s{j}_term") if k == "p" else F.col(f"s{j}")]]
    after = later.select("conv", (F.col("pos") - F.col("h") + F.col("hb")).alias("depth"), *moved, "h1", "h2", "words", "size")
    rows = in_head.unionByName(after)
    return rows.select("conv", "depth", *_sums("f"), *_sums("p"), "h1", "h2", "words", (F.col("depth") == F.col("size")).alias("ends")), convs.select("conv", "size")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids sorted by node and run -> a digest for each node, however many runs it has."""
    at, sha, out = None, None, []
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        for key, ids in zip(keys, batch.column(6).to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield _digests(out)
            out = []
    if at is not None:
        yield _digests([(*at, sha.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string())], names=["depth", *_sums("f"), "ends_sha256"])


def ends_of(members: DataFrame) -> DataFrame:
    """(depth, f0-f3, ends_sha256) from (depth, f0-f3, conv) of conversations that end there."""
    key = ["depth", *_sums("f")]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = members.groupBy(*key, F.expr(f"conv - pmod(conv, {RUN})").alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return runs.select(*key, "run", "ids").repartition(n, *key).sortWithinPartitions(*key, "run").mapInArrow(_joined, ", ".join(f"{k} long" for k in key) + ", ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """(chain, up, at, leaves, saved) with sums over all chains below each, its own included.

    ``chains`` has one row a chain: its parent ``up`` (null for the root's), where it hangs (``at``), its own sums.
    Round i adds what lies at a distance of 2^i chains and more below, and doubles the distance.
    """
    now = stage(chains.withColumn("far", F.col("up")))
    while True:
        given = now.where("far IS NOT NULL").groupBy(F.col("far").alias("target")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        ends = now.select(F.col("chain").alias("mid"), F.col("far").alias("next"))
        now = stage(
            now.join(given, F.col("chain") == F.col("target"), "left")
            .join(ends, F.col("far") == F.col("mid"), "left")
            .select("chain", "up", "at", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("next").alias("far"))
        )
        if now.where("far IS NOT NULL").limit(1).count() == 0:
            return now.drop("far")


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's base is ``conv_id - conv_id % group``, and ``crc32(conv_id) % heads`` turns of it are the head.
    """
    turns, _ = hash_turns(conversations)
    rows, convs = memberships(turns, group, heads)
    zero = [F.lit(0).cast("long").alias(k) for k in _sums("f")]
    up = [F.lit(None).cast("long").alias(k) for k in [*_sums("p"), "h1", "h2"]]
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), *zero, *up, F.lit(0).cast("long").alias("words"), (F.col("size") == 0).alias("ends"))
    rows = stage(rows.unionByName(root))

    key, same = ["depth", *_sums("f")], [*_sums("p"), "h1", "h2"]
    checked = [F.min(c).eqNullSafe(F.max(c)) for c in same]
    alike = checked[0]
    for c in checked[1:]:
        alike &= c
    nodes = stage(rows.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *[F.min(c).alias(c) for c in _sums("p")], alike.alias("alike")))
    if nodes.where("NOT alike").limit(1).count():
        raise ValueError("prefixes collide in four sums")  # 1 in 2^124 a pair

    parent = nodes.select((F.col("depth") + 1).alias("d"), *[F.col(f"f{j}").alias(f"q{j}") for j in range(4)], F.col("conv").alias("parent_conv"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("d"), *[F.col(f"p{j}").alias(f"q{j}") for j in range(4)]).agg(F.count("*").alias("n_children"))
    on_parent = [F.col("depth") == F.col("d"), *[F.col(f"p{j}") == F.col(f"q{j}") for j in range(4)]]
    on_self = [F.col("depth") == F.col("d"), *[F.col(f"f{j}") == F.col(f"q{j}") for j in range(4)]]
    full = nodes.join(parent, on_parent, "left").drop("d", *_sums("q")).join(children, on_self, "left").drop("d", *_sums("q"))
    full = full.select(*key, "conv", "parent_conv", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("save"))
    full = stage(full.withColumn("down", -F.col("depth")))

    top = F.min_by(F.struct("parent_conv", "depth"), "depth")
    chains = full.groupBy(F.col("conv").alias("chain")).agg(top.alias("top"), F.sum("leaf").alias("leaves"), F.sum("save").alias("saved"))
    hung = chain_totals(chains.select("chain", F.col("top.parent_conv").alias("up"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved"))
    below = hung.where("up IS NOT NULL").groupBy(F.col("up").alias("c"), F.col("at").alias("d")).agg(F.sum("leaves").alias("add_leaves"), F.sum("saved").alias("add_saved"))
    own = full.join(below, (F.col("conv") == F.col("c")) & (F.col("depth") == F.col("d")), "left").drop("c", "d")
    dealt = _dealt(own.fillna(0, ["add_leaves", "add_saved"]), "conv", [F.col("down")])
    summed = running_sums(dealt, "conv", [F.col("down")], {"n_leaves": F.col("leaf") + F.col("add_leaves"), "saved_tokens": F.col("save") + F.col("add_saved")})

    ends = ends_of(rows.where("ends").select(*key, "conv")).withColumnRenamed("depth", "d")
    ends = ends.select("d", *[F.col(f"f{j}").alias(f"q{j}") for j in range(4)], "ends_sha256")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(ends, on_self, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP13_SQL = rf"""
WITH {CRC32_SQL}, own AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), lengths AS (
  SELECT conv, max(pos) AS n, conv - conv % 20 AS base FROM own GROUP BY conv
), convs AS (
  SELECT conv, n, base, {crc32_sql('conv::VARCHAR')} % 4 AS h FROM lengths, crc32_table
), sized AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS hb, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS size
  FROM convs c LEFT JOIN convs b ON c.base = b.conv
), rebuilt AS (
  SELECT s.conv, s.size, o.pos AS depth, o.role, o.text FROM sized s JOIN own o ON o.conv = s.base AND o.pos <= s.hb
  UNION ALL
  SELECT s.conv, s.size, o.pos - s.h + s.hb, o.role, o.text FROM sized s JOIN own o ON o.conv = s.conv AND o.pos > s.h
), paths AS (
  SELECT conv, size, depth, list({{'r': role, 't': text}}) OVER (PARTITION BY conv ORDER BY depth) AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt
  UNION ALL SELECT conv, size, 0, [], 0 FROM sized
), keyed AS (
  SELECT conv, size, depth, words, sha256(path::JSON::VARCHAR) AS k FROM paths
), up AS (
  SELECT *, lag(k) OVER (PARTITION BY conv ORDER BY depth) AS pk FROM keyed
), nodes AS (
  SELECT k, depth, any_value(pk) AS pk, min(conv) AS conv, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS save,
         sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM up GROUP BY k, depth
), kids AS (
  SELECT pk, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY pk
), full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN kids c ON n.k = c.pk
), sums AS (
  SELECT a.k, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum(w.save) AS saved_tokens
  FROM full_nodes w JOIN keyed a ON a.conv = w.conv AND a.depth <= w.depth GROUP BY a.k
)
SELECT n.conv AS conv_id, n.depth, p.conv AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON n.k = s.k LEFT JOIN nodes p ON n.pk = p.k
"""
