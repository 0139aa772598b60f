"""Cheapest repair of broken conversations: generalised LR parsing over the grammar of roles.

The roles of a sound conversation are ``(s?(ua)+)?`` (system, user, assistant). Rows may be kept, reroled or
deleted, and rows without text inserted; blank rows and repetitions have to go. The parser reads the rows of
a conversation in order with all edits at once. Its stacks are one graph: stacks with equal tops at the same row
are merged, and of what led to them only the least (cost, audit) stays on, where the audit is the text of edits.
That is exact, for two audits of equal cost at the same row are never one the beginning of the other, so what is
appended can't change their order.

On Spark: a conversation is cut where ranges of (conversation, turn) end, so one with a third of all rows
lies in many tasks. For a conversation that crosses borders each task parses its piece from every stack top and
sends on, per top it began and ended with, one cost and audit; these compose in order, which fixes the tops at
the borders. Then each task parses its pieces again and emits edited rows, holding one conversation's rows of its
range at most. At most two conversations a range cross a border, so the table of tops is broadcast.

Defined cases: rows are in the order of turn (null first), role and text; null role or text is one space, so
such a row is blank or has no legal role; rows without a conversation id are one conversation; repeated rows
follow each other, and all but the first are repetitions (they stay in one range); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC32_SQL, crc32_sql, stage, table, text_batches

# The grammar's LR table:  Conv = "" | Body;  Body = Head Pair | Body Pair;  Pair = u a;  Head = "" | s.
SHIFT = {("0", "s"): "S", ("H", "u"): "U", ("B", "u"): "U", ("U", "a"): "A"}
#: State -> (symbols that may follow, what the reduced symbols become, how many they are).
REDUCE = {"0": ("u", "Head", 0), "S": ("u", "Head", 1), "A": ("u$", "Pair", 2), "P": ("u$", "Body", 2), "Q": ("u$", "Body", 2)}
GOTO = {("0", "Head"): "H", ("0", "Body"): "B", ("H", "Pair"): "P", ("B", "Pair"): "Q"}
ACCEPT = "0B"

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A stack that costs more than this above the cheapest can't win: any stack can take any other's part for so
#: much (one insert to end a pair, one deleted system row, two inserts at the end).
SLACK = DELETE + 2 * INSERT

#: A node of the graph: its state, and the nodes that may lie below it.
Node = tuple[str, tuple]
#: Edits so far, newest last: what came before and the last row's.
Audit = tuple


@cache
def merge(a: Node, b: Node) -> Node:
    """Two stacks with equal tops as one node, and so on down."""
    below = {n[0]: n for n in a[1]}
    for n in b[1]:
        below[n[0]] = merge(below[n[0]], n) if n[0] in below else n
    return a[0], tuple(below[k] for k in sorted(below))


def _down(node: Node, steps: int) -> list[Node]:
    return [node] if steps == 0 else [x for n in node[1] for x in _down(n, steps - 1)]


@cache
def reduced(node: Node, symbol: str) -> tuple[Node, ...]:
    """The node and all that reductions before ``symbol`` make of it."""
    look, what, steps = REDUCE.get(node[0], ("", "", 0))
    more = [x for n in _down(node, steps) for x in reduced((GOTO[n[0], what], (n,)), symbol)] if symbol in look else []
    return node, *more


@cache
def shifted(node: Node, symbol: str) -> Node | None:
    """The stacks after ``symbol``, one node, for one state follows a symbol here; None if it is an error."""
    out = None
    for n in reduced(node, symbol):
        if (n[0], symbol) in SHIFT:
            top = SHIFT[n[0], symbol], (n,)
            out = top if out is None else merge(out, top)
    return out


@cache
def inserted(node: Node) -> tuple[tuple[int, Node], ...]:
    """(number of inserts, stacks) of all tops that inserted rows lead to, fewest inserts each."""
    out, edge, k = {node[0]: (0, node)}, [node], 0
    while edge:
        k, last, edge = k + 1, edge, []
        for n in last:
            for symbol in "ua":
                if (top := shifted(n, symbol)) and top[0] not in out:
                    out[top[0]] = k, top
                    edge.append(top)
    return tuple(out.values())


def accepted(node: Node) -> bool:
    return any(n[0] in ACCEPT for n in reduced(node, "$"))


def _stack(roles: str) -> Node:
    node = "0", ()
    for r in roles:
        node = shifted(node, r)
    return node


#: All stacks with a given top.
STACKS: dict[str, Node] = {"0": _stack(""), "S": _stack("s"), "U": merge(merge(_stack("u"), _stack("su")), _stack("uau")), "A": merge(merge(_stack("ua"), _stack("sua")), _stack("uaua"))}


def row_code(initial: str, gone: bool, truncated: bool) -> str:
    """A row as the parser sees it: ``-`` has to go, else its role's initial (x: none of these), upper case if truncated."""
    code = "-" if gone else initial if initial in ("s", "u", "a") else "x"
    return code.upper() if truncated else code


def step(front: dict[str, tuple[int, int, Audit | None, Node]], code: str) -> dict[str, tuple[int, int, Audit | None, Node]]:
    """One row on: top -> (cost, rank of its audit among the tops', audit, stacks)."""
    role, extra = code.lower(), TRUNCATED if code.isupper() else 0
    best: dict[str, tuple[tuple[int, int, str], Audit | None, Node]] = {}
    for cost, rank, audit, node in front.values():
        for k, mid in inserted(node):
            moves = [(DELETE, "D", mid)]
            if role != "-":
                moves += [(extra + (0 if r == role else REROLE), "K" if r == role else "R", top) for r in ("sua" if role == "s" else "ua") if (top := shifted(mid, r))]
            for c, edit, top in moves:
                key = cost + INSERT * k + c, rank, "I" * k + edit
                if (old := best.get(top[0])) is None:
                    best[top[0]] = key, audit, top
                else:
                    best[top[0]] = (key, audit, merge(old[2], top)) if key < old[0] else (*old[:2], merge(old[2], top))
    most = min(key[0] for key, _, _ in best.values()) + SLACK
    best = {s: x for s, x in best.items() if x[0][0] <= most}
    ranks = {k: i for i, k in enumerate(sorted({key[1:] for key, _, _ in best.values()}))}
    return {s: (key[0], ranks[key[1:]], (audit, key[2]), top) for s, (key, audit, top) in best.items()}


def _text(audit: Audit | None) -> str:
    parts = []
    while audit is not None:
        audit, last = audit
        parts.append(last)
    return "".join(reversed(parts))


def parse(codes: str, top: str) -> dict[str, tuple[int, str]]:
    """From stacks with ``top``: top after the rows -> the least (cost, audit)."""
    front = {top: (0, 0, None, STACKS[top])}
    for code in codes:
        front = step(front, code)
    return {s: (cost, _text(audit)) for s, (cost, _, audit, _) in front.items()}


_parse_short = lru_cache(1 << 14)(parse)


def parsed(codes: str, top: str) -> dict[str, tuple[int, str]]:
    return _parse_short(codes, top) if len(codes) <= 32 else parse(codes, top)


def closed(ways: dict[str, tuple[int, str]]) -> tuple[int, str, str]:
    """(cost, audit, last top before the inserts that end it) of the cheapest whole conversation."""
    return min((cost + INSERT * k, audit + "I" * k, top) for top, (cost, audit) in ways.items() for k, end in inserted(STACKS[top]) if accepted(end))


# ---- rows ----


def _faults(rows: DataFrame) -> DataFrame:
    """Flags that need no order but the turns': ``later`` says that role and text are in an earlier turn too."""
    marked = rows.select(
        "conv", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"),
        F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1).alias("last"),
    )
    firsts = marked.groupBy("conv", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("t"), F.col("turn").alias("first"))).alias("m")).where("n > 1")
    firsts = stage(firsts.select(F.col("conv").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("m.first").alias("first"), F.lit(True).alias("again")))
    met = marked.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    later = F.coalesce(F.col("again") & ~F.col("turn").eqNullSafe(F.col("first")), F.lit(False))
    return met.select("conv", "turn", "role", "text", "initial", (F.col("last") == "").alias("blank"), later.alias("later"), (~F.col("last").isin("", ".", "!", "?")).alias("cut"))


FIELDS = ("conv", "turn", "role", "text", "initial", "blank", "later", "cut", "seq", "pid")


def _pieces(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[list[tuple]]:
    """Rows of a task, in order -> those of one conversation at a time."""
    at: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in FIELDS + more), strict=True):
            if at and at[0][0] != row[0]:
                yield at
                at = []
            at.append(row)
    if at:
        yield at


def _seen(piece: list[tuple]) -> list[tuple[str | None, str]]:
    """(fault, code) of each row; equal rows of one turn are neighbours."""
    out, before = [], None
    for _, turn, role, text, initial, blank, later, cut, *_ in piece:
        fault = "blank" if blank else "duplicate" if later or before == (turn, role, text) else "truncated" if cut else None
        before = turn, role, text
        out.append((fault, row_code(initial, fault in ("blank", "duplicate"), fault == "truncated")))
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        codes = "".join(code for _, code in _seen(piece))
        rows = [(piece[0][0], piece[0][9], piece[-1][4], top, end, cost, audit) for top in STACKS for end, (cost, audit) in parsed(codes, top).items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("conv", "pid", "initial", "top", "end", "cost", "audit"), r, strict=True)) for r in rows], schema=pa.schema([("conv", pa.int64()), ("pid", pa.int32()), ("initial", pa.string()), ("top", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def _composed(pieces: pd.DataFrame) -> pd.DataFrame:
    """The summaries of one conversation -> the tops that each piece begins and ends with."""
    ways: dict[str, tuple[int, str, tuple]] = {"0": (0, "", ())}
    order = []
    for pid, rows in pieces.sort_values("pid", kind="stable").groupby("pid", sort=True):
        order.append((pid, rows["initial"].iloc[0]))
        now: dict[str, tuple[int, str, tuple]] = {}
        for top, end, cost, audit in zip(rows["top"], rows["end"], rows["cost"], rows["audit"], strict=True):
            if top in ways:
                way = ways[top][0] + int(cost), ways[top][1] + audit, (ways[top][2], end)
                now[end] = min(now.get(end, way), way, key=lambda w: w[:2])
        ways = now
    last = closed({k: w[:2] for k, w in ways.items()})[2]
    ends, trail = [], ways[last][2]
    while trail:
        trail, end = trail
        ends.append(end)
    ends.reverse()
    return pd.DataFrame({"b_conv": pieces["conv"].iloc[0], "b_pid": [p for p, _ in order], "top": ["0", *ends[:-1]], "end": ends, "before": [None, *[i for _, i in order[:-1]]], "final": [False] * (len(ends) - 1) + [True]}).astype({"b_conv": "Int64"})


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their edits, and the inserted ones, a conversation's piece at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("sub", pa.int32()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()), ("cost", pa.int64()), ("border", pa.bool_())])
    out: list[tuple] = []
    size = 0
    for piece in _pieces(batches, ("top", "end", "before", "final")):
        conv, (top, end, before, final) = piece[0][0], piece[0][-4:]
        seen = _seen(piece)
        ways = parsed("".join(code for _, code in seen), top or "0")
        edits = closed(ways)[1] if top is None else closed({end: ways[end]})[1] if final else ways[end][1]
        due, edits, sub = "a" if top == "U" else "u", iter(edits), 0
        for row, (fault, _) in zip(piece, seen, strict=True):
            sub = 0
            while (edit := next(edits)) == "I":
                out.append((conv, row[8], sub, None, "I", "user" if due == "u" else "assistant", "", None, None, INSERT, top is not None))
                due, sub = "ua"[due == "u"], sub + 1
            role = row[2]
            cost = (DELETE if edit == "D" else REROLE * (edit == "R") + TRUNCATED * (fault == "truncated"))
            if edit == "R":
                role = "user" if due == "u" else "assistant"
            if edit == "R" or (edit == "K" and row[4] != "s"):
                due = "ua"[due == "u"]
            illegal = before is not None and before + row[4] not in ("su", "ua", "au")
            out.append((conv, row[8], sub, row[1], edit, role, row[3], fault, illegal, cost, top is not None))
            before, size = row[4], size + len(row[3])
        for k, _ in enumerate(edits):
            out.append((conv, piece[-1][8], sub + 1 + k, None, "I", "user" if due == "u" else "assistant", "", None, None, INSERT, top is not None))
            due = "ua"[due == "u"]
        if len(out) >= 1000 or size >= 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


EDITED = "conv_id long, seq long, sub int, turn long, edit string, role string, text string, fault string, illegal boolean, cost long, border boolean"


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each row of a conversation and each inserted one.

    ``edit`` is K(eep), R(erole), D(elete) or I(nsert); those but D, by ``seq`` and ``sub``, are the repaired
    conversation. ``fault`` is blank, duplicate, truncated or null, ``illegal`` says that the role can't follow the
    row's before it, ``cost`` is the edit's. ``border`` marks conversations that lie in several ranges.
    """
    spark = conversations.sparkSession
    text_batches(spark)
    given = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _faults(given).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumn("seq", F.monotonically_increasing_id()).withColumn("pid", F.spark_partition_id()))

    crossing = dealt.groupBy("conv").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).where("lo < hi").select(F.col("conv").alias("x_conv"))
    split = dealt.join(F.broadcast(crossing), F.col("conv").eqNullSafe(F.col("x_conv")), "left_semi")
    summed = split.select(*FIELDS).mapInArrow(_summaries, "conv long, pid int, initial string, top string, end string, cost long, audit string")
    borders = summed.groupBy("conv").applyInPandas(_composed, "b_conv long, b_pid int, top string, end string, before string, final boolean")
    met = dealt.join(F.broadcast(stage(borders)), F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("pid") == F.col("b_pid")), "left")
    return met.select(*FIELDS, "top", "end", "before", "final").mapInArrow(_edited, EDITED)


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn`` modulo 20 rows are dropped, emptied, cut, repeated or reroled."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key) % 20
    hit = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return hit.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


DIGEST = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edited rows in order -> a row for each conversation; texts are hashed as they pass."""
    out: list[tuple] = []
    at: dict | None = None

    def end() -> None:
        gaps = at["hi"] - at["lo"] + 1 - at["turns"] if at["turns"] else 0
        out.append((at["conv"], gaps, at["blank"], at["duplicate"], at["truncated"], at["illegal"], at["cost"], "".join(at["audit"]), at["sha"].hexdigest()))

    def made() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", *DIGEST, "audit", "repaired_sha256"])

    for batch in batches:
        for conv, turn, edit, role, text, fault, illegal, cost in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "edit", "role", "text", "fault", "illegal", "cost")), strict=True):
            if at is None or at["conv"] != conv:
                if at is not None:
                    end()
                at = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost", "kept"), 0) | {"conv": conv, "lo": None, "hi": None, "audit": [], "sha": hashlib.sha256()}
            if turn is not None and turn != at["hi"]:
                at["lo"], at["hi"], at["turns"] = turn if at["lo"] is None else at["lo"], turn, at["turns"] + 1
            if fault:
                at[fault] += 1
            at["illegal"] += bool(illegal)
            at["cost"] += cost
            at["audit"].append(edit)
            if edit != "D":
                at["sha"].update(f"{'\n' if at['kept'] else ''}{role}:{text}".encode())
                at["kept"] += 1
        if len(out) >= 1000:
            yield made()
            out.clear()
    if at is not None:
        end()
    if out:
        yield made()


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, the six figures, audit, repaired_sha256) of ``repair_conversations``' rows, in place where they are.

    A hash over a text runs from its beginning to its end: only conversations that cross borders are dealt anew
    for it, each to one task, which holds a row at a time.
    """
    schema = "conv_id long, " + ", ".join(f"{c} long" for c in DIGEST) + ", audit string, repaired_sha256 string"
    edited = stage(edited)
    n = int(edited.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = edited.where("border").repartition(n, "conv_id").sortWithinPartitions("conv_id", "seq", "sub")
    return edited.where("NOT border").mapInArrow(_digested, schema).unionByName(whole.mapInArrow(_digested, schema))


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = digests(repair_conversations(damage(given))).withColumnRenamed("conv_id", "c")
    ids = given.select("conv_id").distinct()
    met = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return met.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in DIGEST], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _more(way: str, cost: str, edit: str) -> str:
    """SQL: a way (its cost in ten digits, then its audit, so that text order is that of ways) and one more edit."""
    return f"lpad((left({way}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({way}, 11) || '{edit}'"


def _role(way: str, role: str) -> str:
    return f"CASE WHEN code <> '-' THEN {_more(way, f'extra + (code <> {role!r})::INT', '')} || CASE WHEN code = '{role}' THEN 'K' ELSE 'R' END END"


#: A search over what the last role was (n none, s, u, a), a row a step.
OP12_SQL = rf"""
WITH RECURSIVE {CRC32_SQL}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, {crc32_sql("key")} % 20 AS kind FROM keyed, crc32_table
), hit AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char, left(role, 1) AS initial
  FROM hit
), faults AS (
  SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS step
  FROM placed
), codes AS (
  SELECT conv_id, pos, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS code,
         CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra
  FROM faults
), ways AS (
  SELECT conv_id, 0::BIGINT AS pos, '0000000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT conv_id FROM codes)
  UNION ALL
  SELECT conv_id, pos, {_more("n", "2", "D")} AS n,
         least({_more("s", "2", "D")}, CASE WHEN code = 's' THEN {_more("n", "extra", "K")} END) AS s,
         least({_more("u", "2", "D")}, {_role("n", "u")}, {_role("s", "u")}, {_role("a", "u")}) AS u,
         least({_more("a", "2", "D")}, {_role("u", "a")}) AS a
  FROM (
    SELECT w.conv_id, c.pos, c.code, c.extra, n, s, least(u, {_more("n", "5", "I")}, {_more("s", "5", "I")}, {_more("a", "5", "I")}) AS u,
           least(a, {_more("u", "5", "I")}, {_more("n", "10", "II")}, {_more("s", "10", "II")}) AS a
    FROM ways w JOIN codes c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND c.pos = w.pos + 1
  )
), best AS (
  SELECT conv_id, least(n, a, {_more("u", "5", "I")}, {_more("s", "10", "II")}) AS way FROM ways
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), edits AS (
  SELECT conv_id, unnest(range(1, length(way) - 9)) AS i, way FROM best
), consumed AS (
  SELECT conv_id, i, way[10 + i] AS edit, count(*) FILTER (WHERE way[10 + i] <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM edits
), kept AS (
  SELECT e.conv_id, e.i, e.edit, f.role, f.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.i) AS nth
  FROM consumed e LEFT JOIN faults f ON e.edit <> 'I' AND e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.pos = f.pos WHERE e.edit <> 'D'
), shaped AS (
  SELECT *, nth - bool_or(nth = 1 AND edit = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id)::INT AS place FROM kept
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS body
  FROM shaped GROUP BY conv_id
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE step NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT o.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
       coalesce(left(b.way, 10)::BIGINT, 0) AS cost, coalesce(substr(b.way, 11), '') AS audit, sha256(coalesce(r.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN figures f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""
