"""Exact Jaccard join of documents on word shingles, and the groups its links make.

Three steps, each linear in what it ships:

1. *Routing.* A pair that reaches the similarity shares at least T = pct% of either set, so it shares
   k of the n - T + k rarest shingles of either: those are a set's short lists, the rest its long
   lists; k grows with the set (``least_shared``), for large sets share some by chance. Rare means few
   occurrences in a sketch of ``COUNTERS`` counters over all shingles of all documents (bounded, so it
   may be broadcast); any order of shingles that all documents share keeps the search exact, the counts
   only keep frequent passages out of the short lists. Equal sets are one node, so exact copies cost
   nothing here. Sets on the same list make pairs, and a pair goes on if it is on k lists, and if sizes
   and histograms of shingles allow the similarity, bounds that no linked pair breaks. The sets of a list
   of over ``PAIRS`` are compared in one place by sizes and histograms alone. A list of over ``LIST`` sets
   makes edges to its smallest instead, so a hot group costs one edge per set; a task ends such lists
   itself and sends one entry on. The components of pairs and edges are groups outside of which no link
   can be. Histograms have more bins for larger sets: with few, all large sets look alike, and would be one group.
2. *T-occurrence search.* Per group, one document stands for all of an equal set. The shingles' inverted
   lists are split as DivideSkip does: the longest lists are set aside, the short ones are merged, and
   sets found often enough in them are probed in the long lists. A set is kept when its overlap reaches
   what the similarity asks of the two sizes. Large groups are dealt into blocks of bounded size and
   every two blocks meet in one task.
3. *Groups.* Each task sends stars of linked documents, not the links; components join them.

Defined cases: null or blank text has no shingles and links with nothing; a text of fewer words than
a shingle is one shingle; a null id is never linked; each row is a document, also where rows share an
id: a row's component is that of its own text, and texts whose smallest id is the same are in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table, text_batches
from .components import connected_components, local_roots
from .tokens import NOT_BLANK, distinct_shingles, mix, slices

#: Counters of the sketch, a power of two from 2**16 on: 2**22 (4 MB) tells shingles of a few hundred
#: documents from rare ones in some 30 GB of text, 2**26 (64 MB) those of some thousands in 100 TB.
COUNTERS = 1 << 22
#: Entries of short lists that a task holds before it sends them on.
FLUSH = 250_000
#: Lists of up to so many entries are taken apart into pairs, longer ones are compared as a whole.
PAIRS = 8
#: Lists of more entries make edges to their first.
LIST = 256
#: A set has to share one of its rarest shingles more for so many that it has.
SHARE = 128
#: Bins of a document's histogram of shingles, at least and at most, and shingles that one should hold.
BINS, MOST, FILL = 128, 1 << 16, 8
#: Slots by which texts of no group are told, a power of two: 2**20 hold a few hundred thousand sets, and what passes by chance is met by id.
SLOTS = 1 << 20
#: Shingles that one block of a large group holds.
BLOCK = 1_000_000
#: Reducers' keys for each shuffle partition.
SPREAD = 4
_U = np.uint64


def least_shared(n: int, pct: int) -> int:
    """How many of the ``rarest`` shingles of a set of n, or of a larger one, two sets share that are similar enough."""
    return min(1 + n // SHARE, -(-pct * n // 100))


def rarest(shingles: np.ndarray, pct: int, levels: np.ndarray) -> np.ndarray:
    """Keys of the shingles of a set that must hold ``least_shared`` in common with any set that is similar enough.

    Of two such sets, all that they share among the one's keys that end first is among the other's keys too, and
    what stands behind its keys is less than the overlap by ``least_shared``.
    """
    n = len(shingles)
    k = n - -(-pct * n // 100) + least_shared(n, pct)
    rare = levels[(mix(shingles) & _U(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    keys = (rare << _U(56)) | (shingles >> _U(8))
    return np.partition(keys, k - 1)[:k] if k < n else keys


def _count(size: int) -> Callable:
    """The occurrences that each counter gets from a task, in blocks of 65536 counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            for s in slices(batch.column(0), NOT_BLANK):
                words = s.hashes(lowered=True)
                sets = [distinct_shingles(words[s.first[d] : s.first[d + 1]], size) for d in range(len(s))]
                at = (mix(np.concatenate(sets)) & _U(COUNTERS - 1)).astype(np.int64)
                if len(at) * 8 > COUNTERS:
                    total += np.bincount(at, minlength=COUNTERS).astype(np.uint32)
                else:
                    np.add.at(total, at, 1)
        for b in range(COUNTERS >> 16):
            own = np.minimum(total[b << 16 : (b + 1) << 16], 65535).astype(np.uint16)
            some = np.flatnonzero(own)
            if len(some):
                dense = len(some) > 32768
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([b"" if dense else some.astype(np.uint16).tobytes()]), pa.array([own.tobytes() if dense else own[some].tobytes()])], names=["block", "at", "n"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters' sums, on a scale of 8 steps to each doubling."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, at, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = total.setdefault(b, np.zeros(65536, dtype=np.int64))
            n = np.frombuffer(n, dtype=np.uint16)
            if at:
                own[np.frombuffer(at, dtype=np.uint16)] += n
            else:
                own += n
    for b, own in total.items():
        level = np.minimum(8 * np.log2(1.0 + own), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()])], names=["block", "level"])


def shingle_levels(slim: DataFrame, size: int) -> np.ndarray:
    """How frequent shingles are, by counter: one byte for each of COUNTERS, whatever the input's size."""
    # a few tasks a core, whatever the input's size, for each sends a sketch of its own
    counted = slim.select("text").coalesce(4 * slim.sparkSession.sparkContext.defaultParallelism).mapInArrow(_count(size), "block int, at binary, n binary")
    summed = counted.repartition("block").mapInArrow(_add_up, "block int, level binary")
    levels = np.zeros(COUNTERS, dtype=np.uint8)
    for r in summed.collect():  # COUNTERS bytes
        levels[r["block"] << 16 : (r["block"] + 1) << 16] = np.frombuffer(r["level"], dtype=np.uint8)
    return levels


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """Distinct rows (a, b) with a > b, without loops."""
    pairs = np.stack([pairs.max(axis=1), pairs.min(axis=1)], axis=1)[pairs[:, 0] != pairs[:, 1]] if len(pairs) else pairs
    if len(pairs):
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])]
    return pairs


def _lists(hashes: np.ndarray, nodes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, length and whether it is over LIST of each list; then hashes, nodes and levels by list and node, each node once."""
    order = np.lexsort((levels, nodes, hashes))
    h, v, level = hashes[order], nodes[order], levels[order]
    last = np.ones(len(h), dtype=bool)
    last[:-1] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])
    h, v, level = h[last], v[last], level[last]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
    length = np.diff(np.append(start, len(h)))
    long = (length > LIST) | (np.maximum.reduceat(level, start) == _LONG) if len(h) else np.empty(0, dtype=bool)
    return start, length, long, h, v, level


def _stars(nodes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Edges from each entry of a list to its first."""
    at = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(start) else np.empty(0, dtype=np.int64)
    return _distinct(np.stack([nodes[at], nodes[np.repeat(start, length)]], axis=1))


def _size_level(n: int) -> int:
    """A set's size on a scale of steps of half a percent."""
    return min(int(200 * np.log(n)), _LONG - 1)


def _pairs(nodes: np.ndarray, levels: np.ndarray, start: np.ndarray, length: np.ndarray, pct: int) -> np.ndarray:
    """Pairs (a, b, lists, least) of the lists whose sizes allow the similarity: on how many they are, and on how many they have to be. Lists are short."""
    apart = int(200 * np.log(100 / pct)) + 1  # levels are rounded down
    out = [np.empty((0, 3), dtype=np.int64)]
    for n in np.unique(length[length > 1]):
        at = start[length == n][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        a, b = at[:, i].ravel(), at[:, j].ravel()
        near = np.abs(levels[a].astype(np.int64) - levels[b].astype(np.int64)) <= apart
        a, b = a[near], b[near]
        out.append(np.stack([np.maximum(nodes[a], nodes[b]), np.minimum(nodes[a], nodes[b]), np.minimum(levels[a], levels[b])], axis=1))
    pairs = np.concatenate(out)
    level, place = np.unique(pairs[:, 2], return_inverse=True)
    # levels are rounded down, and a smaller set has to share less
    least = np.array([least_shared(max(1, int(np.exp(x / 200))), pct) for x in level], dtype=np.int64)
    return _added(np.stack([pairs[:, 0], pairs[:, 1], np.ones(len(pairs), dtype=np.int64), least[place]], axis=1)) if len(pairs) else np.empty((0, 4), dtype=np.int64)


def _added(pairs: np.ndarray) -> np.ndarray:
    """Rows (a, b, lists, least) of distinct pairs, their lists summed up."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    start = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]))
    return np.concatenate([pairs[start, :2], np.add.reduceat(pairs[:, 2], start)[:, None], pairs[start, 3:]], axis=1)


def histogram(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles fall to each of its bins, 255 at most; their number is a power of two.

    The bins of two sets differ, summed up, by no more than the sets do.
    """
    bins = min(max(BINS, 1 << (max(len(shingles) - 1, 0) // FILL).bit_length()), MOST)
    return np.minimum(np.bincount(((shingles >> _U(8)) % _U(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _folded(bins: list[bytes], size: int) -> np.ndarray:
    """Histograms of one length as rows of ``size`` bins, as the sets would have with so few."""
    x = np.frombuffer(b"".join(bins), dtype=np.uint8).reshape(len(bins), -1, size)
    return np.minimum(x.sum(axis=1, dtype=np.int32), 255)


def differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """By how much the bins of each two sets differ, summed up; where one has more, they are folded."""
    p, q = (np.array([len(x) for x in c], dtype=np.int64) for c in (a, b))
    out = np.zeros(len(a), dtype=np.int64)
    for k, m in {*zip(p.tolist(), q.tolist(), strict=True)}:
        at = np.flatnonzero((p == k) & (q == m))
        for some in np.array_split(at, -(-len(at) * max(k, m) // 4_000_000)):
            x, y = (_folded([c[i] for i in some], min(k, m)) for c in (a, b))
            out[some] = np.abs(x - y).sum(axis=1)
    return out


#: Of an entry's size level: the list that the entry is on is a long one, whatever else is there.
_LONG = 65535
#: kind 0: a document (id, t, n, h1, h2, bins); 1: an edge (h1, other); 3: a pair (h1, other) on n lists, of t that it needs;
#: 4: a set h1 on the list ``other`` that is to be compared; 2: entries of short lists for reducer r.
_SQL_SCHEMA = "kind int, id long, t long, n long, h1 long, h2 long, other long, bins binary, r int, hashes binary, nodes binary, levels binary"
_SCHEMA = pa.schema([(k, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for k, t in (c.split() for c in _SQL_SCHEMA.split(", "))])


def _batch(rows: int, **columns) -> pa.RecordBatch:
    arrays = [columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _dealt(keys: np.ndarray, reducers: int) -> np.ndarray:
    """Reducers for rows that only pass through, spread over all of them."""
    return (mix(keys.astype(np.uint64)) % _U(reducers)).astype(np.int32)


def _set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    h1 = np.sum(mix(shingles ^ _U(0x2545F4914F6CDD1D)), dtype=np.uint64)
    h2 = np.sum(mix(shingles + _U(0x9E6C63D0876A9A47)), dtype=np.uint64)
    return int(h1.astype(np.int64)), int(h2.astype(np.int64))


def _edges(kind: int, ends: np.ndarray, reducers: int = 1) -> pa.RecordBatch:
    counts = {"n": ends[:, 2], "t": ends[:, 3]} if ends.shape[1] > 2 else {}
    return _batch(len(ends), kind=np.full(len(ends), kind, dtype=np.int32), h1=ends[:, 0], other=ends[:, 1], r=_dealt(ends[:, 0], reducers), **counts)


def _scan(size: int, pct: int, reducers: int, levels) -> Callable:
    """Rows (id, t, text) -> documents, entries of their sets' short lists, and edges of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        sent: set[tuple[int, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal hashes, owners, sizes, held
            if held:
                start, length, long, h, nodes, level = _lists(np.concatenate(hashes), np.concatenate(owners), np.concatenate(sizes))
                if long.any():
                    yield _edges(1, _stars(nodes, start[long], length[long]), reducers)
                    level[start[long]] = _LONG  # the first one goes on, and makes the list a long one for its reducer too
                    left = np.repeat(~long, length)
                    left[start[long]] = True
                    h, nodes, level = h[left], nodes[left], level[left]
                to = (h % _U(reducers)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                h, nodes, level, to = h[order], nodes[order], level[order], to[order]
                at = np.searchsorted(to, np.arange(reducers + 1))
                full = np.flatnonzero(at[1:] > at[:-1])
                for some in np.array_split(full, max(1, len(full) // 256)):
                    blobs = {k: pa.array([x[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()) for k, x in (("hashes", h), ("nodes", nodes), ("levels", level))}
                    yield _batch(len(some), kind=np.full(len(some), 2, dtype=np.int32), r=some.astype(np.int32), **blobs)
            hashes, owners, sizes, held = [], [], [], 0
            sent.clear()

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            n, h1, h2 = (np.zeros(len(ids), dtype=np.int64) for _ in range(3))
            bins: list[bytes | None] = [None] * len(ids)
            for s in slices(batch.column(2), NOT_BLANK):
                words = s.hashes(lowered=True)
                for d in range(len(s)):
                    u = distinct_shingles(words[s.first[d] : s.first[d + 1]], size)
                    k = s.row + d
                    n[k] = len(u)
                    if len(u):
                        h1[k], h2[k] = own = _set_hash(u)
                        if not known[k] or own in sent:
                            continue
                        sent.add(own)
                        bins[k] = histogram(u)
                        p = rarest(u, pct, levels.value)
                        hashes.append(p)
                        owners.append(np.full(len(p), h1[k]))
                        sizes.append(np.full(len(p), _size_level(len(u)), dtype=np.uint16))
                        held += len(p)
                if held >= FLUSH:
                    yield from flush()
            to = _dealt(h1 ^ mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)).astype(np.int64), reducers)
            yield _batch(len(ids), kind=np.zeros(len(ids), dtype=np.int32), id=ids, t=texts, n=n, h1=h1, h2=h2, bins=pa.array(bins, pa.binary()), r=to)
        yield from flush()

    return run


def _reduce(pct: int) -> Callable:
    """Short lists become their pairs, longer ones rows for each entry, those over LIST edges to their smallest node; other rows pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            entries = np.flatnonzero(kind == 2)
            if len(entries):
                own = batch.take(pa.array(entries))
                for r, *blobs in zip(*[own.column(c).to_pylist() for c in ("r", "hashes", "nodes", "levels")], strict=True):
                    found.setdefault(r, []).append(tuple(blobs))
            rest = np.flatnonzero(kind != 2)
            if len(rest):
                yield batch.take(pa.array(rest)) if len(entries) else batch
        pairs, waiting = [np.empty((0, 4), dtype=np.int64)], 0
        while found:
            _, blobs = found.popitem()
            start, length, long, hashes, nodes, level = _lists(*[np.frombuffer(b"".join(x[i] for x in blobs), dtype=t) for i, t in enumerate((np.uint64, np.int64, np.uint16))])
            star = _stars(nodes, start[long], length[long])
            if len(star):
                yield _edges(1, star)
            short = ~long & (length <= PAIRS)
            middle = np.repeat(~long & ~short, length)
            if middle.any():
                yield _edges(4, np.stack([nodes[middle], hashes[middle].astype(np.int64)], axis=1))
            pairs.append(_pairs(nodes, level, start[short], length[short], pct))
            waiting += len(pairs[-1])
            if waiting > FLUSH or not found:
                p = _added(np.concatenate(pairs))
                pairs, waiting = [np.empty((0, 4), dtype=np.int64)], 0
                if len(p):
                    yield _edges(3, p)

    return run


def _near(n: np.ndarray, m: np.ndarray, apart: np.ndarray, pct: int) -> np.ndarray:
    """Whether sizes and the bins' differences allow the similarity."""
    return (100 * np.minimum(n, m) >= pct * np.maximum(n, m)) & (apart * (100 + pct) <= (n + m) * (100 - pct))


def _as_stars(a: list[int], b: list[int]) -> pa.RecordBatch:
    """What a batch of edges holds together, as stars: fewer edges, and fewer rounds after."""
    stars = [(x, r) for x, r in local_roots(a, b).items() if x != r]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], names=["h1", "other"])


def _possible(pct: int) -> Callable:
    """Edges of the pairs (h1, other) whose sizes and bins allow the similarity. Rows: h1, other, n, m, bins, bins2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
            ok = _near(n, m, differences(*[batch.column(c).to_pylist() for c in ("bins", "bins2")]), pct)
            left = batch.select(["h1", "other"]).take(pa.array(np.flatnonzero(ok)))
            yield _as_stars(left.column(0).to_pylist(), left.column(1).to_pylist())

    return run


def near_on_list(n: np.ndarray, bins: list[bytes], pct: int) -> list[tuple[int, int]]:
    """Places on a list of sets that hold together all whose sizes and bins allow the similarity."""
    order = np.argsort(n, kind="stable")
    n, bins = n[order], [bins[i] for i in order]
    last = np.searchsorted(n, 100 * n // pct, side="right")
    label, out = np.arange(len(n)), []
    rows: dict[int, tuple[int, np.ndarray]] = {}
    for i in range(len(n)):
        later = np.arange(i + 1, last[i])
        later = later[label[later] != label[i]]  # the rest are together with it already
        if not len(later):
            continue
        k = len(bins[i])  # larger sets have as many bins at least
        if k not in rows:
            rows = {k: (i, np.concatenate([_folded([x], k) for x in bins[i:]]))}
        at, x = rows[k]
        for j in later[_near(n[i], n[later], np.abs(x[later - at] - x[i - at]).sum(axis=1), pct)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _compared(pct: int) -> Callable:
    """Rows (other, h1, n, bins) sorted by other, a list -> stars (h1, other) of sets on a list that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        a, b = [], []

        def end() -> None:
            for i, k in near_on_list(np.array([x[1] for x in own], dtype=np.int64), [x[2] for x in own], pct) if len(own) > 1 else []:
                a.append(own[i][0])
                b.append(own[k][0])

        for batch in batches:
            for at, *row in zip(*[batch.column(c).to_pylist() for c in ("other", "h1", "n", "bins")], strict=True):
                if at != now:
                    end()
                    now, own = at, []
                    if len(a) > FLUSH:
                        yield _as_stars(a, b)
                        a, b = [], []
                own.append(row)
        end()
        yield _as_stars(a, b)

    return run


def search(sets: list[np.ndarray], side: np.ndarray, pct: int, crossing: bool) -> Iterator[tuple[int, np.ndarray]]:
    """T-occurrence search: for each set the places of later sets that are similar enough.

    When ``crossing`` only pairs of different ``side`` count. A document's long lists are those set
    aside so that the rest must still give a hit; short lists are merged, long ones are probed by
    binary search, or through a row of bits for lists that a quarter of the block is on.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    _, token = np.unique(tokens, return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(token))])
    length = np.diff(at)
    dense = np.flatnonzero(length * 4 >= n)
    bits_of = np.full(len(length), -1, dtype=np.int64)
    if n > 16 and len(dense) * n <= 16_000_000:
        bits_of[dense] = np.arange(len(dense))
        bits = np.zeros((len(dense), n), dtype=np.uint8)
        row = bits_of[token]
        bits[row[row >= 0], owner[row >= 0]] = 1
    keys = token[order] * n + posting  # sorted: all lists one after the other
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for q in range(n):
        lists = token[begin[q] : begin[q + 1]]
        t = -(-pct * int(sizes[q]) // 100)  # the least overlap with any set that is similar enough
        lists = lists[np.argsort(length[lists], kind="stable")]
        longest = int(length[lists[-1]])
        aside = min(t - 1, int(t / (0.01 * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        short = short[length[short] > 1]
        if not len(short):
            continue
        merged = np.concatenate([posting[at[k] : at[k + 1]] for k in short])
        merged = merged[merged > q]
        count = np.bincount(merged, minlength=n) if len(merged) * 8 > n else None
        if count is None:
            cand, c = np.unique(merged, return_counts=True)
        else:
            cand = np.flatnonzero(count)
            c = count[cand]
        need = -(-pct * (sizes[q] + sizes[cand]) // (100 + pct))
        ok = c + len(long) >= need
        if crossing:
            ok &= side[cand] != side[q]
        cand, c, need = cand[ok], c[ok], need[ok]
        if len(cand) and len(long):
            rows = bits_of[long]
            if (rows >= 0).any():
                c = c + bits[rows[rows >= 0]][:, cand].sum(axis=0, dtype=np.int64)
            probe = long[rows < 0]
            if len(probe):
                key = probe[:, None] * n + cand[None, :]
                place = np.searchsorted(keys, key)
                c = c + (keys[np.minimum(place, len(keys) - 1)] == key).sum(axis=0)
        cand = cand[c >= need]
        if len(cand):
            yield q, cand


def _search_blocks(size: int, pct: int) -> Callable:
    """Rows sorted by (grp, i, j) -> stars of linked documents (id, other), and the links of each set (h1, h2)."""
    out = pa.schema([(k, pa.int64()) for k in ("id", "other", "h1", "h2", "links")])

    def block(ids: list[int], keys: list[tuple[int, int]], sets: list[np.ndarray], side: list[int], copies: list[int], crossing: bool) -> pa.RecordBatch:
        many = np.array(copies, dtype=np.int64)
        links = np.zeros(len(ids), dtype=np.int64)
        label = np.arange(len(ids))
        for q, cand in search(sets, np.array(side), pct, crossing):
            links[q] += many[cand].sum()
            links[cand] += many[q]
            for other in np.unique(label[cand]):
                if other != label[q]:
                    label[label == other] = label[q]
        some = np.flatnonzero(links)
        least = dict(sorted(zip(label.tolist(), ids, strict=True), key=lambda x: -x[1]))  # the smallest id of a label stays
        stars = [(ids[i], least[label[i]]) for i in some if ids[i] != least[label[i]]]
        n, m = len(stars), len(some)
        columns = (
            [x for x, _ in stars] + [None] * m,
            [r for _, r in stars] + [None] * m,
            [None] * n + [keys[i][0] for i in some],
            [None] * n + [keys[i][1] for i in some],
            [None] * n + links[some].tolist(),
        )
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, keys, sets, side, copies = None, [], [], [], [], []
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("grp", "i", "j", "b", "rep", "h1", "h2", "copies")}
            for s in slices(batch.column("text"), NOT_BLANK):
                words = s.hashes(lowered=True)
                for d in range(len(s)):
                    k = s.row + d
                    now = (cols["grp"][k], cols["i"][k], cols["j"][k])
                    if now != key:
                        if len(ids) > 1:
                            yield block(ids, keys, sets, side, copies, key[1] != key[2])
                        key, ids, keys, sets, side, copies = now, [], [], [], [], []
                    own = (cols["h1"][k], cols["h2"][k])
                    if keys and keys[-1] == own:
                        continue  # a repeated row
                    u = distinct_shingles(words[s.first[d] : s.first[d + 1]], size)
                    if _set_hash(u) == own:
                        ids.append(cols["rep"][k])
                        keys.append(own)
                        sets.append(u)
                        side.append(cols["b"][k])
                        copies.append(cols["copies"][k])
        if len(ids) > 1:
            yield block(ids, keys, sets, side, copies, key[1] != key[2])

    return run


def _candidates(rows: DataFrame, pct: int) -> DataFrame:
    """(node, grp) of the sets that may link with others; a set's node is its h1."""
    bins = rows.where("kind = 0 and bins is not null").select(F.col("h1").alias("k"), "n", "bins").repartition("k").distinct()
    pairs = rows.where("kind = 3").groupBy("h1", "other").agg(F.sum("n").alias("lists"), F.max("t").alias("least")).where("lists >= least").select("h1", "other")
    left = pairs.join(bins, pairs.h1 == bins.k).drop("k")
    both = left.join(bins.select("k", F.col("n").alias("m"), F.col("bins").alias("bins2")), F.col("other") == F.col("k"))
    near = both.select("h1", "other", "n", "m", "bins", "bins2").mapInArrow(_possible(pct), "h1 long, other long")
    listed = rows.where("kind = 4").select("h1", "other")
    listed = listed.join(bins, listed.h1 == bins.k).select("other", "h1", "n", "bins").repartition("other").sortWithinPartitions("other")
    edges = rows.where("kind = 1").select("h1", "other").unionByName(near).unionByName(listed.mapInArrow(_compared(pct), "h1 long, other long"))
    return connected_components(edges, "h1", "other", starred=True).withColumnRenamed("component", "grp")


def _row_groups(docs: DataFrame, size: int, pct: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, component, links) of each row; t is a hash of its text."""
    spark = docs.sparkSession
    text_batches(spark)
    reducers = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("t"), docs[text_col].alias("text"))
    levels = spark.sparkContext.broadcast(shingle_levels(slim, size))
    rows = stage(slim.mapInArrow(_scan(size, pct, reducers, levels), _SQL_SCHEMA).repartition("r").mapInArrow(_reduce(pct), _SQL_SCHEMA).drop("r", "hashes", "nodes", "levels"))
    levels.unpersist()
    grouped = _candidates(rows, pct)

    # one document stands for each set
    own = rows.where("kind = 0 and n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "t")).alias("rep"), F.count("*").alias("copies"))
    reps = stage(own.join(grouped, own.h1 == grouped.node, "left").select("h1", "h2", "n", "rep.*", "copies", "grp"))
    shape = reps.where("grp is not null").groupBy("grp").agg(F.count("*").alias("k"), F.sum("n").alias("weight")).where("k > 1")
    blocks = F.ceil(F.col("weight") / BLOCK).cast("int")
    dealt = reps.join(shape.select("grp", blocks.alias("g")), "grp").withColumn("b", F.pmod(F.xxhash64("h1", "h2"), F.col("g")).cast("int"))
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    work = pairs.select("grp", F.col("id").alias("rep"), F.col("t").alias("rep_t"), "h1", "h2", "copies", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    # texts of no group mostly stay where they are: they miss the slots of all that are in one, SLOTS at most
    slot = lambda c: F.pmod(F.xxhash64(F.lit(9), c), F.lit(SLOTS)).alias("slot")
    close = slim.join(F.broadcast(dealt.select(slot("id")).distinct()), slot(slim["id"]) == F.col("slot"), "left_semi")
    sent = close.join(work, (close.id == work.rep) & (close.t == work.rep_t)).select("grp", "i", "j", "b", "rep", "h1", "h2", "copies", "text")
    found = stage(sent.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "rep", "h1", "h2").mapInArrow(_search_blocks(size, pct), "id long, other long, h1 long, h2 long, links long"))

    linked = connected_components(found.where("other is not null"), "id", "other", starred=True)
    counted = found.where("links is not null").groupBy("h1", "h2").agg(F.sum("links").alias("found"))
    known = reps.select("h1", "h2", "id", "copies").join(linked, F.col("id") == F.col("node"), "left").join(counted, ["h1", "h2"], "left")
    reached = stage(known.select("h1", "h2", F.coalesce("component", "id").alias("component"), (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("links")))
    members = rows.where("kind = 0").select("id", "t", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("h1")).alias("h1"), "h2")
    return members.join(reached, ["h1", "h2"], "left").select("id", "t", "n", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))


def jaccard_groups(docs: DataFrame, size: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) of each row; ``size`` words a shingle, ``pct`` percent.

    Two documents link when 100 * intersection >= pct * union. ``component_id`` is the smallest id
    that links reach, ``n_links`` the number of other documents that a document links with. Ids are
    numbers.
    """
    return _row_groups(docs, size, pct, id_col, text_col).select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, size: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are in a group with a smaller id."""
    gone = _row_groups(docs, size, pct, id_col, text_col).where("component <> id").select(F.col("id").alias("__gone"), F.col("t").alias("__gone_t")).distinct()
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__gone_t"]), "left_anti")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    groups = jaccard_groups(table(spark, sf_dir, "documents"), size=3, pct=90)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), comp AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(k, 0) AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN comp ON comp.x = d.doc_id
LEFT JOIN (SELECT x, count(*) AS k FROM links GROUP BY x) l ON l.x = d.doc_id
"""
