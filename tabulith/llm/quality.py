"""Quality rules and line labelling: a linear-chain CRF tells content lines from boilerplate.

Base figures (words, symbols, repeated lines, repeated word windows) come from one vectorised pass.
The same pass makes indicator features of every line; Viterbi decoding labels the lines, for all
documents of a slice at once, and the share of words in content lines decides.

Training is weakly supervised: every line of a document labelled with quality 1 counts as content,
with quality 0 as boilerplate. It uses at most ``max_docs`` documents per class, chosen by a hash of
the id (the bound of the sample; a broadcast of their ids and their lines' features, 4 bytes a line,
are all that leaves the executors). Whole documents are scored, whatever their length.

Defined cases: null text has no words and one empty line; without labels of both classes there is no
model and only the base rules decide; rows are judged one by one, so repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_batches
from .tokens import _BASE, _BYTE, NOT_BLANK, Slice, _ranges, mix, slices, windows

_U = np.uint64
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLASSES = {
    "symbol": _SYMBOL,
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "letter": np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)]),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "bang": np.arange(256) == ord("!"),
    "bar": np.arange(256) == ord("|"),
    "stop": np.isin(np.arange(256), [ord(c) for c in ".?;:,"]),
}
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\"')"]] = True
FEATURES = 24
#: So many sequences of a slice that are longer than all others are decoded one by one.
FEW = 4


def _per(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[hi] - total[lo]


def _equal_earlier(groups: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value whether its group has it earlier; whether its group has it twice or more."""
    key = mix(hashes + mix(groups.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    earlier, twice = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    earlier[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return earlier, twice


@dataclass
class Measured:
    """Figures of a slice's texts, and its lines: those of text d are first[d] to first[d + 1]."""

    base: dict[str, np.ndarray]
    first: np.ndarray
    words: np.ndarray
    features: np.ndarray


def measure(s: Slice) -> Measured:
    n = len(s)
    data, offsets = s.data, s.offsets
    n_words = np.diff(s.first)
    point = (data & 0xC0) != 0x80
    words = s.hashes(lowered=False)
    doc_of_word = np.repeat(np.arange(n), n_words)

    grams = windows(words, 3)
    at = np.flatnonzero(doc_of_word[: len(grams)] == doc_of_word[2:]) if len(grams) else np.empty(0, dtype=np.int64)
    _, twice = _equal_earlier(doc_of_word[at], grams[at])
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, at[twice], 1)
    np.add.at(depth, at[twice] + 3, -1)
    repeated = np.cumsum(depth[:-1]) > 0

    breaks = np.flatnonzero(data == 10)
    lo = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    hi = np.sort(np.concatenate([breaks, offsets[1:]]))
    first = np.concatenate([[0], np.cumsum(_per(data == 10, offsets[:-1], offsets[1:]) + 1)])
    doc_of_line = np.repeat(np.arange(n), np.diff(first))
    w_lo, w_hi = np.searchsorted(s.starts, lo), np.searchsorted(s.starts, hi)
    line_words = w_hi - w_lo
    line_hash = mix(_ranges(_BYTE[data], lo, hi, _BASE) + (hi - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    earlier, _ = _equal_earlier(doc_of_line, line_hash)
    dup = earlier & (line_words > 0)

    base = {
        "n_words": n_words,
        "word_chars": _per(point & NOT_BLANK[data], offsets[:-1], offsets[1:]),
        "n_symbols": _per(_SYMBOL[data], offsets[:-1], offsets[1:]),
        "n_dup_lines": _per(dup, first[:-1], first[1:]),
        "n_repeat_words": _per(repeated, s.first[:-1], s.first[1:]),
    }

    chars = np.maximum(_per(point, lo, hi), 1)
    share = {k: _per(t[data], lo, hi) / np.maximum(hi - lo, 1) for k, t in _CLASSES.items()}
    same = np.zeros(len(words), dtype=bool)
    same[1:] = words[1:] == words[:-1]
    echo = _per(same, w_lo, w_hi) / np.maximum(line_words, 1)
    again = _per(repeated, w_lo, w_hi) / np.maximum(line_words, 1)
    length = chars / np.maximum(line_words, 1)
    last = data[np.maximum(hi - 1, 0)] if len(data) else np.zeros(len(hi), dtype=np.uint8)
    upper = share["upper"] / np.maximum(share["letter"], 1e-9)
    tests = [
        np.ones(len(lo), dtype=bool),
        line_words == 0,
        line_words < 4,
        line_words < 12,
        line_words >= 40,
        dup,
        share["symbol"] > 0.01,
        share["symbol"] > 0.08,
        share["bar"] > 0.02,
        share["bang"] > 0.02,
        upper > 0.3,
        upper > 0.7,
        share["digit"] > 0.1,
        share["letter"] < 0.6,
        share["letter"] > 0.75,
        share["stop"] > 0.002,
        share["stop"] > 0.05,
        echo > 0.1,
        echo > 0.4,
        again > 0.3,
        again > 0.7,
        length > 12,
        length < 3.5,
        _END[last] & (hi > lo),
    ]
    return Measured(base, first, line_words, np.stack(tests, axis=1))


@dataclass
class Chain:
    """Weights of label 1 (content) by feature, of the first label, and of label pairs."""

    w: np.ndarray
    start: np.ndarray
    move: np.ndarray

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of each line; sequences are decoded side by side."""
        score = features @ self.w
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        begin, sizes = first[:-1][order], n[order]
        back = np.zeros((len(score), 2), dtype=bool)
        v0 = np.full(len(n), self.start[0])
        v1 = self.start[1] + (score[begin] if len(begin) else np.empty(0))
        longest = int(sizes[0]) if len(sizes) else 0
        side = int(sizes[FEW]) if len(sizes) > FEW else 0  # from here on at most FEW go on, one by one
        for t in range(1, min(longest, max(side, 1))):
            k = int(np.searchsorted(-sizes, -t))  # sequences with more than t lines
            at = begin[:k] + t
            a0, a1 = v0[:k] + self.move[0, 0], v1[:k] + self.move[1, 0]
            b0, b1 = v0[:k] + self.move[0, 1], v1[:k] + self.move[1, 1]
            back[at, 0], back[at, 1] = a1 > a0, b1 > b0
            v0[:k], v1[:k] = np.maximum(a0, a1), np.maximum(b0, b1) + score[at]
        label = np.zeros(len(score), dtype=bool)
        shared = np.minimum(sizes, max(side, 1))
        now = v1 >= v0
        for d in range(int(np.searchsorted(-sizes, -max(side, 1)))):
            lo, hi = int(begin[d]) + max(side, 1), int(begin[d]) + int(sizes[d])
            label[lo:hi], now[d] = self._alone(float(v0[d]), float(v1[d]), score[lo:hi].tolist())
        longest = int(shared[0]) if len(shared) else 0
        sizes = shared
        for t in range(longest - 1, -1, -1):
            k = int(np.searchsorted(-sizes, -t))
            at = begin[:k] + t
            label[at] = now[:k]
            now[:k] = np.where(now[:k], back[at, 1], back[at, 0])
        return label


    def _alone(self, v0: float, v1: float, score: list[float]) -> tuple[list[bool], bool]:
        """The rest of one sequence from the values of its line before: its labels, and that line's."""
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        for s in score:
            a0, a1, b0, b1 = v0 + m00, v1 + m10, v0 + m01, v1 + m11
            back.append((a1 > a0, b1 > b0))
            v0, v1 = max(a0, a1), max(b0, b1) + s
        now, label = v1 >= v0, []
        for b in reversed(back):
            label.append(now)
            now = b[now]
        return label[::-1], now


def fit_chain(sequences: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.15, l2: float = 1e-3, l2_move: float = 5e-2, window: int = 64) -> Chain:
    """Maximum likelihood by Adam; each sequence is (features of its lines, label of all its lines).

    Long sequences are cut into windows of ``window`` lines, all of which are used. Classes weigh equally.
    Labels that are constant in a document would make moves between labels all but impossible, so their
    weights are held back more than those of features: two odd lines must not outvote a long good one.
    """
    parts = [(x[i : i + window], y) for x, y in sequences for i in range(0, len(x), window)]
    x, size, y = padded(parts)
    theta = np.zeros(x.shape[2] + 6)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    shrink = np.full(len(theta), l2)
    shrink[-6:] = l2_move
    for step in range(1, steps + 1):
        g = likelihood(theta, x, size, y)[1] - shrink * theta
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    return Chain(theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2))


def padded(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side: features (line, sequence, feature), numbers of lines, labels."""
    x = np.zeros((max(len(p) for p, _ in parts), len(parts), parts[0][0].shape[1]))
    for i, (p, _) in enumerate(parts):
        x[: len(p), i] = p
    return x, np.array([len(p) for p, _ in parts]), np.array([v for _, v in parts])


def likelihood(theta: np.ndarray, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted mean log likelihood of labels, and its gradient, by forward and backward sums.

    ``theta`` has weights of features, of the first label and of moves.
    """
    m, k = x.shape[:2]
    live = np.arange(m)[:, None] < size[None, :]
    weight = np.where(y == 1, 0.5 / max(1, size[y == 1].sum()), 0.5 / max(1, size[y == 0].sum()))
    w, start, move = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
    e1 = x @ w
    alpha, beta = np.zeros((m, k, 2)), np.zeros((m, k, 2))
    alpha[0] = start + np.stack([np.zeros(k), e1[0]], axis=1)
    for t in range(1, m):
        into = np.logaddexp(alpha[t - 1][:, 0, None] + move[0], alpha[t - 1][:, 1, None] + move[1])
        into[:, 1] += e1[t]
        alpha[t] = np.where(live[t][:, None], into, alpha[t - 1])
    for t in range(m - 2, -1, -1):
        nxt = beta[t + 1].copy()
        nxt[:, 1] += e1[t + 1]
        out = np.logaddexp(move[:, 0] + nxt[:, 0, None], move[:, 1] + nxt[:, 1, None])
        beta[t] = np.where(live[t + 1][:, None], out, beta[t + 1])
    z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    p1 = np.where(live, np.exp(alpha[:, :, 1] + beta[:, :, 1] - z), 0.0)
    own = start[y] + y * (e1 * live).sum(axis=0) + move[y, y] * (size - 1)
    g = np.zeros_like(theta)
    g[:-6] = np.einsum("tk,tkf->f", (live * y - p1) * weight, x)
    g[-5] = ((y - p1[0]) * weight).sum()
    g[-6] = ((p1[0] - y) * weight).sum()
    for a in (0, 1):
        for b in (0, 1):
            pair = np.exp(alpha[:-1, :, a] + move[a, b] + b * e1[1:] + beta[1:, :, b] - z) * live[1:]
            true = live[1:] * ((y == a) & (y == b))
            g[len(theta) - 4 + 2 * a + b] = ((true - pair) * weight).sum()
    return float(((own - z) * weight).sum()), g


def train_chain(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Chain | None:
    """A chain from documents with labels, at most ``max_docs`` of each class; None without both classes."""
    text_batches(docs.sparkSession)
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).where("id is not null and y is not null")
    chosen = None
    for v in (0, 1):
        some = known.where(F.col("y") == v).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * max_docs ids
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id").select(F.col("y").cast("int").alias("y"), "text")
    weights = (1 << np.arange(FEATURES)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for s in slices(batch.column(1), NOT_BLANK):
                m = measure(s)
                bits = (m.features @ weights).astype(np.int32)
                packed += [bits[m.first[d] : m.first[d + 1]].tobytes() for d in range(len(s))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["y", "bits"])

    found = sorted((r["y"], bytes(r["bits"])) for r in rows.mapInArrow(run, "y int, bits binary").collect())
    if len({y for y, _ in found}) < 2:
        return None
    unpack = lambda b: ((np.frombuffer(b, dtype=np.int32)[:, None] >> np.arange(FEATURES)) & 1).astype(np.float64)
    return fit_chain([(unpack(b), y) for y, b in found])


_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judge(chain: Chain | None, text: str, keep: list[str], min_words: int, max_repeat_pct: int, min_share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures: dict[str, list] = {k: [] for k in [*_FIGURES, "base_failed", "content_share", "kept"]}
            for s in slices(batch.column(text), NOT_BLANK):
                m = measure(s)
                n = m.base["n_words"]
                failed = (n < min_words) | (100 * m.base["n_repeat_words"] > max_repeat_pct * n)
                share = np.ones(len(s))
                if chain is not None:
                    content = chain.viterbi(m.features.astype(np.float64), m.first)
                    share = _per(content * m.words, m.first[:-1], m.first[1:]) / np.maximum(n, 1)
                for k in _FIGURES:
                    figures[k].append(m.base[k])
                figures["base_failed"].append(failed)
                figures["content_share"].append(share)
                figures["kept"].append(~failed & (share >= min_share))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array(np.concatenate(v) if v else [], pa.int64() if k in _FIGURES else pa.float64() if k == "content_share" else pa.bool_()) for k, v in figures.items()],
                names=[*keep, *figures],
            )

    return run


def judge(docs: DataFrame, chain: Chain | None, keep: list[str], min_words: int = 50, max_repeat_pct: int = 50, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with the base figures, base_failed, content_share and kept."""
    text_batches(docs.sparkSession)
    slim = docs.select(*dict.fromkeys([text_col, *keep]))  # the text goes to the tasks once
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keep], *[f"{k} long" for k in _FIGURES], "base_failed boolean, content_share double, kept boolean"])
    return slim.mapInArrow(_judge(chain, text_col, keep, min_words, max_repeat_pct, min_share), schema)


def keep_good(docs: DataFrame, chain: Chain | None, text_col: str = "text", **limits) -> DataFrame:
    """``docs`` without the rejected documents; columns stay as they are."""
    # other names, so that those of the results can't clash
    named = {f"c{i}": c for i, c in enumerate(docs.columns)}
    text = next(k for k, c in named.items() if c.lower() == text_col.lower())
    judged = judge(docs.select(*[docs[c].alias(k) for k, c in named.items()]), chain, list(named), text_col=text, **limits)
    return judged.where("kept").select(*[F.col(k).alias(c) for k, c in named.items()])


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = train_chain(docs, table(spark, sf_dir, "labels"))
    return judge(docs, chain, ["doc_id"])
