"""Language identification by string kernels: Nyström features and one-versus-rest kernel ridge regression.

A text's blended spectrum is the set of n-grams of lengths 1 to 3 that are in it, of its UTF-8 bytes with
A-Z lowered and every other ASCII character but letters as one blank. The kernel of two texts is the
number of n-grams in both over the geometric mean of their numbers; n-grams are told apart exactly and
texts are taken whole, however long. Landmarks are some training texts; a text's kernel values with
them, whitened by the landmarks' own kernel matrix, are its Nyström features, and ridge regression on
these gives a score per language.

Scoring is batched: presence rows of many texts over the landmarks' n-grams, times the folded weights.

The model is fitted on a bounded sample: at most ``per_lang`` rows of each language and ``max_rows`` in
all (but one of each language at least), chosen by a hash of the id, of the ``max_langs`` languages that
have the most rows. Kernel values of these rows are made by tasks; the driver gets them (a number for each
row and landmark) and the landmarks' n-grams. A text of over ``LANDMARK_GRAMS`` different n-grams trains
like others but is no landmark.

Defined cases: null text, or a text without a letter, is ``und`` with score 0; a null id is held out;
without labelled rows everything is ``und``; ties go to the first language in code point order; ids are
numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table, text_batches
from .tokens import LOWERED, slices

LENGTHS = (1, 2, 3)
LANDMARK_GRAMS = 1 << 16
#: Numbers of presence rows that are made at a time.
CELLS = 4_000_000
#: Symbols: 0 is a blank, then a to z, then bytes of other characters.
_SYMBOL = np.zeros(256, dtype=np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
_SYMBOL = _SYMBOL[LOWERED]
_N = 155
#: Codes of n-grams: those of shorter ones come first.
CODES = _N + _N**2 + _N**3
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_scratch: list[np.ndarray] = []


def spectra(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The codes of the n-grams of each text that lies at ``offsets``, each once."""
    if not _scratch:
        _scratch.append(np.zeros(CODES, dtype=np.int32))
    last = _scratch[0]  # where a code was seen last; what other texts left there can't be mistaken
    x = _SYMBOL[data]
    two = x[:-1] * _N + x[1:]
    three = two[:-1] * _N + x[2:] + (_N + _N**2)
    two = two + _N
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        every = np.concatenate([x[lo:hi], two[lo : max(hi - 1, lo)], three[lo : max(hi - 2, lo)]])
        place = np.arange(len(every), dtype=np.int32)
        last[every] = place
        yield every[last[every] == place]


@dataclass
class Model:
    """Languages, landmarks (sorted codes of each) with their weights, and the constant score of each language."""

    langs: list[str]
    landmarks: list[np.ndarray]
    alpha: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """The landmarks' n-grams, and the weight of each for each language in a text's score times the root of its number of n-grams."""
        codes, has = presence(self.landmarks)
        return codes, (has @ (self.alpha / np.sqrt([len(z) for z in self.landmarks])[:, None])).astype(np.float32)


def presence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All codes of some sets, and a 0/1 matrix (codes x sets)."""
    codes = np.unique(np.concatenate(sets))
    has = np.zeros((len(codes), len(sets)), dtype=np.float32)
    for i, z in enumerate(sets):
        has[np.searchsorted(codes, z), i] = 1
    return codes, has


class _Products:
    """Products of texts' presence rows over ``codes`` with a matrix (codes x columns), over the roots of their numbers of n-grams."""

    def __init__(self, codes: np.ndarray, matrix: np.ndarray):
        self.place = np.full(CODES, -1, dtype=np.int32)
        self.place[codes] = np.arange(len(codes))
        self.matrix = matrix

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        some = max(1, CELLS // len(self.matrix))
        out = np.zeros((n, self.matrix.shape[1]))
        rows, size = np.zeros((some, len(self.matrix)), dtype=np.float32), np.ones(some)
        for d, codes in enumerate(spectra(data, offsets)):
            at = self.place[codes]
            rows[d % some, at[at >= 0]] = 1
            size[d % some] = max(len(codes), 1)
            if d % some == some - 1 or d == n - 1:
                k = d % some + 1
                out[d + 1 - k : d + 1] = (rows[:k] @ self.matrix) / np.sqrt(size[:k])[:, None]
                rows[:k] = 0
        return out


def fit(kernel: np.ndarray, langs: list[str], landmarks: list[np.ndarray], ridge: float = 1e-2) -> Model:
    """A model from the kernel values (rows x landmarks) of rows with a language."""
    names = sorted(set(langs), key=str.encode)
    _, has = presence(landmarks)
    size = np.sqrt([len(z) for z in landmarks])
    own = (has.T @ has).astype(np.float64) / (size[:, None] * size[None, :])
    value, vector = np.linalg.eigh(own)
    live = value > 1e-6 * value[-1]
    white = vector[:, live] / np.sqrt(value[live])
    features = np.concatenate([kernel @ white, np.ones((len(kernel), 1))], axis=1)
    target = np.array([[float(v == k) for k in names] for v in langs])
    # classes weigh equally
    weight = (target / (target.sum(axis=0) * len(names))).sum(axis=1)[:, None] * len(langs)
    penalty = ridge * len(langs) * np.eye(features.shape[1]) / features.shape[1]
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ (weight * features) + penalty, features.T @ (weight * target))
    return Model(names, landmarks, white @ solved[:-1], solved[-1])


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, lang, text) -> (k, lang, grams) of those that can be landmarks."""
    for batch in batches:
        sets = [z for s in slices(batch.column(2)) for z in spectra(s.data, s.offsets)]
        own = [i for i, z in enumerate(sets) if len(z) <= LANDMARK_GRAMS]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), batch.column(1).take(pa.array(own, pa.int64())), pa.array([np.sort(sets[i]).tobytes() for i in own], pa.binary())], names=["k", "lang", "grams"])


def _kernel_of(known) -> Callable:
    """Rows (k, lang, text) -> (k, lang, values), the kernel values with the landmarks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = None
        for batch in batches:
            if products is None:
                landmarks = known.value
                codes, has = presence(landmarks)
                products = _Products(codes, has / np.sqrt([len(z) for z in landmarks], dtype=np.float32))
            values = [v.tobytes() for s in slices(batch.column(2)) for v in products(s.data, s.offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], names=["k", "lang", "values"])

    return run


def train(docs: DataFrame, per_lang: int = 300, max_rows: int = 6000, max_langs: int = 1000, landmarks: int = 128, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from rows that are not held out and have a language; see the module's text for the bounds."""
    text_batches(docs.sparkSession)
    known = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).where(~held_out(docs[id_col]) & docs[lang_col].isNotNull() & docs[text_col].isNotNull() & (F.length(docs[text_col]) > 0))
    order = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    found = {r["lang"]: r["n"] for r in sizes.orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not found:
        return None
    each = min(per_lang, max(1, max_rows // len(found)))
    # a share of rows that holds a few more than are wanted, so that no language's rows all meet in one task
    share = F.element_at(F.create_map(*[x for k, n in found.items() for x in (F.lit(k), F.lit(min(1.0, (1.5 * each + 50) / n)))]), F.col("lang"))
    some = known.where(order < share * float(1 << 40)).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "id", "text"))).where(F.col("k") <= each)
    rows = stage(some.select("k", "lang", "text"))
    own = rows.where(F.col("k") <= -(-landmarks // len(found))).mapInArrow(_grams_of, "k int, lang string, grams binary").collect()
    sets = [np.frombuffer(bytes(r["grams"]), dtype=np.int32) for r in sorted(own, key=lambda r: (r["k"], r["lang"].encode()))[:landmarks]]
    if not sets:
        return None
    spark = docs.sparkSession
    # a landmark has LANDMARK_GRAMS n-grams at most
    values = rows.mapInArrow(_kernel_of(spark.sparkContext.broadcast(sets)), "k int, lang string, values binary").collect()
    values.sort(key=lambda r: (r["lang"].encode(), r["k"]))
    return fit(np.array([np.frombuffer(bytes(r["values"])) for r in values]), [r["lang"] for r in values], sets)


def _predict(known, langs: list[str], bias: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = None
        for batch in batches:
            if products is None and langs:
                products = _Products(*known.value)
            found, values = [], []
            for s in slices(batch.column(2)):
                n = len(s)
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[s.data])])
                some = letters[s.offsets[1:]] > letters[s.offsets[:-1]]
                for d in np.flatnonzero(~some & (np.diff(s.offsets) > 0)):
                    some[d] = _has_letter(s.data[s.offsets[d] : s.offsets[d + 1]].tobytes())
                if not langs:
                    found += ["und"] * n
                    values += [0.0] * n
                    continue
                total = products(s.data, s.offsets) + bias
                best = total.argmax(axis=1)
                odds = np.exp(4 * (total - total.max(axis=1, keepdims=True)))
                chance = odds.max(axis=1) / odds.sum(axis=1)
                found += [langs[b] if ok else "und" for b, ok in zip(best, some, strict=True)]
                values += np.where(some, chance, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(values, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of each row, from its text alone."""
    slim = docs.select(docs[id_col].cast("long").alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    text_batches(docs.sparkSession)
    known = model and docs.sparkSession.sparkContext.broadcast(model.folded())
    return slim.mapInArrow(_predict(known, model.langs if model else [], model and model.bias), "id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).withColumnRenamed("id", "doc_id")
