"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct words (letters and digits, lower-cased), hashed to ``1 << bits``
buckets. Training keeps the buckets whose chi-square against the label is above ``CHI_SQUARE``; a text
has those of its words with value 1 / sqrt(number of features). The score is the logistic function of
``w0 + sum of w[i] x[i] + sum over pairs of <v[i], v[j]> x[i] x[j]``: the factors learn that two
terms together, such as an insult with a mention of a group, weigh more than either alone.

The model is fitted on a bounded sample of labelled rows, at most about ``sample_rows`` picked by a
hash of the id, whose hashed features (never texts) come to the driver. Training is mini-batch
gradient descent with per-weight step sizes, deterministic by seed. Copies of one text would make its
words look telling, so of sample rows with the same label and the same min-hash signature one counts.
Training rows are ordered by id and features, so that repeated ids do not leave the model undetermined.

Null and empty texts have no features and get the logistic of w0 with a cap below 0.5: a text without
words is not toxic. Rows with a null label are not learned from; a row counts once for each label that
it has. Without labels, or with one label only, every score is 0 or the label. Repeated rows give
repeated rows, an empty table an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, release, slices, small_batches

BITS, FACTORS, SAMPLE_ROWS, CHI_SQUARE = 20, 4, 20_000, 16.0
WORD = re.compile(r"\w+")
#: Characters from which on a text's words are never all listed at once.
LONG = 1 << 18
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


class Hasher(dict):
    """Buckets of words; remembers at most ``most`` of them, then starts anew."""

    def __init__(self, bits: int, most: int = 200_000):
        super().__init__()
        self.mask, self.most = (1 << bits) - 1, most

    def __missing__(self, word: str) -> int:
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass")) & self.mask
        return h

    def features(self, text: bytes | None) -> np.ndarray:
        """The distinct buckets of a whole text, ascending."""
        if len(self) > self.most:
            self.clear()
        plain = (text or b"").decode("utf-8", "replace").lower()
        words = set(WORD.findall(plain)) if len(plain) < LONG else {m[0] for m in WORD.finditer(plain)}
        return np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))


@dataclass
class Machine:
    """The buckets kept (ascending), w0, and for each of them w and v [factors]."""

    bits: int
    codes: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def kept(self, row: np.ndarray) -> np.ndarray:
        """Numbers of the kept buckets among a text's features."""
        if not len(self.codes):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, row), len(self.codes) - 1)
        return at[self.codes[at] == row]

    def raw(self, index: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The value before the logistic of rows whose features are index[begin[k]:begin[k+1]]."""
        n = np.diff(begin)
        x = 1 / np.sqrt(np.maximum(n, 1))
        linear = _sums(self.w[index], begin) * x
        v = self.v[index].astype(np.float64)
        pairs = _sums(v, begin) ** 2 - _sums(v * v, begin)
        return self.w0 + linear + 0.5 * pairs.sum(axis=1) * x * x

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        wordless = np.array([len(r) == 0 for r in rows])
        rows = [self.kept(r) for r in rows]
        begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        raw = self.raw(np.concatenate([*rows, np.empty(0, np.int64)]), begin)
        got = 1 / (1 + np.exp(-np.clip(raw, -60, 60)))
        return np.where(wordless, np.minimum(got, 0.49), got)


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of runs of values, 0 for an empty run."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[begin[1:]] - total[begin[:-1]]


def chi_square(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Pearson's statistic of each bucket's presence against the label."""
    n, ones = len(labels), int(labels.sum())
    both = [np.bincount(np.concatenate([np.empty(0, np.int64), *(r for r, y in zip(rows, labels, strict=True) if y == k)]), minlength=size) for k in (0, 1)]
    a, b = both[1].astype(float), both[0].astype(float)
    c, d = ones - a, n - ones - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where(below > 0, n * (a * d - b * c) ** 2 / np.maximum(below, 1), 0.0)


def distinct_rows(rows: list[np.ndarray], labels: np.ndarray, signature: int = 3) -> list[int]:
    """The first row of each label and min-hash signature of features; copies and near copies have one signature nearly always."""
    seen: dict[tuple, int] = {}
    odd = [(2654435761, 40503), (2246822519, 3266489917), (668265263, 374761393)][:signature]
    for k, (r, y) in enumerate(zip(rows, labels.tolist(), strict=True)):
        mixed = [int(((r * a + b) % 4294967291).min()) if len(r) else -1 for a, b in odd]
        seen.setdefault((y, *mixed), k)
    return list(seen.values())


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 12, batch: int = 64, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Fits a machine; step sizes shrink by each weight's own gradients (AdaGrad)."""
    random = np.random.default_rng(seed)
    none = np.empty(0, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Machine(bits, none, 8.0 if len(labels) and labels[0] else -8.0, np.empty(0), np.empty((0, factors)))
    first = distinct_rows(rows, labels)
    rows, labels = [rows[k] for k in first], labels[first]
    codes = np.flatnonzero(chi_square(rows, labels, 1 << bits) > CHI_SQUARE)
    size = len(codes)
    m = Machine(bits, codes, 0.0, np.zeros(size), random.normal(0, 0.02, (size, factors)))
    rows = [m.kept(r) for r in rows]
    gw, gv, g0 = np.full(size, 1e-3), np.full((size, factors), 1e-3), 1e-3
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(labels)), max(1, len(labels) // batch)):
            chosen = [rows[k] for k in part]
            begin = np.concatenate([[0], np.cumsum([len(r) for r in chosen])]).astype(np.int64)
            index = np.concatenate(chosen)
            n = np.diff(begin)
            of, x = np.repeat(np.arange(len(part)), n), 1 / np.sqrt(np.maximum(n, 1))
            p = 1 / (1 + np.exp(-np.clip(m.raw(index, begin), -60, 60)))
            d = (p - labels[part]) / len(part)
            unique, inverse = np.unique(index, return_inverse=True)
            dw = np.bincount(inverse, (d * x)[of], len(unique)) + decay * m.w[unique]
            v = m.v[index]
            both = ((d * x * x)[of])[:, None] * (_sums(v, begin)[of] - v)
            dv = np.stack([np.bincount(inverse, both[:, f], len(unique)) for f in range(factors)], axis=1) + decay * m.v[unique]
            gw[unique] += dw * dw
            gv[unique] += dv * dv
            g0 += d.sum() ** 2
            m.w[unique] -= 5 * rate * dw / np.sqrt(gw[unique])
            m.v[unique] -= rate * dv / np.sqrt(gv[unique])
            m.w0 -= rate * d.sum() / np.sqrt(g0)
    return m


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for part in slices(batches):
            found = [hasher.features(t).astype("<u4").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(found, pa.binary())], ["id", "label", "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, bits: int = BITS, factors: int = FACTORS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine from the rows of docs that labels (id_col, label_col) marks. The driver holds sample_rows rows of hashed features."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    total = marks.count()
    if total > sample_rows:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (sample_rows << 30) // total)
    # About sample_rows rows of two numbers, whatever the tables' size: small enough to broadcast, so no text is shuffled.
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(marks), "id").mapInArrow(_features(bits), "id long, label int, features binary")
    got = sorted(zip(*(c.to_pylist() for c in rows.toArrow().columns), strict=True))
    found = [np.frombuffer(b, "<u4").astype(np.int64) for _, _, b in got]
    return train(found, np.array([y for _, y, _ in got], np.int64), bits, factors)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of each row; the text is all that a score sees."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = sent.value
        hasher = Hasher(m.bits)
        for part in slices(batches):
            got = m.score([hasher.features(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], schema=SCORED)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the machine does not take for toxic, with the columns of docs. A row is scored where it stands: nothing is joined, and only the text goes to Python."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        m = sent.value
        hasher = Hasher(m.bits)
        for texts in batches:
            found = [m.score([hasher.features(t) for t in part.column("text").to_pylist()]) < 0.5 for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))]
            yield pa.array(np.concatenate([*found, np.empty(0, bool)]))

    return docs.where(clean(F.col(text_col).cast("string").cast("binary")))
