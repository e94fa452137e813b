"""Language identification by rank-order profiles of n-grams.

A profile is the ``top`` most frequent n-grams (1 to 3 letters, with a mark at word ends) of a
language's training texts in rank order. A text gets a profile of the same kind; its distance to a
language is the sum over its n-grams of the difference of ranks, ``top`` for an n-gram that the
language's profile lacks. The nearest language wins, ties go to the smaller name. The score is 1
minus the distance's share of the largest possible one.

Training takes the ``MOST_LANGUAGES`` most frequent languages and of each a sample of about ``per_language``
rows, picked by a hash of the id, and counts the n-grams of their whole texts on the executors; only the
profiles, ``top`` rows a language, come to the driver.

Letters are what Unicode calls alphabetic, lower-cased; anything else ends a word. A null text or one
without letters is ``und`` with score 0, as is every text where no language could be learned. Rows
with a null language are not learned from. Repeated rows give repeated rows, an empty table an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, release, slices, small_batches

TOP = 400
PER_LANGUAGE = 2000
#: Languages that are learned at most, by number of rows, ties by name: a bound for a column with stray values.
MOST_LANGUAGES = 500
#: Bits of a code point; the word mark is code point 1, which no letter has.
BITS, MARK = 21, 1
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: bytes | None) -> np.ndarray:
    """The n-grams of a text, one number each: code points of 21 bits, the first highest."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters()[points]
    if not letters.any():
        return np.empty(0, np.int64)
    marked = np.where(letters, points, MARK).astype(np.int64)
    marked = np.concatenate([[MARK], marked, [MARK]])
    marked = marked[np.concatenate([[True], (marked[1:] != MARK) | (marked[:-1] != MARK)])]
    two = marked[:-1] << BITS | marked[1:]
    three = two[:-1] << BITS | marked[2:]
    return np.concatenate([marked[marked != MARK], two, three[marked[1:-1] != MARK]])


def ranked(text: bytes | None, top: int) -> np.ndarray:
    """The most frequent n-grams of a text in rank order, ties by number."""
    found, counts = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:top]]


@dataclass(frozen=True)
class Profiles:
    """Languages by name; ``codes`` ascending; ``ranks[g, l]`` is the rank of n-gram g in language l, or ``top``."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    top: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], top: int) -> Profiles:
        """rows: language, n-gram, rank from 0."""
        names = sorted({r[0] for r in rows})
        codes = np.unique(np.array([r[1] for r in rows], np.int64))
        ranks = np.full((len(codes), len(names)), top, np.int64)
        for name, code, rank in rows:
            ranks[np.searchsorted(codes, code), names.index(name)] = rank
        return cls(names, codes, ranks, top)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        own = ranked(text, self.top)
        if not len(own) or not self.languages:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        apart = np.abs(self.ranks[at[known]] - np.arange(len(own))[known, None])
        missing = self.ranks[at[known]] == self.top
        distance = np.where(missing, self.top, apart).sum(axis=0) + self.top * int((~known).sum())
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (self.top * len(own)))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        languages = np.array(part.column("lang").to_pylist(), object)
        texts = part.column("text").to_pylist()
        for name in sorted(set(languages)):
            codes, counts = np.unique(np.concatenate([grams(texts[i]) for i in np.flatnonzero(languages == name)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from rows whose language is not null; the driver holds ``top`` rows of MOST_LANGUAGES languages at most."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not totals:
        return Profiles.of([], top)
    shares = F.create_map(*[F.lit(x) for name, n in sorted(totals.items()) for x in (name, min(1 << 20, (per_language << 20) // n))])
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("lang", "text")
    counts = sample.mapInArrow(_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram")))
    best = counts.select("lang", "gram", (first - 1).alias("rank")).where(F.col("rank") < top)
    return Profiles.of([(r["lang"], r["gram"], r["rank"]) for r in best.collect()], top)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row; the text is all that a prediction sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            names, scores = zip(*[profiles.predict(t) for t in part.column("text").to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=PREDICTED)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
