"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A ``Rule`` rejects a row where its column is true; it names the measures that it needs. A row is kept if
no rule rejects it, so the order of rules changes the work, never the verdict.

``order`` estimates on a sample what each rule rejects and what each measure and rule costs: the sample
is written once, and the cost is the time that evaluating it over the sample takes beyond reading it.
It then picks rules one by one: the one that rejects most of the rows still left per cost, where a
measure that an earlier rule needed is free. ``keep_good`` runs that cascade with every measure behind
the rules before it: rows that a cheap rule has rejected never reach a dear measure. ``judge`` reports
all measures of every row, so there they are computed for all, and the cascade is one CASE expression.

Words are ``[^\\x20\\x09-\\x0D]+``. Null texts count as empty: no words, so the base rule rejects them.
Repeated windows of three words are found by sorting the windows' 64-bit hashes and comparing the
words of neighbours; a text in which different windows share a hash is sorted by the words instead, so
the count is exact at any length. Repeated rows give repeated rows; an empty table gives an empty
result and the rules' given order. Columns of the input are kept, whatever their names; ``judge``
replaces those named as an output of its own.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, packed_row, unpacked

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Rows of the sample for the cascade's order, in expectation.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """A rule by name: ``rejects`` over ``text`` and the columns of the measures that it needs."""

    name: str
    rejects: Column
    needs: tuple[str, ...] = ()


def base_rule() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def base_rules() -> list[Rule]:
    """The base rule in its two parts, for a cascade that stops between them."""
    return [Rule("base_words", F.col("n_words") < 50, ("words",)), Rule("base_repeats", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), ("words", "windows"))]


def rules() -> list[Rule]:
    """The method's own rules beside the base rule. Bounds are wide: ordinary prose in any language that separates words passes all."""
    text, words = F.col("text"), F.col("n_words")
    return [
        Rule("symbol_ratio", 10 * F.col("n_symbols") > words, ("words", "symbols")),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words), ("words",)),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines"), ("lines",)),
        Rule("ellipsis_lines", 10 * F.regexp_count(text, F.lit("(?md)(?:\\.\\.\\.|\u2026)[ \\t\\r]*$")) > 5 * F.col("n_lines"), ("lines",)),
        Rule("bullet_lines", 10 * F.regexp_count(text, F.lit("(?md)^[ \\t]*[-*\u2022\u2023\u25cf]")) > 9 * F.col("n_lines"), ("lines",)),
        Rule("without_letters", 10 * F.length(F.regexp_replace(text, "[^\\p{L}\\p{M}]+", "")) < 4 * F.col("word_chars"), ("words",)),
    ]


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: an optimizer would else put a long array's expression into each element's lambda."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _words_at(i: Column) -> list[Column]:
    return [F.get("_words", i + k) for k in range(3)]


def _same_words(i: Column, j: Column) -> Column:
    """Whether the windows of three words at two places are equal; null if a place is."""
    one, two = _words_at(i), _words_at(j)
    return (one[0] == two[0]) & (one[1] == two[1]) & (one[2] == two[2])


def _places(*before: str) -> Column:
    """The places of the windows of three words, sorted by their hash or, with names for them, by the words themselves."""
    key = (lambda i: [F.xxhash64(*_words_at(i)).alias("h")]) if not before else (lambda i: [c.alias(n) for n, c in zip(before, _words_at(i), strict=True)])
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(*key(i), i.alias("i"))))


def _window_order() -> Column:
    """Places of the windows in an order in which equal windows are neighbours: by hash or, where different windows share a hash, by words."""
    clash = F.filter(F.col("_hashed"), lambda x, k: (F.get("_hashed", k + 1)["h"] == x["h"]) & ~_same_words(x["i"], F.get("_hashed", k + 1)["i"]))
    return F.when(F.size(clash) > 0, F.transform(_places("a", "b", "c"), lambda x: x["i"])).otherwise(F.transform("_hashed", lambda x: x["i"]))


def _words(df: DataFrame) -> DataFrame:
    step = _with(df, _words=F.array_remove(F.split("text", SPACE), ""))
    return _with(step, n_words=F.size("_words").cast("long"), word_chars=F.length(F.array_join("_words", "")).cast("long"))


def _windows(df: DataFrame) -> DataFrame:
    step = _with(df, _hashed=F.when(F.size("_words") >= 3, _places()).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    step = _with(step, _order=_window_order())
    # A window is repeated if a neighbour in this order has its words; the first place has no one before it, the last no one after it.
    again = F.filter(F.col("_order"), lambda x, k: _same_words(x, F.get("_order", k - 1)) | _same_words(x, F.get("_order", k + 1)))
    step = _with(step, _at=F.sort_array(again))
    gaps = F.zip_with(F.col("_at"), F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)).cast("long"))
    return _with(step, n_repeat_words=F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)).drop("_hashed", "_order", "_at")


def _lines(df: DataFrame) -> DataFrame:
    step = _with(df, _lines=F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    return _with(step, n_lines=F.size("_lines").cast("long"), n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")


def _symbols(df: DataFrame) -> DataFrame:
    return df.withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOLS)).cast("long"))


#: Measures by name: the columns that each adds, and how, to a frame with ``text`` and the measures before it.
MEASURES = {"words": (("n_words", "word_chars"), _words), "lines": (("n_lines", "n_dup_lines"), _lines), "symbols": (("n_symbols",), _symbols), "windows": (("n_repeat_words",), _windows)}
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "rejected_by", "base_failed", "kept")


def _plain(docs: DataFrame, text_col: str) -> DataFrame:
    """row, the columns of docs as a struct, and text."""
    return docs.select(*packed_row(docs), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long)."""
    return _unpacked(_measured(_plain(docs, text_col)), docs)


def _measured(plain: DataFrame) -> DataFrame:
    for _, add in MEASURES.values():
        plain = add(plain)
    return plain.drop("_words")


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    made = [c for c in OUTPUTS if c in found.columns]
    return found.select(*unpacked(docs, but=tuple(made)), *made)


def _seconds(df: DataFrame, made: Sequence[Column]) -> float:
    """The time to evaluate columns over a table, the better of two runs."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        df.agg(F.count(F.lit(1)), *[F.max(F.xxhash64(c)) for c in made]).first()
        took.append(time.perf_counter() - began)
    return min(took)


def costs(sample: DataFrame, candidates: Sequence[Rule]) -> tuple[dict[str, float], dict[str, float]]:
    """Seconds of each measure and of each rule on its own over a written sample (``text`` and all measures), beyond reading it."""
    floor = _seconds(sample, [F.col("text")])
    text = sample.select("text")
    done = {name: add(_words(text) if name == "windows" else text).select(*columns) for name, (columns, add) in MEASURES.items()}
    per_measure = {name: _seconds(df, [F.col(c) for c in df.columns]) - floor for name, df in done.items()}
    per_measure["windows"] -= per_measure["words"]
    return {k: max(t, 1e-4) for k, t in per_measure.items()}, {r.name: max(_seconds(sample, [F.col("text"), r.rejects]) - floor, 1e-4) for r in candidates}


def order(docs: DataFrame, candidates: Sequence[Rule], id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, text_col: str = "text", ready: Sequence[str] = ()) -> list[Rule]:
    """The rules in the order in which each rejects most of the rows still left per cost, as estimated on about sample_rows rows that a hash of the id picks.

    ``ready`` names measures that cost nothing, since they are computed anyway. What comes to the driver is a count for each
    combination of rejecting rules. With no row or one rule the given order stays.
    """
    rows = docs.select(F.lit(1)).count()
    if not rows or len(candidates) < 2:
        return list(candidates)
    share = max(1, (1 << 20) * sample_rows // rows)
    part = docs.where(F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(1 << 20)) < share)
    sample = cut(_measured(_plain(part, text_col)).drop("row"), "quality-sample")
    per_measure, per_rule = costs(sample, candidates)
    hits = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{k}") for k, r in enumerate(candidates)]
    found = [(tuple(row)[:-1], row["n"]) for row in sample.select(*hits).groupBy(*[f"r{k}" for k in range(len(candidates))]).agg(F.count(F.lit(1)).alias("n")).collect()]
    drop(sample)
    return greedy(list(candidates), found, per_measure, per_rule, set(ready))


def greedy(candidates: list[Rule], found: list[tuple[tuple[bool, ...], int]], per_measure: dict[str, float], per_rule: dict[str, float], done: set[str]) -> list[Rule]:
    """found: how many sample rows which rules reject. Rules that reject nothing more come last, cheap ones first."""
    left, out = list(range(len(candidates))), []
    while left:
        price = {k: per_rule[candidates[k].name] + sum(per_measure[m] for m in candidates[k].needs if m not in done) for k in left}
        cut_ = {k: sum(n for hit, n in found if hit[k]) for k in left}
        best = min(left, key=lambda k: (-cut_[k] / price[k], price[k], k))
        left.remove(best)
        out.append(candidates[best])
        done = done | set(candidates[best].needs)
        found = [(hit, n) for hit, n in found if not hit[best]]
    return out


def judge(docs: DataFrame, candidates: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the measures, ``base_failed``, ``kept`` and ``rejected_by`` (the first rule of the cascade that rejects, ``base`` before all; null if kept)."""
    cascade = order(docs, rules() if candidates is None else candidates, id_col, sample_rows, text_col, ready=tuple(MEASURES))
    first = F.when(base_rule(), F.lit("base"))
    for rule in cascade:
        first = first.when(rule.rejects, F.lit(rule.name))
    judged = _measured(_plain(docs, text_col)).withColumn("rejected_by", first)
    return _unpacked(judged.withColumns({"base_failed": base_rule(), "kept": F.col("rejected_by").isNull()}), docs)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs. Rules run one after another, each with the measures that it is the first to need, on the rows still left."""
    left, done = _plain(docs, text_col), set()
    for rule in order(docs, [*base_rules(), *(rules() if candidates is None else candidates)], id_col, sample_rows, text_col):
        for name in rule.needs:
            if name not in done:
                left = MEASURES[name][1](left)
                done.add(name)
        left = left.where(~F.coalesce(rule.rejects, F.lit(False)))
    return left.select(*unpacked(docs))
