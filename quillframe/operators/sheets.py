"""Aggregates, lookups and projections over tables with worksheet semantics, as DataFrame algebra.

Aggregates ignore what is not a number and turn an empty set into 0 or an error as the worksheet does;
lookups take the first match in row order, without regard to case, and give ``#N/A`` where there is
none. All of it is built-in expressions, equi-joins and map-side combined aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.cells import MAX_ROW
from ..functions.criteria import criterion_of


def sum_(n: Column) -> Column:
    return F.coalesce(F.sum(n), F.lit(0.0))


def product(n: Column) -> Column:
    return F.coalesce(F.product(n), F.lit(1.0))


def average(n: Column) -> Column:
    """A value: #DIV/0! over nothing."""
    return F.when(F.count(n) == 0, v.err(v.DIV0)).otherwise(v.number(F.avg(n)))


def least(n: Column) -> Column:
    return F.coalesce(F.min(n), F.lit(0.0))


def greatest(n: Column) -> Column:
    return F.coalesce(F.max(n), F.lit(0.0))


def matching(c: Column, kind: str, criterion: float | str | bool) -> Column:
    """Whether a table's column meets a criterion; NULL is blank."""
    return criterion_of(criterion)(v.from_column(c, kind))


def countifs(*tests: Column) -> Column:
    return F.count_if(_all(tests))


def sumifs(n: Column, *tests: Column) -> Column:
    return F.coalesce(F.sum(F.when(_all(tests), n)), F.lit(0.0))


def averageifs(n: Column, *tests: Column) -> Column:
    chosen = F.when(_all(tests), n)
    return F.when(F.count(chosen) == 0, v.err(v.DIV0)).otherwise(v.number(F.avg(chosen)))


def sumproduct(*factors: Column) -> Column:
    out = F.coalesce(factors[0], F.lit(0.0))
    for f in factors[1:]:
        out = out * F.coalesce(f, F.lit(0.0))
    return F.coalesce(F.sum(out), F.lit(0.0))


def all_true(b: Column) -> Column:
    return F.when(F.count(b) == 0, v.err(v.VALUE)).otherwise(v.boolean(F.bool_and(b)))


def any_true(b: Column) -> Column:
    return F.when(F.count(b) == 0, v.err(v.VALUE)).otherwise(v.boolean(F.bool_or(b)))


def odd_true(b: Column) -> Column:
    return F.when(F.count(b) == 0, v.err(v.VALUE)).otherwise(v.boolean(F.pmod(F.count_if(b), F.lit(2)) == 1))


def text_join(delimiter: str, s: Column, position: Column, skip_empty: bool = True) -> Column:
    """Texts in the order of position; #VALUE! above the longest text. A group's texts must fit a row, which that limit bounds only after the join: use it on short lists."""
    kept = F.when(~F.lit(skip_empty) | (F.coalesce(s, F.lit("")) != ""), F.struct(position.alias("p"), F.coalesce(s, F.lit("")).alias("s")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["s"]), delimiter)
    return F.when(F.length(joined) > v.MAX_TEXT, v.err(v.VALUE)).otherwise(v.text(joined))


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def used_range(cells: DataFrame, *keys: str) -> DataFrame:
    """r1, c1, r2, c2 of the cells with a value or a formula, by keys."""
    filled = cells.where("value is not null or formula is not null")
    return filled.groupBy(*keys).agg(F.min("row").alias("r1"), F.min("col").alias("c1"), F.max("row").alias("r2"), F.max("col").alias("c2"))


def column_widths(shown: DataFrame, *keys: str) -> DataFrame:
    """Widths that fit the longest shown text of each column, from 8 to 80."""
    return shown.groupBy(*keys, "col").agg(F.greatest(F.lit(8), F.least(F.lit(80), F.max(F.length("shown")))).alias("width"))


def _key_of(table: DataFrame, name: str) -> Column:
    """A column as a lookup key: texts without regard to case."""
    return v.fold(F.col(name)) if dict(table.dtypes)[name] == "string" else F.col(name)


def first_by_key(table: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key (folded text or number) in row order, with its key as ``_key``; a hot key is combined before its shuffle."""
    rest = [c for c in table.columns if c != position]
    picked = table.where(F.col(key).isNotNull()).groupBy(_key_of(table, key).alias("_key")).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_row"))
    return picked.select("_key", *[F.col(f"_row.{c}").alias(c) for c in rest])


def exact_lookup(left: DataFrame, value: str, table: DataFrame, key: str, position: str, result: str, out: str = "found", missing: str = v.NA) -> DataFrame:
    """left with ``out``: result of the first row of table whose key equals value (texts without regard to case), as text; missing where there is none. A blank hit is 0. Columns of left keep their names and values."""
    right = first_by_key(table.select(key, position, result), key, position).select(F.col("_key").alias("key"), F.coalesce(F.col(result).cast("string"), F.lit("0")).alias("shown"))
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"), _key_of(left, value).alias("value"))
    joined = rows.join(right, F.col("value") == F.col("key"), "left")
    return joined.select(*[F.col("row")[c].alias(c) for c in left.columns if c != out], F.coalesce("shown", F.lit(missing)).alias(out))


def wildcard_lookup(left: DataFrame, patterns: dict[str, str], s: str, out: str = "found") -> DataFrame:
    """left with ``out``: the name of the first pattern (with * ? ~) that the text meets; #N/A where there is none. Patterns are part of the plan."""
    made = None
    for name, pattern in patterns.items():
        test = F.col(s).rlike(v.wildcard_regex(pattern))
        made = F.when(test, F.lit(name)) if made is None else made.when(test, F.lit(name))
    return left.withColumn(out, made.otherwise(F.lit(v.NA)) if made is not None else F.lit(v.NA))


def as_of_lookup(left: DataFrame, value: str, steps: DataFrame, key: str, result: str, out: str = "found") -> DataFrame:
    """left with ``out`` (text): result of the largest key not above value, for keys in ascending order; #N/A below the first and for NULL.

    The steps are a sheet's range: above a sheet's rows they are refused, and within that they go to every
    task as a sorted array, in which a batch of values is found by binary search; left is not shuffled.
    """
    spark = left.sparkSession
    if (n := steps.count()) > MAX_ROW:
        raise ValueError(f"{n} steps are more than a sheet's rows")
    spans = steps.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("double").alias("at")).agg(F.max(F.col(result).cast("string")).alias("shown")).toArrow()
    keys = spans.column("at").to_numpy()
    order = np.argsort(keys)
    shown = spans.column("shown").to_pylist()
    sent = spark.sparkContext.broadcast((keys[order], [v.NA, *(shown[i] for i in order)]))
    names = left.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shown = sent.value
        shown = pa.array(shown, pa.string())
        for batch in batches:
            at = batch.column("_at").to_numpy(zero_copy_only=False)
            place = np.where(np.isnan(at), 0, np.searchsorted(keys, at, side="right"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), shown.take(pa.array(place))], [*names, out])

    return left.withColumn("_at", F.col(value).cast("double")).mapInArrow(run, left.select("*", F.lit("").alias(out)).schema)


def in_list(left: DataFrame, value: str, table: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """Rows of left whose value is (or is not) among the keys: ISNUMBER or ISNA of MATCH."""
    keys = table.select(v.fold(F.col(key).cast("string")).alias("_key")).distinct()
    return left.join(keys, v.fold(left[value].cast("string")) == keys["_key"], "left_anti" if anti else "left_semi")
