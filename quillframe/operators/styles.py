"""Styles of documents as tables: inheritance chains, shared classes, and lines wrapped by measured width.

Nothing here gathers a document: chains are resolved by doubling joins on (document, style), classes are
numbered among the distinct formats of a document, and a text is wrapped within its row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Doublings of a chain: a style inherits from at most 2 ** DOUBLINGS - 1 others (fixed value: 32 styles a chain).
DOUBLINGS = 5


def _cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: a doubled join would double its own plan."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint()


def resolved_styles(styles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, style and ``props`` (map of texts) of every style with what it inherits, the nearest first.

    styles has keys, style, based_on (or null) and props (map<string,string> or null). A style named twice in a document
    counts once, as the one with the smallest parent and properties; a parent that does not exist ends the chain, and so does the 32nd style; styles
    that inherit from each other see each other's properties once. Each round is checkpointed, and the last is where no chain goes on.
    """
    own = F.coalesce("props", F.expr("cast(map() as map<string,string>)"))
    picked = F.min(F.struct(F.col("based_on").cast("string").alias("next"), F.array_sort(F.map_entries(own)).alias("props"))).alias("x")
    key = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(0)
    known = styles.select(key.alias("key"), F.col("style").cast("string").alias("style"), "based_on", "props").where("style is not null").groupBy("key", "style").agg(picked)
    known = known.select("key", "style", "x.next", F.map_from_entries("x.props").alias("props"))
    for _ in range(DOUBLINGS):
        known = _cut(known)
        if known.where("next is not null").isEmpty():
            break
        above = known.select(F.col("key").alias("above_key"), F.col("style").alias("above"), F.col("next").alias("further"), F.col("props").alias("inherited"))
        joined = known.join(above, known["key"].eqNullSafe(above["above_key"]) & (known["next"] == above["above"]), "left")
        none = F.expr("cast(map() as map<string,string>)")
        kept = F.map_filter(F.coalesce("inherited", none), lambda k, _: ~F.map_contains_key("props", k))
        known = joined.select("key", "style", F.col("further").alias("next"), F.map_concat("props", kept).alias("props"))
    return known.select(*[F.col("key")[k].alias(k) for k in keys], "style", "props")


def style_classes(runs: DataFrame, keys: list[str], position: str, formatting: list[str], prefix: str = "c") -> DataFrame:
    """keys, formatting and ``class``: equal formats of a document share one, numbered by where they first stand (ties by the format). A null is a format of its own."""
    first = runs.groupBy(*keys, *formatting).agg(F.min(position).alias("_first_at"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("_first_at", *formatting))
    return first.select(*keys, *formatting, F.concat(F.lit(prefix), n.cast("string")).alias("class"))


def table_width(widths: Mapping[str, float], default: float) -> Callable[[Column], Column]:
    """The width of a text by a table of the widths of characters."""
    classes: dict[float, str] = {}
    for c, w in widths.items():
        classes[w] = classes.get(w, "") + c

    def measure(s: Column) -> Column:
        out = F.length(s) * F.lit(float(default))
        for w, chars in classes.items():
            out = out + (F.length(s) - F.length(F.translate(s, chars, ""))) * F.lit(float(w - default))
        return out

    return measure


def wrapped(text: Column, limit: float, measure: Callable[[Column], Column] = lambda s: F.length(s).cast("double"), space: float = 1.0) -> Column:
    """The lines of a text, greedily filled: an array of texts. Words are what white space parts; one wider than the limit has a line of its own. Null stays null, a text without words has no lines."""
    words = F.filter(F.split(text, r"[ \t\r\n\x0B\f]+"), lambda w: w != "")
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("line"), F.lit(0.0).alias("used"))

    def step(a: Column, w: Column) -> Column:
        size = measure(w)
        fits = a["used"] + F.lit(float(space)) + size <= F.lit(float(limit))
        fresh = F.struct(F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"])).alias("done"), w.alias("line"), size.alias("used"))
        more = F.struct(a["done"].alias("done"), F.concat(a["line"], F.lit(" "), w).alias("line"), (a["used"] + F.lit(float(space)) + size).alias("used"))
        return F.when((a["line"] != "") & fits, more).otherwise(fresh)

    return F.aggregate(words, empty, step, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"])))
