"""URL filters by dated lists: an as-of join of captures with validity intervals.

A list is a table of dated entries (``domain``, ``action``, ``listed_at``, ``category``): ``add`` puts
a domain with its subdomains on the list, ``remove`` takes it off. Entries of one domain and category
become validity intervals: an ``add`` opens one unless one is open, the next ``remove`` closes it. At one
instant ``remove`` comes before ``add``. A capture is blocked if, at its fetch time t, an interval
with ``valid_from <= t < valid_to`` holds for its host or a domain above it.

Captures are not exploded. Distinct hosts (counted before their shuffle) are matched with the list by
their suffixes; each host then has a timeline of intervals, as large as the list's entries for its
suffixes, and captures join their host's timeline, whose intervals are evaluated at each fetch time.
Timelines are written first. Up to ``BROADCAST_BYTES`` they are broadcast and captures do not move.
Beyond that a host of more than ``HOT`` captures gets a salt per ``HOT`` of them: its timeline is repeated
for each and its captures are dealt by a hash, so no host fills a task. The list of hot hosts, a row per
``HOT`` captures at most, is broadcast.

Nulls: a capture with a null URL, a URL without host, or a null fetch time is not blocked; list
entries with a null domain or date are ignored. Hosts are lower-cased, ports and user names dropped.
Repeated captures give repeated rows; repeated entries change nothing. Columns of captures are kept,
whatever their names, except for those named as an output, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed_row, unpacked, written_bytes

#: Captures of a host that one task may read, and bytes of written timelines up to which they are broadcast.
HOT, BROADCAST_BYTES = 1 << 20, 16 << 20


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), "^[^@]*@", ""), "(:[0-9]*)?\\.?$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """domain, category, valid_from, valid_to (null: still valid). ``listed_at`` is a timestamp."""
    found = entries.where(F.col("domain").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin("add", "remove"))
    found = found.select(F.lower("domain").alias("domain"), F.coalesce("category", F.lit("")).alias("category"), "listed_at", (F.col("action") == "add").cast("int").alias("on")).distinct()
    per = Window.partitionBy("domain", "category").orderBy("listed_at", "on")
    changes = found.withColumn("before", F.coalesce(F.lag("on").over(per), F.lit(0))).where(F.col("on") != F.col("before"))
    opened = changes.withColumn("valid_to", F.lead("listed_at").over(per)).where("on = 1")
    return opened.select("domain", "category", F.col("listed_at").alias("valid_from"), "valid_to").where("valid_to is null or valid_to > valid_from")


def timelines(hosts: DataFrame, valid: DataFrame) -> DataFrame:
    """host and timeline (sorted intervals of the host and the domains above it) of the hosts that have any."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rows = hosts.select("host", F.explode(suffixes).alias("domain")).join(valid, "domain")
    spans = F.sort_array(F.collect_set(F.struct("valid_from", "valid_to", "category", "domain")))
    return rows.groupBy("host").agg(spans.alias("timeline"))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with ``blocked`` and, from the longest listed domain (then the smallest category), ``matched_domain`` and ``matched_category`` (null if not blocked)."""
    rows = captures.select(*packed_row(captures), host_of(F.col(url_col).cast("string")).alias("host"), F.col(time_col).alias("at"))
    hosts = cut(rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    found = cut(timelines(hosts, intervals(entries)), "timelines")
    if written_bytes(found) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        salts = hosts.where(F.col("n") > HOT).select("host", F.ceil(F.col("n") / F.lit(HOT)).alias("salts"))
        several = F.coalesce("salts", F.lit(1).cast("long"))
        dealt = rows.join(F.broadcast(salts), "host", "left").withColumn("salt", F.pmod(F.xxhash64(F.col("row")[url_col], "at"), several)).drop("salts")
        repeated = found.join(F.broadcast(salts), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), several - 1))).drop("salts")
        joined = dealt.join(repeated, ["host", "salt"], "left")
    active = F.filter("timeline", lambda x: (x["valid_from"] <= F.col("at")) & (x["valid_to"].isNull() | (F.col("at") < x["valid_to"])))
    best = F.array_min(F.transform(active, lambda x: F.struct((-F.length(x["domain"])).alias("n"), x["category"].alias("category"), x["domain"].alias("domain"))))
    out = {"matched_domain": F.col("best.domain"), "matched_category": F.col("best.category"), "blocked": F.col("best").isNotNull()}
    return joined.withColumn("best", best).select(*unpacked(captures, but=tuple(out)), *[c.alias(k) for k, c in out.items()])
