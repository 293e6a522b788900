"""URL filters against dated lists. DataFrame functions only.

List entries come as dated changes (pattern, verdict, add or remove). A pattern is a domain, which covers its subdomains, or
a host with the first parts of a path. The changes of a pattern become validity intervals. A capture's URL is spelled out as
all patterns that would cover it, and joined with the intervals on pattern and month, keeping those in force at the moment of
the fetch. The longest pattern decides; of equal ones ``allow`` wins.

Both sides of the join come from exchanges, so a host with a third of all captures is split by Spark, and the month spreads
it further. Nothing is gathered but one best entry per capture.

Cases: a URL that is null or has no host matches nothing and is not blocked; neither is a capture without a time. Repeated
captures are one row. Changes without pattern or time are left out; of changes at the same moment ``add`` counts. An interval
is from the change on, up to the next change, that moment excluded. No list entries: nothing is blocked. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SITE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _SITE, 1)), r"\.+$", "")


def patterns_of(url: str) -> Column:
    """All patterns that cover a URL: its host, the domains above it, and the host with ever longer paths."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")
    domains = F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    paths = F.transform(parts, lambda x, i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(domains, paths))


def _month(time: str) -> Column:
    return (12 * F.year(time) + F.month(time)).cast("int")


def intervals(changes: DataFrame) -> DataFrame:
    """``pattern, verdict, since, until`` (until null: still in force) from ``pattern, verdict, change, at``."""
    known = changes.where("pattern is not null and at is not null and verdict in ('block', 'allow') and change in ('add', 'remove')")
    single = known.groupBy("pattern", "verdict", "at").agg(F.min("change").alias("change"))
    later = F.lead("at").over(Window.partitionBy("pattern", "verdict").orderBy("at"))
    return single.withColumn("until", later).where("change = 'add'").select("pattern", "verdict", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``page_id, url, fetched, blocked, entry, since`` of every distinct capture ``(page_id, url, fetched)``."""
    last = captures.agg(F.max(_month("fetched")).alias("m")).select("m").scalar()
    listed = intervals(changes).withColumn("upto", F.least(F.coalesce(_month("until"), last), last))
    listed = listed.where(F.col("upto") >= _month("since"))
    listed = listed.withColumn("month", F.explode(F.sequence(_month("since"), F.col("upto")))).drop("upto")
    asked = captures.select(
        "page_id", "url", "fetched", _month("fetched").alias("month"), F.explode_outer(patterns_of("url")).alias("pattern")
    )
    in_force = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = asked.join(listed, ["pattern", "month"], "left")
    found = F.when(
        in_force,
        F.struct(F.char_length("pattern").alias("n"), (F.col("verdict") == "allow").alias("allow"), "pattern", "since"),
    )
    best = met.groupBy("page_id", "url", "fetched").agg(F.max(found).alias("best"))
    return best.select(
        "page_id", "url", "fetched", F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked"),
        F.col("best.pattern").alias("entry"), F.col("best.since").alias("since"),
    )
