"""URL filters with dated lists, in DataFrame functions only.

A list entry is a dated change: on ``day`` a list adds or removes a pattern.  The
changes of one pattern become validity intervals, and an as-of join judges every
capture against the entries active on the day it was fetched.

A pattern is a host, which also covers its subdomains, or a host and a path
prefix (``host/dir``, whole path segments).  So a URL meets the patterns among
its own *candidates*: every suffix of its host at a dot, and the full host with
every prefix of its path.  Matching is an equality join on the candidate.

Before the join, captures are reduced to distinct (candidate, day) pairs, with
partial aggregation, and entries to the last state of a day: a host or a pattern
that holds a third of all rows is at most as many rows as there are days.  The
as-of step runs over these pairs; verdicts go back to the captures by
(URL key, day), where adaptive execution splits a large key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canonspark.llm.textops import ascii_lower


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port, leading ``www.`` and last dot; null
    if there is none."""
    authority = F.regexp_extract(ascii_lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path segments joined by ``/``, without query, fragment and outer slashes."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)
    return F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/")


def candidates_of(host: Column, path: Column) -> Column:
    """Patterns that cover the URL."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.split(path, "/")
    prefixes = F.when(path != "", F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.array_distinct(F.concat(suffixes, F.coalesce(prefixes, F.expr("cast(array() as array<string>)"))))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(list, pattern, day, action)`` -> ``(list, pattern, valid_from,
    valid_to)``, ``valid_to`` exclusive and null while the entry stands.

    Of several changes of a pattern on one day, a removal wins; an ``add`` while
    the entry stands and a ``remove`` while it does not change nothing.  Rows with
    a null in any column or another action are no entries.  A group holds one row
    a day."""
    ok = entries.where("list is not null and pattern is not null and day is not null and action in ('add', 'remove')")
    daily = ok.groupBy("list", ascii_lower(F.col("pattern")).alias("pattern"), F.col("day").cast("date").alias("day")
                       ).agg(F.min(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("list", "pattern").orderBy("day")
    changed = (daily.withColumn("before", F.coalesce(F.lag("on").over(w), F.lit(False)))
               .where(F.col("on") != F.col("before")))
    return (changed.withColumn("valid_to", F.lead("day").over(w)).where("on")
            .select("list", "pattern", F.col("day").alias("valid_from"), "valid_to"))


def _active(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """As-of join of distinct ``pairs(pattern, day)`` with the entries: one row for
    each list active on the day.  Both sides are one row a day, list and pattern;
    the last state on or before the day is carried forward."""
    spans = intervals(entries)
    changes = spans.select("list", "pattern", F.col("valid_from").alias("day"), F.lit(True).alias("on")).unionByName(
        spans.where("valid_to is not null").select("list", "pattern", F.col("valid_to").alias("day"),
                                                   F.lit(False).alias("on")))
    # the lists that name a pattern; a pattern no list names leaves the pairs here
    named = spans.select("list", "pattern").distinct()
    asked = pairs.join(named, "pattern").select("list", "pattern", "day", F.lit(None).cast("boolean").alias("on"))
    # a change of the same day counts: changes come first
    w = (Window.partitionBy("list", "pattern").orderBy("day", F.col("on").isNull())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (changes.unionByName(asked).withColumn("state", F.last("on", ignorenulls=True).over(w))
            .where("on is null and state").select("list", "pattern", "day"))


def judge(captures: DataFrame, entries: DataFrame, result: str = "url_filter") -> DataFrame:
    """The rows of ``captures(url, fetched, ...)`` with a struct ``result``: ``host``,
    ``lists`` (lists with an active entry that covers the URL, sorted),
    ``patterns`` (``list:pattern`` of these entries, sorted) and ``blocked`` (any).

    ``fetched`` is taken as a date.  A null or unparsable URL has a null host and is
    not blocked, nor is a capture without a date.  Other columns pass through, one
    named like ``result`` is replaced (names beginning with ``_u`` are reserved).
    Repeated captures are judged each; empty tables are allowed on either side.
    """
    own = captures.drop(result)
    keyed = own.withColumns({"_uhost": host_of(F.col("url")), "_upath": path_of(F.col("url")),
                             "_uday": F.col("fetched").cast("date")})
    asked = keyed.where("_uhost is not null and _uday is not null").select("_uhost", "_upath", "_uday").distinct()
    pairs = asked.select(F.explode(candidates_of(F.col("_uhost"), F.col("_upath"))).alias("pattern"),
                         "_uhost", "_upath", "_uday")
    active = _active(pairs.select("pattern", F.col("_uday").alias("day")).distinct(), entries)
    hits = (pairs.join(active.withColumnRenamed("day", "_uday"), ["pattern", "_uday"])
            .groupBy("_uhost", "_upath", "_uday")
            .agg(F.array_sort(F.collect_set("list")).alias("_ulists"),
                 F.array_sort(F.collect_set(F.concat("list", F.lit(":"), "pattern"))).alias("_upatterns")))
    none = F.expr("cast(array() as array<string>)")
    found = keyed.where("_uhost is not null and _uday is not null").join(hits, ["_uhost", "_upath", "_uday"], "left")
    other = keyed.where("_uhost is null or _uday is null").withColumns(
        {"_ulists": none, "_upatterns": none})
    rows = found.select(*own.columns, "_uhost", "_ulists", "_upatterns").unionByName(
        other.select(*own.columns, "_uhost", "_ulists", "_upatterns"))
    return rows.withColumn(result, F.struct(
        F.col("_uhost").alias("host"), F.coalesce("_ulists", none).alias("lists"),
        F.coalesce("_upatterns", none).alias("patterns"), F.col("_ulists").isNotNull().alias("blocked"))
    ).withColumn(result, F.col(result).withField("blocked", F.size(F.col(f"{result}.lists")) > 0)).select(*own.columns, result)
