"""Temporal list join for URL filtering (operator 8), DataFrame functions only.

A list is a history of dated entries (scope, value, category, day, action):
scope ``domain`` covers a domain and its subdomains, ``host`` one host,
``prefix`` a host with the first segments of a path. The entries of one rule
become validity intervals: an ``add`` holds from its day until the next
``remove`` of the rule. A capture is judged by the entries valid on the day it
was fetched, not by today's list.

How it runs
-----------
* Captures are first reduced to their distinct (host, day) and (prefix, day)
  pairs, with partial aggregates: however many captures a host has, it brings
  at most one row per day to the join.
* The as-of join is a union of probes and entries of a key, ordered by day, with
  the last action carried forward. A key holds at most (days x categories)
  rows, so no range join is needed and no pair of probe and entry is formed.
* The verdicts, one row per (host, day) and (path, day), are joined back on
  equality; adaptive execution splits a hot pair. Captures without a host are
  kept apart, so that null keys do not meet in one task.

Defined results: a null or unparseable URL, or a null day, is not listed; on one
day a removal comes before an addition; repeated entries count once; of
several valid rules the least (category, scope, value) is reported; empty tables are
fine; prefixes may have any depth and are compared in lower case; all columns of the captures
are kept, and a result whose name a capture column has already gets underscores in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonon.llm.common import fresh

SCOPES = ("domain", "host", "prefix")
OUTPUT = ("listed", "category", "entry_scope", "entry_value", "listed_since")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: F.Column) -> F.Column:
    """Lower-case host of a URL, null if it has none."""
    host = F.lower(F.regexp_extract(F.trim(url), HOST, 1))
    return F.when(host != "", F.regexp_replace(host, r"\.$", ""))


def prefix_of(url: F.Column, depth: int) -> F.Column:
    """Host and the first ``depth`` path segments, null if the path is shorter."""
    parts = F.filter(F.split(F.regexp_extract(F.trim(url), PATH, 1), "/"), lambda s: s != "")
    return F.when(F.size(parts) >= depth, F.concat(host_of(url), F.lit("/"), F.array_join(
        F.slice(parts, 1, depth), "/")))


def prefixes_of(url: F.Column, depths: list[int]) -> F.Column:
    """Lower-case prefixes of a URL at those ``depths`` that its path reaches, as an array."""
    parts = F.filter(F.split(F.regexp_extract(F.trim(url), PATH, 1), "/"), lambda s: s != "")
    reached = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: d <= F.size(parts))
    return F.coalesce(F.transform(reached, lambda d: F.lower(F.concat(
        host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), d), "/")))),
        F.array().cast("array<string>"))


def _domains(host: str) -> str:
    """SQL: the host's suffixes of two labels and more."""
    return (f"transform(sequence(1, greatest(1, size(split({host}, '[.]')) - 1)), k -> "
            f"array_join(slice(split({host}, '[.]'), k, size(split({host}, '[.]'))), '.'))")


def intervals(entries: DataFrame) -> DataFrame:
    """(scope, value, category, valid_from, valid_to): when each rule is in force.

    ``valid_to`` is the first day it no longer holds, null if it still does.
    """
    rule = ["scope", "value", "category"]
    days = entries.groupBy(*rule, "day").agg(
        F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    w = Window.partitionBy(*rule).orderBy("day")
    turns = days.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0))).where("on <> was")
    return turns.withColumn("valid_to", F.lead("day").over(w)).where("on = 1").select(
        *rule, F.col("day").alias("valid_from"), "valid_to")


def _in_force(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, day, category, since) for the rules valid on each probed (key, day).

    As-of by carrying state forward: a rule's interval starts and ends are rows
    between the probes of its key.
    """
    starts = spans.select("key", "category", F.col("valid_from").alias("day"),
                          F.col("valid_from").alias("since"), F.lit(0).alias("turn"))
    ends = spans.where("valid_to IS NOT NULL").select(
        "key", "category", F.col("valid_to").alias("day"), F.lit(None).cast("date").alias("since"),
        F.lit(0).alias("turn"))
    # one probe per category of its key (categories are few and distinct per key)
    kinds = spans.select("key", "category").distinct()
    asked = probes.join(kinds, "key").select(
        "key", "category", "day", F.lit(None).cast("date").alias("since"), F.lit(1).alias("turn"))
    w = (Window.partitionBy("key", "category").orderBy("day", "turn")
         .rowsBetween(Window.unboundedPreceding, 0))
    state = F.last(F.when(F.col("turn") == 0, F.struct(F.col("since").alias("since"))),
                   ignorenulls=True).over(w)["since"]
    return (starts.unionByName(ends).unionByName(asked).withColumn("held", state)
            .where("turn = 1 AND held IS NOT NULL")
            .select("key", "day", "category", F.col("held").alias("since")))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url",
          day_col: str = "day") -> DataFrame:
    """``captures`` with listed, category, entry_scope, entry_value and listed_since.

    ``entries`` has scope, value, category, day and action ('add' or 'remove').
    """
    given = {c.lower() for c in captures.columns}
    names = {n: n if n not in given else fresh(captures, n)[0] for n in OUTPUT}
    known = entries.where(F.col("scope").isin(*SCOPES) & F.col("action").isin("add", "remove")
                          ).select("scope", F.lower("value").alias("value"), "category",
                                   F.col("day").cast("date").alias("day"), "action"
                                   ).where("value IS NOT NULL AND category IS NOT NULL "
                                           "AND day IS NOT NULL")
    spans = intervals(known)
    host, hit = fresh(captures, "host", "hit")
    caps = captures.withColumn(host, F.when(F.col(day_col).isNotNull(), host_of(F.col(url_col))))
    out = caps.where(F.col(host).isNotNull())
    day = F.col(day_col).cast("date")

    def best(verdicts: DataFrame, *by: str) -> DataFrame:
        return verdicts.groupBy(*by).agg(F.min(F.struct(
            "category", "scope", "value", "since")).alias("best"))

    # hosts and their domains
    pairs = out.select(F.col(host).alias("host"), day.alias("day")).distinct()
    keys = pairs.select("host", "day", F.explode(F.expr(
        f"array_union(transform({_domains('host')}, d -> concat('domain ', d)), "
        "array(concat('host ', host)))")).alias("key"))
    ruled = _in_force(keys.select("key", "day").distinct(),
                      spans.where("scope <> 'prefix'").select(
                          F.concat_ws(" ", "scope", "value").alias("key"), "category",
                          "valid_from", "valid_to"))
    by_host = best(keys.join(ruled, ["key", "day"]).select(
        "host", "day", "category", "since", F.split_part("key", F.lit(" "), F.lit(1)).alias("scope"),
        F.split_part("key", F.lit(" "), F.lit(2)).alias("value")), "host", "day")
    found = [by_host.select(F.col("host").alias("k"), F.col("day").alias("d"), "best")]
    on = [F.col(host)]
    # path prefixes of the depths that the list uses, however deep, in one table of probes
    depths = [r["n"] for r in spans.where("scope = 'prefix'").select(
        (F.size(F.split("value", "/")) - 1).alias("n")).distinct().orderBy("n").collect()]
    if depths:
        pre = prefixes_of(F.col(url_col), depths)
        probes = out.select(F.explode(pre).alias("key"), day.alias("day")).distinct()
        active = _in_force(probes, spans.where("scope = 'prefix'").select(
            F.col("value").alias("key"), "category", "valid_from", "valid_to"))
        by_prefix = best(active.select("key", "day", "category", "since", F.lit("prefix").alias("scope"),
                                       F.col("key").alias("value")), "key", "day")
        # the verdict of a URL's longest list of prefixes: from its probes, a row per (deepest path, day)
        paths = out.select(F.array_join(pre, " ").alias("p"), pre.alias("keys"), day.alias("day")).where(
            "p <> ''").select("p", "keys", "day").distinct()
        by_path = paths.select("p", "day", F.explode("keys").alias("key")).join(
            by_prefix, ["key", "day"]).groupBy("p", "day").agg(F.min("best").alias("best"))
        found.append(by_path.select(F.col("p").alias("k"), F.col("day").alias("d"), "best"))
        # a URL without a path is matched by nothing, and its key is not shared by a whole day
        joined = F.array_join(pre, " ")
        on.append(F.when(joined != "", joined).otherwise(F.concat(F.col(host), F.lit("//"))))
    hits = []
    for i, (verdict, key) in enumerate(zip(found, on, strict=True)):
        name = f"{hit}{i}"
        hits.append(name)
        keyed = f"{hit}k{i}"
        out = out.withColumn(keyed, key)
        v = verdict.select(F.col("k").alias(keyed), F.col("d").alias(f"{hit}d{i}"),
                           F.col("best").alias(name))
        out = out.join(v, (out[keyed] == v[keyed]) & (day == v[f"{hit}d{i}"]), "left").drop(
            keyed, f"{hit}d{i}")
    chosen = F.array_min(F.filter(F.array(*hits), lambda s: s.isNotNull()))
    out = out.withColumn(hit, chosen).drop(*hits)
    lost = caps.where(F.col(host).isNull()).withColumn(
        hit, F.lit(None).cast(out.schema[hit].dataType))
    both = out.unionByName(lost)
    made = {"listed": F.col(hit).isNotNull(), "category": F.col(f"{hit}.category"),
            "entry_scope": F.col(f"{hit}.scope"), "entry_value": F.col(f"{hit}.value"),
            "listed_since": F.col(f"{hit}.since")}
    return both.withColumns({names[n]: c for n, c in made.items()}).drop(host, hit)
