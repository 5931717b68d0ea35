"""URL filtering against lists as they stood when a page was fetched.

Dated list entries (a rule is added or removed on a day) become validity
intervals per rule.  A capture is held against its own address, its host, every
parent domain and every path prefix, each by an as-of join: the interval of
that rule which holds the fetch day, if any.

The as-of join is an equi-join on (rule, period): an interval is repeated for
each period of ``PERIOD_DAYS`` it touches, within the captures' own days, so a
capture meets only the intervals of its rule in its period, however long the
rule's history is.  Captures with the same address and day are judged once.

Scale: a host with a third of all captures is a hot key of a plain inner join,
whose partitions adaptive execution splits; nothing is broadcast by hand.

Defined results: an address without a host is held against itself alone; an empty
step of a path is no step; very long addresses are read whole; a capture with a
null address or day matches no rule; entries
with a null rule or day are ignored; of entries of one rule and day a removal
wins; repeated rows are judged alike and all returned; extra columns are not
read; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 64


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    """The path, without query and fragment; at least a slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def rules_of(url: Column) -> Column:
    """Every rule that could match: url, host, parent domains, path prefixes."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n), "."))
    )
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: i <= F.size(steps)),
        lambda i: F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
    )
    own = F.array(F.concat(F.lit("url:"), url), F.concat(F.lit("host:"), host))
    return F.when(host == "", F.array(F.concat(F.lit("url:"), url))).otherwise(F.array_distinct(F.concat(own, domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, action add/remove, day) -> (rule, since, until): until is the first day no longer listed, or null."""
    known = entries.where(F.col("rule").isNotNull() & F.col("day").isNotNull())
    # one state per rule and day: listed unless any entry removes it
    days = known.groupBy("rule", "day").agg(F.max((F.col("action") == "remove").cast("int")).alias("off"))
    over = Window.partitionBy("rule").orderBy("day")
    changes = days.withColumn("was", F.lag("off", 1, 1).over(over)).where(F.col("off") != F.col("was"))
    ends = changes.withColumn("until", F.lead("day").over(over))
    return ends.where(F.col("off") == 0).select("rule", F.col("day").alias("since"), "until")


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PERIOD_DAYS).cast("int")


def matches(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct (url, day) of ``captures`` with each rule active at that day: (url, day, rule)."""
    asked = captures.select("url", "day").where(F.col("url").isNotNull() & F.col("day").isNotNull()).distinct()
    span = asked.agg(F.min("day").alias("first"), F.max("day").alias("last")).head()
    keys = asked.select("url", "day", F.explode(rules_of(F.col("url"))).alias("rule"), _period(F.col("day")).alias("period"))
    first, last = F.lit(span.first), F.lit(span.last)
    if span.first is None:
        return asked.select("url", "day", F.lit("").alias("rule")).where("false")
    inside = listed.where((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first)))
    touched = F.sequence(_period(F.greatest("since", first)), _period(F.least(F.coalesce(F.date_sub("until", 1), last), last)))
    spread = inside.select("rule", "since", "until", F.explode(touched).alias("period"))
    met = keys.join(spread, ["rule", "period"])
    return met.where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))).select("url", "day", "rule")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, day) with n_rules, rules (sorted, by comma) and blocked."""
    found = matches(captures, intervals(entries)).groupBy("url", "day").agg(F.array_sort(F.collect_set("rule")).alias("hit"))
    found = found.select(F.col("url").alias("_u"), F.col("day").alias("_d"), "hit")
    out = captures.select("page_id", "url", "day").join(found, (F.col("url") == F.col("_u")) & (F.col("day") == F.col("_d")), "left")
    n = F.coalesce(F.size("hit"), F.lit(0)).cast("long")
    rules = F.coalesce(F.array_join("hit", ","), F.lit(""))
    return out.select("page_id", "url", "day", F.greatest(n, F.lit(0)).alias("n_rules"), rules.alias("rules"), F.col("hit").isNotNull().alias("blocked"))
