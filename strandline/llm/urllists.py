"""URL filters by a temporal list join, with DataFrame functions only.

A list is a log of dated changes: entry `host` (a host or a domain above it) is added or removed `at` a time. The
changes of an entry become validity intervals [since, until) of its additions; a capture (url, fetched) is listed if
an entry for its host or for a domain above it is active when it was fetched.

Captures are first reduced to their distinct (host, fetch time), so a host with most of the pages costs one row for
each time. Of each distinct host only the suffixes that are on the list at all go on; suffixes of one label, which half
of all hosts may share, are salted for that. The others are joined as-of to the intervals, and the verdicts go back by an
equi-join. Every join is between plain exchanges, which adaptive execution can split; Catalyst broadcasts the list only
below its size threshold.

Cases: a null or hostless url, or a null fetch time, is never listed (no verdict: 0 entries); of changes of one entry
at one time the removal counts; a repeated addition changes nothing; changes with a null host or time are ignored;
an empty list lists nothing; an empty table gives an empty result; repeated captures stay separate; all columns of the
captures are kept, and where one has a name of the result's (listed, n_entries, lists), the result's gets a leading
underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The lower-cased host of a url without user, port and final dot; null if it has none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(authority, r"\.+$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and each domain above it, as an array."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """(list, host, since, until) from changes (list, host, at, added): until is null while the entry stands."""
    dated = changes.filter("host IS NOT NULL AND at IS NOT NULL").select("list", F.lower("host").alias("host"), "at", F.coalesce("added", F.lit(False)).alias("added"))
    last = dated.groupBy("list", "host", "at").agg(F.min("added").alias("added"))
    entry = Window.partitionBy("list", "host").orderBy("at")
    turns = last.withColumn("before", F.lag("added", 1, False).over(entry)).filter(F.col("added") != F.col("before"))
    return turns.withColumn("until", F.lead("at").over(entry)).filter("added").select("list", "host", F.col("at").alias("since"), "until")


#: Parts into which the hosts under a suffix of one label are dealt.
SALTS = 32


def _free(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def listed_suffixes(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, host) for each host `name` and each entry `host` that is it or a domain above it."""
    one_label = ~F.contains("host", F.lit("."))
    wide = hosts.select("name", F.explode(suffixes(F.col("name"))).alias("host"))
    wide = wide.withColumn("salt", F.when(one_label, F.pmod(F.xxhash64("name"), F.lit(SALTS))).otherwise(0))
    salted = entries.select("host").distinct().withColumn("salt", F.explode(F.when(one_label, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return wide.join(salted, ["host", "salt"], "left_semi").select("name", "host")


def verdicts(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """`captures` with `listed`, `n_entries` (active entries that match) and `lists` (their lists, sorted, comma-joined)."""
    name, at, listed, n_entries, lists = (_free(x, captures.columns) for x in ("_name", "_at", "listed", "n_entries", "lists"))
    named = captures.withColumn(name, host_of(F.col(f"`{url}`"))).withColumn(at, F.col(f"`{fetched}`"))
    asked = named.select(F.col(name).alias("name"), F.col(at).alias("at")).filter("name IS NOT NULL AND at IS NOT NULL").distinct()
    entries = intervals(changes)
    met = asked.join(listed_suffixes(asked.select("name").distinct(), entries), "name").join(entries, "host")
    active = met.filter((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    verdict = active.groupBy(F.col("name").alias(name), F.col("at").alias(at)).agg(F.count("*").alias(n_entries), F.array_join(F.sort_array(F.collect_set("list")), ",").alias(lists))
    out = named.join(verdict, [name, at], "left")
    own = [F.col(f"`{c}`") for c in captures.columns]
    return out.select(*own, F.col(n_entries).isNotNull().alias(listed), F.coalesce(n_entries, F.lit(0)).alias(n_entries), F.coalesce(lists, F.lit("")).alias(lists))
