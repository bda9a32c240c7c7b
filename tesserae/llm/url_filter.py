"""URL filters as a temporal list join, in DataFrame operations only.

A list is dated entries: on `effective_at`, `action` ('add' or 'remove') of a rule. A rule is a kind and a key:

- domain: the host or any host below it;
- host: that host only;
- prefix: host and path, up to a `/` or the end; a last `/` of a longer path than `/` doesn't matter, and `host/` is the root page only;
- url: host, path and query.

Entries become validity intervals: an addition holds until the next removal of its rule. A capture is evaluated as of
its fetch time, `valid_from <= fetched_at < valid_to`, against every rule its URL could meet. The most specific active
rule decides (url, prefix, host, domain; then the longer key; then allow before block); without one it is allowed.

The keys that a capture could meet are joined to the intervals by (kind, key); verdicts join back by (url, fetch time).
Both are plain equi-joins with the time as a further condition, so adaptive execution splits hot hosts and URLs, and
neither side is broadcast unless Spark finds it small. Intervals of a rule are merged first and disjoint. Of a URL's path
prefixes and a host's domains only those as deep as some rule are tried, so a URL of any length gives few keys: the depths
are a scalar subquery, no more of them than the longest key has steps.

Defined cases: a null URL or fetch time meets no rule and is allowed; a URL without scheme or host meets no rule;
repeated rows each get a row; of entries of one rule at one time an addition counts; unknown actions, kinds, null keys
and null times are ignored; keys are lowered (the path's case stays), `www.`, ports and user names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: scheme, host, path with query; user name and port are skipped, a fragment too.
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^#]*)"
RANK = {"domain": 1, "host": 2, "prefix": 3, "url": 4}


def host_of(url: Column) -> Column:
    """The lower-case host without a last dot and `www.`; empty if there is none."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.$", ""), r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path and query; a missing path is /."""
    rest = F.regexp_extract(url, URL, 2)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, verdict, valid_from, valid_to (null: still active): disjoint intervals per rule and verdict."""
    rule = ["kind", "key", "verdict"]
    e = entries.select("kind", F.lower(F.substring_index("key", "/", 1)).alias("host"), "key", "verdict", "action", F.col("effective_at").cast("timestamp_ntz").alias("at"))
    e = e.where(F.col("kind").isin(*RANK) & F.col("action").isin("add", "remove") & F.col("verdict").isin("block", "allow") & F.col("key").isNotNull() & F.col("at").isNotNull())
    host = F.regexp_replace(F.regexp_replace("host", r"\.$", ""), r"^www\.", "")
    rest = F.substr("key", F.char_length("host") + 1)
    e = e.withColumn("key", F.concat(host, F.when(F.col("kind") == "prefix", F.regexp_replace(rest, "(?<=[^/])/$", "")).otherwise(rest)))
    e = e.groupBy(*rule, "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    by_time = Window.partitionBy(*rule).orderBy("at")
    changes = e.withColumn("before", F.coalesce(F.lag("on").over(by_time), F.lit(0))).where("on <> before")
    closed = changes.withColumn("valid_to", F.lead("at").over(by_time))
    return closed.where("on = 1").select(*rule, F.col("at").alias("valid_from"), "valid_to")


def depth(kind: Column, key: Column) -> Column:
    """How many labels a domain or steps a prefix has; null for other kinds."""
    return F.when(kind == "domain", F.size(F.split(key, r"\."))).when(kind == "prefix", F.size(F.split(key, "/")) - 1)


def steps_of(path: Column) -> Column:
    return F.split(F.regexp_replace(F.substring_index(path, "?", 1), "^/|/$", ""), "/")


def candidates() -> Column:
    """The (kind, key) of every rule that a URL (host, labels, path, steps) could meet; depths has the (kind, depth) of domain and prefix rules."""
    host, path, labels, steps, depths = map(F.col, ("host", "path", "labels", "steps", "depths"))
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    deep = lambda kind, most: F.transform(F.filter(depths, lambda d: (d["kind"] == kind) & (d["depth"] <= F.size(most))), lambda d: d["depth"])
    suffixes = F.transform(deep("domain", labels), lambda n: pair("domain", F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    prefixes = F.transform(deep("prefix", steps), lambda n: pair("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, n), "/"))))
    return F.when(host != "", F.concat(suffixes, F.array(pair("host", host), pair("url", F.concat(host, path))), prefixes))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """captures with url_verdict ('allow' or 'block'), url_rule_kind and url_rule_key, in place of columns so named."""
    when = F.col(fetched_at).cast("timestamp_ntz")
    rules = intervals(entries)
    known = rules.select("kind", depth(F.col("kind"), F.col("key")).alias("depth"))
    depths = known.where("depth > 0").agg(F.collect_set(F.struct("kind", "depth")).alias("depths")).scalar()
    seen = captures.select(F.col(url).alias("u"), when.alias("t")).where("u is not null and t is not null")
    seen = seen.select("u", "t", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), depths.alias("depths"))
    seen = seen.select("u", "t", "host", "path", "depths", F.split("host", r"\.").alias("labels"), steps_of(F.col("path")).alias("steps"))
    # An outer explode, as for a plain one its array would be made again for a filter that Spark infers.
    asked = seen.select("u", "t", F.explode_outer(candidates()).alias("c")).where("c is not null").select("u", "t", "c.kind", "c.key")
    active = (F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to")))
    met = asked.join(rules, ["kind", "key"]).where(active)
    rank = F.expr("case kind " + " ".join(f"when '{k}' then {v}" for k, v in RANK.items()) + " end")
    best = F.max(F.struct(rank.alias("rank"), F.char_length("key").alias("size"), (F.col("verdict") == "allow").alias("allowed"), "kind", "key"))
    verdicts = met.groupBy("u", "t").agg(best.alias("best"))
    out = [c for c in captures.columns if c not in ("url_verdict", "url_rule_kind", "url_rule_key")]
    c = captures.select(F.struct(*(captures[x] for x in out)).alias("row"), F.col(url).alias("u"), when.alias("t"))
    joined = c.join(verdicts, ["u", "t"], "left")
    return joined.select("row.*", F.when(F.col("best.allowed") | F.col("best").isNull(), "allow").otherwise("block").alias("url_verdict"), F.col("best.kind").alias("url_rule_kind"), F.col("best.key").alias("url_rule_key"))


def keep_allowed(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """captures without those that are blocked as of their fetch time."""
    return evaluate(captures, entries, url, fetched_at).where("url_verdict = 'allow'").select(*captures.columns)
