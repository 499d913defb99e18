"""URL filters: a temporal list join.

A list changes over time: each dated entry says what holds for a pattern from then on.  Entries become validity
intervals, and every capture is judged by the entries that were active when it was fetched.  Everything here is
DataFrame operations.

The as-of join is an equi-join: an interval is listed under every period with captures that it touches, a capture under
its own, so that a host with a third of all captures and a pattern with very many entries meet period by period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a period.
PERIOD = 30 * 86400

#: What an entry does to its pattern; if several are dated alike, the first of these counts.
ACTIONS = ("block", "allow", "lift")


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def patterns_of(url: Column) -> Column:
    """What a list may name a capture by: its host, every parent domain of two labels at least, and host/first folder."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folder = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]+)", 1)
    both = F.when(folder != "", F.array_append(parents, F.concat(host, folder))).otherwise(parents)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def listed_pattern(pattern: Column) -> Column:
    """A listed pattern as captures are named: the host in lower case, the folder as it is."""
    p = F.trim(pattern.cast("string"))
    return F.concat(F.lower(F.regexp_extract(p, "^[^/]*", 0)), F.regexp_extract(p, "^[^/]*(/.*)$", 1))


def intervals(entries: DataFrame, pattern: str = "pattern", action: str = "action", listed_at: str = "listed_at", period: int = PERIOD) -> DataFrame:
    """(pattern, action, start, stop): start included, stop excluded or null; lifted times are left out.

    Entries without a pattern or date, or with an unknown action, are ignored."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    e = entries.select(listed_pattern(F.col(pattern)).alias("pattern"), F.lower(F.col(action).cast("string")).alias("action"), F.col(listed_at).cast("timestamp").alias("start"))
    e = e.filter(F.col("pattern").isNotNull() & F.col("start").isNotNull() & F.col("action").isin(*ACTIONS))
    e = e.groupBy("pattern", "start").agg(F.min_by("action", rank).alias("action")).withColumn("period", F.floor(F.unix_timestamp("start") / period))
    # the next entry stands in the same period, or is the first of the next period that has any
    firsts = e.groupBy("pattern", "period").agg(F.min("start").alias("first"))
    firsts = firsts.select("pattern", "period", F.lead("first").over(Window.partitionBy("pattern").orderBy("period")).alias("next_first"))
    e = e.withColumn("within", F.lead("start").over(Window.partitionBy("pattern", "period").orderBy("start"))).join(firsts, ["pattern", "period"])
    return e.select("pattern", "action", "start", F.coalesce("within", "next_first").alias("stop")).filter("action <> 'lift'")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched_at", pattern: str = "pattern", action: str = "action", listed_at: str = "listed_at", period: int = PERIOD) -> DataFrame:
    """(id, url, fetched_at, n_captures, host, pattern, action, listed_at, kept), one row a distinct capture.

    The longest pattern with an active entry decides (its text breaks ties): `block` drops the capture, `allow` keeps
    it, and a capture that no active entry names is kept, with null pattern, action and date.  Repeated captures
    are counted in n_captures.  A null or relative URL has no host and no pattern and is kept, as is a capture
    without a fetch time.  Hosts are compared without case, folders with it; URLs of any length are read whole.  Empty captures give an empty result; an empty list keeps everything.  Other columns are
    ignored, whatever their names.
    """
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(fetched_col).cast("timestamp").alias("fetched_at"))
    c = c.groupBy("id", "url", "fetched_at").agg(F.count("*").alias("n_captures"))
    named = c.withColumn("period", F.floor(F.unix_timestamp("fetched_at") / period)).withColumn("pattern", F.explode_outer(patterns_of(F.col("url"))))
    span = intervals(entries, pattern, action, listed_at, period)
    # an interval is listed under the periods that have captures, of which there are 122,000 from year 1 to year 9999
    fetched = c.agg(F.sort_array(F.collect_set(F.floor(F.unix_timestamp("fetched_at") / period))).alias("periods"))  # one row
    first, final = F.floor(F.unix_timestamp("start") / period), F.floor(F.unix_timestamp("stop") / period)
    touched = F.filter("periods", lambda p: (p >= first) & (F.col("stop").isNull() | (p <= final)))
    span = span.join(F.broadcast(fetched), F.size("periods") > 0)
    span = span.select("pattern", "action", "start", "stop", F.explode(touched).alias("period")).select("pattern", "period", "action", "start", "stop")
    active = (F.col("start") <= F.col("fetched_at")) & (F.col("stop").isNull() | (F.col("fetched_at") < F.col("stop")))
    named = named.join(span, ["pattern", "period"], "left")
    best = F.max(F.when(active, F.struct(F.length("pattern").alias("length"), "pattern", "action", F.col("start").alias("listed_at"))))
    out = named.groupBy("id", "url", "fetched_at", "n_captures").agg(best.alias("best"))
    return out.select("id", "url", "fetched_at", "n_captures", host_of(F.col("url")).alias("host"), "best.pattern", "best.action", "best.listed_at", (F.coalesce(F.col("best.action"), F.lit("allow")) != "block").alias("kept"))
