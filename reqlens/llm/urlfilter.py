"""URL filters against dated lists: entries become validity intervals, captures meet the entries active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens.llm.common import spread

#: Scheme, user, host, port, path and query of a URL; the fragment is left out. Java and RE2 read it alike.
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
REST = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def url_key(url: Column) -> Column:
    """Host and path with query, without scheme, port, 'www.', fragment and final slash."""
    return F.regexp_replace(F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_extract(F.coalesce(url, F.lit("")), REST, 1)), r"/$", "")


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals [since, until) of dated list entries: kind, entry, since, until (null: open).

    events: kind ('domain', 'host' or 'url'), entry, listed_on date, action ('add' or 'remove'). Of several events of an
    entry on one day, 'remove' holds. An add while listed and a remove while not listed change nothing. Events with a
    null in any column are no events.
    """
    day = events.where("kind IS NOT NULL AND entry IS NOT NULL AND listed_on IS NOT NULL AND action IN ('add', 'remove')")
    day = day.groupBy("kind", "entry", "listed_on").agg(F.min(F.col("action") == "add").alias("on"))
    order = Window.partitionBy("kind", "entry").orderBy("listed_on")
    changes = day.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where(F.col("on") != F.col("was"))
    return changes.withColumn("until", F.lead("listed_on").over(order)).where("on").select("kind", "entry", F.col("listed_on").alias("since"), "until")


def active_on(asked: DataFrame, held: DataFrame) -> DataFrame:
    """As-of join: for each asked (kind, entry, day) the interval that began last by that day, if it has not ended: since, until.

    Days and beginnings stand in one order for each entry, and each day takes the last beginning before it; no day meets
    the other intervals of its entry. asked: distinct rows, so that an entry has as many as there are days, not captures.
    """
    none = F.lit(None).cast("struct<since:date,until:date>")
    begun = held.select("kind", "entry", F.col("since").alias("day"), F.lit(0).alias("turn"), F.struct("since", "until").alias("held"))
    both = begun.unionByName(asked.select("kind", "entry", "day", F.lit(1).alias("turn"), none.alias("held")))
    order = Window.partitionBy("kind", "entry").orderBy("day", "turn")
    last = both.withColumn("held", F.last("held", ignorenulls=True).over(order)).where("turn = 1 AND held IS NOT NULL")
    return last.select("kind", "entry", "day", "held.since", "held.until").where("until IS NULL OR day < until")


def capture_keys(url: Column) -> Column:
    """What a list may name of a URL: its key, its host, and the host with each of its parent domains."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("entry")))
    own = F.array(F.struct(F.lit("url").alias("kind"), url_key(url).alias("entry")), F.struct(F.lit("host").alias("kind"), host.alias("entry")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,entry:string>>")).otherwise(F.concat(own, domains))


def filter_urls(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """Verdict for each capture: id_col, url, host, fetched_on, n_entries (active entries that name it), blocked, and of the
    most specific one (url, host, longest domain) kind, entry, since and until.

    Captures with a null or unparsable URL or a null day are kept, unblocked. Every row is judged, repeated ids too;
    columns of captures beside the three are not read.

    Captures are first reduced to distinct (URL, day), so that a host with a third of all captures meets its list entries
    once for each URL and day. The as-of join (`active_on`) is at the level of (kind, entry, day): entries that many
    captures share (a domain suffix) have as many rows there as days, not captures. Hot URLs are split by `spread`.
    """
    rows = captures.select(F.col(id_col), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("fetched_on")).withColumn("host", host_of(F.col("url")))
    wanted = rows.where("fetched_on IS NOT NULL AND host != ''").select(F.explode(capture_keys(F.col("url"))).alias("k"), "fetched_on").select("k.kind", "k.entry", "fetched_on")
    asked = wanted.withColumnRenamed("fetched_on", "day").distinct()
    active = active_on(asked, intervals(events)).withColumnRenamed("day", "fetched_on")
    rank = F.when(F.col("kind") == "url", 0).when(F.col("kind") == "host", 1).otherwise(2)
    # the verdict of a (URL, day) is that of its keys: one row for each distinct URL and day goes through the second join
    pairs = rows.where("fetched_on IS NOT NULL AND host != ''").groupBy("url", "fetched_on").agg(F.lit(1).alias("one"))
    hits = pairs.select("url", "fetched_on", F.explode(capture_keys(F.col("url"))).alias("k")).select("url", "fetched_on", "k.kind", "k.entry")
    verdicts = (
        spread(hits, active, ["kind", "entry", "fetched_on"])
        .groupBy("url", "fetched_on")
        .agg(F.count(F.lit(1)).alias("n_entries"), F.min(F.struct(rank.alias("rank"), (-F.length("entry")).alias("len"), "kind", "entry", "since", "until")).alias("by"))
    )
    return spread(rows, verdicts, ["url", "fetched_on"], "left").select(
        id_col, "url", "host", "fetched_on", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.col("n_entries").isNotNull().alias("blocked"), "by.kind", "by.entry", "by.since", "by.until"
    )
