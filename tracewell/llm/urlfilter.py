"""URL filtering against dated lists: a temporal join in plain DataFrame operations.

Lists change: a host, domain or URL prefix is added on one day and may be removed on
another.  Dated entries become validity intervals, and every capture is judged by the
entries that were active when it was fetched, not by today's list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Path segments that a prefix entry may have.
SEGMENTS = 3
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"
FOREVER = "9999-12-31"


def host_of(url: str) -> F.Column:
    """The host in lower case; empty if the text is no URL, null if it is null."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def validity(entries: DataFrame) -> DataFrame:
    """Entries ``(list, kind, value, action, day)`` to intervals ``(list, kind, value,
    valid_from, valid_to)``, the end excluded.

    An entry holds from its day to the next entry's of the same list, kind and value;
    ``add`` opens an interval, anything else closes it; the last stays open.  Of several
    entries of one day the removal counts, repeated entries count once, and entries with a
    null value or day never hold.  A value has at most one row a day by then, so the window
    below stays small however often an entry is repeated.
    """
    known = entries.where(F.col("value").isNotNull() & F.col("day").isNotNull())
    daily = known.groupBy("list", "kind", "value", "day").agg(F.min(F.col("action").eqNullSafe("add")).alias("adds"))
    after = F.lead("day").over(Window.partitionBy("list", "kind", "value").orderBy("day"))
    spans = daily.withColumn("valid_to", F.coalesce(after, F.lit(FOREVER).cast("date")))
    return spans.where("adds").select("list", "kind", F.lower("value").alias("value"), F.col("day").alias("valid_from"), "valid_to")


def lookup_keys(url: str) -> F.Column:
    """Array of ``(kind, value)`` under which a URL may be listed: its host, every domain
    above or equal to it, and host with one to SEGMENTS segments of the path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")),
    )
    parts = F.filter(F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/"), lambda x: x != "")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(SEGMENTS)), lambda i: i <= F.size(parts)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("value")),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return F.when(host != "", F.concat(own, domains, prefixes))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """``captures`` with ``n_active`` (entries active and matching when fetched), ``first_rule``
    (least ``list/kind/value`` of them) and ``blocked``; columns of these names are replaced.

    Each distinct URL and day is judged once: its lookup keys meet the intervals of the same
    key in an equality join that also tests the day.  A null or odd URL matches nothing, a
    null day meets no active entry.  Every capture keeps a row, repeated ones too.  A host
    with very many captures is spread over tasks by adaptive execution, in both joins.
    """
    spans = validity(entries)
    asked = captures.select(F.col(url_col).alias("_url"), F.col(day_col).alias("_day")).distinct()
    keys = asked.where(F.col("_day").isNotNull()).select("_url", "_day", F.explode(lookup_keys("_url")).alias("_key"))
    active = (
        keys.join(spans, (F.col("_key.kind") == F.col("kind")) & (F.col("_key.value") == F.col("value")))
        .where((F.col("_day") >= F.col("valid_from")) & (F.col("_day") < F.col("valid_to")))
        .groupBy("_url", "_day")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.concat_ws("/", "list", "kind", "value")).alias("_rule"))
    )
    joined = captures.join(active, (captures[url_col] == F.col("_url")) & (captures[day_col] == F.col("_day")), "left")
    count = F.coalesce("_n", F.lit(0).cast("long"))
    own = [captures[c] for c in captures.columns if c not in ("n_active", "first_rule", "blocked")]
    return joined.select(*own, count.alias("n_active"), F.col("_rule").alias("first_rule"), (count > 0).alias("blocked"))
