"""URL filters as a temporal list join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: str):
    """Lower-case host of column ``url``; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, start, end): when each domain is on each list, from dated entries (list, domain, action, day).

    An entry holds until the next one of its list and domain; ``add`` puts the domain on, any other action takes it off. The end
    is exclusive, null if open. Of entries of one day the removals win. Entries with a null list, domain or day are ignored.
    """
    known = entries.where("list is not null and domain is not null and day is not null")
    daily = known.groupBy("list", F.lower("domain").alias("domain"), "day").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    ends = F.lead("day").over(Window.partitionBy("list", "domain").orderBy("day"))
    return daily.withColumn("end", ends).where("on = 1").select("list", "domain", F.col("day").alias("start"), "end")


def states(spans: DataFrame) -> DataFrame:
    """(domain, day, lists): the lists that hold each domain from a day on, at every day where that changes."""
    days = spans.select("domain", F.col("start").alias("day")).unionByName(spans.where("end is not null").select("domain", F.col("end").alias("day"))).distinct()
    active = F.when((F.col("start") <= F.col("day")) & (F.col("end").isNull() | (F.col("day") < F.col("end"))), F.col("list"))
    return days.join(spans, "domain").groupBy("domain", "day").agg(F.array_sort(F.collect_set(active)).alias("lists"))


def listed(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", salts: int = 16) -> DataFrame:
    """(id, host, fetched, lists, n_lists): for every capture, the lists whose entry for its host or a parent domain is active at fetch time.

    An as-of join: validity intervals become the states of each domain, states and captures of a domain are put in order of time, and
    each capture takes the last state before it, carried forward in one pass. A capture has as many domains as its host has
    labels. Captures of a domain are dealt over ``salts`` parts, to each of which its states, few, are copied, so that a
    frequent host or parent is no single task's. Bare last labels are left out unless the lists hold one.

    A null or malformed url has a null host and no list; a null time matches no interval. Repeated rows and null ids come
    back once for each row. An empty table of captures gives none, an empty list matches nothing.
    """
    # numbered once: both uses below read the same numbers
    rows = cut(captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), host(url_col).alias("host"), F.col(time_col).alias("fetched")))
    spans = cut(intervals(entries))
    least = 1 if not spans.where(~F.col("domain").contains(".")).isEmpty() else 2
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - (least - 1), F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    found = rows.where("host is not null and fetched is not null").select(F.explode(suffixes).alias("domain"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), F.col("fetched").alias("at"), "row", F.lit(None).cast("array<string>").alias("lists"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    known = states(spans).select("domain", copies, F.col("day").cast(rows.schema["fetched"].dataType).alias("at"), F.lit(None).cast("long").alias("row"), "lists")
    # a state holds from its day on: before the captures of the same time
    order = Window.partitionBy("domain", "salt").orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = found.unionByName(known).withColumn("lists", F.last("lists", ignorenulls=True).over(order))
    met = carried.where("row is not null and size(lists) > 0").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("lists"))
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    return rows.join(met, "row", "left").select("id", "host", "fetched", lists.alias("lists"), F.size(lists).alias("n_lists"))


def given_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the given pages, which come without a list, by rules on the domains that occur.

    bulk: every site (the last three labels of a host) is added and taken off on days that depend on its name's length. spam: names
    with casino, bets or pills, from 1 February on, off in May, back from 1 August. zone: example.org, in June.
    """
    sites = pages.select(F.regexp_extract(host("url"), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain")).where("domain <> ''").distinct()
    day = lambda shift: F.date_add(F.lit("2024-01-01").cast("date"), shift)
    n = F.length("domain")
    bulk = [("bulk", "add", day((n * 7) % 180)), ("bulk", "remove", day(180 + (n * 3) % 90))]
    spam = [("spam", a, F.lit(d).cast("date")) for a, d in (("add", "2024-02-01"), ("remove", "2024-05-01"), ("add", "2024-08-01"))]
    zone = [("zone", a, F.lit(d).cast("date")) for a, d in (("add", "2024-06-01"), ("remove", "2024-07-01"))]
    entry = lambda rules: F.explode(F.array(*[F.struct(F.lit(k).alias("list"), F.lit(a).alias("action"), d.alias("day")) for k, a, d in rules]))
    root = pages.sparkSession.range(1).select(F.lit("example.org").alias("domain"))
    parts = [sites.select("domain", entry(bulk).alias("e")), sites.where("domain rlike 'casino|bets|pills'").select("domain", entry(spam).alias("e")), root.select("domain", entry(zone).alias("e"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("e.list", "domain", "e.action", "e.day")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    found = listed(captures, given_entries(pages))
    return found.select(F.col("id").alias("page_id"), "host", F.col("fetched").cast("string").alias("fetched"), F.array_join("lists", ",").alias("lists"), "n_lists", (F.col("n_lists") > 0).alias("blocked"))


OP9_SQL = r"""
WITH captures AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched
  FROM pages
), sites AS (
  SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS domain FROM captures
), entries AS (
  SELECT 'bulk' AS list, domain, 'add' AS action, DATE '2024-01-01' + CAST((length(domain) * 7) % 180 AS INTEGER) AS day FROM sites WHERE domain <> ''
  UNION ALL
  SELECT 'bulk', domain, 'remove', DATE '2024-01-01' + CAST(180 + (length(domain) * 3) % 90 AS INTEGER) FROM sites WHERE domain <> ''
  UNION ALL
  SELECT 'spam', domain, a, CAST(d AS DATE) FROM sites, (VALUES ('add', '2024-02-01'), ('remove', '2024-05-01'), ('add', '2024-08-01')) AS v(a, d)
  WHERE regexp_matches(domain, 'casino|bets|pills')
  UNION ALL
  SELECT 'zone', 'example.org', a, CAST(d AS DATE) FROM (VALUES ('add', '2024-06-01'), ('remove', '2024-07-01')) AS v(a, d)
), spans AS (
  SELECT list, domain, action, day AS start, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS stop FROM entries
), hits AS (
  SELECT DISTINCT c.page_id, s.list
  FROM captures c JOIN spans s ON (c.host = s.domain OR suffix(c.host, '.' || s.domain))
  WHERE s.action = 'add' AND c.fetched >= s.start AND (s.stop IS NULL OR c.fetched < s.stop)
), lists AS (
  SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists, CAST(count(*) AS INTEGER) AS n_lists FROM hits GROUP BY page_id
)
SELECT c.page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(l.lists, '') AS lists, coalesce(l.n_lists, 0) AS n_lists, coalesce(l.n_lists, 0) > 0 AS blocked
FROM captures c LEFT JOIN lists l USING (page_id)
"""
