"""Operator 9: URL filters by a temporal list join, in DataFrame operations alone.

A list is dated entries (pattern, day, action): ``block`` or ``allow`` from that day on, ``drop`` ends the pattern's
entry. Dated entries become validity intervals. A capture's host gives its suffixes; the as-of join finds, for every
suffix, the entry active when the capture was fetched, and the longest suffix decides. A host with a third of all
captures is spread by salt, the intervals being repeated once per salt. Joins carry no cross product: the key is
the suffix, and a pattern has as many intervals as dated entries.

A null url, or one without a host, matches nothing; a null fetch day matches nothing. Of entries of one pattern and
day the last action by name holds. Repeated captures give repeated rows; extra columns are ignored; with an empty list
nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SALTS = 16


def host(url: Column) -> Column:
    """Lower-cased host of a url, without user, port and trailing dot; null if there is none."""
    got = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(got), r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since, until (null: open), action, from dated ``entries(pattern, day, action)``."""
    one = entries.where("pattern is not null and day is not null").groupBy("pattern", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(W.partitionBy("pattern").orderBy("day"))
    return one.select("pattern", F.col("day").alias("since"), until.alias("until"), "action").where("action in ('block', 'allow')")


def apply(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, day, pattern, since, blocked) of each row of ``captures(page_id, url, day)``."""
    rows = captures.select("page_id", host(F.col("url")).alias("host"), "day")
    # captures of one host and day share their answer, so they are joined once
    asked = rows.where("host is not null and day is not null").select("host", "day").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = asked.select("host", "day", F.explode(suffixes).alias("pattern")).withColumn("_salt", F.pmod(F.xxhash64("host", "day"), F.lit(SALTS)).cast("int"))
    spans = intervals(entries).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = asked.join(spans, ["pattern", "_salt"]).where((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = hit.groupBy("host", "day").agg(F.max_by(F.struct("pattern", "since", "action"), F.length("pattern")).alias("_hit"))
    spread = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    best = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", spread).join(best, ["host", "day", "_salt"], "left")
    return out.select("page_id", "host", "day", F.col("_hit.pattern").alias("pattern"), F.col("_hit.since").alias("since"), F.coalesce(F.col("_hit.action") == "block", F.lit(False)).alias("blocked"))


#: The tables have neither fetch days nor a list, so both are derived by rule from ids and hosts: a capture's day is
#: page_id mod 365; the list has each host's entries by the crc of its name, and those of its last two labels.
_DAY = "page_id % 365"


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr(_DAY).alias("day"))
    hosts = pages.select(host(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    site = hosts.select(F.array_join(F.slice(F.split("pattern", r"\."), -2, 2), ".").alias("pattern")).where("pattern like '%.%'").distinct()
    h = F.expr("cast(conv(substr(md5(cast(pattern as binary)), 1, 6), 16, 10) as bigint)")
    dated = lambda d, add, times, action: d.withColumn("_h", h).where("_h % 3 < 2").select("pattern", F.pmod(F.col("_h") * times + add, F.lit(365)).alias("day"), F.lit(action).alias("action"))
    entries = dated(hosts, 0, 1, "block").union(dated(hosts, 150, 3, "drop")).union(dated(hosts, 40, 7, "allow")).union(dated(site, 11, 5, "block")).union(dated(site, 200, 2, "drop"))
    return apply(pages, entries)


OP9_SQL = r"""
WITH c AS (SELECT page_id, page_id % 365 AS day,
        nullif(regexp_replace(lower(regexp_extract(url,
          '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host FROM pages),
h AS (SELECT DISTINCT host AS pattern FROM c WHERE host IS NOT NULL),
s AS (SELECT DISTINCT array_to_string(string_split(pattern, '.')[-2:], '.') AS pattern FROM h WHERE contains(pattern, '.')),
n AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS k, 'h' AS kind FROM h
      UNION ALL SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT, 's' FROM s),
e AS (SELECT pattern, (k * times + plus) % 365 AS day, action
      FROM n JOIN (VALUES ('h', 0, 1, 'block'), ('h', 150, 3, 'drop'), ('h', 40, 7, 'allow'),
                          ('s', 11, 5, 'block'), ('s', 200, 2, 'drop')) v(kind, plus, times, action) USING (kind)
      WHERE k % 3 < 2),
o AS (SELECT pattern, day, max(action) AS action FROM e GROUP BY pattern, day),
i AS (SELECT pattern, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until, action FROM o),
m AS (SELECT c.page_id, i.pattern, i.since, i.action,
        row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.pattern) DESC) AS k
      FROM c JOIN i ON (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern))
        AND c.day >= i.since AND (i.until IS NULL OR c.day < i.until) WHERE i.action IN ('block', 'allow'))
SELECT c.page_id, c.host, c.day, m.pattern, m.since, coalesce(m.action = 'block', false) AS blocked
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.k = 1
"""
