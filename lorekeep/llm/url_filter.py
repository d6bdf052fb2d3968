"""URL filters by a temporal list join, in DataFrame functions alone.

List entries are dated events: an entry is added to a list or removed from it. Between an addition
and the next event of its entry it is active: a validity interval [from, to). Each capture offers
the keys it can match (its host, every parent domain, host and first path segment); an as-of join
finds the entries of those keys that were active when it was fetched.

Plan: intervals are clipped to the time that captures span and cut at the edges of time blocks, the
widest that fit: buckets of BUCKET_SECONDS, of FAN times that, and so on, so that even one of an
hour and one of a thousand years are a few blocks per level. A capture asks for its block of each
level. So the join is an equality of (key, level, block, salt) with a range check inside, and its
work stays in proportion to both sides however long a key's history is or however far one capture
lies from the others. Captures carry a salt of their id and intervals are copied to every salt:
a domain with a third of all captures is dealt over SALTS tasks. What the join finds is reduced by
capture with partial aggregation. Spark broadcasts the intervals only where it has measured them to
be under its threshold.

Defined results: a capture without a url, host or time matches nothing (allowed, no lists); events
without list, key, action or time are ignored; repeated events count once; at equal times a removal
wins over an addition; empty lists allow everything; repeated captures (same id) are reported as
one row with what any of them matches, those without an id as a row each; user names and passwords
before a host are no part of it, and an IPv6 address in brackets is a host; urls of any length are
read whole; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

SALTS = 16
#: Width of a time bucket.
BUCKET_SECONDS = 30 * 86_400
#: Buckets of one level that make one of the next.
FAN = 8
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host(url: Column) -> Column:
    """The host in lower case, null if the url has none."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(found != "", found)


def keys(url: Column) -> Column:
    """The keys that a url can match: host, parent domains of two labels or more, host/segment."""
    labels = F.split(host(url), r"\.")
    size = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, size), "."))
    segment = F.lower(F.regexp_extract(url, _SEGMENT, 1))
    whole = F.when(segment != "", F.array(F.concat_ws("/", host(url), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host(url).isNotNull(), F.array_distinct(F.concat(domains, whole)))


def intervals(events: DataFrame) -> DataFrame:
    """events(list, key, action add/remove, at) -> list, key, valid_from, valid_to (null: still active)."""
    events = (
        events.where(F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
        .groupBy("list", "key", "at").agg(F.max("action").alias("action"))
    )
    then = Window.partitionBy("list", "key").orderBy("at")
    return (
        events.withColumn("valid_to", F.lead("at").over(then)).where(F.col("action") == "add")
        .select("list", "key", F.col("at").alias("valid_from"), "valid_to")
    )


def blocks(low: Column, high: Column, top: int) -> Column:
    """The buckets low to high - 1 as the fewest aligned blocks of FAN^level buckets, up to level ``top``: (level, block)."""
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    inner = lambda k: (F.ceil(low / F.lit(FAN**k)).cast("long"), F.floor(high / F.lit(FAN**k)).cast("long"))
    of_level = lambda k: lambda x: F.struct(F.lit(k).alias("level"), x.alias("block"))
    found = []
    for k in range(top + 1):
        a, b = inner(k)
        whole = run(a, b)
        if k < top:
            c, d = inner(k + 1)
            whole = F.when(c < d, F.concat(run(a, c * FAN), run(d * FAN, b))).otherwise(whole)
        found.append(F.transform(whole, of_level(k)))
    return F.concat(*found)


def temporal_list_join(captures: DataFrame, events: DataFrame, salts: int = SALTS, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """captures(id, url, at) with epoch seconds -> id, blocked, n_lists, n_matches, lists."""
    bucket = lambda c: F.floor(c / F.lit(bucket_seconds)).cast("long")
    first, last = captures.agg(F.min("at"), F.max("at")).first()  # one row
    if first is None:
        first = last = 0
    top = 0
    while FAN ** (top + 1) <= (last - first) // bucket_seconds + 1:
        top += 1
    active = (
        intervals(events)
        .withColumn("until", F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last)))
        .withColumn("since", F.greatest("valid_from", F.lit(first)))
        .where(F.col("since") <= F.col("until"))
        .withColumn("b", F.explode(blocks(bucket(F.col("since")), bucket(F.col("until")) + 1, top)))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .select("list", "key", "valid_from", "valid_to", "b.level", "b.block", "salt")
    )
    row = F.when(F.col("id").isNull(), F.monotonically_increasing_id())  # captures without an id are told apart
    offered = (
        captures.select("id", "at", "url", row.alias("row"))
        .select("id", "row", "at", F.explode_outer(keys(F.col("url"))).alias("key"), F.pmod(F.xxhash64("id", "row"), F.lit(salts)).cast("int").alias("salt"))
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
        .withColumn("block", F.floor(bucket(F.col("at")) / F.pow(F.lit(FAN), F.col("level"))).cast("long"))
    )
    at = offered["at"]
    hit = (
        (offered["key"] == active["key"]) & (offered["level"] == active["level"]) & (offered["block"] == active["block"]) & (offered["salt"] == active["salt"])
        & (at >= active["valid_from"]) & (active["valid_to"].isNull() | (at < active["valid_to"]))
    )
    return (
        offered.join(active, hit, "left").groupBy(offered["id"], offered["row"])
        .agg(F.count("list").alias("n_matches"), F.collect_set("list").alias("lists"))
        .select("id", (F.col("n_matches") > 0).alias("blocked"), F.size("lists").cast("long").alias("n_lists"), "n_matches", F.array_join(F.array_sort("lists"), ",").alias("lists"))
    )


#: The query's timeline: captures are fetched STEP_SECONDS apart, in the order of their ids modulo SPAN.
START, STEP_SECONDS, SPAN = 1_704_067_200, 600, 100_000_000


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("id"), "url", (F.lit(START) + F.pmod("page_id", F.lit(SPAN)) * STEP_SECONDS).alias("at"))


def page_events(pages: DataFrame) -> DataFrame:
    """Dated entries about the hosts and languages that the pages show, spread by digits of their md5."""
    hosts = pages.select(host(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()
    digit = lambda c, i: F.conv(F.substring(F.md5(c), i, 2), 16, 10).cast("long")
    dated = lambda source, name, action, i, shift, when: source.where(when).select(
        F.lit(name).alias("list"), "key", F.lit(action).alias("action"), (F.lit(START) + (digit(F.col("key"), i) + shift) * 86_400).alias("at")
    )
    own = hosts.select(F.col("host").alias("key"))
    parent = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("key")).where("key <> ''").distinct()
    path = hosts.select(F.concat("host", F.lit("/de")).alias("key"))
    return (
        dated(own, "malware", "add", 1, 0, digit(F.col("key"), 9) < 96)
        .unionByName(dated(own, "malware", "remove", 1, 20, digit(F.col("key"), 9) < 96))
        .unionByName(dated(own, "malware", "add", 1, 60, digit(F.col("key"), 9) < 48))
        .unionByName(dated(parent, "parked", "add", 3, -200, F.lit(True)))
        .unionByName(dated(parent, "parked", "remove", 3, -190, F.lit(True)))
        .unionByName(dated(path, "adult", "add", 5, 0, digit(F.col("key"), 11) < 128))
    )


def op7_url_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    found = temporal_list_join(page_captures(pages), page_events(pages))
    return found.select(F.col("id").alias("page_id"), "blocked", "n_lists", "n_matches", "lists")


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, 1704067200 + (page_id % 100000000 + 100000000) % 100000000 * 600 AS ts, lower(url) AS url,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)', 1)), '') AS host,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)), '') AS segment
  FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL),
named AS (
  SELECT 'own' AS kind, host AS key FROM hosts
  UNION ALL SELECT DISTINCT 'parent', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM hosts WHERE regexp_matches(host, '[^.]+\.[^.]+$')
  UNION ALL SELECT 'path', host || '/de' FROM hosts),
digits AS (
  SELECT kind, key, list_transform([1, 3, 5, 9, 11], lambda i: ('0x' || substr(md5(key), i, 2))::BIGINT) AS d FROM named),
events AS (
  SELECT 'malware' AS list, key, 'add' AS action, 1704067200 + d[1] * 86400 AS ts FROM digits WHERE kind = 'own' AND d[4] < 96
  UNION ALL SELECT 'malware', key, 'remove', 1704067200 + (d[1] + 20) * 86400 FROM digits WHERE kind = 'own' AND d[4] < 96
  UNION ALL SELECT 'malware', key, 'add', 1704067200 + (d[1] + 60) * 86400 FROM digits WHERE kind = 'own' AND d[4] < 48
  UNION ALL SELECT 'parked', key, 'add', 1704067200 + (d[2] - 200) * 86400 FROM digits WHERE kind = 'parent'
  UNION ALL SELECT 'parked', key, 'remove', 1704067200 + (d[2] - 190) * 86400 FROM digits WHERE kind = 'parent'
  UNION ALL SELECT 'adult', key, 'add', 1704067200 + d[3] * 86400 FROM digits WHERE kind = 'path' AND d[5] < 128),
spans AS (
  SELECT list, key, action, ts AS valid_from, lead(ts) OVER (PARTITION BY list, key ORDER BY ts) AS valid_to FROM events),
labels AS (SELECT page_id, ts, segment, host, string_split(host, '.') AS parts FROM captures WHERE host IS NOT NULL),
keyed AS (
  SELECT DISTINCT page_id, ts, key FROM (
    SELECT page_id, ts, unnest(list_transform(range(1, greatest(len(parts) - 1, 1) + 1), lambda i: array_to_string(parts[i:], '.'))) AS key FROM labels
    UNION ALL SELECT page_id, ts, host || '/' || segment FROM labels WHERE segment IS NOT NULL)),
hits AS (
  SELECT k.page_id, count(*) AS n_matches, count(DISTINCT list) AS n_lists, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM keyed k JOIN spans s ON k.key = s.key AND s.action = 'add' AND k.ts >= s.valid_from AND (s.valid_to IS NULL OR k.ts < s.valid_to)
  GROUP BY k.page_id)
SELECT c.page_id, n_matches IS NOT NULL AS blocked, coalesce(n_lists, 0) AS n_lists, coalesce(n_matches, 0) AS n_matches, coalesce(lists, '') AS lists
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id
"""
