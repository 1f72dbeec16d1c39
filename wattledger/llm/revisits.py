"""Not-modified revisits of a web archive: an as-of join to the latest earlier full response of the same canonical URL.

A URL may hold a large share of all records, so no window spans a whole URL. Times are cut into ranges; a window runs over
one URL in one range, and what earlier ranges leave behind comes from one row per URL and range (a map-side combined
maximum). Bodies do not travel: records carry their digests, and a revisit gets the id of the response whose body it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of time; a URL with all records of a table still spreads over so many windows.
RANGES = 256
#: Cuts between ranges that are looked at together.
STEP = 16
#: The headers that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Names of query parameters that say where a visitor came from, not what is asked for.
TRACKING = "^(?:utm_.*|gclid|fbclid|msclkid|phpsessid|jsessionid)$"
#: Captures of a page; every tenth page is one of a URL that they share, whose content changes with time.
CAPTURES, HOT_EVERY, HOT_URL = 6, 10, "https://www.hot.example/Start?id=1"


def canonical_url(url: Column) -> Column:
    """Lower case without scheme, `www.` or `m.`, query, fragment, `.html` and last slash; null counts as empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z]+://(?:www\.|m\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)[?#].*$", ""), r"(?:\.html|/)$", "")


def resource_url(url: Column) -> Column:
    """The key of one resource: `canonical_url` without its losses. Only scheme and host are put in lower case, and the query
    stays, by parameter name (equal names in their order), without the parameters in TRACKING.
    """
    text = F.coalesce(url, F.lit(""))
    parts = [F.regexp_extract(text, r"(?s)^([A-Za-z]+://[^/?#]*)?([^?#]*)(?:\?([^#]*))?", k) for k in (1, 2, 3)]
    host, path = F.regexp_replace(F.lower(parts[0]), r"^[a-z]+://(?:www\.|m\.)?", ""), F.regexp_replace(parts[1], r"(?:\.html|/)$", "")
    named = F.transform(F.split(parts[2], "&", -1), lambda p, k: F.struct(F.substring_index(p, "=", 1).alias("name"), k.alias("k"), p.alias("text")))
    kept = F.array_sort(F.filter(named, lambda p: (p["text"] != "") & ~F.lower(p["name"]).rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: p["text"]), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def resolve_revisits(records: DataFrame, ranges: int = RANGES, place: Callable[[Column], Column] = resource_url) -> DataFrame:
    """record_id, outcome, source_id, digest, headers of every revisit.

    `records` has record_id, url, captured (long), kind (response or revisit), etag, last_modified, digest and headers (map,
    lower-case names). The source is the latest response before the revisit, ties by the larger id. It must agree in
    the entity tag (weak comparison) where both have one, else in the date where both have one; with neither it stands.
    Outcome: resolved, mismatch (source_id says with what), or orphan. A resolved revisit has its source's digest
    and headers, with the permitted ones of its own put over them. `place` says which URLs are one; a record whose URL is null
    or has an empty key is no other's, so such revisits are orphans. Records without a time, and of other kinds, take no part.
    Repeated record ids are records of their own. Ranges of time are cut at quantiles, so a few outlying times leave them even.
    """
    key = place(F.col("url"))
    rows = records.filter("captured is not null and kind in ('response', 'revisit')").select(
        F.when(F.coalesce(key, F.lit("")) == "", F.concat(F.lit("\0"), F.col("record_id").cast("string"), F.lit("\0"), "kind")).otherwise(key).alias("place"), "record_id", "captured", "kind", "etag", "last_modified", "digest", "headers")
    # Any cuts give the same result; they are fixed here, as the plan reads the records more than once.
    cuts = rows.agg(F.percentile_approx("captured", [k / ranges for k in range(1, ranges)] or [0.5], 10 * ranges).alias("cuts")).first()["cuts"] or []
    bounds = sorted(set(cuts))[: ranges - 1]

    def array(values: list[int]) -> Column:
        return F.array(*[F.lit(x) for x in values]).cast("array<bigint>")

    def passed(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.col("captured")))

    # First among every STEP-th cut, then among the cuts before the next of these.
    rows = rows.withColumn("range", passed(array(bounds[STEP - 1 :: STEP])) * STEP)
    rows = rows.withColumn("range", F.col("range") + passed(F.slice(array(bounds), F.col("range") + 1, F.lit(STEP))))
    full = F.when(F.col("kind") == "response", F.struct("captured", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("headers")))
    rows = rows.withColumn("full", full)
    left = rows.filter("kind = 'response'").groupBy("place", "range").agg(F.max("full").alias("kept"))
    ahead = Window.partitionBy("place").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    asked = rows.filter("kind = 'revisit'").select("place", "range").distinct()
    carried = left.unionByName(asked.withColumn("kept", F.lit(None)), allowMissingColumns=True).groupBy("place", "range").agg(F.max("kept").alias("kept"))
    carried = carried.withColumn("carried", F.max("kept").over(ahead)).select("place", "range", "carried")
    before = Window.partitionBy("place", "range").orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("near", F.max("full").over(before)).filter("kind = 'revisit'").join(carried, ["place", "range"], "left")
    source = F.coalesce("near", "carried")

    def tag(c: Column) -> Column:
        return F.regexp_replace(c, "^W/", "")

    found = found.withColumn("source", source)
    agrees = F.coalesce(tag(F.col("source.etag")) == tag(F.col("etag")), F.col("source.last_modified") == F.col("last_modified"), F.lit(True))
    outcome = F.when(F.col("source").isNull(), "orphan").when(agrees, "resolved").otherwise("mismatch")
    own = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(list(PERMITTED)))
    old = F.coalesce(F.map_from_entries("source.headers"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    resolved = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "outcome", F.col("source.record_id").alias("source_id"), F.when(resolved, F.col("source.digest")).alias("digest"),
        F.when(resolved, F.map_concat(kept, own)).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Pages as archive records in the order of their ids: every third is a revisit with validators of its own."""
    k, size = F.col("page_id"), F.length(F.coalesce("html", F.lit("")))
    mark = F.concat(F.lit('"'), F.substring(F.md5(canonical_url(F.col("url"))), 1, 8), F.lit("-"), (size % 2).cast("string"), F.lit('"'))
    again = k % 3 == 2
    headers = F.when(again, F.create_map(F.lit("date"), k.cast("string"), F.lit("server"), F.lit("new"))).otherwise(
        F.create_map(F.lit("date"), k.cast("string"), F.lit("server"), F.lit("old"), F.lit("content-type"), F.lit("text/html")))
    return pages.select(
        k.alias("record_id"), "url", k.alias("captured"), F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(k % 5 != 0, F.when(again, F.concat(F.lit("W/"), mark)).otherwise(mark)).alias("etag"),
        F.when(k % 2 == 0, (size % 3).cast("string")).alias("last_modified"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"), headers.alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Six captures of every page, in turns with those of the next pages.

    Two responses (0 and 2; the second has new content) and revisits (1, 3, 4, 5), under several spellings of the URL. For
    every sixteenth page capture 0 is a revisit too, before any response. Revisits have a weak entity tag (3: every fourth page's is
    stale), or only a date (4: every eighth page's is wrong), or nothing (5). On the shared URL tags and dates follow its content.
    """
    k, step = F.col("page_id"), F.col("step")
    hot = k % HOT_EVERY == 0
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("body"), F.explode(F.array(*map(F.lit, range(CAPTURES)))).alias("step"))
    again = step.isin(1, 3, 4, 5) | ((step == 0) & (k % 16 == 5))
    captured = k * 10 + step * 37
    seen = F.when(again, captured - 25).otherwise(captured)
    version = F.when(hot, F.floor(seen / 500)).when((step < 2) | ((step == 3) & (k % 4 == 1)) | ((step == 4) & (k % 8 == 3)), 0).otherwise(1)
    rows = rows.select("page_id", "url", "step", again.alias("again"), captured.alias("captured"), version.cast("long").alias("version"), F.when(hot, "hot").otherwise(F.col("body")).alias("body"))
    url = F.when(hot, HOT_URL).otherwise(F.coalesce("url", F.lit("")))
    spelled = F.when(step == 3, F.concat(url, F.lit("#again"))).when(step == 4, F.regexp_replace(url, "^http:", "https:")).when(
        step == 5, F.regexp_replace(url, r"^([^#?]*)\?", "$1?utm_medium=a&")).otherwise(url)
    digest = F.md5(F.concat_ws("/", "body", F.col("version").cast("string")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 8), F.lit('"'))
    own = F.create_map(F.lit("date"), F.col("captured").cast("string"), F.lit("server"), F.when(F.col("again"), "new").otherwise("old"))
    more = F.create_map(F.lit("content-type"), F.lit("text/html"))
    return rows.select(
        (k * CAPTURES + step).alias("record_id"), spelled.alias("url"), "captured", F.when(F.col("again"), "revisit").otherwise("response").alias("kind"),
        F.when(~F.col("again"), tag).when(step < 4, F.concat(F.lit("W/"), tag)).alias("etag"),
        F.when(~F.col("again") | (step == 4), F.col("version").cast("string")).alias("last_modified"), digest.alias("digest"),
        F.when(F.col("again"), own).otherwise(F.map_concat(own, more)).alias("headers"))


def listed_headers(found: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.withColumn("headers", listed)


def captures_report(pages: DataFrame) -> DataFrame:
    """As `revisit_report`, of every revisit among six captures of each page, where URLs are one only if they are one resource."""
    return listed_headers(resolve_revisits(captures_of_pages(pages)))


def revisit_report(pages: DataFrame) -> DataFrame:
    """record_id, outcome, source_id, digest, headers (text, by name) of every revisit among the records of `pages`."""
    return listed_headers(resolve_revisits(records_of_pages(pages), place=canonical_url))
