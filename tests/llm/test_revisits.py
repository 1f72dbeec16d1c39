"""Revisits against a plain scan over all records."""

import random

import duckdb

from wattledger.llm import checks
from wattledger.llm import revisits as R

SCHEMA = "record_id long, url string, captured long, kind string, etag string, last_modified string, digest string, headers map<string,string>, source_id long"


def plain(rows):
    place = lambda u: "a.com/x" if u and "a.com" in u.lower() else u or None
    out = {}
    for r in rows:
        if r[3] != "revisit" or r[2] is None:
            continue
        earlier = [s for s in rows if s[3] == "response" and s[2] is not None and s[2] < r[2] and place(r[1]) and place(s[1]) == place(r[1])]
        if not earlier:
            out[r[0]] = ("orphan", None, None)
            continue
        s = max(earlier, key=lambda s: (s[2], s[0]))
        tags = [t.removeprefix("W/") if t else None for t in (s[4], r[4])]
        same = tags[0] == tags[1] if all(tags) else s[5] == r[5] if s[5] and r[5] else True
        merged = {**(s[7] or {}), **{k: v for k, v in (r[7] or {}).items() if k in R.PERMITTED}} if same else None
        out[r[0]] = ("resolved" if same else "mismatch", s[0], merged)
    return out


def test_hot_url_ties_and_nulls(spark):
    rng = random.Random(8)
    urls = ["http://A.com/x", "https://www.a.com/x/?q=1", "http://m.a.com/x.html#f", None, "", "b"]
    rows = [
        (k, rng.choice(urls), rng.choice([None, *range(40)]), rng.choice(["response", "revisit", "revisit", "other", None]), rng.choice([None, '"1"', 'W/"1"', '"2"']),
         rng.choice([None, "m", "n"]), f"d{k}", rng.choice([None, {"date": str(k), "server": "s"}, {"etag": "e", "x": str(k)}]), 0)
        for k in range(500)
    ]
    for ranges in (1, 7, 256):
        got = {r.record_id: (r.outcome, r.source_id, r.headers) for r in R.resolve_revisits(spark.createDataFrame(rows, SCHEMA), ranges, R.canonical_url).collect()}
        assert got == plain(rows)
    assert R.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_outlying_time_leaves_the_ranges_of_a_hot_url_even(spark):
    rows = [(k, "http://hot.com/x", 0 if k == 0 else 10**12 + k, ("response", "revisit")[k % 2], f'"{k // 50}"', None, f"d{k}", {}, 0) for k in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.record_id: r.source_id for r in R.resolve_revisits(df, 16).collect()}
    assert out == {k: k - 1 for k in range(1, 4000, 2)}
    cuts = df.agg(R.F.percentile_approx("captured", [k / 16 for k in range(1, 16)], 160).alias("c")).first().c
    per_range = [sum(a <= r[2] < b for r in rows) for a, b in zip([-1, *sorted(set(cuts))], [*sorted(set(cuts)), 10**13], strict=True)]
    assert max(per_range) < 4 * 4000 / 16


def test_query_and_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    got = R.revisit_report(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(checks.REVISITS).fetchall()))


def test_different_resources_do_not_meet(spark):
    urls = ["http://a.com/item?id=1", "http://a.com/item?id=2", "http://a.com/l", "http://a.com/l?page=2", "http://a.com/A", "http://a.com/a"]
    rows = [(2 * k + again, u, 10 + again * 10 + k, ("response", "revisit")[again], None, None, f"d{k}", {}, 0) for k, u in enumerate(urls) for again in (0, 1)]
    rows += [(50, "HTTPS://WWW.A.com/item/?utm_source=x&id=2#f", 90, "revisit", None, None, None, None, 0), (51, "http://a.com/s?b=2&a=1&a=0", 91, "response", None, None, "s", {}, 0),
             (52, "http://a.com/s?a=1&gclid=7&a=0&b=2", 92, "revisit", None, None, None, {}, 0), (53, "http://a.com/s?a=0&a=1&b=2", 93, "revisit", None, None, None, {}, 0)]
    got = {r.record_id: r.source_id for r in R.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {2 * k + 1: 2 * k for k in range(len(urls))} | {50: 2, 52: 51, 53: None}


def test_captures_query_and_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    got = R.captures_report(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(checks.CAPTURES).fetchall()))
    share = {o: sum(r.outcome == o for r in got) / len(got) for o in ("resolved", "mismatch", "orphan")}
    assert share["resolved"] > 0.6 and share["mismatch"] > 0.02 and 0 < share["orphan"] < 0.1
