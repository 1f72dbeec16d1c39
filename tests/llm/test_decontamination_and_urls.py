"""Both against their DuckDB SQL, on hand-made cases."""

import duckdb
import pytest

from wattledger.llm import checks
from wattledger.llm import decontamination as C
from wattledger.llm import url_filter as U

W = [f"w{k}" for k in range(40)]


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, (ddl, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({ddl})")
        for row in rows:
            con.execute(f"INSERT INTO {name} VALUES ({', '.join('?' * len(row))})", row)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return sorted(str(sorted(dict(zip(names, r, strict=True)).items())) for r in out.fetchall())


def rows_of(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


ITEMS = [
    (1, " ".join(W[:25])), (2, "Short ITEM here"), (3, None), (4, ""), (5, "the the the the the the the the the the the"), (6, "the"),
    (7, " ".join(W[:25])), (None, " ".join(W[20:35])), (8, "ÄPFEL und äpfel x"), (9, "?!"), (10, "never seen words at all in any of these documents ok"), (2, "Short ITEM here"),
]
TEXTS = [
    (1, " ".join(W[3:20])), (2, "x " + " ".join(W[3:12])), (3, " ".join(W).upper()), (4, None), (5, ""), (6, "short-item,HERE! short item"), (7, "the " * 30),
    (8, "äpfel UND äpfel x; ÄPFEL und äpfel x"), (9, "clean words only"), (9, "clean words only"), (9, " ".join(W[:10])), (None, " ".join(W[20:30])), (11, "a " * 40_000 + " ".join(W[:12])),
]


def test_containment(spark, corpus):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, window string")
    want = run_sql(checks.CONTAMINATION, documents=("doc_id BIGINT, text VARCHAR", TEXTS), benchmark=("item_id BIGINT, text VARCHAR", ITEMS))
    assert rows_of(C.contamination_report(corpus(TEXTS), benchmark)) == want
    kept = C.drop_contaminated(corpus(TEXTS), benchmark)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["4", "5", "2", "9", "9"]) and kept.columns == corpus([]).columns


def test_blocks_give_the_same(spark, corpus):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda df: sorted(map(str, df.drop("body").collect()))
    assert key(C.contamination(corpus(TEXTS), benchmark, block_windows=4)) == key(C.contamination(corpus(TEXTS), benchmark))


def test_empty_tables(spark, corpus):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert C.contamination_report(corpus([]), benchmark).count() == 0
    assert not any(r.contaminated for r in C.contamination_report(corpus(TEXTS), benchmark.limit(0)).collect())


URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/x"), (4, "http://EXAMPLE.com/en/x"), (5, "http://www.example.com/en/a?b"), (6, "http://x.net/fr/#"),
    (7, "http://x.org/ads/1"), (8, "http://x.org/ads/policy"), (9, "http://x.org?PHPSESSID=3"), (10, "http://example.com"), (11, "http://notexample.com/en/"),
    (12, "http://x.org/a-casino-bonuses"), (13, "http://tracker.x.org/"), (14, "http://x.org/banner1/a.gif"), (15, "http://É.com/É?x"), (None, "http://x.net/fr/"),
    (16, "http://x.com:80/"), (17, "://"), (18, "http://x.net/FR/"), (19, "http://" + "a." * 20_000 + "com/" + "b" * 50_000), (20, "http://com/"), (21, "http://xcom/"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in URLS], "page_id long, url string, html string, token string")
    assert rows_of(U.judge_urls(pages)) == run_sql(checks.URLS, pages=("page_id BIGINT, url VARCHAR", URLS))
    assert U.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in U.judge_urls(pages, rules=[], default="block").collect()} == {"block"}


@pytest.mark.parametrize(("pattern", "tokens"), [("/ads/", ("ads",)), ("*ads*", ()), ("/ads", ()), ("^id=*x", ("id",)), ("/a/bc*", ("a",))])
def test_tokens_of_patterns(pattern, tokens):
    assert U.pattern_rule("block", pattern).tokens == tokens


def test_rarest_token_is_chosen(spark):
    pages = spark.createDataFrame([(k, f"http://a.com/common/{'rare' if k == 3 else k}/") for k in range(9)], "page_id long, url string")
    index = U.rule_index(pages, [U.host_rule("block", "com", "/common/rare/"), U.host_rule("block", "com", "/absent/")]).collect()
    assert [(r.name, r.token) for r in index] == [("com/common/rare/", "rare")]
