"""Spans against plain regular expressions, guess costs against all segmentations, private data against brute force."""

import hashlib
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from wattledger.llm import private_data as P
from wattledger.llm import secrets as S


def plain_secrets(text):
    text = text or ""
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


PIECES = ["password", "Token", "api_key", "APIKEY", "secret", "=", ": ", " ", '"', "'", "hunter22!", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "abc", "é", "ſecret", "toKen", "\n", "x9$Kq-77pLm"]


def random_texts(pieces, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_base_spans():
    for text in [None, "", "token: secret: abcdefghijk", "AKIA" * 9, "f" * 31 + "g" + "f" * 32, *random_texts(PIECES, 3000, 1)]:
        found = S.find_secrets(text)
        assert [(s.kind, s.start, s.end) for s in found if s.kind != "guess"] == plain_secrets(text)
        for s in found:
            assert s.kind != "guess" or not any(s.start < e and b < s.end for k, b, e in plain_secrets(text))


def test_guess_cost_is_the_least_over_all_segmentations():
    for value in ["", *random_texts(["password", "Dragon", "1999", "2020-03-04", "qwerty", "aaa", "x9", "$", "abab", "m", "é", "P@ssw0rd", "İ"], 250, 2)]:
        value = value[:24]
        segments = S.pattern_segments(value)

        @lru_cache(None)
        def least(i, value=value, segments=segments):
            if i == len(value):
                return 0.0
            brute = [S._KIND_COST + sum(map(S.character_cost, value[i:j])) + least(j) for j in range(i + 1, len(value) + 1)]
            return min(brute + [S._KIND_COST + cost + least(j) for j, cost in segments[i]])

        assert S.guess_cost(value) == pytest.approx(least(0))
        least.cache_clear()


def test_strong_values_cost_more():
    order = ["password1", "aaaaaaaaaaaa", "Dragon1999", "qwerty2020!", "x9$Kq-77pLm!", "f3ef4d6b2755a36d7d9c25bd72c4d5f6"]
    costs = [S.guess_cost(v) for v in order]
    assert costs == sorted(costs)


def test_added_spans_and_mask():
    text = "My password is x9$Kq-77pLm! but the password is protection. token = abcdefgh12"
    assert [s.kind for s in S.find_secrets(text)] == ["guess", "assign"]
    assert S.mask(text) == "My password is [SECRET] but the password is protection. token = [SECRET]"
    assert S.mask(None) is None and S.mask("plain") == "plain"


def test_unmixed_values_are_priced():
    assert S.mask("pwd=QXZKVWPTRMNB now") == "pwd=[SECRET] now"
    assert S.mask("passphrase: 918273645546") == "passphrase: [SECRET]"
    for text in ["pwd=passwordpassword", "passcode: 111111111111", "the passphrase is protection and was forgotten"]:
        assert S.find_secrets(text) == []


def test_values_longer_than_their_base_span(corpus):
    text = "password=Summer2024!x9$Kq7pLm and more"
    assert S.listed(S.find_secrets(text)) == "assign:0:19,guess:19:29"
    assert S.mask(text) == "password=[SECRET] and more"
    inside = "pwd: x9$AKIAABCDEFGHIJKL!foo#7 z"
    assert S.listed(S.find_secrets(inside)) == "guess:5:8,access:8:24,guess:24:30" and S.mask(inside) == "pwd: [SECRET] z"
    assert S.listed(S.find_secrets("{token=abcdefgh12}")) == "assign:1:17" and S.mask("password=password!") == "password=[SECRET]!"
    rows = S.secret_report(corpus([(1, text), (2, inside)])).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_guess, r.n_strong) for r in rows) == [(1, 1, 0, 1, 1), (2, 0, 1, 2, 1)]


def test_secret_tables(corpus):
    rows = [(1, None), (2, ""), (3, "token=abcdefgh é password: 12345678"), (3, "token=abcdefgh é password: 12345678"), (None, "AKIA1234567890ABCD"), (5, "word " * 50_000 + "secret=" + "a1" * 30_000)]
    out = S.secret_report(corpus(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        spans = plain_secrets(next(t for i, t in rows if i == r.doc_id))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans == listed
    masked = S.mask_secrets(corpus(rows))
    assert masked.columns == corpus([]).columns and masked.count() == len(rows)
    assert all(r.n_chars == len(r.text) for r in masked.collect() if r.n_chars is not None)
    assert not any("abcdefgh" in (r.text or "") for r in masked.collect())
    assert S.secret_report(corpus([])).count() == S.mask_secrets(corpus([])).count() == 0


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_private(text):
    text = text or ""
    only = lambda v: re.sub("[^0-9]", "", v)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(only(v)) <= 19 and luhn(only(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(only(v)) <= 15),
    ]
    return [(k, *m.span()) for k, rule, good in rules for m in re.finditer(rule, text) if good(m[0])]


HARD = [
    "a@b.cc-d%x@e.ff @x.y a@b a..b@c.d.e@f.g é@é.com x@y.zz.", "1.2.3.4.5.6.7.8 1.2.3.456.7.8.9.10 0255.1.1.01 999.1.1.1.1 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111 4111111111111111-2 4 111 1111 11111 11111  4111111111111111 5",
    "+1 (555) 123-4567 +1234567 ++12 345 678 9+1 (2) 3 4 5 6 7 8 9- +1-2", None, "", "é😀 4111111111111111 +49 30 1234567 x",
    "1" * 3000 + ".1.1.1 " + "4" * 50 + " " + "a" * 5000 + "@" + "b.c" * 100, "10.0.0.1 " * 3000,
]


def test_private_base_spans(corpus):
    pieces = ["1", "22", "4111111111111111", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "é", "255", "\n", "%"]
    rows = list(enumerate([*HARD, *random_texts(pieces, 400, 7)])) + [(None, HARD[0]), (3, HARD[3])]
    out = P.private_report(corpus(rows)).collect()
    texts = {i: t for i, t in rows}
    assert len(out) == len(rows)
    for r in out:
        spans = plain_private(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in P.BASE_KINDS]
    assert P.private_report(corpus([])).count() == 0


def test_added_private_spans(corpus):
    rows = [(k, f"Her SSN: 123-45-6{k:03d} and IBAN DE89 3704 0044 0532 0130 {k % 100:02d}. Dear Mary Smith, hello") for k in range(40)]
    rows += [(100 + k, f"Part no 900-00-{k:04d} of The Long version") for k in range(40)]
    out = {r.doc_id: r.spans for r in P.private_report(corpus(rows)).collect()}
    assert all(out[k].count("ssn:") == out[k].count("iban:") == out[k].count("name:") == 1 for k in range(40))
    assert not any(out[100 + k] for k in range(40))


def test_reliabilities_find_the_bad_labeler():
    rng, counts = random.Random(0), {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = [(1 if truth else -1) if rng.random() < p else (-1 if truth else 1) for p in (0.95, 0.9, 0.9, 0.5, 0.85)]
        key = ",".join(map(str, votes))
        counts.setdefault(key, [0, 0])[truth] += 1
    posterior = P.reliabilities([("ssn", v, sum(n)) for v, n in counts.items()])
    right = sum(n[posterior["ssn", v] > 0.5] for v, n in counts.items())
    assert right / 4000 > 0.95


def test_positions_in_a_text_of_many_matches(spark):
    text = " é".join(f"a{k}@b.com" + "x" * (k % 7) for k in range(60_000))
    found = spark.createDataFrame([(text,)], "text string").select(P.spans_of(F.col("text"), P.PATTERNS["email"], "@").alias("s")).first().s
    want = [(m.group(), m.start()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    assert [(r.value, r.start) for r in found] == want and len(want) == 60_000
