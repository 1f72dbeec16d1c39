"""Personal data by weak supervision, in DataFrame functions only.

Patterns find candidate spans in whole texts. Five labelers vote on each candidate (1 personal data, -1 not, 0 no
opinion): the shape of the value, a gazetteer, cue words nearby, words that speak against it, and its borders. How
reliable each labeler is comes from expectation-maximisation over the counts of vote patterns (at most 3**5 per kind,
whatever the corpus). Its posteriors are the soft labels of a naive Bayes span classifier over features of the span
itself next to the votes, which decides the added kinds. Base spans that pass their own test always stay.

The text is read once: candidates with votes and features, without their text, go to the shared folder, and all
else is aggregates over them and arithmetic within a row.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import written

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("ssn", "iban", "name")
LABELERS = ("shape", "gazetteer", "cue", "against", "border")
ACCEPT = 0.5
#: Lengths that are added up at once when positions are counted.
SUM_BLOCK = 64

# The base patterns. A guard keeps a search from starting inside a run that was tried from its start
# (unless the last match ended there), and possessive repeats keep it from going back; both leave matches as they are.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": r"(?<![\p{L}\p{N}])(?!(?:Dear|Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Name|By|Signed)\b)\p{Lu}\p{Ll}{1,20}\x20(?:\p{Lu}\.\x20)?\p{Lu}\p{Ll}{1,20}(?:-\p{Lu}\p{Ll}{1,20})?(?![\p{L}\p{N}])",
}
#: A text in which this is not found has no candidate of the kind.
HINTS = {"email": "@", "phone": "+"}

GIVEN_NAMES = (
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah "
    "charles karen christopher nancy daniel matthew anthony margaret donald sandra steven ashley andrew kimberly emily joshua "
    "donna kenneth michelle kevin carol brian amanda george melissa edward deborah stephanie jean pierre marie sophie julien camille "
    "hans klaus petra sabine juergen ursula wolfgang jose maria carlos ana luis carmen antonio isabel javier lucia"
).split()
TOP_DOMAINS = "com org net edu gov info io co uk de fr es it nl eu us ca ch at be pt pl se no dk fi ie br mx ar au nz jp in".split()
IBAN_LANDS = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
CUES = {
    "email": "e-?mail|contact|write to|reach|@", "ip": r"\bip\b|host|server|client|address|from", "card": "card|visa|master|amex|credit|debit|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax|whatsapp|contact|\bsms", "ssn": r"\bssn\b|social security|taxpayer", "iban": "iban|account|konto|compte|cuenta|bank",
    "name": r"\b(?:name|mr|mrs|ms|dr|prof|dear|sincerely|regards|signed|by|herr|frau|madame|monsieur|se[ñn]or|se[ñn]ora)\b[.:,]?\s*$",
}
AGAINST = r"version|\bv$|isbn|figure|table|section|chapter|serial|order no|part no|invoice|street|avenue|university|inc\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Array of (value, start, left, right) of all matches: start in code points, and the text before and after.

    The pieces between the matches give the positions, as Spark's expressions return no offsets: a match starts after
    all earlier pieces and matches. Their lengths are summed by blocks first, so a match adds up at most a block of
    lengths, and no array is copied per match.
    """
    element = "array<struct<value string, start bigint, left string, right string>>"
    nothing, zero, block = F.array().cast(element), F.lit(0).cast("long"), F.lit(SUM_BLOCK)

    def total(lengths: Column, start: Column, count: Column) -> Column:
        return F.aggregate(F.slice(lengths, start + 1, count), zero, lambda a, b: a + b)

    def place(both: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(both["m"]) - 1)
        lengths = F.transform(steps, lambda i: (F.length(F.get(both["g"], i)) + F.length(F.get(both["m"], i))).cast("long"))

        def sums(each: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / block).cast("int")), lambda k: total(each, k * block, block))
            before = let(blocks, lambda s: F.transform(s, lambda _, k: total(s, F.lit(0), k)))
            return F.struct(each.alias("each"), before.alias("before"))

        def one(s: Column) -> Column:
            def start(i: Column) -> Column:
                own = F.floor(i / block).cast("int")
                return F.get(s["before"], own) + total(s["each"], own * block, i - own * block) + F.length(F.get(both["g"], i))

            return F.transform(steps, lambda i: F.struct(
                F.get(both["m"], i).alias("value"), start(i).alias("start"), F.right(F.get(both["g"], i), F.lit(40)).alias("left"),
                F.left(F.get(both["g"], i + 1), F.lit(40)).alias("right")))

        return let(let(lengths, sums), one)

    def pieces(found: Column) -> Column:
        both = F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g"))
        return F.when(F.size(found) == 0, nothing).otherwise(let(both, place).cast(element))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if hint:
        matches = F.when(F.contains(text, F.lit(hint)), matches).otherwise(F.array().cast("array<string>"))
    return let(matches, pieces)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a run of digits passes the check sum: every second digit from the right doubled, less 9 if over 9."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


PARTS_TO_255 = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def passes(kind: str, value: Column) -> Column:
    """The test of a base kind; matches that fail are dropped."""
    count = F.length(_digits(value))
    return {
        "ip": value.rlike(PARTS_TO_255), "card": count.between(16, 19) & luhn(_digits(value)), "phone": count.between(8, 15),
    }.get(kind, F.lit(True))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return F.coalesce((out if no is None else out.when(no, F.lit(-1))).otherwise(0), F.lit(0))


def votes(kind: str, x: Column) -> list[Column]:
    """One vote per labeler, in the order of LABELERS."""
    value, near = x["value"], F.concat_ws(" ", F.lower(x["left"]), F.lower(x["right"]))
    shape = {
        "email": ~value.rlike(r"\.\.|^\.|\.@|%"), "ip": ~value.rlike(r"(?:^|\.)0[0-9]"), "card": value.rlike(r"^(?:[0-9]{4}[\x20-]?){4}"),
        "phone": ~value.rlike(r"[.-]{2}|\x20{3}"), "ssn": ~value.rlike("^(?:000|666|9)|-00-|-0000$"), "iban": F.length(F.regexp_replace(value, r"\x20", "")).between(15, 34),
        "name": ~value.rlike(r"^(?:The|This|That|And|For|With|From)\x20"),
    }[kind]
    gazetteer = {
        "email": F.lower(F.regexp_extract(value, r"\.([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS), "ip": ~value.rlike(r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."),
        "card": value.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), "phone": value.rlike(r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"),
        "ssn": value.rlike("^[0-8]"), "iban": F.left(value, F.lit(2)).isin(IBAN_LANDS), "name": F.lower(F.regexp_extract(value, r"^(\p{L}+)", 1)).isin(GIVEN_NAMES),
    }[kind]
    open_border = x["left"].rlike(r"[\p{L}\p{N}@/_-]$") | x["right"].rlike(r"^[\p{L}\p{N}@/_]")
    cue = F.lower(x["left"]) if kind == "name" else near
    against = near.rlike(AGAINST)
    return [_vote(shape, ~shape), _vote(gazetteer, ~gazetteer), _vote(cue.rlike(CUES[kind])), _vote(F.lit(False), against), _vote(~open_border, open_border)]


def features(x: Column) -> list[Column]:
    """A few buckets of the span itself; none of them is a vote."""
    value = x["value"]
    before, after = F.right(x["left"], F.lit(1)), F.left(x["right"], F.lit(1))

    def class_of(c: Column) -> Column:
        return F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"[\p{L}\p{N}]"), "word").otherwise("mark")

    share = F.floor(F.length(_digits(value)) * 4 / F.length(value))
    return [
        F.concat(F.lit("length"), F.floor(F.log2(F.length(value))).cast("string")), F.concat(F.lit("digits"), share.cast("string")),
        F.concat(F.lit("before "), class_of(before)), F.concat(F.lit("after "), class_of(after)),
        F.concat(F.lit("marks"), F.least(F.length(F.regexp_replace(value, r"[\p{L}\p{N}]", "")), F.lit(6)).cast("string")),
    ]


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, passed, votes, features) of every row, from its whole text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_kind(kind: str) -> Column:
        found = spans_of(text, PATTERNS[kind], HINTS.get(kind))
        if kind == "name":
            found = F.filter(found, lambda x: F.lower(F.regexp_extract(x["value"], r"^(\p{L}+)", 1)).isin(GIVEN_NAMES) | F.lower(x["left"]).rlike(CUES["name"]))
        return F.transform(found, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), passes(kind, x["value"]).alias("passed"),
            F.concat_ws(",", *[v.cast("string") for v in votes(kind, x)]).alias("votes"), F.array(*features(x)).alias("features")))

    return documents.select("doc_id", F.concat(*[of_kind(k) for k in (*BASE_KINDS, *ADDED_KINDS)]).alias("spans"))


def reliabilities(counts: Iterable[tuple[str, str, int]], rounds: int = 50, smooth: float = 2.0) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, votes) that it is personal data, by expectation-maximisation over their counts.

    Each labeler has, for either truth, its own chances of 1, 0 and -1, shared by all kinds, and each kind its own share
    of true candidates. Rounds start from labelers that are right four times in five when they speak, and smoothing
    keeps unseen votes possible.
    """
    table = sorted((kind, tuple(map(int, v.split(","))), n) for kind, v, n in counts)
    labelers, kinds = range(len(LABELERS)), {k for k, _, _ in table}
    chance = [{1: {1: 0.56, 0: 0.3, -1: 0.14}, 0: {1: 0.14, 0: 0.3, -1: 0.56}} for _ in labelers]
    share, posterior = dict.fromkeys(kinds, 0.5), {}
    for _ in range(rounds):
        for kind, v, _ in table:
            yes, no = (math.log(p) + sum(math.log(chance[k][truth][v[k]]) for k in labelers) for truth, p in ((1, share[kind]), (0, 1 - share[kind])))
            posterior[kind, v] = 1 / (1 + math.exp(min(700.0, no - yes)))
        for kind in kinds:
            own = [(posterior[k, v], n) for k, v, n in table if k == kind]
            share[kind] = (smooth + sum(p * n for p, n in own)) / (2 * smooth + sum(n for _, n in own))
        total = sum(n for _, _, n in table)
        for k in labelers:
            for truth in (1, 0):
                prior = {1: 0.56, 0: 0.3, -1: 0.14} if truth else {1: 0.14, 0: 0.3, -1: 0.56}
                seen = defaultdict(float)
                for kind, v, n in table:
                    seen[v[k]] += n * (posterior[kind, v] if truth else 1 - posterior[kind, v])
                weight = smooth + 0.05 * total
                whole = sum(seen.values()) + weight
                chance[k][truth] = {o: (seen[o] + weight * prior[o]) / whole for o in (1, 0, -1)}
    return {(kind, ",".join(map(str, v))): p for (kind, v), p in posterior.items()}


def span_classifier(found: DataFrame, posterior: dict[tuple[str, str], float], smooth: float = 1.0) -> dict[str, float]:
    """Naive Bayes weights: log odds per kind (key: the kind), per kind and feature from soft labels, and per kind and votes.

    The weight of votes is what their posterior says beyond the kind's own odds.
    """
    soft = found.sparkSession.createDataFrame([(k, v, p) for (k, v), p in posterior.items()], "kind string, votes string, p double")
    each = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", F.explode(F.array_append("s.features", F.lit(""))).alias("feature"))
    sums = each.groupBy("kind", "votes", "feature").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(soft), ["kind", "votes"])
    rows = sums.groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
    whole = {r["kind"]: (r["yes"], r["no"]) for r in rows if r["feature"] == ""}
    out = {kind: math.log((yes + smooth) / (no + smooth)) for kind, (yes, no) in whole.items()}
    for r in rows:
        if r["feature"]:
            yes, no = whole[r["kind"]]
            out[f"{r['kind']} {r['feature']}"] = math.log((r["yes"] + smooth) / (yes + 2 * smooth)) - math.log((r["no"] + smooth) / (no + 2 * smooth))
    for (kind, votes), p in posterior.items():
        p = min(1 - 1e-6, max(1e-6, p))
        out[f"{kind} votes {votes}"] = math.log(p / (1 - p)) - out[kind]
    return out


def private_spans(documents: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id and spans (kind, start, end, probability) of every row: base spans, then added ones that the classifier accepts.

    An added span also needs a vote for it beyond its shape. Null and empty texts have no spans, and repeated rows come
    back as often as they are there. Without any candidate there is nothing to learn, and no span.
    """
    found = written(candidates(documents))
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).collect()
    weights = span_classifier(found, reliabilities([(r["kind"], r["votes"], r["n"]) for r in counts]))
    known = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else F.lit(None).cast("map<string,double>")

    def weight(key: Column) -> Column:
        return F.coalesce(F.try_element_at(known, key), F.lit(0.0))

    def scored(s: Column) -> Column:
        told = F.concat(F.lit("votes "), s["votes"])
        odds = F.aggregate(F.array_append(s["features"], told), weight(s["kind"]), lambda total, f: total + weight(F.concat_ws(" ", s["kind"], f)))
        backed = s["votes"].rlike("^-?[0-9],(?:1,.*|-?[0-9],1,.*)$")
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (1 / (1 + F.exp(-odds))).alias("probability"),
                        s["passed"].alias("passed"), backed.alias("backed"))

    def stays(s: Column) -> Column:
        base = s["kind"].isin(list(BASE_KINDS))
        return (base & s["passed"]) | (~base & s["backed"] & (s["probability"] >= accept))

    kept = F.filter(F.transform("spans", scored), stays)
    return found.select("doc_id", F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["probability"].alias("probability"))).alias("spans"))


def private_report(documents: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row."""
    found = private_spans(documents, accept)

    def listed(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(list(BASE_KINDS)))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(list(BASE_KINDS)))).cast("long").alias("n_added"))
