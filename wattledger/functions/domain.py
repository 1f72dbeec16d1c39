"""Energy-domain functions: supply types, categories, consumer classes, step rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.binding import bind
from wattledger.functions.text import ascii_upper, plain_lower, strip


def _ladder(cases: list[tuple[Column, object]], default) -> Column:
    """First condition that holds."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(default)


def availability_kwh(supply: Column) -> Column:
    return bind(ascii_upper(supply), lambda text: _ladder(
        [(text.contains(word), F.lit(kwh)) for word, kwh in V.AVAILABILITY_KWH.items()], 0.0))


def availability_exact_kwh(supply: Column) -> Column:
    text = strip(F.upper(F.coalesce(supply, F.lit(""))))
    return _ladder([(text == word, F.lit(kwh)) for word, kwh in V.AVAILABILITY_EXACT_KWH.items()], 0)


def supply_type(text: Column) -> Column:
    return bind(ascii_upper(text), supply_of_plain)


def supply_of_plain(plain: Column) -> Column:
    """Supply type named in an `ascii_upper` text."""
    return _ladder([(plain.contains(word), F.lit(name)) for word, name in V.SUPPLY_TYPE_LABEL.items()], "")


def a4_label(text: Column) -> Column:
    return bind(plain_lower(text), lambda plain: F.when(
        plain.contains("a4") & plain.contains("verde"), "A4 VERDE").otherwise("A4"))


def category(group: Column, subgroup: Column, class_text: Column) -> Column:
    """The class text decides first, the voltage group only when it is silent."""
    grp, sub = strip(F.upper(F.coalesce(group, F.lit("")))), strip(F.upper(F.coalesce(subgroup, F.lit(""))))
    return bind(ascii_upper(class_text), lambda plain: _ladder([
        (plain.rlike(r"\bA4\b"), F.lit("A4")),
        (plain.rlike(r"\bB3\b"), F.lit("B3")),
        (plain.rlike(r"\bB4[AB]?\b|ILUMINACAO PUBLICA"), F.lit("IP")),
        ((grp == "A") & (sub == "A4"), F.lit("A4")),
        ((grp == "B") & (sub == "B3"), F.lit("B3")),
        ((grp == "B") & sub.isin("B4A", "B4B"), F.lit("IP")),
    ], "OUTROS"))


def legacy_category(group: Column, subgroup: Column, class_text: Column) -> Column:
    """Older rule order: the A4 subgroup before everything else."""
    text = F.upper(F.coalesce(class_text, F.lit("")))
    grp, sub = F.upper(F.coalesce(group, F.lit(""))), strip(F.upper(F.coalesce(subgroup, F.lit(""))))
    return _ladder([
        ((grp == "A") & (sub == "A4"), F.lit("A4")),
        (text.contains("ILUMINAÇÃO PÚBLICA") | text.contains("ILUMINACAO PUBLICA"), F.lit("IP")),
        ((grp == "B") & sub.isin("B4A", "B4B"), F.lit("IP")),
        ((grp == "B") & (sub == "B3"), F.lit("B3")),
    ], "OUTROS")


def category_of_text(plain: Column) -> Column:
    """Category of a whole `ascii_upper` text."""
    peak = plain.contains("CONSUMO PONTA") | plain.contains("FORA PONTA")
    return _ladder([
        (plain.rlike(r"\bA4\b"), F.lit("A4")),
        (plain.rlike(r"\bB3\b"), F.lit("B3")),
        (plain.rlike(r"\bB4[AB]?\b|ILUMINACAO PUBLICA"), F.lit("IP")),
        (plain.contains("PODER PUBLICO") & ~peak, F.lit("B3")),
    ], "OUTROS")


def low_voltage_class(header_class: Column, page: Column) -> Column:
    """struct(grupo, subgrupo, categoria) of a low-voltage page, header first; blanks when neither tells."""
    def answer(sub: str, cat: str) -> Column:
        return F.struct(F.lit("B").alias("grupo"), F.lit(sub).alias("subgrupo"), F.lit(cat).alias("categoria"))

    cases = []
    for text in (header_class, page):
        cases += [
            (text.rlike(r"\bB3\b"), answer("B3", "B3")),
            (text.contains("B4A"), answer("B4A", "IP")),
            (text.contains("B4B"), answer("B4B", "IP")),
            (text.contains("ILUMINACAO PUBLICA"), answer("B4A", "IP")),
        ]
    blank = F.struct(F.lit("").alias("grupo"), F.lit("").alias("subgrupo"), F.lit("").alias("categoria"))
    return _ladder(cases, blank)


def contract_class(c: Column) -> Column:
    """First adapter family. `mt` counts anywhere in the text; B4A is not known here."""
    return bind(plain_lower(c), lambda text: _ladder([
        ((text == "ip") | text.contains("iluminacao publica") | text.startswith("ip "), F.lit("IP")),
        (text.rlike("a4|grupo a|alta tensao|mt"), F.lit("A4")),
        (text.rlike("b3|grupo b|comercial"), F.lit("B3")),
    ], "OUTROS"))


def bridge_class(c: Column) -> Column:
    """Sizing classes: A4 first, every B4 is public lighting."""
    return bind(plain_lower(c), lambda text: _ladder([
        (text.rlike("a4|alta tensao|grupo a") | (text == "a"), F.lit("A4")),
        ((text == "ip") | text.rlike("iluminacao|b4"), F.lit("IP")),
        (text.rlike("b3|grupo b|comercial"), F.lit("B3")),
    ], "OUTROS"))


def rule_class(c: Column, rules: list[tuple[str, str]], default: str = "OUTROS") -> Column:
    """Ordered (pattern, class) rules of a configured adapter."""
    def classify(text: Column) -> Column:
        cases = [(text == "", F.lit("OUTROS"))]
        cases += [(text.rlike("(?i)" + pattern), F.lit(value)) for pattern, value in rules]
        return _ladder(cases, default)

    return bind(plain_lower(c), classify)


def known_class(c: Column) -> Column:
    return F.when(c.isin(V.QUALITY_CLASSES), c).otherwise("OUTROS")


def message(condition: Column, level: str, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(condition, F.struct(F.lit(level).alias("level"), text.alias("text")))


def messages(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def unique_messages(*groups: Column) -> Column:
    """Trimmed, non-blank, first occurrence kept."""
    joined = F.concat(*[F.coalesce(g, F.array().cast("array<string>")) for g in groups])
    return F.array_distinct(F.filter(F.transform(joined, lambda m: strip(m)), lambda m: m != ""))
