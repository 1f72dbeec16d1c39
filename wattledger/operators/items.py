"""Invoice items as `array<struct>` columns, and their JSON text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.binding import bind
from wattledger.functions.numbers import numeric_columns, plain_number, positive, ptbr_number
from wattledger.functions.text import ascii_upper, pick_all, pick_ascii

ITEM_TYPE = (
    "struct<item:string,quantidade:double,preco_unitario_com_tributos:double,valor:double,"
    "posto:string,componente:string,fonte:string>"
)
_NUMBER_FIELDS = ["quantidade", "preco_unitario_com_tributos", "valor"]


_FIELDS = ["item", *_NUMBER_FIELDS, "posto", "componente", "fonte"]
_AS_TEXT = "struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ">"
_TYPED = "struct<" + ",".join(f"{f}:{'double' if f in _NUMBER_FIELDS else 'string'}" for f in _FIELDS) + ">"
_UNREAD, _WRAPPER = "_corrupt_record", "__array"
_TELL = {"columnNameOfCorruptRecord": _UNREAD}


def _object_texts(text: Column) -> Column:
    """Trimmed JSON text -> texts of the elements that are objects; null when the text is no array.

    The elements are read as text first: broken JSON, a bare object and elements
    that are not objects then drop out one by one instead of voiding the array.
    An array that closes nowhere is not tried, as each failure to read costs an exception.
    """
    elements = F.when(text.startswith("[") & text.contains("]"), F.from_json(text, "array<string>"))
    return F.filter(elements, lambda e: F.ltrim(e).startswith("{"))


def _trimmed(json_text: Column) -> Column:
    return F.trim(F.coalesce(json_text, F.lit("")))


def item_texts(json_text: Column) -> Column:
    """JSON text -> array of items with every field as text, never null."""
    objects = bind(_trimmed(json_text), _object_texts)
    return F.coalesce(F.transform(objects, lambda e: F.from_json(e, _AS_TEXT)), F.array().cast(f"array<{_AS_TEXT}>"))


def _too_large(x: Column) -> Column:
    """An amount is NaN or infinite; as texts such amounts are no numbers. Null where there is no amount."""
    amounts = [x[f] for f in _NUMBER_FIELDS]
    return (F.greatest(*amounts) >= float("inf")) | (F.least(*amounts) <= float("-inf"))


def _misread(x: Column) -> Column:
    """No object, or one whose fields read otherwise through text: `NaN` in a text field keeps its quotes when read at once."""
    quoted = [x[f].startswith('"') for f in _FIELDS if f not in _NUMBER_FIELDS]
    return x.isNull() | F.coalesce(reduce(or_, quoted, _too_large(x)), F.lit(False))


def _typed_item(text: Column) -> Column:
    """Text of an object -> typed item. An object with a field of another type is read again, field by field as text."""
    def through_text(raw: Column) -> Column:
        return F.struct(*[(plain_number(raw[f]) if f in _NUMBER_FIELDS else raw[f]).alias(f) for f in _FIELDS])

    def checked(x: Column) -> Column:
        return F.when(x[_UNREAD].isNotNull() | _too_large(x), bind(F.from_json(text, _AS_TEXT), through_text)).otherwise(
            F.struct(*[x[f].alias(f) for f in _FIELDS]))

    return bind(F.from_json(text, _TYPED[:-1] + f",{_UNREAD}:string>", _TELL), checked)


def parse_items(json_text: Column) -> Column:
    """JSON text -> array of typed items, never null.

    An array that begins and ends with an object is read at once; if anything in it cannot be taken as it stands, and in
    any other array, the elements are read one by one. The array is wrapped, as only an object tells of fields not read;
    a second key of the wrapper's name could only be written out or with `\\u`.
    """
    def read(text: Column) -> Column:
        objects = text.startswith("[{") & text.endswith("}]") & ~text.contains("\\u") & ~text.contains(_WRAPPER)
        wrapped = F.from_json(F.concat(F.lit(f'{{"{_WRAPPER}":'), text, F.lit("}")), f"struct<{_WRAPPER}:array<{_TYPED}>,{_UNREAD}:string>", _TELL)
        return bind(F.when(objects, wrapped), lambda x: F.when(
            x[_UNREAD].isNull() & ~F.exists(x[_WRAPPER], _misread), x[_WRAPPER]).otherwise(
            F.coalesce(F.transform(_object_texts(text), _typed_item), F.array().cast(f"array<{_TYPED}>"))))

    return bind(_trimmed(json_text), read)


def no_items() -> Column:
    return F.array().cast(f"array<{ITEM_TYPE}>")


def items_json(items: Column) -> Column:
    """Array of items -> JSON text; an empty array is ''."""
    return bind(items, lambda rows: F.when(F.size(rows) > 0, F.to_json(rows)).otherwise(""))


def make_item(item: Column, quantity: Column, price: Column, value: Column,
              period: Column | str | None = None, component: Column | None = None,
              source: str | None = None) -> Column:
    period = F.lit(period) if period is None or isinstance(period, str) else period
    return F.struct(
        item.alias("item"),
        quantity.alias("quantidade"),
        price.alias("preco_unitario_com_tributos"),
        value.alias("valor"),
        period.cast("string").alias("posto"),
        (F.lit(None) if component is None else component).cast("string").alias("componente"),
        F.lit(source).cast("string").alias("fonte"),
    )


def _complete(items: Column) -> Column:
    """Items whose three amounts could all be read."""
    return F.filter(items, lambda x: x["quantidade"].isNotNull()
                    & x["preco_unitario_com_tributos"].isNotNull() & x["valor"].isNotNull())


# The first look-ahead passes over letters that begin no label.
_LABEL_SEARCH = (
    "(?=[" + "".join(sorted({label[0] for label in V.ITEM_LABELS})) + r"])\b(?=("
    + "|".join(r"\s+".join(label.split()) for label in sorted(V.ITEM_LABELS, key=len, reverse=True))
    + rf")\b(.{{0,{V.ITEM_TAIL_CHARS}}}))"
)


def labelled_items(section: Column) -> Column:
    """Items of the invoice section: a known label and the next three numbers.

    One look-ahead alternation, longest label first, finds the best label at every
    position without consuming text, so overlapping labels are all seen.
    """
    labels, tails = pick_all(section, _LABEL_SEARCH, 1), pick_all(section, _LABEL_SEARCH, 2)

    def read(label: Column, tail: Column) -> Column:
        return bind(pick_all(tail, V.ITEM_NUMBER), lambda numbers: F.when(F.size(numbers) >= 3, make_item(
            label, *[ptbr_number(F.get(numbers, F.lit(i))) for i in range(3)])))

    found = F.array_compact(F.zip_with(labels, tails, read))
    return F.coalesce(_complete(found), no_items())


def energy_items(plain: Column, category: Column) -> Column:
    """`ENERGIA ATIVA FORNECIDA` rows: by period for A4, single for B3 and IP."""
    def by_period(hit: Column) -> Column:
        raw = pick_ascii(hit, V.ENERGY_ROW_PERIOD, 1)
        period = F.when(raw.startswith("F"), "FHP").otherwise("HP")
        component = pick_ascii(hit, V.ENERGY_ROW_PERIOD, 2)
        numbers = [ptbr_number(pick_ascii(hit, V.ENERGY_ROW_PERIOD, g)) for g in (3, 4, 5)]
        name = F.concat_ws(" ", F.lit("ENERGIA ATIVA FORNECIDA"), period, component)
        return make_item(name, *numbers, period=period, component=component, source="ITENS_DE_FATURA")

    def single(hit: Column) -> Column:
        component = pick_ascii(hit, V.ENERGY_ROW_SINGLE, 1)
        numbers = [ptbr_number(pick_ascii(hit, V.ENERGY_ROW_SINGLE, g)) for g in (2, 3, 4)]
        name = F.concat_ws(" ", F.lit("ENERGIA ATIVA FORNECIDA"), component)
        return make_item(name, *numbers, period="UNICO", component=component, source="ITENS_DE_FATURA")

    periods = F.transform(pick_all(plain, V.ENERGY_ROW_PERIOD), by_period)
    singles = F.transform(pick_all(plain, V.ENERGY_ROW_SINGLE), single)
    wanted = (
        F.when(category.isin("B3", "IP"), singles)
        .when(category == "A4", periods)
        .otherwise(F.concat(periods, singles))
    )
    return unique_items(F.coalesce(_complete(wanted), no_items()))


def unique_items(items: Column) -> Column:
    """First of each item; amounts compared after half-even rounding."""
    def key(x: Column) -> Column:
        def text(f: str) -> Column:
            return F.upper(F.trim(F.coalesce(x[f], F.lit(""))))

        def amount(f: str, digits: int) -> Column:
            return F.bround(F.coalesce(x[f], F.lit(0.0)), digits)

        return F.struct(
            text("item"), amount("quantidade", 6), amount("preco_unitario_com_tributos", 8), amount("valor", 6),
            text("posto"), text("componente"))

    def firsts(rows: Column) -> Column:
        return bind(F.transform(rows, key), lambda keys: F.filter(
            rows, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    return bind(items, firsts)


def _total(items: Column, amount) -> Column:
    """Sum of one number per item; in item order, so always the same."""
    return F.aggregate(F.transform(items, lambda x: F.coalesce(amount(x), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)


def item_measures(items: Column) -> Column:
    """struct of the seven invoice measures.

    TE and TUSD rows bill the same energy twice, so energy per period is the
    larger of the two, while money adds up.
    """
    def name(x):
        return F.upper(F.coalesce(x["item"], F.lit("")))

    def period(x):
        return F.upper(F.coalesce(x["posto"], F.lit("")))

    def component(x):
        return F.upper(F.coalesce(x["componente"], F.lit("")))

    def bucket(energy: Column, periods: list[str], comp: str) -> Column:
        return F.filter(energy, lambda x: period(x).isin(periods) & (component(x) == comp))

    def quantity(x):
        return x["quantidade"]

    def value(x):
        return x["valor"]

    def sums(energy: Column) -> Column:
        out = [_total(energy, value).alias("energy_value"), _total(energy, quantity).alias("energy_qty")]
        for tag, periods in (("fhp", ["FHP"]), ("hp", ["HP"]), ("unico", ["UNICO", ""])):
            te, tusd = bucket(energy, periods, "TE"), bucket(energy, periods, "TUSD")
            out.append(F.greatest(_total(te, quantity), _total(tusd, quantity)).alias(f"{tag}_kwh"))
            out.append((_total(te, value) + _total(tusd, value)).alias(f"{tag}_value"))
        return F.struct(*out)

    def with_kwh(s: Column) -> Column:
        kwh = (
            F.when((s["fhp_kwh"] > 0) | (s["hp_kwh"] > 0), s["fhp_kwh"] + s["hp_kwh"])
            .when(s["unico_kwh"] > 0, s["unico_kwh"])
            .otherwise(s["energy_qty"])
        )
        return F.struct(s.alias("s"), kwh.alias("kwh"))

    def measures(x: Column) -> Column:
        s, kwh = x["s"], x["kwh"]
        mean_price = F.when(kwh > 0, s["energy_value"] / kwh)
        all_in = {t: F.when(s[f"{t}_kwh"] > 0, s[f"{t}_value"] / s[f"{t}_kwh"]) for t in ("fhp", "hp", "unico")}
        values = [
            bind(_total(items, value), positive),
            positive(s["energy_value"]),
            positive(kwh),
            mean_price,
            all_in["fhp"],
            all_in["hp"],
            F.coalesce(all_in["unico"], mean_price),
        ]
        return F.struct(*[v.alias(n) for v, n in zip(values, V.ITEM_MEASURES)])

    energy = F.filter(items, lambda x: name(x).contains("CONSUMO") | name(x).contains("ENERGIA"))
    return bind(bind(bind(energy, sums), with_kwh), measures)


def tag_items(items: Column) -> Column:
    """Energy items only, each tagged TE or TUSD. Put the result in a column of its own before summing it."""
    def tag(x: Column) -> Column:
        names = F.struct(ascii_upper(x["item"]).alias("n"), ascii_upper(x["componente"]).alias("c"))
        amounts = [F.coalesce(x[f], F.lit(0.0)).alias(a)
                   for f, a in (("quantidade", "qty"), ("preco_unitario_com_tributos", "unit"), ("valor", "value"))]
        return F.struct(names.alias("names"), *amounts)

    def kind(x: Column) -> Column:
        name, comp = x["names"]["n"], x["names"]["c"]
        energy = name.contains("CONSUMO") | name.contains("ENERGIA") | comp.isin("TE", "TUSD")
        which = F.when(name.contains("TUSD") | (comp == "TUSD"), "TUSD").when(
            name.rlike(r"\bTE\b") | (comp == "TE"), "TE")
        return F.struct(F.when(energy, which).alias("kind"), x["qty"].alias("qty"), x["unit"].alias("unit"),
                        x["value"].alias("value"))

    return F.filter(F.transform(F.transform(items, tag), kind), lambda x: x["kind"].isNotNull())


def _of_kind(tagged: Column, kind: str) -> Column:
    return F.filter(tagged, lambda x: x["kind"] == kind)


def te_quantity(tagged: Column) -> Column:
    return _total(_of_kind(tagged, "TE"), lambda x: x["qty"])


def component_prices(tagged: Column) -> Column:
    """struct(te_qty, preco_te, valor_te, tusd_qty, preco_tusd, valor_tusd); prices weighted by quantity."""
    out = []
    for tag, kind in (("te", "TE"), ("tusd", "TUSD")):
        rows = _of_kind(tagged, kind)
        qty = _total(rows, lambda x: x["qty"])
        weighted = _total(rows, lambda x: x["unit"] * x["qty"])
        out.append(qty.alias(f"{tag}_qty"))
        out.append(F.coalesce(weighted / bind(qty, positive), F.lit(0.0)).alias(f"preco_{tag}"))
        out.append(_total(rows, lambda x: x["value"]).alias(f"valor_{tag}"))
    return F.struct(*out)


def item_rows(df: DataFrame, as_written: bool = False) -> DataFrame:
    """One row per item object, with the keys of its invoice.

    Amounts are JSON numbers. `as_written=True` also reads amounts that were
    stored as money text; the choice is made per column, which costs one more
    pass over the items.
    """
    keys = [c for c in ("municipio", "reference_date", "referencia", "uc", "uploaded_file") if c in df.columns]
    amounts = {"quantidade": "quantidade", "preco_unitario_com_tributos": "preco_unitario_com_tributos_rs",
               "valor": "valor_rs"}
    objects = item_texts(F.col("itens_fatura_json")) if as_written else parse_items(F.col("itens_fatura_json"))
    rows = df.select(*keys, F.explode(objects).alias("i")).select(
        *[c for c in keys if c != "uploaded_file"],
        F.col("i.item").alias("item"),
        *[F.col(f"i.{field}").alias(name) for field, name in amounts.items()],
        *[c for c in keys if c == "uploaded_file"],
    )
    return numeric_columns(rows, list(amounts.values())) if as_written else rows
