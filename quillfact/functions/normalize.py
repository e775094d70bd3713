"""Numbers, units and periods of facts in normal form, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L
from quillfact.functions.roles import number_role
from quillfact.functions.text import first_of, has_any, let, like, literal, short, strip


def parse_numeric(value: Column) -> Column:
    """The first number in a text; one in parentheses is negative."""
    inside = F.nullif(F.regexp_extract(value, r"(?i)\(\s*(?:₹|\$|inr|usd|rs\.?)?\s*(\d+(?:,\d+)*(?:\.\d+)?)\s*\%?\s*\)", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(value, r"[-+]?\d+(?:,\d+)*(?:\.\d+)?", 0), F.lit(""))
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(-F.abs(number(inside)), number(plain))


def period(value: Column) -> Column:
    p = strip(F.upper(value))
    for pattern, put in ((r"\bFISCAL\s*(\d{4})\b", "FY $1"), (r"\bFISCAL\s*(\d{2})\b", "FY 20$1"), (r"\bFY\s*(\d{2})\b", "FY 20$1"), (r"\bFY\s*(\d{4})\b", "FY $1")):
        p = F.regexp_replace(p, pattern, put)
    return F.when((value != "") & ~F.lower(value).isin(L.NO_PERIOD), p)


def period_scope(text: Column) -> Column:
    c = F.lower(F.coalesce(text, F.lit("")))
    return F.when(like(c, r"april\s*.*?december|apr(?:il)?\s*.*?dec"), "APR_DEC").when(has_any(c, ["full year", "annual"]), "FULL_YEAR")


def vintage(text: Column) -> Column:
    c = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.contains(c, F.lit("first advance estimate")), "FIRST_ADVANCE_ESTIMATE").when(F.contains(c, F.lit("second advance estimate")), "SECOND_ADVANCE_ESTIMATE")


def document_entity(filename: Column) -> Column:
    return F.coalesce(first_of(F.lower(filename), L.FILE_ENTITIES), F.lit("Document Entity"))


def source_organisation(filename: Column) -> Column:
    return first_of(F.lower(filename), L.FILE_ORGANISATIONS)


def document_period(filename: Column) -> Column:
    return first_of(F.lower(filename), L.FILE_PERIODS)


def currency(text: Column) -> Column:
    return first_of(F.lower(text), L.CURRENCIES)


def normalized(value: Column, unit: Column, quote: Column, metric: Column) -> Column:
    """struct<numeric_value, normalized_value, normalized_unit, value_type, scale, currency, explanation> of a stated value: scale is
    the factor of a magnitude that was found, currency that of money; the explanation's wording is our own."""
    value, unit, quote, metric = (strip(F.coalesce(c, F.lit(""))) for c in (value, unit, quote, metric))
    number = F.coalesce(parse_numeric(value), parse_numeric(unit))
    return let(_with_role, value=value, unit=unit, quote=quote, metric=metric, text=F.lower(F.concat_ws(" ", value, unit)), number=number)


def _with_role(x: Column) -> Column:
    stated = F.coalesce(*[F.when(like(x["text"], rf"\b{m}\b"), F.lit(m)) for m, _ in L.MAGNITUDES])
    nearby = F.coalesce(*[F.when(like(x["quote"], F.concat(F.lit(r"(?i)\b"), literal(x["value"]), F.lit(rf"[\s\w]{{0,20}}\b{m}\b"))), F.lit(m)) for m, _ in L.MAGNITUDES])
    role = number_role(short(x["number"]), x["value"], x["unit"], x["quote"])["role"]
    return let(_with_unit, role=role, magnitude=F.coalesce(stated, nearby), **{c: x[c] for c in ("unit", "quote", "metric", "text", "number")})


def _with_unit(x: Column) -> Column:
    role, magnitude, text, number = (x[c] for c in ("role", "magnitude", "text", "number"))
    factor = F.coalesce(*[F.when(magnitude == m, F.lit(f)) for m, f in L.MAGNITUDES], F.lit(1.0))
    assumed = F.coalesce(magnitude.isin("crore", "cr", "lakh", "lacs", "lac"), F.lit(False)) | (role == "MONEY") | has_any(F.lower(F.concat_ws(" ", x["metric"], x["quote"])), L.MONEY_WORDS)
    money = F.coalesce(currency(text), F.when(assumed, "INR"))
    return let(_unit_ladder, role=role, magnitude=magnitude, text=text, number=number, scaled=F.round(number * factor, 4), money=money, said=F.concat_ws(" ", text, magnitude), unit=x["unit"])


def _unit_ladder(x: Column) -> Column:
    role, magnitude, text, number, scaled, money, said = (x[c] for c in ("role", "magnitude", "text", "number", "scaled", "money", "said"))
    factor = F.coalesce(*[F.when(magnitude == m, F.lit(f)) for m, f in L.MAGNITUDES])

    def out(v: Column, u: Column, t: Column, scaled_by: Column | None = None, coin: Column | None = None) -> Column:
        v, u, t, blank = v.cast("double"), u.cast("string"), t.cast("string"), F.lit(None)
        scaled_by, coin = (blank.cast("double") if scaled_by is None else scaled_by), (blank.cast("string") if coin is None else coin)
        grown = F.coalesce(F.concat(F.lit(" (times "), short(scaled_by), F.lit(")")), F.lit(""))
        said = F.when(number.isNull(), "no number").otherwise(F.concat(short(number), F.coalesce(F.concat(F.lit(" "), F.nullif(x["unit"], F.lit(""))), F.lit("")), F.lit(" is "), short(v), F.coalesce(F.concat(F.lit(" "), u), F.lit("")), grown))
        return F.struct(number.alias("numeric_value"), v.alias("normalized_value"), u.alias("normalized_unit"), t.alias("value_type"), scaled_by.alias("scale"), coin.alias("currency"), said.alias("explanation"))

    none = F.lit(None)
    return (
        F.when(number.isNull(), out(none, none, F.lit("SEMANTIC")))
        .when((role == "PERCENT") | has_any(text, ["%", "percent"]), out(number, F.lit("%"), F.lit("PERCENT")))
        .when(((role == "SHARE_COUNT") | F.contains(text, F.lit("shares"))) & ~has_any(text, L.MONEY_SIGNS), out(number, F.lit("shares"), F.lit("SHARE_COUNT")))
        .when(has_any(said, ["parcel", "order", "shipment"]), out(F.when(magnitude.isNull(), scaled).otherwise(number), F.concat_ws("_", magnitude, F.lit("parcels")), F.lit("COUNT")))
        .when(has_any(said, ["employee", "headcount", "worker"]), out(scaled, F.lit("employees"), F.lit("COUNT"), factor))
        .when(money.isNotNull(), out(scaled, money, F.lit("MONEY"), factor, money))
        .otherwise(out(scaled, F.nullif(x["unit"], F.lit("")), role, factor))
    )


def human(value: Column, unit: Column) -> Column:
    """A value as it is shown to people: billions and millions to two places, other fractions from a thousand on too, and else the number
    with its digits in groups and three places at most; empty without a value."""
    fixed = lambda c, mark: F.concat(F.format_string("%.2f", c), F.lit(mark))
    number = F.when(value >= 1e9, fixed(value / 1e9, "B")).when(value >= 1e6, fixed(value / 1e6, "M")).when((value >= 1e3) & (value % 1 != 0), fixed(value, "")).otherwise(F.call_function("format_number", value, F.lit("#,##0.###")))
    return F.coalesce(F.trim(F.concat(number, F.lit(" "), F.coalesce(unit, F.lit("")))), F.lit(""))
