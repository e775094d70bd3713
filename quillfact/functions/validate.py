"""The validator: an ordered ladder of reasons to reject a fact candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L
from quillfact.functions.roles import navigation, number_role, section_prefix
from quillfact.functions.text import either, fence, has_any, let, like, short, strip


def header_label(text: Column) -> Column:
    """Whether a text is just a table header, a unit label or a generic title."""
    known, pattern = [*L.UNIT_WORDS, *L.GENERIC_METRICS], "|".join(L.HEADERS)
    return F.coalesce(let(lambda x: (x["c"] != "") & (x["c"].isin(known) | x["c"].startswith("#") | like(x["c"], pattern)), c=F.lower(strip(text))), F.lit(False))


def failure_type(value: Column, metric: Column, unit: Column, quote: Column, number: Column, binding: Column, extraction: Column) -> Column:
    """The first rule that a candidate breaks, null for a valid one."""
    value, metric, unit, quote = (strip(F.coalesce(c, F.lit(""))) for c in (value, metric, unit, quote))
    return let(_first_failure, value=value, metric=metric, unit=unit, quote=quote, number=number, binding=binding, extraction=extraction)


def _named(rules: list[tuple[Column, str]]) -> list[Column]:
    return [F.when(test, name) for test, name in rules]


def _first_failure(x: Column) -> Column:
    value, quote, number = x["value"], x["quote"], x["number"]
    before = [
        (navigation(quote) | navigation(value), "NAVIGATION_REFERENCE"),
        (F.length(quote) < 4, "INSUFFICIENT_CONTEXT"),
    ]
    # the role is the dearest of all: only a number has one, and only where no rule before needs none
    role = F.when(number.isNotNull(), number_role(short(number), value, x["unit"], quote)["role"])
    rest = let(_failure_of_role, role=role, m=F.lower(x["metric"]), u=F.lower(x["unit"]), v=F.lower(value), q=F.lower(quote), **{c: x[c] for c in ("value", "metric", "quote", "number", "binding", "extraction")})
    return F.coalesce(*_named(before), rest)


def _failure_of_role(x: Column) -> Column:
    value, metric, quote, number, role, binding, extraction, m, u = (x[c] for c in ("value", "metric", "quote", "number", "role", "binding", "extraction", "m", "u"))
    numeric, relative = number.isNotNull(), has_any(m, ["change", "spread", "delta"])
    rules = [
        (numeric & ~role.isin(L.METRIC_ROLES), "INVALID_NUMBER_ROLE"),
        (numeric & section_prefix(quote, value, number.cast("string")), "SECTION_IDENTIFIER_AS_VALUE"),
        (numeric & (F.contains(x["q"], F.lit("bps")) | role.isin("BASIS_POINT_CHANGE", "SPREAD")) & has_any(m, ["repo", "interest", "rate"]) & ~relative, "DELTA_SPREAD_AS_LEVEL"),
        (numeric & has_any(m, ["inflation", "gdp", "growth rate", "repo rate"]) & ~relative & ~has_any(u, ["%", "percent", "bps"]) & ~F.contains(value, F.lit("%")), "MISSING_PERCENT_UNIT"),
        (numeric & has_any(m, ["borrowings", "net debt", "revenue", "income", "cash flow", "offer size", "share capital", "litigation"]) & ~has_any(F.concat_ws("\n", u, x["v"]), ["inr", "usd", "₹", "$", "rs", "crore", "million", "billion", "lakh"]), "MISSING_CURRENCY_UNIT"),
        (numeric & (binding < L.MIN_BINDING), "LOW_BINDING_CONFIDENCE"),
        (header_label(value) | header_label(metric), "TABLE_HEADER_WITHOUT_VALUE"),
        (m == "", "VALUE_WITHOUT_METRIC"),
        (~numeric & ((F.length(value) < 5) | x["v"].isin(L.EMPTY_PHRASES)), "INSUFFICIENT_CONTEXT"),
        (extraction < L.MIN_EXTRACTION, "LOW_CONFIDENCE"),
    ]
    return F.coalesce(*_named(rules))


#: What is said of a rejected candidate, in our own words: {0} is its value, {1} its metric, {2} its unit.
REASONS = {
    "NAVIGATION_REFERENCE": "The line points to a page.", "INSUFFICIENT_CONTEXT": "Too little is said around '{0}'.", "INVALID_NUMBER_ROLE": "The number '{0}' is no value of a metric.",
    "SECTION_IDENTIFIER_AS_VALUE": "'{0}' numbers a section.", "DELTA_SPREAD_AS_LEVEL": "'{0}' is a change or a spread, not a level of {1}.", "MISSING_PERCENT_UNIT": "{1} is a rate, its unit '{2}' is none.",
    "MISSING_CURRENCY_UNIT": "{1} is money, its unit '{2}' is not.", "LOW_BINDING_CONFIDENCE": "'{0}' is not bound firmly to {1}.", "TABLE_HEADER_WITHOUT_VALUE": "A header or unit label: {1} {0}.", "VALUE_WITHOUT_METRIC": "'{0}' has no metric.", "LOW_CONFIDENCE": "Extracted with little confidence.",
}


def reason(failure: Column, value: Column, metric: Column, unit: Column) -> Column:
    """What is said of a candidate that breaks a rule."""
    text = F.coalesce(*[F.when(failure == k, F.lit(v)) for k, v in REASONS.items()])
    for i, c in enumerate((value, metric, unit)):
        text = F.replace(text, F.lit(f"{{{i}}}"), F.coalesce(c, F.lit("")))
    return text


def with_failures(candidates: DataFrame, quote: Column) -> DataFrame:
    """Candidates with normalised values, and failure_type: null for valid ones."""
    return fence(candidates, failure_type=failure_type(F.col("value"), F.col("metric"), F.col("unit"), quote, F.col("numeric_value"), F.col("value_binding_confidence"), F.col("extraction_confidence")))


def passed(c: DataFrame) -> DataFrame:
    return c.where("failure_type is null").drop("failure_type").withColumn("validation_status", F.lit("valid"))


def failed(c: DataFrame, quote: Column) -> DataFrame:
    """Rejected candidates, kept whole as JSON, with where they were found as far as c knows."""
    whole = F.to_json(F.struct(*[x for x in c.columns if x != "failure_type"]))
    place = [x for x in ("chunk_index", "stage", "ordinal", "rank", "number") if x in c.columns]
    return c.where("failure_type is not null").select(
        "document_id", "page_number", *place, either(F.col("value"), quote).alias("candidate_text"), "failure_type", reason(F.col("failure_type"), F.col("value"), F.col("metric"), F.col("unit")).alias("rejection_reason"),
        F.array(F.lower(F.replace(F.col("failure_type"), F.lit("_"), F.lit(" ")))).alias("warnings"), whole.alias("attempted_extraction"),
    )


def checked(candidates: DataFrame, quote: Column) -> tuple[DataFrame, DataFrame]:
    """(valid facts, rejected candidates) of candidates with normalised values."""
    c = with_failures(candidates, quote)
    return passed(c), failed(c, quote)
