"""Fact candidates from lines, seller rows and period series; enrichment, validation, in-chunk dedup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L
from quillfact.functions.normalize import document_entity, document_period, normalized, parse_numeric, period, period_scope, source_organisation, vintage
from quillfact.functions.roles import index_base, navigation, number_role, section_prefix
from quillfact.functions.text import fence, final_confidence, grounding, has_any, like, short, strip
from quillfact.functions.validate import failed, header_label, passed, reason, with_failures
from quillfact.operators.chunks import nonblank_lines, route, sentences
from quillfact.sources.scratch import settle

KEYS = ("document_id", "filename", "page_number", "chunk_index")
CANDIDATE = ["entity", "metric", "value", "unit", "period", "period_scope", "raw_quote", "binding_method", "value_binding_confidence", "extraction_confidence"]
MONEY_UNITS = ["inr", "usd", "₹", "$", "rs", "crore", "million", "billion", "lakh"]


def metric_rows(c: Column) -> Column:
    """array<struct<rank, metric, role>> of the dictionary's entries that c matches: every pattern is one codegen test, so
    the dictionary needs no join."""
    rows = [F.when(like(c, pattern), F.struct(F.lit(i).alias("rank"), F.lit(name).alias("metric"), F.lit(role).alias("role"))) for i, (pattern, name, role) in enumerate(L.METRICS)]
    return F.array_compact(F.array(*rows))


def seller_rows(line: Column) -> Column:
    """Two candidates of a selling-shareholder row: name, number of shares, amount."""
    # fixed patterns of such a row
    shares = F.regexp_extract(line, r"(?i)([\d,]+)\s*(?:equity|preference)?\s*shares", 1)
    money = strip(F.regexp_extract(line, r"(?i)((?:₹|\$|INR|USD|Rs\.?)\s*[-+]?\d+(?:,\d+)*(?:\.\d+)?\s*(?:million|billion|crore|lakh)?)", 1))
    before = strip(F.regexp_extract(line, r"(?is)^(.*?)[\d,]+\s*(?:equity|preference)?\s*shares", 1))
    name = F.regexp_extract(before, r"([A-Z][A-Za-z0-9\s\.\&\,\(\)\-]+?(?:Limited|Ltd|Pte|Inc|Capital|Investments|Holdings|Trust|Corp|LLC)?)$", 1)
    name = F.regexp_replace(name, r"^[,. ]+|[,. ]+$", "")
    fits = (shares != "") & (money != "") & (F.length(name) > 3) & ~has_any(F.lower(name), ["total", "particulars", "table", "statement", "index"]) & ~navigation(line) & ~header_label(line)
    row = lambda metric, predicate, value, unit: F.struct(name.alias("entity"), F.lit(metric).alias("metric"), F.lit(predicate).alias("predicate"), value.alias("value"), unit.alias("unit"))
    amount = row("Offer for Sale Amount", "offered for sale", money, F.when(F.contains(F.lower(money), F.lit("million")), "INR million").otherwise("INR"))
    both = F.array(amount, row("Shares Offered for Sale", "offered equity shares of", shares, F.lit("shares")))
    return F.when(fits, both)


def line_candidates(lines: DataFrame, *keys: str) -> DataFrame:
    """Candidates of lines(keys, ordinal, filename, line): each metric that a line names with each of its numbers."""
    line = F.col("line")
    base = lines.withColumn("seller", seller_rows(line))
    sellers = base.where("seller is not null").select(*keys, "ordinal", "line", F.posexplode("seller").alias("rank", "s")).select(
        *keys, "ordinal", "rank", F.lit(0).alias("number"), F.col("s.entity").alias("entity"), F.col("s.metric").alias("metric"), F.col("s.value").alias("value"), F.col("s.unit").alias("unit"),
        F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("period_scope"), F.col("line").alias("raw_quote"), F.lit("table_cell").alias("binding_method"), F.lit(0.90).alias("value_binding_confidence"), F.lit(0.90).alias("extraction_confidence"),
        F.col("s.predicate").alias("predicate"), F.lit(L.SELLER_SCOPE).alias("scope"),
    )
    low = F.lower(line)
    rows = base.where(F.col("seller").isNull() & ~navigation(line)).withColumn("m", F.explode(metric_rows(low))).select("*", F.posexplode(F.regexp_extract_all(line, F.lit(L.NUMBER), F.lit(1))).alias("number", "token"))
    # the patterns below are fixed, and so is their order
    token = strip(F.col("token"))
    rows = fence(rows.where(like(F.col("token"), r"\d")), num=parse_numeric(F.col("token")), tok=token)
    rows = fence(rows, role=number_role(short(F.col("num")), F.col("token"), F.lit(""), line)["role"]).where(F.col("role").isin(L.METRIC_ROLES))
    rows = rows.where(~section_prefix(low, F.col("tok"), F.col("num").cast("string")))
    at = F.instr(line, F.col("tok"))  # the first place of the token, also of a repeated one
    money_led = like(F.col("tok"), r"^(?:\$|₹|INR|USD|Rs)")
    rows = fence(rows, at=at).where(~((F.col("at") > 1) & like(F.substring(line, F.col("at") - 1, F.lit(1)), r"[A-Za-z)]") & ~money_led))
    rows = rows.where(~like(F.substring(line, F.greatest(F.col("at") - 5, F.lit(1)), F.least(F.col("at") - 1, F.lit(5))), r"(?:19|20)\d{2}-?$"))
    tok, role, expected = F.col("tok"), F.col("role"), F.col("m.role")
    shown = F.when((F.col("num") < 0) & ~like(tok, r"^[-(]"), F.concat(F.lit("-"), tok)).when(F.contains(tok, F.lit("(")) & F.contains(tok, F.lit(")")), F.concat(F.lit("-"), strip(F.regexp_replace(tok, r"[()]", "")))).otherwise(tok)
    first = Window.partitionBy(*keys, "ordinal", "m.rank", short(F.col("num")), "shown").orderBy("number")
    rows = fence(rows, shown=shown).withColumn("again", F.row_number().over(first)).where("again = 1")
    relative = role.isin("BASIS_POINT_CHANGE", "SPREAD")
    has = lambda *w: reduce(lambda a, b: a & b, [F.contains(low, F.lit(x)) for x in w])
    metric = (
        F.when(role == "BASIS_POINT_CHANGE", "Policy Repo Rate Change").when(role == "SPREAD", "Spread to Policy Repo Rate")
        .when(has("shares", "aggregating") & (role == "MONEY") & (expected == "SHARE_COUNT"), "Offer Size")
        .when(F.contains(F.lower(tok), F.lit("shares")) | (role == "SHARE_COUNT"), "Offer Equity Shares")
        .when(has("retail headline inflation"), "Retail Headline Inflation").when(has("headline inflation"), "Headline Inflation")
        .when(has("core", "inflation"), "Core Inflation").when(has("food", "inflation"), "Food Inflation")
        .when(has("real gross domestic product") | has("real gdp"), "Real GDP Growth").otherwise(F.col("m.metric"))
    )
    p = F.col("at") - 1
    before = F.substring(line, F.greatest(p - 40, F.lit(0)) + 1, F.least(p, F.lit(40)))
    after = F.substring(line, p + F.length(tok) + 1, F.lit(50))
    rows = fence(rows, before=before, after=after)
    before, after = F.col("before"), F.col("after")
    rows = rows.where(~(like(before, r"(?:\(\s*\+/-\s*\)|\+/-|±)\s*$") | F.contains(F.lower(before), F.lit("tolerance band")) | like(before, r"(?i)\b(?:chart|figure|table|box)\s+[A-Za-z0-9\.]*$")))
    unit = F.nullif(F.regexp_extract(F.col("token"), r"(?i)(million|billion|crore|lakh|crores|lakhs|%|percent|per cent|shares|equity\s+shares|parcels|orders|employees|INR|USD|₹|\$)", 1), F.lit(""))
    unit = F.when(F.lower(unit).isin("%", "percent", "per cent"), "%").otherwise(unit)
    follows = F.lower(strip(after))
    unit = F.when(relative, "bps").when(unit.isNull() & (expected == "PERCENT") & like(follows, r"^(?:%|per cent|percent)"), "%").when(unit.isNull() & (expected == "PERCENT") & like(follows, r"^bps"), "bps").otherwise(unit)
    rows = fence(rows, unit=unit)
    rows = rows.where(F.when(expected == "PERCENT", F.coalesce(F.col("unit").isin("%", "bps"), F.lit(False))).when(expected == "MONEY", F.coalesce(has_any(F.lower(F.col("unit")), MONEY_UNITS), F.lit(False))).otherwise(F.lit(True)))
    rows = fence(rows, window=F.lower(F.concat_ws(" ", before, tok, after)), scope=period_scope(F.concat_ws(" ", F.right(before, F.lit(20)), tok, F.left(after, F.lit(28)))))
    window, scope = F.col("window"), F.col("scope")
    named = r"(FY\s?\d{2,4}|Fiscal\s?\d{2,4}|20\d{2}-\d{2}|20\d{2})"
    found = lambda c, pattern: period(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))
    of_line = found(line, r"(?i)\b(FY\s?\d{2,4}|Fiscal\s?\d{2,4}|Q[1-4]\s?FY?\d{2,4}|20\d{2})\b")
    other = F.regexp_extract(line, r"\b(20\d{2}-\d{2})\b", 1)
    year = F.left(other, F.lit(4)).try_cast("int")
    bound = F.when(has_any(window, ["previous year", "prior year"]), F.coalesce(F.concat(F.lit("FY "), (year - 1).cast("string"), F.lit("-"), F.right(year.cast("string"), F.lit(2))), of_line)).otherwise(
        F.coalesce(found(after, rf"(?i)^\s*(?:in|during|for)?\s*{named}\b"), found(before, rf"(?i)\b{named}\s*(?:in|during|from|to)?\s*$"), found(window, rf"(?i)\b{named}\b"), of_line)
    )
    rows, bound = fence(rows, stated=bound), F.col("stated")
    rows = fence(rows, bound=F.when(bound.isNull() & has_any(low, ["year-on-year", "yoy", "annual"]), document_period(F.col("filename"))).otherwise(bound))
    bound = F.col("bound")
    bound = F.when((scope == "APR_DEC") & has_any(window, ["2024", "fy25"]), "FY 2024-25").when(scope.isNull() & (bound == "FY 2024"), "FY 2023-24").when(bound == "FY 2025", "FY 2024-25").when(like(bound, r"^\d{4}-\d{2}$"), F.concat(F.lit("FY "), bound)).otherwise(bound)
    value = F.when((role == "BASIS_POINT_CHANGE") & ~F.col("shown").startswith("-"), F.concat(F.lit("-"), F.col("shown"))).otherwise(F.col("shown"))
    plain = rows.select(
        *keys, "ordinal", F.col("m.rank").alias("rank"), "number", document_entity(F.col("filename")).alias("entity"), metric.alias("metric"), value.alias("value"), F.coalesce("unit", F.when(role == "SHARE_COUNT", "shares")).alias("unit"),
        bound.alias("period"), scope.alias("period_scope"), line.alias("raw_quote"), F.lit("sentence_direct").alias("binding_method"), F.lit(0.85).alias("value_binding_confidence"), F.lit(0.85).alias("extraction_confidence"),
        F.when(F.contains(F.lower(metric), F.lit("revenue")), "was reported as").otherwise("reached").alias("predicate"), scope.alias("scope"),
    )
    return sellers.unionByName(plain)


# Fixed pattern: a number of a series.
SERIES_NUMBER = r"(\(\s*[-+]?\d+(?:,\d+)*(?:\.\d+)?\s*%?\s*\)|[-+]?\d+(?:,\d+)*(?:\.\d+)?%?)"


def series_candidates(lines: DataFrame, *keys: str) -> DataFrame:
    """Values of a number row bound to the periods of a header row, by position.

    The metric is named in the three lines above, else in the three below; the numbers are in a line below, else above,
    else stand one a line right above the header under their label. Rows of another length than the header give nothing."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    line, low = F.col("line"), F.lower(F.col("line"))
    periods = F.regexp_extract_all(line, F.lit(L.PERIOD), F.lit(1))
    n_numbers = F.size(F.regexp_extract_all(line, F.lit(r"(?<![A-Za-z])[-+]?\d+(?:,\d+)*(?:\.\d+)?%?"), F.lit(0)))
    plain = ~like(line, r"\b(?:19|20)\d{2}-\d{2,4}\b") & (F.size(periods) < 2) & (F.size(F.regexp_extract_all(line, F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0))) <= 2) & ~has_any(low, ["tolerance", "+/-"])
    info = F.struct(line.alias("line"), F.when(plain, n_numbers).otherwise(0).alias("n"), (F.size(metric_rows(low)) > 0).alias("named"), like(line, r"^\(?[-+]?\d+(?:,\d+)*(?:\.\d+)?%?\)?$").alias("lone"), header_label(line).alias("label"))
    rows = lines.withColumn("periods", periods).withColumn("info", info)
    rows = rows.withColumn("above", F.collect_list("info").over(order.rowsBetween(-3, -1))).withColumn("below", F.collect_list("info").over(order.rowsBetween(1, 3)))
    # a stack of numbers is as long as its header has periods, with one or two label lines above: just these lines are fetched
    k = F.size("periods")
    stacks = rows.where((F.size("periods") > 1) & (F.col("line_no") > 0)).select(*keys, F.col("line_no").alias("head"), F.explode(F.sequence(F.greatest(F.col("line_no") - k - 2, F.lit(0)), F.col("line_no") - 1)).alias("line_no"))
    stacks = stacks.join(rows.select(*keys, "line_no", "info"), [*keys, "line_no"]).groupBy(*keys, "head").agg(F.array_sort(F.collect_list(F.struct("line_no", "info"))).alias("s"))
    stacks = stacks.select(*keys, F.col("head").alias("line_no"), F.transform("s", lambda x: x["info"]).alias("all_above"))
    rows = rows.where("size(periods) > 1").join(stacks, [*keys, "line_no"], "left")
    pick = lambda c, test: F.try_element_at(F.filter(c, test), F.lit(1))["line"]
    metric = F.coalesce(pick("above", lambda x: x["named"]), pick("below", lambda x: x["named"]))
    value = F.coalesce(pick("below", lambda x: x["n"] >= k), pick("above", lambda x: x["n"] >= k))
    stack = F.slice("all_above", F.greatest(F.size("all_above") - k + 1, F.lit(1)), k)
    label = F.when(F.size("all_above") > k, F.try_element_at(F.col("all_above"), F.size("all_above") - k))
    label = F.when(label["label"] & (F.size("all_above") > k + 1), F.try_element_at(F.col("all_above"), F.size("all_above") - k - 1)).otherwise(label)
    stacked = value.isNull() & (F.size("all_above") >= k) & F.forall(stack, lambda x: x["lone"]) & F.coalesce(label["named"], F.lit(False))
    rows = fence(rows, metric_line=F.when(stacked, label["line"]).otherwise(metric), value_line=F.when(stacked, F.array_join(F.transform(stack, lambda x: x["line"]), " ")).otherwise(value))
    rows = fence(rows.where("metric_line is not null and value_line is not null"), m=F.try_element_at(metric_rows(F.lower("metric_line")), F.lit(1))).where("m is not null")
    tokens = F.regexp_extract_all("value_line", F.lit(SERIES_NUMBER), F.lit(1))
    rows = rows.withColumn("tokens", tokens).where(F.size("tokens") == F.size("periods"))
    rows = rows.select("*", F.posexplode(F.arrays_zip("tokens", "periods")).alias("number", "z")).withColumn("token", F.col("z.tokens")).withColumn("num", parse_numeric(F.col("z.tokens")))
    rows = rows.where("num is not null").where(number_role(short(F.col("num")), F.col("token"), F.lit(""), F.col("value_line"))["role"].isin(L.METRIC_ROLES) | F.contains("token", F.lit("%")))
    unit = F.nullif(F.regexp_extract(F.concat_ws(" ", "metric_line", "value_line"), r"(?i)(million|billion|crore|lakh|%|percent|shares|parcels|orders|employees)", 1), F.lit(""))
    unit = F.coalesce(unit, F.when(F.col("m.role") == "PERCENT", "%"))
    unit = F.when(F.contains(F.lower("m.metric"), F.lit("express parcel")) & F.lower(unit).isin("million", "billion", "thousand"), F.concat(unit, F.lit(" parcels"))).otherwise(unit)
    token = strip(F.col("token"))
    shown = F.when(token.startswith("("), F.concat(F.lit("-"), strip(F.regexp_replace(token, r"^\(|\)$", "")))).otherwise(token)
    return rows.select(
        *keys, F.col("line_no").alias("ordinal"), F.col("m.rank").alias("rank"), "number", document_entity(F.col("filename")).alias("entity"), F.col("m.metric").alias("metric"), shown.alias("value"), unit.alias("unit"), period(F.col("z.periods")).alias("period"),
        F.lit(None).cast("string").alias("period_scope"), F.concat_ws("\n", "metric_line", "line", "value_line").alias("raw_quote"), F.lit("table_series_alignment").alias("binding_method"), F.lit(0.98).alias("value_binding_confidence"), F.lit(0.92).alias("extraction_confidence"),
        F.lit("was reported as").alias("predicate"), F.lit(None).cast("string").alias("scope"),
    )


def candidates(chunks: DataFrame) -> DataFrame:
    """All candidates of chunks(document_id, filename, page_number, chunk_index, text), in stages series (0), line (1), sentence (2).
    Lines and sentences go through the same extractor, as one table."""
    lines = settle(nonblank_lines(chunks, *KEYS))
    free = lines.where(route(F.col("line")).isNull()).select(*KEYS, F.lit(1).alias("stage"), F.col("line_no").alias("ordinal"), "line")
    flowing = sentences(lines, *KEYS).select(*KEYS, F.lit(2).alias("stage"), F.col("first_line").alias("ordinal"), F.col("sentence").alias("line"))
    said = line_candidates(settle(free.unionByName(flowing)), *KEYS, "stage")
    return series_candidates(lines, *KEYS).withColumn("stage", F.lit(0)).unionByName(said)


def checked_candidates(chunks: DataFrame) -> DataFrame:
    """All candidates of chunks with their normal forms, confidences and failure_type (null for valid ones)."""
    whole = chunks.select(*KEYS, F.col("text").alias("chunk_text"))
    c = settle(candidates(chunks)).join(whole, list(KEYS))
    year, value = (F.coalesce(a, b) for a, b in zip(index_base(F.col("raw_quote")), index_base(F.col("chunk_text")), strict=True))
    scope = F.when(F.col("stage") == 0, period_scope(F.col("raw_quote"))).when(F.col("binding_method") == "table_cell", period_scope(F.col("raw_quote"))).otherwise(F.col("period_scope"))
    c = c.withColumn("period_scope", scope).withColumn("estimate_vintage", F.coalesce(vintage(F.col("raw_quote")), vintage(F.col("chunk_text")))).withColumn("index_base_year", year).withColumn("index_base_value", value)
    c = c.withColumn("source_organization", source_organisation(F.col("filename"))).withColumn("subject_entity", F.col("entity")).withColumn("subject", F.col("entity")).withColumn("extraction_method", F.lit("fallback"))
    c = c.select("*", F.inline(F.array(normalized(F.col("value"), F.col("unit"), F.col("raw_quote"), F.col("metric")))))
    c = c.withColumn("is_numeric", F.col("numeric_value").isNotNull()).withColumn("grounding_confidence", grounding(F.col("raw_quote"), F.col("chunk_text")))
    c = c.withColumn("final_confidence", final_confidence(F.col("extraction_confidence"), F.col("grounding_confidence"), F.col("value_binding_confidence"))).drop("chunk_text")
    return with_failures(c, F.col("raw_quote"))


def accepted(c: DataFrame) -> DataFrame:
    """The valid ones of checked candidates, each once a chunk."""
    return first_candidates(passed(c), *KEYS)


def refused(c: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ledger: checked candidates that failed, and lines of chunks that are not extracted from."""
    lines = nonblank_lines(chunks, *KEYS).withColumn("failure_type", route(F.col("line"))).where("failure_type is not null")
    text = F.left("line", F.when(F.col("failure_type") == "STRUCTURAL_INDEX_METADATA", 100).otherwise(80))
    why = F.coalesce(reason(F.col("failure_type"), text, F.lit(""), F.lit("")), F.lit("The base of an index."))
    lines = lines.select("document_id", "page_number", "chunk_index", F.lit(1).alias("stage"), F.col("line_no").alias("ordinal"), text.alias("candidate_text"), "failure_type", why.alias("rejection_reason"))
    return failed(c, F.col("raw_quote")).unionByName(lines, allowMissingColumns=True)


def extract_facts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid facts, rejected candidates and lines) of chunks."""
    c = settle(checked_candidates(chunks))
    return accepted(c), refused(c, chunks)


def first_candidates(c: DataFrame, *keys: str) -> DataFrame:
    """Of candidates of a chunk with equal metric, value, period, scope and vintage the first (nulls are equal)."""
    same = Window.partitionBy(*keys, "metric", "normalized_value", "period", "period_scope", "estimate_vintage").orderBy("stage", "ordinal", "rank", "number")
    return c.withColumn("again", F.row_number().over(same)).where("again = 1").drop("again")


GRAM = 3


def grounded(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """texts with the quotes (quote, and other columns) that stand in them, and the grounding score.

    A quote's words but the first and last are whole words of the text, so a quote of enough words is looked up by its longest
    run of GRAM inner words: an equi-join on hashes, whose hits grounding decides. Only shorter quotes meet every text."""
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")), " ")
    grams = lambda w, first, n: F.transform(F.sequence(F.lit(first), n), lambda i: F.array_join(F.slice(w, i, GRAM), " "))
    q = quotes.withColumn("w", words(F.col("quote")))
    inner = grams(F.col("w"), 2, F.size("w") - GRAM)
    longest = F.array_max(F.transform(inner, lambda g: F.struct(F.length(g).alias("n"), g.alias("g"))))["g"]
    long = q.where(F.size("w") >= GRAM + 2).withColumn("key", F.xxhash64(longest)).drop("w")
    held = texts.withColumn("w", words(F.col("text"))).where(F.size("w") >= GRAM)
    held = held.select(*texts.columns, F.explode(F.array_distinct(F.transform(grams(F.col("w"), 1, F.size("w") - GRAM + 1), lambda g: F.xxhash64(g)))).alias("key"))
    hits = held.join(long, "key").drop("key")
    short_ = texts.join(q.where(F.size("w") < GRAM + 2).drop("w"), F.contains(F.lower("text"), F.element_at(words(F.col("quote")), 1)))
    return hits.unionByName(short_).withColumn("grounding", grounding(F.col("quote"), F.col("text"))).where("grounding > 0")
