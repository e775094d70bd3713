"""Pages to chunks, chunks to lines, lines to sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L
from quillfact.functions.roles import navigation
from quillfact.functions.text import fence, like, strip, token_estimate
from quillfact.functions.validate import header_label


def page_spans(text: Column, limit: int = L.CHUNK_TOKENS) -> Column:
    """array<struct<start, end>> of a page's chunks: paragraphs (set apart by blank lines) fill up chunks in order; one
    that exceeds the limit by itself stays whole."""
    kind = "array<struct<start:int,end:int>>"
    lines = F.split(text, "\n", -1)
    # fold over lines: at = offset of the line, p = start of the open paragraph (-1: none), pw = its words, c/e/w = open chunk
    state = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("p"), F.lit(0).alias("pw"), F.lit(-1).alias("c"), F.lit(0).alias("e"), F.lit(0).alias("w"), F.array().cast(kind).alias("out"))
    tokens = lambda w: F.floor(w * F.lit(L.TOKENS_PER_WORD))

    def closed(acc, end):
        """acc with its open paragraph (up to end) put into the chunk, or into a new one if it does not fit."""
        fits = (acc["c"] < 0) | (tokens(acc["w"] + acc["pw"]) <= limit)
        done = F.concat(acc["out"], F.array(F.struct(acc["c"].alias("start"), acc["e"].alias("end"))))
        return [
            F.when(fits & (acc["c"] >= 0), acc["c"]).otherwise(acc["p"]), end, F.when(fits, acc["w"] + acc["pw"]).otherwise(acc["pw"]), F.when(fits, acc["out"]).otherwise(done),
        ]

    def step(acc, line):
        blank, after = strip(line) == "", acc["at"] + F.length(line) + 1
        c, e, w, out = closed(acc, acc["at"])
        shut = blank & (acc["p"] >= 0)
        keep = lambda new, old: F.when(shut, new).otherwise(old)
        return F.struct(
            after.alias("at"), F.when(blank, -1).when(acc["p"] >= 0, acc["p"]).otherwise(acc["at"]).alias("p"),
            F.when(blank, 0).otherwise(acc["pw"] + F.size(F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0)))).alias("pw"),
            keep(c, acc["c"]).alias("c"), keep(e, acc["e"]).alias("e"), keep(w, acc["w"]).alias("w"), keep(out, acc["out"]).alias("out"),
        )

    def finish(acc):
        c, e, _, out = closed(acc, F.length(text))
        last = lambda o, s, t: F.concat(o, F.array(F.struct(s.alias("start"), t.alias("end"))))
        return F.when(acc["p"] >= 0, last(out, c, e)).when(acc["c"] >= 0, last(acc["out"], acc["c"], acc["e"])).otherwise(acc["out"])

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", F.array().cast(kind)).when(token_estimate(text) <= limit, whole).otherwise(F.aggregate(lines, state, step, finish))


def chunk_pages(pages: DataFrame, limit: int = L.CHUNK_TOKENS) -> DataFrame:
    """pages(document_id, page_number, text) -> chunks with a running index in each document."""
    spans = pages.select("document_id", "page_number", "text", F.inline(page_spans(F.col("text"), limit)))
    chunk = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "start")) - 1
    return spans.select("document_id", "page_number", index.alias("chunk_index"), F.col("start").alias("start_char"), F.col("end").alias("end_char"), chunk.alias("text"), token_estimate(chunk).alias("token_count"))


def nonblank_lines(chunks: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no (among lines that are not blank, from 0) and line of each chunk's text."""
    kept = F.filter(F.transform(F.split("text", "\n", -1), strip), lambda x: x != "")
    return chunks.select(*keys, F.posexplode(kept).alias("line_no", "line"))


def route(line: Column) -> Column:
    """Where a line goes: to the ledger under a failure type, or to extraction (null)."""
    return (
        F.when(navigation(line), "NAVIGATION_REFERENCE")
        .when(header_label(line), "TABLE_HEADER_WITHOUT_VALUE")
        .when(like(line, r"\[\s*\d{4}(?:-\d{2,4})?\s*=\s*\d+\s*\]"), "STRUCTURAL_INDEX_METADATA")
    )


def sentences(lines: DataFrame, *keys: str) -> DataFrame:
    """Sentences that were wrapped over several lines: keys, sentence_no, first_line, n_lines, sentence.

    A navigation or header line throws the open lines away; a heading-like line closes what is open before it; a line that
    ends in a full stop or colon closes after itself. Only sentences of several lines and over 25 characters remain.
    """
    order = Window.partitionBy(*keys).orderBy("line_no")
    drop = navigation(F.col("line")) | header_label(F.col("line"))
    heading = like(F.col("line"), r"^(?:[A-Z0-9\.\s]{4,}|Table\s+|Chart\s+|Appendix\s+|Note:|\d+\.\s+|[IVXLCDM]+\.\d+)")
    ends = like(F.col("line"), r"[.:]$")
    marked = fence(lines, drop=drop, heading=heading)
    drop, heading = F.col("drop"), F.col("heading")
    marked = marked.withColumn("starts", drop | heading | F.coalesce(F.lag(drop | ends).over(order), F.lit(True)))
    grouped = marked.withColumn("sentence_no", F.sum(F.col("starts").cast("int")).over(order))
    # lines that a dropped one follows before they were closed go with it
    grouped = grouped.withColumn("lost", F.coalesce(F.lead("drop").over(order), F.lit(False)) & ~ends)
    out = grouped.where("not drop").groupBy(*keys, "sentence_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("part"), F.max("lost").alias("lost"))
    joined = strip(F.array_join(F.transform("part", lambda x: x["line"]), " "))
    return out.where(~F.col("lost") & (F.size("part") > 1)).select(*keys, "sentence_no", F.element_at("part", 1)["line_no"].alias("first_line"), F.size("part").alias("n_lines"), joined.alias("sentence")).where(F.length("sentence") > 25)
