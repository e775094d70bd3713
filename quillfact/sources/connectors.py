"""Seams for what lies outside: page parsers and language models, as callables that run in the tasks.

None is bundled. What a model says of a chunk is mapped to the same columns, normal forms and checks as what the rules find;
where it fails, the rules take over. Answers are written to a table before they are used, so nothing is asked twice."""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfact.functions.normalize import document_entity, normalized, period
from quillfact.functions.text import either, final_confidence, grounding
from quillfact.functions.validate import checked
from quillfact.operators.extract import KEYS, extract_facts
from quillfact.operators.judge import floored, percent_delta, verdict

PAGES = "document_id string, filename string, page_number int, text string, error string"
ANSWERS = "document_id string, filename string, page_number int, chunk_index int, text string, answer string, method string, warning string"
FACTS = """facts array<struct<entity: string, subject: string, metric: string, predicate: string, value: string, unit: string, period: string, time_scope: string, as_of_date: string, scope: string,
qualifiers: string, raw_quote: string, extraction_confidence: double, value_binding_confidence: double>>"""
JUDGEMENT = "taxonomy_category string, reasoning string, confidence_delta double, comparison_delta double"


#: Seconds that a model has for an answer about a chunk, and about a pair; calls of a task that run side by side.
ASK_SECONDS, JUDGE_SECONDS, WORKERS = 15.0, 4.0, 4


def timed(call: Callable, seconds: float) -> Callable:
    """call, with a deadline: where it gives no answer in time, TimeoutError. A call that hangs is left to a thread of its own,
    which ends with the worker."""

    def run(*args):
        box: queue.SimpleQueue = queue.SimpleQueue()

        def answer() -> None:
            try:
                box.put((call(*args), None))
            except BaseException as e:
                box.put((None, e))

        threading.Thread(target=answer, daemon=True).start()
        try:
            value, error = box.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no answer in {seconds:g} s") from None
        if error is not None:
            raise error
        return value

    return run


def pages_of(files: DataFrame, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of files(document_id, filename, content), numbered from 1; a file that cannot be parsed gives one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, name, content in zip(frame["document_id"], frame["filename"], frame["content"], strict=True):
                try:
                    rows = [(doc, name, i, text, None) for i, text in enumerate(parse(bytes(content)), 1)]
                except Exception as e:
                    rows = [(doc, name, None, None, str(e))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")]).astype({"page_number": "Int32"})

    return files.select("document_id", "filename", "content").mapInPandas(run, PAGES)


def ask(chunks: DataFrame, call: Callable[[str, str, int], str], path: str, seconds: float = ASK_SECONDS, workers: int = WORKERS) -> DataFrame:
    """What a model says (call(text, filename, page) gives a JSON object) of chunks(document_id, filename, page_number,
    chunk_index, text), written to path. The chunks of a document are asked about in order, those of several documents side
    by side; after a failure, or no answer within the seconds, the model is not asked about the document's other chunks."""

    def of_document(rows: list[tuple], failed: bool) -> tuple[list[tuple], bool]:
        said, answer_of = [], timed(call, seconds)
        for name, page, text in rows:
            if failed:
                said.append((None, "fallback", "model failed on an earlier chunk"))
                continue
            try:
                answer = answer_of(text, name, page)
                if not isinstance(json.loads(answer), dict):
                    raise ValueError("no JSON object")
                said.append((answer, "llm", None))
            except Exception as e:
                failed = True
                said.append((None, "fallback", f"model failed: {e}"))
        return said, failed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed: str | None = None  # rows come by document; one may go on in the next frame
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                docs = [(doc, list(rows)) for doc, rows in groupby(zip(frame["document_id"], frame["filename"], frame["page_number"], frame["text"], strict=True), key=lambda r: r[0])]
                done = list(pool.map(lambda d, failed=failed: of_document([r[1:] for r in d[1]], d[0] == failed), docs))
                failed = docs[-1][0] if docs and done[-1][1] else None
                said = [x for some, _ in done for x in some]
                yield frame.assign(**{c: [s[i] for s in said] for i, c in enumerate(("answer", "method", "warning"))})

    asked = chunks.select(*KEYS, "text").repartition("document_id").sortWithinPartitions("document_id", "chunk_index")
    asked.mapInPandas(run, ANSWERS).write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.schema(ANSWERS).parquet(path)


def said_facts(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid facts, rejected candidates) of the answers of ask."""
    each = answers.where("answer is not null").select(*KEYS, "text", F.posexplode(F.from_json("answer", FACTS)["facts"]).alias("number", "f"))
    quote = F.coalesce("f.raw_quote", F.lit(""))
    c = each.select(
        *KEYS, "text", "number", either(either(F.col("f.entity"), F.col("f.subject")), document_entity(F.col("filename"))).alias("entity"), F.coalesce("f.metric", F.lit("")).alias("metric"),
        either(F.col("f.predicate"), F.lit("was reported as")).alias("predicate"), F.coalesce("f.value", F.lit("")).alias("value"), F.col("f.unit").alias("unit"), period(either(F.col("f.period"), F.col("f.time_scope"))).alias("period"),
        F.col("f.as_of_date").alias("as_of_date"), F.col("f.scope").alias("scope"), F.col("f.qualifiers").alias("qualifiers"), quote.alias("raw_quote"), F.coalesce("f.extraction_confidence", F.lit(0.9)).alias("extraction_confidence"),
        F.coalesce("f.value_binding_confidence", F.lit(0.9)).alias("value_binding_confidence"), grounding(quote, F.col("text")).alias("grounding_confidence"), F.lit("llm").alias("extraction_method"),
    )
    c = c.withColumn("subject", F.col("entity")).withColumn("final_confidence", final_confidence(F.col("extraction_confidence"), F.col("grounding_confidence"), F.col("value_binding_confidence"))).drop("text")
    c = c.select("*", F.inline(F.array(normalized(F.col("value"), F.col("unit"), F.col("raw_quote"), F.col("metric")))))
    c = c.withColumn("is_numeric", F.col("numeric_value").isNotNull())
    return checked(c, F.col("raw_quote"))


def extract_with_model(chunks: DataFrame, call: Callable[[str, str, int], str], path: str, seconds: float = ASK_SECONDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, rejected, modes): of the model where it answers, of the rules elsewhere."""
    answers = ask(chunks, call, path, seconds)
    facts, rejected = said_facts(answers)
    others, noise = extract_facts(answers.where("answer is null").select(*KEYS, "text"))
    both = lambda a, b: a.unionByName(b.withColumn("extraction_method", F.lit("fallback")) if "extraction_method" in a.columns else b, allowMissingColumns=True)
    return both(facts, others), both(rejected, noise), run_modes(answers)


def run_modes(answers: DataFrame) -> DataFrame:
    """document_id, mode, warnings of answers(document_id, chunk_index, method, warning): degraded if the rules had to stand in
    anywhere; each warning once, in the order in which they first came."""
    modes = answers.groupBy("document_id").agg(F.when(F.bool_or(F.col("method") == "fallback"), "degraded").otherwise("normal").alias("mode"))
    said = answers.where("warning is not null").groupBy("document_id", "warning").agg(F.min("chunk_index").alias("at"))
    said = said.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "warning"))), lambda x: x["warning"]).alias("warnings"))
    return modes.join(said, "document_id", "left").select("document_id", "mode", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def judge_with_model(call: Callable[[str], str], path: str, seconds: float = JUDGE_SECONDS, workers: int = WORKERS) -> Callable[[DataFrame], DataFrame]:
    """A judge for analyse: the rules decide, and of what they leave uncertain the model (call(pair as JSON) gives a JSON
    object) is asked; where it fails or gives no answer within the seconds, the pair stays uncertain."""

    def opinion(question: str) -> str | None:
        try:
            answer = timed(call, seconds)(question)
            return answer if isinstance(json.loads(answer), dict) else None
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                yield frame[["pos_a", "pos_b"]].assign(answer=list(pool.map(opinion, frame["question"])))

    def judge(pairs: DataFrame) -> DataFrame:
        out = pairs.select("*", F.inline(F.array(verdict()))).withColumn("delta", percent_delta(F.col("a.normalized_value"), F.col("b.normalized_value")))
        unsure = out.where("relationship = 'UNCERTAIN'").select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.to_json(F.struct("a", "b")).alias("question"))
        unsure.mapInPandas(run, "pos_a long, pos_b long, answer string").write.mode("overwrite").parquet(path)
        answers = pairs.sparkSession.read.schema("pos_a long, pos_b long, answer string").parquet(path).where("answer is not null").select("pos_a", "pos_b", F.from_json("answer", JUDGEMENT).alias("said"))
        tax = F.upper(F.coalesce("said.taxonomy_category", F.lit("UNCERTAIN")))
        relation = F.when(tax.isin("RECONCILED_UNIT", "RECONCILED_ROUNDING", "RECONCILED_SCOPE", "CONTEXTUAL_DIFFERENCE"), "RECONCILED").otherwise(tax)
        out = out.join(answers, (F.col("a.pos") == F.col("pos_a")) & (F.col("b.pos") == F.col("pos_b")), "left")
        put = lambda old, new: F.when(F.col("said").isNotNull(), new).otherwise(F.col(old)).alias(old)
        changed = {"relationship": relation, "taxonomy": tax, "reconciliation": tax, "confidence": F.coalesce("said.confidence_delta", F.lit(0.0))}
        return floored(out.select(*[put(c, changed[c]) if c in changed else F.col(c) for c in out.columns if c not in ("pos_a", "pos_b", "said")]))

    return judge
