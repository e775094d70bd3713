"""The analysis of what is stored: relationships take the place of all earlier ones, confidences go back to the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfact.operators.judge import analyse, judged
from quillfact.sources import store as S
from quillfact.sources import tables as T
from quillfact.sources.scratch import settle


def analyse_store(spark: SparkSession, root: str, judge=judged) -> DataFrame:
    """Judge all pairs of stored facts, store relationships and final confidences in one commit; returns the row of counters."""
    facts = S.rows_of(spark, root, "facts")
    done = analyse(facts, judge)
    edges = settle(T.typed(T.numbered(done.relationships, "relationship_id", ["fact_id_a"], ["fact_id_b", "relationship_type"], S.next_number(spark, root, "fact_relationships")), "fact_relationships"))
    scored = facts.drop("final_confidence").join(done.confidences, "fact_id").select(facts.columns)
    S.change(spark, root, whole={"fact_relationships": edges, "facts": scored}, numbers={"fact_relationships": edges.count()})
    return done.summary
