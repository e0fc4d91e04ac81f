"""Hybrid retrieval in one plan over all questions: lexical and dense legs, union, fusion, rerank, first per quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions import text as T
from anamnesis.functions.numbers import places
from anamnesis.operators import diversity, fusion, lexical


def lexical_search(docs: DataFrame, questions: DataFrame, doc: str, text: str, question: str, question_text: str, k: int) -> DataFrame:
    """The k best documents of each question by BM25, one per text."""
    scores = lexical.bm25(docs, questions, doc, text, question, question_text)
    top = lexical.lexical_candidates(scores, k * 8)
    named = top.join(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), "doc")
    return diversity.dedup_top(named, ["question"], T.dedup_key(F.col("text")), [places(F.col("lexical_score"), lexical.DECIMALS).desc(), "doc"], k)


def hybrid_search(lexical_leg: DataFrame, dense_leg: DataFrame, graph_leg: DataFrame | None, docs: DataFrame, questions: DataFrame, k: int, least: float, blocked: DataFrame | None = None) -> DataFrame:
    """(question, doc, hybrid, rerank, score, rank): fused candidates, reranked by the words that question and text share.

    docs: doc, text; questions: question, qtext; blocked: (question, doc) that a question may not use, by its filters or as its own turns: they go
    after candidates were made, so they take their places among these. Other filters belong between the legs and this step: scores are normalised and
    candidates cut before anything is filtered."""
    fused = fusion.candidate_union(dense_leg, lexical_leg, graph_leg).withColumn("hybrid", fusion.hybrid_score()).where("hybrid > 0")
    if blocked is not None:
        fused = fused.join(blocked, ["question", "doc"], "left_anti")
    none = F.lit(None).cast("string")
    named = docs.join(fused.select("doc").distinct(), "doc", "left_semi").select("doc", "text", fusion.rerank_tokens(F.col("text"), none, none).alias("m"))
    rows = fused.join(named, "doc").join(questions.select("question", F.array_distinct(T.retrieval_tokens(F.col("qtext"))).alias("q")), "question")
    rerank = fusion.heuristic_rerank(F.col("q"), F.col("m"), F.col("text"), none, F.array().cast("array<string>"), F.array().cast("array<string>"))
    scored = rows.withColumn("rerank", rerank).withColumn("score", places(fusion.final_score(F.col("rerank"), F.col("hybrid")), lexical.DECIMALS)).where(F.col("score") >= least)
    return diversity.dedup_top(scored, ["question"], T.dedup_key(F.col("text")), [F.desc("score"), "doc"], k).select("question", "doc", "hybrid", "rerank", "score", "rank")


def last_per(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last non-null value before each row, by key."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("previous", F.last(value, ignorenulls=True).over(before))
