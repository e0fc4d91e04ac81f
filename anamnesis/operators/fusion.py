"""Candidate union, filters, hybrid scores, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions import text as T

DENSE, LEXICAL, GRAPH, FLOOR, RERANK = 0.50, 0.30, 0.20, 0.45, 0.65


def candidate_k(n: Column | int, k: int) -> Column | int:
    """How many candidates each leg gives: eight times what is asked, or all."""
    return min(n, k * 8) if isinstance(n, int) else F.least(n, F.lit(k * 8))


def graph_candidates(memories: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question, doc, graph_score): 1 for memories of a found edge, .9 for a shared turn, .7 for a shared end.

    memories: doc, edge_id, source_turn_ids, head_entity_id, tail_entity_id. evidence: question and the same, per edge.
    The either-or is a union of four equi-joins."""
    turns = lambda d, *c: d.select(*c, F.explode("source_turn_ids").alias("turn"))
    ends = evidence.select("question", F.explode(F.array("head_entity_id", "tail_entity_id")).alias("end")).where("end IS NOT NULL").distinct()
    legs = [
        memories.select("doc", "edge_id").join(evidence.select("question", "edge_id").distinct(), "edge_id").select("question", "doc", F.lit(1.0).alias("graph_score")),
        turns(memories, "doc").join(turns(evidence, "question").distinct(), "turn").select("question", "doc", F.lit(0.9).alias("graph_score")),
        *(memories.select("doc", F.col(c).alias("end")).join(ends, "end").select("question", "doc", F.lit(0.7).alias("graph_score")) for c in ("head_entity_id", "tail_entity_id")),
    ]
    out = legs[0]
    for leg in legs[1:]:
        out = out.unionAll(leg)
    return out.groupBy("question", "doc").agg(F.max("graph_score").alias("graph_score"))


def candidate_union(dense: DataFrame, lexical: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """(question, doc, three scores, sources): the largest of each score, 0 where a leg has none."""
    legs = [("dense", dense, "dense_score"), ("bm25", lexical, "lexical_score")] + ([("graph_expansion", graph, "graph_score")] if graph is not None else [])
    names = ("dense_score", "lexical_score", "graph_score")
    rows = None
    for source, leg, own in legs:
        part = leg.select("question", "doc", *((F.col(own) if n == own else F.lit(0.0)).alias(n) for n in names), F.lit(source).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("question", "doc").agg(*(F.max(n).alias(n) for n in names), F.array_sort(F.collect_set("source")).alias("sources"))


def hybrid_score() -> Column:
    h = DENSE * F.col("dense_score") + LEXICAL * F.col("lexical_score") + GRAPH * F.col("graph_score")
    return F.when(F.col("graph_score") > 0, F.greatest(h, FLOOR * F.col("graph_score"))).otherwise(h)


def passes_filters(excluded: Column, scope: Column, keys: Column) -> Column:
    """Whether a memory may be evidence. Columns: source_turn_ids, status, relation_key, relation_keys, superseded_relation_keys; all may be null.

    Tense alone never excludes; relations only count where the question names some."""
    none = F.array().cast("array<string>")
    own, gone = F.coalesce("relation_keys", none), F.coalesce("superseded_relation_keys", none)
    asked, now = F.size(keys) > 0, scope == "current"
    drop = F.coalesce(F.arrays_overlap(F.coalesce(F.col("source_turn_ids"), F.array().cast("array<bigint>")), excluded), F.lit(False))
    drop = drop | (now & F.coalesce(F.col("status") == "superseded", F.lit(False)))
    drop = drop | (asked & F.coalesce((F.col("relation_key") != "") & ~F.array_contains(keys, F.col("relation_key")), F.lit(False)))
    drop = drop | (asked & (F.size(own) > 0) & ~F.arrays_overlap(own, keys)) | (now & asked & F.arrays_overlap(gone, keys))
    return ~drop


def rerank_tokens(text: Column, relation: Column, quote: Column) -> Column:
    """The set of tokens by which a memory is reranked; worked out once per memory, not per pair."""
    return F.array_distinct(T.retrieval_tokens(F.concat_ws(" ", F.nullif(text, F.lit("")), F.nullif(relation, F.lit("")), F.nullif(quote, F.lit("")))))


def heuristic_rerank(q: Column, m: Column, quote: Column, relation_key: Column, relation_keys: Column, keys: Column) -> Column:
    """Overlap of a memory's tokens m with the question's q (both sets), a bonus for its relation and for a quote; at most 1."""
    bonus = F.when(F.coalesce(F.array_contains(keys, relation_key), F.lit(False)), 0.2).when(F.coalesce(F.arrays_overlap(relation_keys, keys), F.lit(False)), 0.15).otherwise(0.0)
    score = F.size(F.array_intersect(q, m)) / F.greatest(F.lit(1), F.size(q)) + bonus + F.when(T.some(quote) != "", 0.1).otherwise(0.0)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.least(F.lit(1.0), score))


def min_max(column: str, constant: Column, scope: str = "question") -> Column:
    """The column scaled to 0..1 within its question; `constant` where all values are equal."""
    w = W.partitionBy(scope)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(constant)


def final_score(rerank: Column, hybrid: Column) -> Column:
    return RERANK * rerank + (1 - RERANK) * hybrid


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))
