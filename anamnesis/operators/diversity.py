"""Selection: first per key, round robin over sessions, ordered merges, neighbours within a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions import text as T


def dedup_top(rows: DataFrame, scope: list[str], key: Column, order: list, k: int) -> DataFrame:
    """The first row per key in the order, then the k first of each scope, with rank."""
    first = rows.withColumn("__key", key).withColumn("__n", F.row_number().over(W.partitionBy(*scope, "__key").orderBy(*order))).where("__n = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*scope).orderBy(*order))).where(F.col("rank") <= k).drop("__key", "__n")


def alignment(content: Column, quote: Column, anchors: Column, role: Column, score: Column) -> Column:
    """How well a memory fits the question: anchors, shared tokens, the user's own words, its score."""
    shared = F.size(F.array_intersect(content, T.content_tokens(quote)))
    return 2.0 * anchors + 0.25 * shared + F.when(T.dedup_key(role) == "user", 0.2).otherwise(0.0) + score


def round_robin(rows: DataFrame, scope: str, session: str, score: str, seq: str, limit: int, most_sessions: int) -> DataFrame:
    """One row per session in turn, sessions by their best row (ties: first seen), rows within by score; with rank."""
    w = W.partitionBy(scope, session)
    deep = rows.withColumn("depth", F.row_number().over(w.orderBy(F.desc(score), seq))).withColumns({"__best": F.max(score).over(w), "__seen": F.min(seq).over(w)})
    ranked = deep.withColumn("session_rank", F.dense_rank().over(W.partitionBy(scope).orderBy(F.desc("__best"), "__seen"))).where(F.col("session_rank") <= most_sessions)
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(scope).orderBy("depth", "session_rank"))).where(F.col("rank") <= limit).drop("__best", "__seen")


def ordered_merge(groups: list[DataFrame], scope: str, seq: str, quote: str, limit: int, blank: bool = False) -> DataFrame:
    """Groups one after the other, the first row per quote; a blank quote counts once if `blank`, else never."""
    rows = None
    for n, g in enumerate(groups):
        part = g.withColumn("group_no", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    key = T.dedup_key(F.col(quote))
    return dedup_top(rows if blank else rows.where(key != ""), [scope], key, ["group_no", seq], limit)


def interleaved(primary: DataFrame, neighbours: DataFrame, scope: str, seq: str, quote: str, limit: int) -> DataFrame:
    """The best row, all its neighbours, then the other rows."""
    first = F.row_number().over(W.partitionBy(scope).orderBy(seq))
    p = primary.withColumn("group_no", F.when(first == 1, 0).otherwise(2))
    rows = p.unionByName(neighbours.withColumn("group_no", F.lit(1)), allowMissingColumns=True)
    return dedup_top(rows, [scope], T.dedup_key(F.col(quote)), ["group_no", seq], limit)


def session_neighbours(turns: DataFrame, anchors: DataFrame, session: str, turn: str, radius: int) -> DataFrame:
    """(session, turn, score): turns within `radius` positions of an anchor, anchors left out; .35 over the least distance.

    The band join is an equi-join: each anchor names the positions around it."""
    placed = turns.select(session, turn).distinct().withColumn("pos", F.row_number().over(W.partitionBy(session).orderBy(turn)))
    a = anchors.select(session, turn).distinct()
    around = placed.join(a, [session, turn]).select(session, F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("off"), "pos").select(session, F.abs("off").alias("distance"), (F.col("pos") + F.col("off")).alias("pos"))
    near = around.groupBy(session, "pos").agg(F.min("distance").alias("distance"))
    return placed.join(near, [session, "pos"]).join(a, [session, turn], "left_anti").select(session, turn, "distance", (0.35 / F.greatest(F.lit(1), "distance")).alias("score"))


# Words after `before` or `after` that name no event.
VAGUE = ["day", "event", "had", "night", "time"]


def reference_tokens(question: Column) -> Column:
    """The event that a question's `before` or `after` names."""
    return F.array_except(T.content_tokens(F.regexp_extract(T.some(question), r"(?i)\b(?:before|after)\b(.+)$", 1)), F.array(*map(F.lit, VAGUE)))


def neighbour_priority(question: Column, quote: Column, role: Column, score: Column) -> Column:
    """(match, timed, overlap, user, score), largest first: whether the quote has the event that the question refers to, and that with a time, its words in common, its role."""
    from anamnesis.functions import spans, temporal

    wanted, have = reference_tokens(question), T.content_tokens(quote)
    match = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, have)) == 0)
    clause = F.when(match, spans.clause_for_tokens(quote, wanted)).otherwise(F.lit(""))
    timed = temporal.weekday(clause).isNotNull() | clause.rlike(r"(?i)\b(?:today|tomorrow|yesterday|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b")
    return F.struct(match.cast("int").alias("match"), timed.cast("int").alias("timed"), F.size(F.array_intersect(T.content_tokens(question), have)).alias("overlap"), (T.dedup_key(role) == "user").cast("int").alias("user"), score.cast("double").alias("score"))


def neighbours_by_priority(rows: DataFrame, scope: str, turn: str, limit: int) -> DataFrame:
    """rows (scope, turn, qtext, quote, role, score) by priority, one per turn, with rank, `limit` per scope."""
    named = rows.withColumn("priority", neighbour_priority(F.col("qtext"), F.col("quote"), F.col("role"), F.col("score")))
    return dedup_top(named, [scope], F.col(turn).cast("string"), [F.desc("priority"), turn], limit)
