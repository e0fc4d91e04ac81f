"""Symbolic plans over facts: measures, identity, sums and counts, joins of adjacent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions import numbers, temporal, text as T

#: Fixed: number, unit and money patterns of a measurement.
NUMBER = r"(?:\d+(?:,\d{3})*(?:\.\d+)?|a|an|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|dozen|couple)(?:[- ](?:one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand))*(?:\s+and\s+(?:a\s+)?half)?"
UNIT = r"(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)"
DURATION = rf"(?i)\b({NUMBER})[\s-]+({UNIT})\b"
MONEY = r"(?i)(?:\$\s*(\d+(?:,\d{3})*(?:\.\d+)?)|\b(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:dollars|usd)\b)"


def measures(text: Column, unit: Column) -> Column:
    """Array of (text, value in the wanted unit) of the measurements in a text; those of another kind are left out."""
    raw = F.regexp_extract_all(T.some(text), F.lit(DURATION), F.lit(0))
    one = lambda m: F.struct(m.alias("text"), numbers.convert(numbers.parse_number(F.regexp_extract(m, DURATION, 1)), F.regexp_extract(m, DURATION, 2), unit).alias("value"))
    paid = F.transform(F.regexp_extract_all(T.some(text), F.lit(MONEY), F.lit(0)), lambda m: F.struct(m.alias("text"), F.regexp_replace(m, "[^0-9.]", "").try_cast("double").alias("value")))
    return F.filter(F.when(unit == "money", paid).otherwise(F.transform(raw, one)), lambda m: m["value"].isNotNull())


def measurement_facts(evidence: DataFrame, plans: DataFrame, most: int = 24) -> DataFrame:
    """(question, turn, session, text, value, overlap, n): what the user said in the unit asked for, best overlap first.

    evidence: question, turn, session, role, quote; plans: question, target_unit, relevance (tokens)."""
    rows = evidence.join(plans, "question").where(F.lower("role") == "user")
    found = rows.select("question", "turn", "session", "quote", F.size(F.array_intersect("relevance", T.content_tokens(F.col("quote")))).alias("overlap"), F.posexplode(measures(F.col("quote"), F.col("target_unit"))).alias("pos", "m"))
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("overlap"), "turn", "pos"))
    return found.select("question", "turn", "session", "pos", F.col("m.text").alias("text"), F.col("m.value").alias("value"), "overlap").withColumn("n", rank).where(F.col("n") <= most)


def distinct_facts(facts: DataFrame, identity: Column, order: list) -> DataFrame:
    """The first fact per identity of each question."""
    first = F.row_number().over(W.partitionBy("question", "__id").orderBy(*order))
    return facts.withColumn("__id", identity).withColumn("__n", first).where("__n = 1").drop("__id", "__n")


def similar_facts_dropped(facts: DataFrame, least: float = 0.35) -> DataFrame:
    """Facts of one question (at most some dozens) in order; one that has the value of a kept one and a similar clause goes.

    facts: question, n, value, clause. Kept facts decide on later ones, so each question is folded in order."""
    item = F.struct("n", "value", T.content_tokens(F.col("clause")).alias("tokens"))
    lists = facts.groupBy("question").agg(F.array_sort(F.collect_list(item)).alias("all"))
    empty = F.expr("cast(array() as array<struct<n:int,value:double,tokens:array<string>>>)")
    same = lambda k, x: (F.abs(k["value"] - x["value"]) < 1e-9) & (T.jaccard(k["tokens"], x["tokens"]) >= least)
    typed = F.transform("all", lambda x: F.struct(x["n"].cast("int").alias("n"), x["value"].cast("double").alias("value"), x["tokens"].alias("tokens")))
    kept = F.aggregate(typed, empty, lambda acc, x: F.when(F.exists(acc, lambda k: same(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select("question", F.explode(F.transform(kept, lambda k: k["n"])).alias("n")).join(facts, ["question", "n"])


def execute(facts: DataFrame, plans: DataFrame) -> DataFrame:
    """(question, status, value, answer, n_facts, n_sessions): sums and counts over distinct facts.

    complete needs as many facts as the question states (if it does) and facts from enough sessions."""
    per = facts.groupBy("question").agg(F.sum("value").alias("total"), F.count("*").alias("n_facts"), F.countDistinct("session").alias("n_sessions"))
    rows = plans.join(per, "question", "left").na.fill(0, ["n_facts", "n_sessions"])
    value = F.when(F.col("operation") == "sum", F.col("total")).otherwise(F.col("n_facts").cast("double"))
    enough = (F.col("n_facts") > 0) & (F.col("n_facts") >= F.coalesce("expected_fact_count", F.lit(1.0))) & (F.col("n_sessions") >= F.col("minimum_sessions"))
    status = F.when(~F.col("operation").isin("sum", "count", "count_distinct"), "not_applicable").when(enough, "complete").otherwise("insufficient_evidence")
    out = rows.withColumns({"status": status, "value": F.when(status == "complete", value)})
    return out.select("question", "status", "value", F.when(F.col("status") == "complete", numbers.answer(F.col("value"), F.col("operation"), F.col("target_unit"))).alias("answer"), "n_facts", "n_sessions")


def temporal_join(targets: DataFrame, references: DataFrame) -> DataFrame:
    """(question, value, n): targets a day before or after a reference; value only if one (turn, value) is left.

    targets: question, direction, turn, value, weekday, date; references: question, turn, weekday, date."""
    r = references.select("question", F.col("turn").alias("r_turn"), F.col("weekday").alias("r_weekday"), F.col("date").alias("r_date"))
    near = temporal.adjacent(F.col("direction"), F.col("weekday"), F.col("r_weekday"), F.col("date"), F.col("r_date"))
    joined = targets.join(r, "question").where(near).select("question", "turn", "value").distinct()
    return joined.groupBy("question").agg(F.count("*").alias("n"), F.min("value").alias("one")).select("question", F.when(F.col("n") == 1, F.col("one")).alias("value"), "n")


def grounded_triples(lines: DataFrame, quotes: DataFrame, most: int = 6) -> DataFrame:
    """(evidence_id, head, relation, tail): `id | head | relation | tail` lines whose ends stand in the quote; distinct, `most` per evidence."""
    from anamnesis.operators.planner import grounded

    part = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    rows = lines.withColumn("p", part).where(F.size("p") == 4).select("line_no", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("evidence_id", "head", "relation", "tail"))))
    rows = rows.where("head <> '' AND relation <> '' AND tail <> ''").join(quotes, "evidence_id").where(grounded(F.col("quote"), F.col("head")) & grounded(F.col("quote"), F.col("tail")))
    first = rows.groupBy("evidence_id", "head", "relation", "tail").agg(F.min("line_no").alias("line_no"))
    return first.withColumn("n", F.row_number().over(W.partitionBy("evidence_id").orderBy("line_no"))).where(F.col("n") <= most)


# Entities that are no facts, and words of a question that name no action.
GENERIC_ENTITIES = ["advice", "answer", "information", "recommendation", "speaker", "tips"]
COUNTING_WORDS = ["different", "many", "number", "total"]


def generic_entity(value: Column) -> Column:
    return T.dedup_key(value).isin([*T.GENERIC_VALUES, *GENERIC_ENTITIES])


def count_facts(extractions: DataFrame, plans: DataFrame, most: int = 30) -> DataFrame:
    """(question, candidate_id, turn, session, head, relation, tail, entity, target_overlap, action_overlap, score, rank): triples that the user
    stated and that have words of what is counted or of what is done with it.

    extractions: question, seq, turn, session, role, speaker, quote, method, triples; plans: question, text, target_tokens. The
    entity is the tail, or the head if the tail is generic; of a batch extraction it must stand in the quote. Equal triples of a turn count once."""
    q = plans.select("question", T.content_tokens(F.col("text")).alias("q"), F.coalesce("target_tokens", F.array().cast("array<string>")).alias("target"))
    q = q.withColumn("action", F.array_except(F.array_except("q", "target"), F.array(*map(F.lit, COUNTING_WORDS))))
    share = lambda a, b: F.size(F.array_intersect(a, b))
    rows = extractions.where(T.dedup_key(F.coalesce(F.nullif("role", F.lit("")), "speaker")) == "user").join(q, "question")
    rows = rows.withColumn("said", share("q", T.content_tokens(F.col("quote")))).where((F.size("q") == 0) | (F.col("said") > 0))
    each = rows.select("question", "seq", "turn", "session", "quote", "method", "q", "target", "action", "said", F.posexplode("triples").alias("pos", "t"))
    each = each.select("*", *(F.trim(F.col("t")[c]).alias(c) for c in ("head", "relation", "tail"))).withColumn("triple", F.concat_ws(" ", "head", "relation", "tail"))
    words = T.content_tokens(F.col("triple"))
    each = each.withColumns({"target_overlap": share("target", words), "action_overlap": share("action", words)}).where("target_overlap > 0 OR action_overlap > 0")
    each = each.withColumn("entity", F.when(generic_entity(F.col("tail")) & ~generic_entity(F.col("head")), F.col("head")).otherwise(F.col("tail"))).where(~generic_entity(F.col("entity")))
    each = each.where(~F.coalesce(F.col("method") == "selected_evidence_batch", F.lit(False)) | T.holds_value(F.col("quote"), F.col("entity")))
    once = each.groupBy("question", "turn", T.dedup_key(F.col("triple")).alias("k1"), T.dedup_key(F.col("entity")).alias("k2")).agg(F.min(F.struct("seq", "pos", "session", "head", "relation", "tail", "entity", "target_overlap", "action_overlap", "said")).alias("x"))
    out = once.select("question", "turn", "x.*").withColumn("score", 2.0 * F.col("target_overlap") + F.col("action_overlap") + 0.2 * F.col("said"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "seq", "pos"))).where(F.col("rank") <= most)
    return out.select("question", F.concat(F.lit("C"), F.col("rank").cast("string")).alias("candidate_id"), "turn", "session", "head", "relation", "tail", "entity", "target_overlap", "action_overlap", "score", "rank")


def selections(lines: DataFrame, candidates: DataFrame, prefix: str) -> DataFrame:
    """candidates that a model's lines `PREFIX | C3 | name` name, with canonical_identity; the first line of each counts, unknown ids don't.

    lines: question, line_no, line; candidates: question, candidate_id, ..."""
    pattern = rf"(?i)^\Q{prefix}\E\s*\|\s*([A-Z]\d+)(?:\s*\|\s*(.+?))?\s*$"
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    named = F.regexp_replace(F.regexp_extract(bare, pattern, 2), r"""^[ .,:;"']+|[ .,:;"']+$""", "")
    rows = lines.where(bare.rlike(pattern)).select("question", F.upper(F.regexp_extract(bare, pattern, 1)).alias("candidate_id"), "line_no", named.alias("canonical_identity"))
    first = rows.groupBy("question", "candidate_id").agg(F.min_by("canonical_identity", "line_no").alias("canonical_identity"), F.min("line_no").alias("line_no"))
    return candidates.join(first, ["question", "candidate_id"])


def execute_plans(facts: DataFrame, adjacent: DataFrame, plans: DataFrame) -> DataFrame:
    """(question, status, answer, n_facts, n_sessions) of every plan: sums and counts over facts, temporal joins over adjacent events, nothing for the others."""
    joined = plans.where("operation = 'temporal_join'").select("question").join(adjacent, "question", "left")
    found = F.col("value").isNotNull()
    temporal_branch = joined.select("question", F.when(found, "complete").otherwise("insufficient_evidence").alias("status"), F.col("value").cast("string").alias("answer"), F.coalesce("n", F.lit(0)).cast("long").alias("n_facts"), F.lit(None).cast("long").alias("n_sessions"))
    measured = execute(facts, plans.where("operation <> 'temporal_join'")).select("question", "status", "answer", "n_facts", "n_sessions")
    return measured.unionByName(temporal_branch)
