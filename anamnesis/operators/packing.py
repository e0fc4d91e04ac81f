"""Evidence text and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions import text as T


def evidence_block(rows: DataFrame, scope: str, order: str, prefix: str, quote: str, empty: str, compact: int = 240) -> DataFrame:
    """(scope, block): `[P1] quote` lines in order, numbered from 1; `empty` where there is none. Rows per scope are top-k lists."""
    lists = rows.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), T.compact_quote(F.col(quote), compact).alias("q")))).alias("x"))
    lines = F.transform("x", lambda r, i: F.concat(F.lit(f"[{prefix}"), (i + 1).cast("string"), F.lit("] "), r["q"]))
    return lists.select(scope, F.when(F.size("x") == 0, F.lit(empty)).otherwise(F.array_join(lines, "\n")).alias("block"))


def packed(sections: Column, budget: Column, joiner: str = "\n\n") -> Column:
    """Sections in order, each trimmed to what is left of the budget; empty ones and those without room are left out."""
    start = F.struct(F.lit("").alias("text"), budget.cast("int").alias("left"))

    def add(s: Column, x: Column) -> Column:
        part = T.trim_to_budget(x, s["left"])
        used = F.when(part == "", 0).otherwise(T.token_count(part))
        text = F.when(part == "", s["text"]).when(s["text"] == "", part).otherwise(F.concat(s["text"], F.lit(joiner), part))
        return F.struct(text.alias("text"), (s["left"] - used).cast("int").alias("left"))

    return F.aggregate(sections, start, add)["text"]


def greedy_sessions(sessions: Column, budget: Column, joiner: str = "\n\n") -> Column:
    """Sessions in order; one that doesn't fit any more is passed over, later ones may still fit. The first, if too long, is trimmed and ends the list."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"), F.lit(0).alias("n"))

    def add(s: Column, x: Column) -> Column:
        whole = F.when(s["n"] == 0, x).otherwise(F.concat(s["text"], F.lit(joiner), x))
        fits = T.token_count(whole) <= budget
        text = F.when(s["full"], s["text"]).when(fits, whole).when(s["n"] == 0, T.trim_to_budget(x, budget)).otherwise(s["text"])
        return F.struct(text.alias("text"), (s["full"] | (~fits & (s["n"] == 0))).alias("full"), (s["n"] + (fits & ~s["full"]).cast("int")).cast("int").alias("n"))

    return F.aggregate(sessions, start, add)["text"]


def batches(blocks: DataFrame, scope: str, order: str, text: str, budget: int) -> DataFrame:
    """blocks with batch_no: consecutive blocks share a batch while they fit the budget together; a block over it is one batch.

    The blocks of one scope are the selected evidence of one question, some dozens."""
    item = F.struct(F.col(order).alias("o"), T.token_count(F.col(text)).alias("t"))
    lists = blocks.groupBy(scope).agg(F.array_sort(F.collect_list(item)).alias("x"))
    start = F.expr("named_struct('b', 0, 'used', 0, 'out', cast(array() as array<int>))")

    def add(s: Column, x: Column) -> Column:
        new = (s["used"] > 0) & (s["used"] + x["t"] > budget)
        b = s["b"] + F.when(new, 1).otherwise(0)
        return F.struct(b.cast("int").alias("b"), F.when(new, x["t"]).otherwise(s["used"] + x["t"]).cast("int").alias("used"), F.concat(s["out"], F.array(b.cast("int"))).alias("out"))

    done = lists.select(scope, F.arrays_zip(F.transform("x", lambda r: r["o"]).alias("o"), F.aggregate("x", start, add)["out"].alias("b")).alias("z"))
    flat = done.select(scope, F.explode("z").alias("z")).select(scope, F.col("z.o").alias(order), F.col("z.b").alias("batch_no"))
    return blocks.join(flat, [scope, order])


# The fields of a trace.
TRACED = "memory_id label source_turn_ids source_session_id source_quote timestamp role speaker chunk_index chunk_count edge_id relation relation_key status score hybrid_score dense_score lexical_score graph_score rerank_score reranker retrieval_sources session_neighbor_distance".split()


def evidence_records(memories: DataFrame, scope: str, order: str) -> DataFrame:
    """(scope, evidence_id, n, source_turn_id, source_session_id, source_role, source_speaker, source_timestamp, source_quote): selected evidence
    numbered E1, E2, ... in order, one per turn and quote; rows without a turn or a quote are left out.

    memories: scope, order, source_turn_ids, source_session_id, role, speaker, timestamp, source_quote, text."""
    quote = F.coalesce(F.nullif("source_quote", F.lit("")), "text")
    rows = memories.select(scope, F.col(order).alias("o"), F.get("source_turn_ids", F.lit(0)).alias("source_turn_id"), "source_session_id", F.col("role").alias("source_role"), F.col("speaker").alias("source_speaker"), F.col("timestamp").alias("source_timestamp"), quote.alias("source_quote"))
    rows = rows.where(F.col("source_turn_id").isNotNull() & (F.trim(F.coalesce("source_quote", F.lit(""))) != ""))
    first = F.row_number().over(W.partitionBy(scope, "source_turn_id", T.dedup_key(F.col("source_quote"))).orderBy("o"))
    once = rows.withColumn("first", first).where("first = 1")
    n = F.row_number().over(W.partitionBy(scope).orderBy("o"))
    return once.withColumn("n", n).select(scope, F.concat(F.lit("E"), F.col("n").cast("string")).alias("evidence_id"), "n", "source_turn_id", "source_session_id", "source_role", "source_speaker", "source_timestamp", "source_quote")


def evidence_text() -> Column:
    """The block of an evidence record."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.concat(F.lit("["), "evidence_id", F.lit("] session="), said("source_session_id"), F.lit("; turn="), said("source_turn_id"), F.lit("; role="), said("source_role"), F.lit("; timestamp="), said("source_timestamp"), F.lit('\ntext: "'), "source_quote", F.lit('"'))


def pending_evidence(records: DataFrame, existing: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(records with the extraction they have already, records that have none): matched by turn and normalised quote; the last extraction counts.

    existing: scope, seq, source_turn_id, source_quote, triples."""
    match = [F.col("source_turn_id").cast("string").alias("__turn"), T.dedup_key(F.col("source_quote")).alias("__key")]
    had = existing.select(scope, *match, "seq", "triples").groupBy(scope, "__turn", "__key").agg(F.max_by("triples", "seq").alias("triples"), F.lit(True).alias("__there"))
    rows = records.select("*", *match).join(had, [scope, "__turn", "__key"], "left").drop("__turn", "__key")
    return rows.where("__there").drop("__there"), rows.where("__there IS NULL").drop("__there", "triples")


def trace(rows: DataFrame) -> Column:
    """A memory as JSON: the traced fields that it has, nulls left out."""
    return F.to_json(F.struct(*(F.col(c) for c in TRACED if c in rows.columns)), {"ignoreNullFields": "true"})


def chat_prompt(user: Column, system: Column) -> Column:
    """A prompt of one turn for a chat model."""
    asked = F.concat(F.lit("<|user|>\n"), user, F.lit("<|end|>\n<|assistant|>\n"))
    return F.when(T.some(system) != "", F.concat(F.lit("<|system|>\n"), system, F.lit("<|end|>\n"), asked)).otherwise(asked)


def question_prompt(question: Column, date: Column, kind: Column) -> Column:
    """A bare question with its date and type, if known."""
    line = lambda name, c: F.when(T.some(c) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("Current date", date), line("Question type", kind), F.concat(F.lit("Question: "), question), F.lit("Answer:"))
