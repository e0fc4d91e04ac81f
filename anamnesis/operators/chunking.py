"""Turns and chunks: flattening of records, envelopes, chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions import text as T


def chunk_rows(rows: DataFrame, text: str = "text", size: int = T.CHUNK_WORDS, overlap: int = T.OVERLAP_WORDS) -> DataFrame:
    """A row per chunk: the other columns, chunk_index (from 0), chunk_count, chunk_text. No shuffle."""
    others = [c for c in rows.columns if c != text]
    cut = rows.select(*others, T.chunks(F.col(text), size, overlap).alias("__chunks"))
    return cut.select(*others, F.size("__chunks").alias("chunk_count"), F.posexplode("__chunks").alias("chunk_index", "chunk_text"))


def envelope(session: Column, turn: Column, role: Column, speaker: Column, stamp: Column, chunk: Column, index: Column, count: Column) -> Column:
    """The text that is embedded and tokenised: a header of key: value lines, then the chunk (numbered from 1)."""
    said = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("")))
    numbered = F.concat(F.lit("chunk: "), (index + 1).cast("string"), F.lit("/"), count.cast("string"))
    return F.concat_ws("\n", said("session_id", session), said("turn_id", turn), said("role", role), said("speaker", speaker), said("timestamp", stamp), numbered, said("text", chunk))


def numbered_turns(turns: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """turns with turn_seq, 1, 2, ... within the scope."""
    return turns.withColumn("turn_seq", F.row_number().over(W.partitionBy(*scope).orderBy(*order)))


def recent_turns(turns: DataFrame, scope: str, order: str, n: int = 2) -> DataFrame:
    """The last n turns of each scope."""
    last = F.row_number().over(W.partitionBy(scope).orderBy(F.col(order).desc()))
    return turns.withColumn("__n", last).where(F.col("__n") <= n).drop("__n")


def rendered_turn(role: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(speaker, F.lit("")), role), F.lit(": "), T.some(text))


def rendered_session(turns: DataFrame, scope: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """A row per session: its turns in order as `role: text` lines. A session is one conversation, so a row stays bounded by it."""
    line = F.concat(F.col(role), F.lit(": "), T.some(F.col(text)))
    lines = turns.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("x"))
    return lines.select(scope, F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("rendered"))


def turn_text(session: Column, turn: Column, role: Column, speaker: Column, stamp: Column, text: Column) -> Column:
    """A turn with all that is known of it."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("None")))
    return F.concat_ws("\n", line("session_id", session), line("turn_id", turn), line("role", role), line("speaker", speaker), line("timestamp", stamp), line("text", text))


def extraction_text(speaker: Column, role: Column, text: Column, entity: Column, entity_id: Column) -> Column:
    """What an extractor reads: the utterance and who speaks, by name if the speaker is known."""
    known = F.when(entity_id.isNotNull(), F.concat(F.lit("Speaker entity: "), entity, F.lit(" ("), entity_id, F.lit(")")))
    return F.concat_ws("\n", F.concat(F.lit("Speaker: "), speaker), F.concat(F.lit("Role: "), role), known, F.lit("Utterance:"), T.some(text))


def created_turns(rows: DataFrame, session: str, order: str) -> DataFrame:
    """rows (session, order, turn_id, role, speaker, timestamp, text) as turns: ids go on from the largest given one before, the speaker is the role where none is named, the time is now."""
    before = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    # A row without an id counts one on from the largest before it, which is a given one and the rows without since, or all rows without.
    counted = F.count_if(F.col("turn_id").isNull()).over(before)
    rows = rows.withColumn("counted", counted)
    base = F.max(F.col("turn_id") - F.col("counted")).over(before)
    number = F.coalesce(F.col("turn_id"), F.col("counted") + F.greatest(F.lit(0), F.coalesce(base, F.lit(0)))).cast("long")
    speaker = F.coalesce(F.nullif("speaker", F.lit("")), "role")
    return rows.withColumn("id", number).withColumns({"speaker": speaker, "timestamp": F.coalesce("timestamp", F.current_timestamp().cast("string"))}).drop("turn_id", "counted").withColumnRenamed("id", "turn_id")


def stored(turns: DataFrame, model=None, text: str = "text", size: int = T.CHUNK_WORDS, overlap: int = T.OVERLAP_WORDS) -> DataFrame:
    """The memory table of turns: their chunks with tokens, length and unit vector; ids follow from session, turn and chunk, so no row needs another one's."""
    from anamnesis.operators.models import embedded, hashing_embedder

    rows = chunk_rows(turns, text, size, overlap).withColumn("tokens", T.retrieval_tokens(F.col("chunk_text")))
    named = rows.withColumn("memory_id", F.concat_ws(":", *(F.col(c).cast("string") for c in ("session_id", "turn_id", "chunk_index"))))
    return embedded(named, model or hashing_embedder(), "chunk_text").withColumn("doc_len", F.size("tokens"))


def with_responses(turns: DataFrame, responses: DataFrame) -> DataFrame:
    """Turns and the answers to them as one stream of turns: an answer is a turn of the assistant."""
    return turns.unionByName(responses.withColumns({"role": F.lit("assistant"), "speaker": F.lit("assistant")}), allowMissingColumns=True)
