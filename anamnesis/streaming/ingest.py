"""Incremental ingest with Structured Streaming: turns become chunks with state per session; the batch result is the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.operators.chunking import chunk_rows

STATE = "turns long, kept array<string>"


def chunked_stream(turns: DataFrame, text: str = "text") -> DataFrame:
    """Chunk rows of a stream of turns; stateless, so the batch plan and the stream plan are one."""
    return chunk_rows(turns, text)


def compacted(turns: DataFrame, session: str, order: str, text: str, keep: int = 2) -> DataFrame:
    """(session, turns, summarised): with each batch of a session's turns, what left the window of the last `keep` turns.

    State per session: how many turns came, and the texts still kept; it doesn't grow with the session."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        n, kept = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values(order)
        kept = [*kept, *rows[text].fillna("").tolist()]
        gone, kept = kept[: max(0, len(kept) - keep)], kept[max(0, len(kept) - keep) :]
        state.update((n + len(rows), kept))
        yield pd.DataFrame({session: [key[0]], "turns": [n + len(rows)], "summarised": ["\n".join(gone)]})

    kind = dict(turns.dtypes)[session]
    return turns.groupBy(session).applyInPandasWithState(step, f"{session} {kind}, turns long, summarised string", STATE, "update", GroupStateTimeout.NoTimeout)


def prior_only(turns: DataFrame, questions: DataFrame, session: str, turn: str, question_turn: str) -> DataFrame:
    """Turns that a question may use: those of its session before its own."""
    q = questions.select(session, "question", F.col(question_turn).alias("__at"))
    return turns.join(q, session).where(F.col(turn) < F.col("__at")).drop("__at")


def user_totals(events: DataFrame) -> DataFrame:
    """Running totals per user and type: the same plan for a table and for a stream in complete or update mode."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def resumed(stream: DataFrame, at: str, checkpoint: str, mode: str = "append"):
    """Starts writing a stream of chunks as Parquet; started again with the same checkpoint it goes on behind the last committed offsets, each row written once."""
    return stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
