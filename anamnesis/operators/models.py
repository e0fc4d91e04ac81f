"""The boundary to models: embedders, extractors of triples, summarisers, selectors, generators, cross-encoders, judges.

A model is loaded once per Python worker and called with batches of rows; any callable fits. The defaults need nothing but
this library: they are plain rules, so that every plan runs and can be tested without a model.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is not tried again, and what is.
PERMANENT = {"billing_hard_limit_reached", "insufficient_quota", "invalid_api_key", "model_not_found"}
AGAIN = {408, 409, 429}


@dataclass(frozen=True)
class Model:
    """load gives a callable from a list of tuples (one per row) to a list of results of the given Spark type."""

    load: Callable[[], Callable[[list], list]]
    kind: str
    batch: int = 64


def applied(model: Model, *columns: Column) -> Column:
    """The model's result for each row."""
    import pandas as pd

    def run(batches):
        call = model.load()
        for series in batches:
            rows = list(zip(*(series if isinstance(series, tuple) else (series,)), strict=True))
            yield pd.Series([y for at in range(0, len(rows), model.batch) for y in call(rows[at : at + model.batch])], dtype=object)

    return F.pandas_udf(run, model.kind, F.PandasUDFType.SCALAR_ITER)(*columns)


def hashing_embedder(size: int = 384) -> Model:
    """Unit vectors of hashed words: texts with words in common are near. A null or wordless text has the zero vector."""

    def load():
        import zlib

        import numpy as np

        def call(rows):
            out = []
            for (text,) in rows:
                v = np.zeros(size, np.float32)
                for w in re.findall(r"[a-z0-9]+", (text or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1 if h >> 31 else -1
                n = float(np.linalg.norm(v))
                out.append((v / n if n else v).tolist())
            return out

        return call

    return Model(load, "array<float>")


def embedded(rows: DataFrame, model: Model, text: str = "text", out: str = "embedding") -> DataFrame:
    return rows.withColumn(out, applied(model, F.col(text)))


def rule_extractor(most: int = 8) -> Model:
    """Triples of plain sentences: a subject, one of a few verbs, and the rest of the clause; `most` per text."""
    pattern = re.compile(r"\b(I|[A-Z][a-z]+(?: [A-Z][a-z]+)?) (am|is|was|like|likes|liked|love|loves|prefer|prefers|live in|lives in|lived in|moved to|work at|works at|worked at|have|has|had|own|owns|bought|visited) ([^.;,!?\n]+)")

    def load():
        return lambda rows: [[{"head": h, "relation": r, "tail": t.strip()} for h, r, t in pattern.findall(text or "")[:most]] for (text,) in rows]

    return Model(load, "array<struct<head:string,relation:string,tail:string>>")


def first_sentences(n: int = 2) -> Model:
    """Summaries: the first sentences."""
    return Model(lambda: lambda rows: [" ".join(re.split(r"(?<=[.!?])\s+", (text or "").strip())[:n]) for (text,) in rows], "string")


def all_facts(prefix: str) -> Model:
    """Selections: a line for every candidate id."""
    return Model(lambda: lambda rows: ["\n".join(f"{prefix} | {i}" for i in (list(ids) if ids is not None else [])) for (ids,) in rows], "string")


def first_evidence() -> Model:
    """Answers: the first quote, of (question, quotes)."""
    return Model(lambda: lambda rows: [str(quotes[0]) if quotes is not None and len(quotes) else "" for _, quotes in rows], "string")


def overlap_encoder() -> Model:
    """Scores of (question, text): the share of the question's words that the text has."""
    words = lambda x: set(re.findall(r"[a-z0-9]+", (x or "").lower()))
    return Model(lambda: lambda rows: [len(words(q) & words(t)) / max(1, len(words(q))) for q, t in rows], "double")


def exact_judge() -> Model:
    """Verdicts of (hypothesis, reference): yes if the one holds the other's words."""
    bare = lambda x: " ".join(re.findall(r"[a-z0-9]+", (x or "").lower()))
    return Model(lambda: lambda rows: ["yes" if bare(r) and f" {bare(r)} " in f" {bare(h)} " else "no" for h, r in rows], "string")


def retryable(status: int | None, code: str | None = None, connection: bool = False) -> bool:
    """Whether a failed call may succeed later: lost connections, time-outs, conflicts, limits and server errors, but no permanent code."""
    if code in PERMANENT:
        return False
    return connection or status in AGAIN or (status is not None and status >= 500)


def with_retries(call: Callable, most: int, base: float, cap: float, may_retry: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(result, attempts) of a call that is tried up to `most` times, with pauses that double up to a cap; what may not be tried again is raised at once."""
    for attempt in range(1, most + 1):
        try:
            return call(), attempt
        except Exception as e:
            if attempt == most or not may_retry(e):
                raise
            sleep(min(cap, base * 2 ** (attempt - 1)))
    raise ValueError("at least one attempt is needed")


def metered(rows: DataFrame, name: str, **measures: Column) -> DataFrame:
    """rows, with counts that a listener gets as they pass, at no further pass over them."""
    return rows.observe(name, F.count("*").alias("rows"), *(c.alias(k) for k, c in measures.items()))
