"""Runs: identities, manifests, resuming, validated joins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_identity(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, size, sha256) of files, read by Spark."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def fingerprint(manifest: dict, skip: tuple[str, ...] = ("created_at", "fingerprint")) -> str:
    """SHA-256 of the manifest as compact JSON with sorted keys; a small record, so it stays on the driver."""
    import hashlib

    said = json.dumps({k: v for k, v in manifest.items() if k not in skip}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(said.encode()).hexdigest()


def manifest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(field): fields whose values differ, or that only one side has. Both: field, value."""
    l, r = left.select("field", F.col("value").alias("l")), right.select("field", F.col("value").alias("r"))
    return l.join(r, "field", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("field")


def pending(workload: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a workload."""
    return workload.join(done.select(key).distinct(), key, "left_anti")


def completed_prefix(workload: DataFrame, predictions: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: completed (rows that both outputs have), mismatches (rows whose ids or texts disagree or aren't the workload's).

    All have row_no (from 0) and question_id; predictions and traces have hypothesis, workload and traces dataset_index."""
    p = predictions.select("row_no", F.col("question_id").alias("p_id"), F.col("hypothesis").alias("p_text"))
    t = traces.select("row_no", F.col("question_id").alias("t_id"), F.col("hypothesis").alias("t_text"), F.col("dataset_index").alias("t_index"))
    w = workload.select("row_no", "question_id", "dataset_index")
    both = p.join(t, "row_no").join(w, "row_no", "left")
    bad = ~(F.col("p_id").eqNullSafe(F.col("t_id")) & F.col("p_text").eqNullSafe(F.col("t_text")) & F.col("p_id").eqNullSafe(F.col("question_id")) & F.col("t_index").eqNullSafe(F.col("dataset_index")))
    return both.agg(F.count("*").alias("completed"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("mismatches"))


def validated_join(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Predictions with their references; a prediction without one fails the job, so does a blank hypothesis."""
    from anamnesis.sources.records import unique

    r = unique(references, key, "reference").withColumn("__there", F.lit(True))
    rows = unique(predictions, key, "prediction").join(r, key, "left")
    fault = F.when(F.col("__there").isNull(), "no reference for ").when(F.trim(F.coalesce("hypothesis", F.lit(""))) == "", "blank hypothesis for ")
    ok = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(ok).drop("__there")


def run_summary(traces: DataFrame) -> DataFrame:
    """One row of means, rates and counts over a run's traces."""
    mean = lambda c: F.avg(c).alias(f"avg_{c}")
    return traces.agg(F.count("*").alias("records"), *(mean(c) for c in ("seconds", "exact_match", "contains_reference", "token_f1") if c in traces.columns), *([F.sum(F.col("abstained").cast("long")).alias("abstentions")] if "abstained" in traces.columns else []))
