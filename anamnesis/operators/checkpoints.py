"""Durable runs: appended outputs, checkpoints with a tail that may be broken, atomic summaries, preparation of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.operators.runs import fingerprint


def append_pair(predictions: DataFrame, traces: DataFrame, at: str) -> None:
    """Predictions and traces as JSON lines below one folder; each write is committed as a whole or not at all."""
    predictions.write.mode("append").json(f"{at}/predictions")
    traces.write.mode("append").json(f"{at}/traces")


def checkpoint_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, line, end: bytes up to its end, ok) of a file of JSON lines; ok: an object. A run's output is one small file."""
    whole = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("t"))
    lines = whole.select(F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line"), F.col("t").endswith("\n").alias("closed"), F.size(F.split("t", "\n", -1)).alias("n"))
    lines = lines.where(~((F.col("line_no") == F.col("n") - 1) & (F.col("line") == "")))
    size = F.octet_length("line") + F.when((F.col("line_no") == F.col("n") - 1), 0).otherwise(1)
    end = F.sum(size).over(W.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    return lines.select("line_no", "line", end.alias("end"), ok.alias("ok"))


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, int, bool]:
    """(lines of whole records, bytes they take, whether a broken tail follows). A broken line that isn't the last one is an error."""
    lines = checkpoint_lines(spark, path)
    bad, last = lines.agg(F.min(F.when(~F.col("ok"), F.col("line_no"))), F.max(F.when(F.trim("line") != "", F.col("line_no")))).first()
    if bad is not None and last is not None and bad < last:
        raise ValueError(f"line {bad + 1} of {path} is broken, and it is not the last one")
    good = lines if bad is None else lines.where(F.col("line_no") < bad)
    return good.select("line_no", "line", "end"), good.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0], bad is not None


def hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def replace_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes beside the file, then renames over it: readers see the old or the new one, never a part."""
    fs, at = hadoop(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(beside, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"{path} could not be replaced")


def truncate(spark: SparkSession, path: str, size: int) -> bool:
    """Cuts a checkpoint to `size` bytes; whether there was anything to cut."""
    content = spark.read.format("binaryFile").load(path).first().content
    if len(content) == size:
        return False
    replace_file(spark, path, bytes(content[:size]))
    return True


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """A small summary, with sorted keys, atomically."""
    replace_file(spark, path, (json.dumps(payload, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode())


def manifest(settings: dict, runtime_only: tuple[str, ...] = (), **more) -> dict:
    """A run's settings but for those that don't change results, with their fingerprint."""
    out = {k: v for k, v in settings.items() if k not in runtime_only} | more
    return out | {"fingerprint": fingerprint(out)}


def prepare(stored: dict | None, wanted: dict, outputs: bool, resume: bool) -> str:
    """"new" or "resume"; an error where outputs would be mixed: outputs without resuming, outputs without a manifest, a manifest that was changed, another run's."""
    if not resume:
        if outputs or stored is not None:
            raise ValueError("outputs of an earlier run are there: resume it or name another run")
        return "new"
    if stored is None:
        if outputs:
            raise ValueError("outputs without a manifest can't be resumed")
        return "new"
    if stored.get("fingerprint") != fingerprint(stored):
        raise ValueError("the stored manifest was changed after it was written")
    if stored["fingerprint"] != wanted["fingerprint"]:
        differ = sorted(k for k in {*stored, *wanted} - {"fingerprint", "created_at"} if stored.get(k) != wanted.get(k))
        raise ValueError(f"the stored run differs in {', '.join(differ)}")
    return "resume"
