"""Reading records: JSON and JSON lines, field names with alternatives, haystacks of sessions, slices of a workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed: names under which a wrapped list may stand.
WRAPPERS = ("data", "records", "examples", "eval")


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines, blank lines left out. strict: the first bad line fails the job; else a bad line is a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A .json file: a list, or an object that wraps one under a known name, or an object whose values are the records."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"))
    item = f"array<struct<{schema}>>" if not schema.startswith("struct") else f"array<{schema}>"
    listed = F.from_json("value", item)
    wrapped = F.coalesce(*(F.from_json(F.get_json_object("value", f"$.{w}"), item) for w in WRAPPERS))
    values = F.map_values(F.from_json("value", f"map<string,struct<{schema}>>"))
    chosen = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(wrapped, values))
    return whole.select(F.explode(chosen).alias("r")).select("r.*")


def first_present(record: Column, names: list[str]) -> Column:
    """The value under the first name that is there (a map of strings); a null that is there wins over later names."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.map_contains_key(record, name), record[name]).otherwise(out)
    return out


def haystack_turns(records: DataFrame) -> DataFrame:
    """A row per message: question_id, session_index, session_id, session_date, turn_id, role, text.

    records: question_id, haystack_sessions array<array<struct<role,content,text>>>, haystack_session_ids, haystack_dates. Blank
    messages are left out; a missing session id is its index; turn_id counts over the whole question."""
    sessions = records.select("question_id", "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("session_index", "messages"))
    sid = F.coalesce(F.try_element_at("haystack_session_ids", F.col("session_index") + 1), F.col("session_index").cast("string"))
    rows = sessions.select("question_id", "session_index", sid.alias("session_id"), F.try_element_at("haystack_dates", F.col("session_index") + 1).alias("session_date"), F.posexplode("messages").alias("message_index", "m"))
    text = F.coalesce(F.col("m.content"), F.col("m.text"))
    rows = rows.select("*", F.col("m.role").alias("role"), text.alias("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "").drop("m")
    order = W.partitionBy("question_id").orderBy("session_index", "message_index")
    return rows.withColumn("turn_id", F.row_number().over(order)).drop("message_index")


def session_count(sessions: Column, ids: Column) -> Column:
    return F.when(F.size(sessions) > 0, F.size(sessions)).when(F.size(ids) > 0, F.size(ids)).otherwise(0)


def record_slice(records: DataFrame, index: str, start: int = 0, limit: int | None = None, kind: str | None = None, kind_column: str = "question_type") -> DataFrame:
    """Records from `start` on, of one kind, at most `limit` of them."""
    rows = records.where(F.col(index) >= start)
    rows = rows if kind is None else rows.where(F.col(kind_column) == kind)
    return rows if limit is None else rows.orderBy(index).limit(limit)


def unique(rows: DataFrame, key: str, what: str) -> DataFrame:
    """rows, failing when a key repeats."""
    n = F.count("*").over(W.partitionBy(key))
    return rows.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {what}: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no record fails the job and names its file and line. Each file is read by one task, as lines are counted."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line")).where(F.trim("line") != "")
    rows = lines.withColumn("record", F.from_json("line", schema, {"mode": "PERMISSIVE"})).withColumn("ok", F.try_parse_json("line").isNotNull())
    fault = F.raise_error(F.concat(F.lit("line "), (F.col("n") + 1).cast("string"), F.lit(" of "), F.col("file"), F.lit(" is no JSON"))).cast("boolean")
    return rows.where(F.when(F.col("ok"), F.lit(True)).otherwise(fault)).select("record.*")


def workload(records: DataFrame, index: str, ids: list[str], questions: list[str], start: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(workload, skipped): records with dataset_index, question_id and question by the first field name that is there; a missing id is
    `row-<index>`, a repeated one is an error; records without a question are skipped after the limit has counted them. records: index, record (map of strings)."""
    rows = record_slice(records, index, start, limit)
    rows = rows.select(F.col(index).alias("dataset_index"), first_present(F.col("record"), ids).alias("question_id"), first_present(F.col("record"), questions).alias("question"), "record")
    rows = rows.withColumn("question_id", F.coalesce(F.nullif("question_id", F.lit("")), F.concat(F.lit("row-"), F.col("dataset_index").cast("string"))))
    asked = F.trim(F.coalesce("question", F.lit(""))) != ""
    return unique(rows.where(asked), "question_id", "question id"), rows.where(~asked)
