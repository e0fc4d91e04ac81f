"""Spans, evidence, models and durable runs, against golden cases and plain versions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from anamnesis.functions import spans
from anamnesis.operators import checkpoints, chunking, dense, diversity, facts, graph, lexical, models, packing
from anamnesis.sources import records


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def plain_clause(text, start, end):
    left, right = text[:start], text[end:]
    begin = max(left.rfind(s) for s in spans.SEPARATORS) + 1
    stops = [p for s in spans.SEPARATORS if (p := right.find(s)) >= 0]
    return (left[begin:] + text[start:end] + right[: min(stops) if stops else len(right)]).strip()


def test_clauses_and_scalar_spans(spark):
    texts = ["I ran 5 km and slept about three hours, then left; it took 20 business days each way.", "twenty-one days but 3:4 at 1,500.5 mb", "", None, "12", "a hour. and, but 7% of $3"]
    for slot, pattern in (("exact duration", spans.DURATION), ("exact quantity or amount", spans.QUANTITY)):
        got = values(spark, [(t, slot) for t in texts], "t string, s string", spans.scalar_spans(F.col("t"), F.col("s")).alias("x"))
        for t, (found,) in zip(texts, got, strict=True):
            want = [(m.group(0).strip(), plain_clause(t, m.start(), m.end())) for m in re.finditer(pattern, t or "")]
            assert [(r.value, r.clause) for r in found] == want, t
    assert values(spark, [("x 5 days", "place")], "t string, s string", spans.scalar_spans(F.col("t"), F.col("s")).alias("x")) == [([],)]
    got = values(spark, [("I met Ann, before the Dentist visit, at noon", ["dentist", "visit"]), ("nothing", ["x"]), (None, ["x"])], "t string, k array<string>", spans.clause_for_tokens(F.col("t"), F.col("k")))
    assert got == [("before the Dentist visit",), ("nothing",), ("",)]


def test_place_scores(spark):
    rows = [("Grand Hotel", "we stayed at the Grand Hotel"), ("MIT", "I studied at MIT"), ("Monday", "on Monday"), ("blue", "it is blue"), (None, None), ("(x", "went to (x")]
    got = [s for (s,) in values(spark, rows, "v string, q string", spans.place_score(F.col("v"), F.col("q")))]
    assert got == [5.75, 5.25, -3.25, 0.0, 0.0, 3.0]


def test_answer_variants(spark):
    cases = ['"a"', "3", "true", '["a", ["b", 2], null]', '{"answer": "x", "value": ["y"]}', '{"b": 1}', "null", None]
    got = [v for (v,) in values(spark, [(c,) for c in cases], "j string", spans.answer_variants(F.col("j")))]
    assert got[:6] == [["a"], ["3"], ["True"], ["a", "b", "2"], ["x", "y"], ['{"b":1}']] and not got[6] and not got[7]


def test_neighbour_priority(spark):
    rows = [("What did I eat the day before the doctor visit?", "doctor visit is on Friday, 2024-01-05", "user", 0.5), ("What did I eat before the doctor visit?", "I ate soup", "assistant", 0.2), ("soup?", None, None, None)]
    got = values(spark, rows, "q string, t string, r string, s double", diversity.neighbour_priority(F.col("q"), F.col("t"), F.col("r"), F.col("s")).alias("p"))
    assert [tuple(p) for (p,) in got] == [(1, 1, 2, 1, 0.5), (0, 0, 0, 0, 0.2), (0, 0, 0, 0, None)]


def test_plan_branches(spark):
    said = spark.createDataFrame([("s", 2.0, "a"), ("s", 3.0, "b"), ("c", 1.0, "a")], "question string, value double, session string")
    plans = spark.createDataFrame([("s", "sum", "hour", 2.0, 1), ("c", "count", "item", 2.0, 1), ("t", "temporal_join", "", None, 1), ("u", "temporal_join", "", None, 1), ("n", "none", "", None, 1)], "question string, operation string, target_unit string, expected_fact_count double, minimum_sessions int")
    near = spark.createDataFrame([("t", "soup", 1)], "question string, value string, n long")
    got = {r.question: (r.status, r.answer) for r in facts.execute_plans(said, near, plans).collect()}
    assert got == {"s": ("complete", "5 hours"), "c": ("insufficient_evidence", None), "t": ("complete", "soup"), "u": ("insufficient_evidence", None), "n": ("not_applicable", None)}


def test_traces_and_prompts(spark):
    row = spark.createDataFrame([(1, None, 0.5, "x")], "memory_id int, label string, score double, other string")
    assert json.loads(row.select(packing.trace(row)).first()[0]) == {"memory_id": 1, "score": 0.5}
    got = values(spark, [("u", "s", "2024", "kind"), ("u", None, None, None)], "u string, s string, d string, k string", packing.chat_prompt(F.col("u"), F.col("s")), packing.question_prompt(F.col("u"), F.col("d"), F.col("k")))
    assert got[0][0].startswith("<|system|>\ns<|end|>\n<|user|>\nu<|end|>") and got[1][0] == "<|user|>\nu<|end|>\n<|assistant|>\n"
    assert got[0][1] == "Current date: 2024\nQuestion type: kind\nQuestion: u\nAnswer:" and got[1][1] == "Question: u\nAnswer:"


def test_created_and_stored_turns(spark):
    rows = spark.createDataFrame([("s", 1, None, "user", None, None, "hi there"), ("s", 2, 7, "user", "Ann", "2024", "old house"), ("s", 3, None, "assistant", "", None, "yes"), ("s", 4, 3, "user", None, None, "x"), ("s", 5, None, "user", None, None, None)], "session_id string, seq int, turn_id long, role string, speaker string, timestamp string, text string")
    turns = chunking.created_turns(rows, "session_id", "seq")
    got = [(r.turn_id, r.speaker) for r in turns.orderBy("seq").collect()]
    assert got == [(1, "user"), (7, "Ann"), (8, "assistant"), (3, "user"), (9, "user")]
    memory = {r.turn_id: r for r in chunking.stored(turns).collect()}
    assert memory[7].memory_id == "s:7:0" and memory[7].tokens == ["old", "house"] and abs(sum(x * x for x in memory[7].embedding) - 1) < 1e-5 and memory[9].doc_len == 0
    both = chunking.with_responses(turns, spark.createDataFrame([("s", 9, "fine")], "session_id string, seq int, text string"))
    assert both.where("role = 'assistant'").count() == 2


def test_models(spark):
    one = spark.createDataFrame([("Ann likes tea. She left. Then more.", "tea")], "t string, q string")
    c = F.col
    assert [tuple(t) for t in one.select(models.applied(models.rule_extractor(), c("t")).alias("x")).first().x] == [("Ann", "likes", "tea")]
    assert one.select(models.applied(models.first_sentences(1), c("t")).alias("x")).first().x == "Ann likes tea."
    assert one.select(models.applied(models.overlap_encoder(), c("q"), c("t")).alias("x")).first().x == 1.0
    assert one.select(models.applied(models.exact_judge(), c("t"), c("q")).alias("x")).first().x == "yes"
    assert one.select(models.applied(models.all_facts("COUNT"), F.array(F.lit("C1"), F.lit("C2"))).alias("x")).first().x == "COUNT | C1\nCOUNT | C2"
    assert one.select(models.applied(models.first_evidence(), c("q"), F.array("t")).alias("x")).first().x.startswith("Ann")
    tries, slept = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert models.with_retries(call, 5, 1.0, 1.5, lambda e: True, slept.append) == ("ok", 3) and slept == [1.0, 1.5]
    with pytest.raises(OSError):
        models.with_retries(lambda: (_ for _ in ()).throw(OSError()), 5, 1, 1, lambda e: False, slept.append)
    assert models.retryable(429) and models.retryable(None, connection=True) and models.retryable(503) and not models.retryable(400) and not models.retryable(429, "insufficient_quota")


def test_checkpoints(spark, tmp_path):
    at = tmp_path / "p.jsonl"
    at.write_bytes(b'{"a": 1}\n{"a": "\xc3\xa9"}\n{"a": ')
    lines, size, broken = checkpoints.read_checkpoint(spark, str(at))
    assert lines.count() == 2 and broken and size == len('{"a": 1}\n{"a": "é"}\n'.encode())
    assert checkpoints.truncate(spark, str(at), size) and not checkpoints.truncate(spark, str(at), size)
    assert at.read_bytes().endswith(b"}\n") and not checkpoints.read_checkpoint(spark, str(at))[2]
    at = tmp_path / "q.jsonl"
    at.write_text('{"a": 1}\n[1]\n{"a": 2}\n')
    with pytest.raises(ValueError, match="line 2"):
        checkpoints.read_checkpoint(spark, str(at))
    checkpoints.write_json(spark, str(tmp_path / "s.json"), {"b": 1, "a": "é"})
    assert (tmp_path / "s.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    old, new = checkpoints.manifest({"k": 1, "dir": "x"}, ("dir",)), checkpoints.manifest({"k": 2})
    assert checkpoints.prepare(None, new, False, True) == "new" and checkpoints.prepare(old, checkpoints.manifest({"k": 1}), True, True) == "resume"
    for args, word in (((old, new, True, True), "differs in k"), ((None, new, True, True), "without a manifest"), ((old, old, True, False), "earlier run"), ((old | {"k": 3}, old, True, True), "changed")):
        with pytest.raises(ValueError, match=word):
            checkpoints.prepare(*args)
    checkpoints.append_pair(spark.range(2), spark.range(2), str(tmp_path / "out"))
    checkpoints.append_pair(spark.range(3), spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/predictions")).count() == 5


def test_workload_and_strict_lines(spark, tmp_path):
    rows = spark.createDataFrame([(0, {"id": "a", "question": "x"}), (1, {"q": "y"}), (2, {"id": "c"}), (3, {"id": "a", "question": "z"})], "n int, record map<string,string>")
    todo, skipped = records.workload(rows, "n", ["question_id", "id"], ["question", "q"], 0, 3)
    assert [(r.question_id, r.question) for r in todo.orderBy("dataset_index").collect()] == [("a", "x"), ("row-1", "y")] and skipped.first().question_id == "c"
    with pytest.raises(Exception, match="duplicate question id"):
        records.workload(rows, "n", ["id"], ["question"])[0].collect()
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2\n')
    with pytest.raises(Exception, match="line 3 of"):
        records.read_strict(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in records.read_strict(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]


def test_traversal_and_triple_lines(spark):
    edges = spark.createDataFrame([("e1", 1, "ann", "tea", "likes", "like", 0.9), ("e2", 2, "tea", "china", "is from", "be", 0.8)], "edge_id string, edge_seq long, head string, tail string, relation string, key string, confidence double")
    asked = spark.createDataFrame([("q", "What does Ann like?")], "question string, text string")
    lines = graph.traversed(asked, spark.createDataFrame([("ann", "ann")], "alias_key string, entity_id string"), edges).orderBy("rank").collect()
    assert [r.line for r in lines] == ["ann -[likes]-> tea", "tea -[is from]-> china"]
    text = spark.createDataFrame([(1, "1. Entity: Ann | relation: likes | tea"), (2, "a | b"), (3, "a || b"), (4, "- x | y | z")], "n int, line string")
    assert [tuple(r)[2:] for r in graph.triple_lines(text).orderBy("n").collect()] == [("Ann", "likes", "tea"), ("x", "y", "z")]


def test_dense_search_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "k int, v array<double>")
    asked = rows.where("k % 3 = 0").select(F.col("k").alias("q"), F.col("v").alias("qv"))
    run = lambda most: {(r.question, r.doc, r["rank"], r.dense_score) for r in dense.dense_candidates(rows, asked, 4, "k", "v", "q", "qv", most=most).collect()}
    assert run(3) == run(5000) and len(run(3)) == 80


def test_bm25_reads_its_texts_once(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i % 3} other") for i in range(30)], "d int, t string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    asked = spark.createDataFrame([(1, "word1 word2")], "q int, t string")
    out = lexical.bm25(docs, asked, "d", "t", "q", "t")
    assert out.count() == 20
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") == 1
