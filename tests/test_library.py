"""Golden cases of the library's operators."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from anamnesis.functions import numbers, temporal
from anamnesis.functions import text as T
from anamnesis.operators import diversity, facts, fusion, graph, metrics, packing, planner, runs
from anamnesis.sources import records


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_chunks_reach_the_end_once(spark):
    for n, size, overlap in itertools.product((0, 1, 16, 159, 160, 161, 288, 289, 500), (16, 160), (0, 5, 32, 400)):
        text = " ".join(map(str, range(n)))
        got = values(spark, [(text,)], "t string", T.chunks(F.col("t"), size, overlap))[0][0]
        step, want, at = size - min(overlap, size - 1), [], 0
        words = text.split()
        while True:
            want.append(" ".join(words[at : at + size]))
            if at + size >= n:
                break
            at += step
        assert got == want
    assert values(spark, [(None,)], "t string", T.chunks(F.col("t")))[0][0] == [""]


def test_names_and_relations(spark):
    rows = [("  The Dr. Ann   Lee's! ",), ("Mr. Bob Stone",), (None,), ("a",)]
    got = values(spark, rows, "t string", T.entity_name(F.col("t")), T.alias_key(F.col("t")), T.alias_variants(F.col("t")))
    assert got[1] == ("Mr. Bob Stone", "bob stone", ["Mr. Bob Stone", "Bob Stone", "Stone"])
    assert got[0][0] == "Dr. Ann Lee's" and got[0][1] == "ann lee" and got[2] == ("", "", [])
    scope = values(spark, [("likes", "I like it"), ("lived in", "I lived there"), ("likes", "I liked it"), ("sees", "moved to it"), ("sees", "x")], "r string, q string", temporal.relation_scope(F.col("r"), F.col("q")))
    assert [s for (s,) in scope] == ["current", "historical", "historical", "current", "unknown"]


def test_weekdays_and_dates(spark):
    got = values(spark, [("on Friday or monday", None), ("2024-2-30", "2024/3/1 10:00"), ("at 2024/02/29", None), (None, None)], "t string, s string", temporal.weekday(F.col("t")), temporal.date_of(F.col("t"), F.col("s")))
    assert got == [(4, None), (None, datetime.date(2024, 3, 1)), (None, datetime.date(2024, 2, 29)), (None, None)]


def test_numbers_and_answers(spark):
    got = values(spark, [(3.5, "sum", "hour"), (1.0, "sum", "hour"), (25.0, "sum", "money"), (3.0, "count", "items"), (2.25, "sum", "money")], "v double, o string, u string", numbers.answer(F.col("v"), F.col("o"), F.col("u")))
    assert [a for (a,) in got] == ["3.5 hours", "1 hour", "$25", "3", "$2.25"]
    conv = values(spark, [(90.0, "minutes", "hour"), (2.0, "weeks", "days"), (3.0, "x", "hour"), (4.0, None, "money")], "v double, u string, t string", numbers.convert(F.col("v"), F.col("u"), F.col("t")))
    assert [c for (c,) in conv] == [1.5, 14.0, None, 4.0]


def test_budgets(spark):
    fit = values(spark, [("x" * 100, 10), ("abc", 1), ("abcdefgh", 0), (None, 5)], "t string, b int", T.trim_to_budget(F.col("t"), F.col("b")), T.token_count(F.col("t")))
    assert fit[0] == ("x" * 37 + "...", 25) and fit[1] == ("abc", 1) and fit[2][0] == "" and fit[3] == ("", 1)
    long, short = "a" * 400, "b" * 40
    got = values(spark, [([short, long, "c" * 40],), ([long, short],), ([],)], "s array<string>", packing.greedy_sessions(F.col("s"), F.lit(30)))
    assert got[0][0] == short + "\n\n" + "c" * 40 and got[1][0].startswith("aaa") and len(got[1][0]) == 120 and got[2][0] == ""


def test_session_metrics_golden(spark):
    ranking = spark.createDataFrame([("q", 1, "s1"), ("q", 2, "s1"), ("q", 3, "s2"), ("q", 4, None), ("q", 5, "s3"), ("q", 6, "s4"), ("r_abs", 1, "s1")], "question_id string, pos int, session string")
    gold = spark.createDataFrame([("q", "s2"), ("q", "s4"), ("r_abs", "s1")], "question_id string, session string")
    asked = spark.createDataFrame([("q",), ("r_abs",), ("none",)], "question_id string")
    ranked = metrics.ranked_sessions(ranking, "question_id", "pos", "session")
    got = {(r.question_id, r.k): r for r in metrics.session_metrics(ranked, gold, asked).collect()}
    assert (got["q", 1].recall_any, got["q", 1].recall_all) == (0.0, 0.0)
    assert (got["q", 5].recall_any, got["q", 5].recall_all, got["q", 5].ndcg) == (1.0, 1.0, 0.75)
    assert got["r_abs", 5].exclusion_reason == "abstention_question" and got["none", 5].exclusion_reason == "no_answer_session_labels" and got["none", 1].ndcg is None
    rows = metrics.macro_average(spark.createDataFrame([r.asDict() for r in got.values()], "question_id string, k int, eligible boolean, exclusion_reason string, recall_any double, recall_all double, ndcg double").withColumn("kind", F.lit("t")), "kind").where("k = 5 and kind is null").first()
    assert (rows.n_eligible, rows.n_excluded, rows.ndcg) == (1, 2, 0.75)


def test_judge_accuracy_golden(spark):
    rows = [("a", True, "q1"), ("a", True, "q2"), ("b", True, "q_abs"), ("b", False, "q3"), ("c", True, "q4"), ("c", True, "q5"), ("d", False, "q6")]
    got = metrics.judge_accuracy(spark.createDataFrame(rows, "kind string, label boolean, id string"), "kind", "label", F.col("id").contains("_abs")).first()
    assert got.overall == pytest.approx(5 / 7) and got.task_averaged == pytest.approx((1 + 0.5 + 1 + 0) / 4) and got.abstention == 1.0


def test_local_metrics(spark):
    rows = spark.createDataFrame([(1, "The red house.", ["red house", "", None]), (2, "blue", []), (3, None, ["x"])], "id int, p string, r array<string>")
    got = {r.id: (r.exact_match, r.contains_reference, r.token_f1) for r in metrics.local_metrics(rows, "id", "p", "r").collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def plain_supersession(rows):
    out = {}
    for i in rows:
        later = [j for j in sorted(rows, key=lambda r: r["seq"]) if j["seq"] > i["seq"] and j["head"] == i["head"] and j["key"] == i["key"] and j["tail"] != i["tail"] and ("changed" in j["quote"] or (j["key"] == "like" and j["scope_time"] == "current") or (i["scope_time"] == "historical" and j["scope_time"] == "current"))]
        out[i["edge_id"]] = later[0]["edge_id"] if later else None
    return out


def test_supersession_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [{"seq": i, "edge_id": f"e{i}", "head": rnd.randrange(3), "key": rnd.choice(["like", "see"]), "tail": rnd.randrange(3), "scope_time": rnd.choice(["historical", "current", "unknown"]), "quote": rnd.choice(["", "", "", "it changed"]), "stamp": str(i)} for i in range(300)]
    got = graph.superseded(spark.createDataFrame(rows, "seq int, edge_id string, head int, key string, tail int, scope_time string, quote string, stamp string"))
    assert {r.edge_id: r.superseded_by for r in got.collect()} == plain_supersession(rows)
    lists = {r.edge_id: r.supersedes for r in graph.supersedes_lists(got).collect()}
    assert sorted(x for v in lists.values() for x in v) == sorted(k for k, v in plain_supersession(rows).items() if v)


def test_bounded_search_and_evidence(spark):
    edges = spark.createDataFrame([("a", "b", "e1", 1, "knows", "know", 0.9), ("b", "c", "e2", 2, "likes", "like", 0.8), ("c", "d", "e3", 3, "likes", "like", 0.9), ("a", "a", "e4", 4, "is", "is", 0.9), ("c", "a", "e5", 5, "sees", "see", 0.6)], "head string, tail string, edge_id string, edge_seq int, relation string, key string, confidence double")
    starts = spark.createDataFrame([(1, "a"), (1, "zzz")], "question int, node string")
    found = graph.bounded_search(starts, edges, 2)
    assert {(r.edge_id, r.depth) for r in found.collect()} == {("e1", 1), ("e4", 1), ("e5", 1), ("e1", 2), ("e2", 2), ("e3", 2), ("e5", 2)}
    best = {r.edge_id: r for r in graph.evidence(found, F.array(F.lit("like"))).collect()}
    assert set(best) == {"e1", "e2", "e3", "e5"} and best["e3"]["rank"] == 1 and best["e2"].score == pytest.approx(1.4)
    assert graph.evidence(found, F.array().cast("array<string>"), 2).count() == 2
    path = values(spark, [([("A", "knows", "out", "B"), ("B", "sees", "in", "C")],)], "p array<struct<from:string,relation:string,direction:string,to:string>>", graph.path_string(F.col("p")))
    assert path[0][0] == "A -[knows]-> B <-[sees]- C"


def test_memory_status(spark):
    closed = spark.createDataFrame([("e1", "like", "superseded", 5, [1]), ("e2", "like", "active", None, [2])], "edge_id string, key string, status string, closed_seq int, source_turn_ids array<int>")
    memories = spark.createDataFrame([(1, 2, "e1", [1], None), (2, 9, None, [1], None), (3, 1, None, [1], ["see"]), (4, 1, "e2", [2], ["like"])], "doc int, seq int, edge_id string, source_turn_ids array<int>, relation_keys array<string>")
    got = {r.doc: (r.status, r.superseded_relation_keys) for r in graph.memory_status(memories, closed).collect()}
    assert got == {1: ("superseded", ["like"]), 2: (None, None), 3: (None, None), 4: ("active", None)}


def test_graph_candidates_and_fusion(spark):
    memories = spark.createDataFrame([(1, "e1", [9], "x", "y"), (2, None, [5], None, None), (3, None, [7], "h", None), (4, None, [8], None, None)], "doc int, edge_id string, source_turn_ids array<int>, head_entity_id string, tail_entity_id string")
    evidence = spark.createDataFrame([(1, "e1", [5], "h", "t")], "question int, edge_id string, source_turn_ids array<int>, head_entity_id string, tail_entity_id string")
    got = {r.doc: r.graph_score for r in fusion.graph_candidates(memories, evidence).collect()}
    assert got == {1: 1.0, 2: 0.9, 3: 0.7}
    rows = spark.createDataFrame([(0.1, 0.0, 1.0), (0.8, 0.5, 0.0)], "dense_score double, lexical_score double, graph_score double")
    assert [round(r[0], 6) for r in rows.select(fusion.hybrid_score()).collect()] == [0.45, 0.55]


def test_interleaving(spark):
    primary = spark.createDataFrame([(1, i, f"p{i}") for i in range(3)] + [(1, 3, " "), (1, 4, "")], "q int, seq int, quote string")
    near = spark.createDataFrame([(1, 1, "n1"), (1, 2, "P0")], "q int, seq int, quote string")
    got = [r.quote for r in diversity.interleaved(primary, near, "q", "seq", "quote", 9).orderBy("rank").collect()]
    assert got == ["p0", "n1", "p1", "p2", " "]


def test_similar_facts(spark):
    rows = [(1, 1, 2.0, "walked two hours by the river"), (1, 2, 2.0, "two hours walked along the river"), (1, 3, 2.0, "cooked soup for guests"), (1, 4, 3.0, "walked two hours by the river"), (2, 1, 2.0, "")]
    got = facts.similar_facts_dropped(spark.createDataFrame(rows, "question int, n int, value double, clause string"))
    assert sorted((r.question, r.n) for r in got.collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_temporal_join_golden(spark):
    targets = spark.createDataFrame([(1, "before", "t1", "1:30 AM", 0, None), (1, "before", "t2", "2 AM", 3, None), (2, "after", "t3", "5 PM", None, datetime.date(2024, 1, 2)), (3, "before", "t4", "1 AM", 0, None), (3, "before", "t5", "2 AM", 0, None)], "question int, direction string, turn string, value string, weekday int, date date")
    references = spark.createDataFrame([(1, "r1", 1, None), (2, "r2", None, datetime.date(2024, 1, 1)), (3, "r3", 1, None)], "question int, turn string, weekday int, date date")
    got = {r.question: (r.value, r.n) for r in facts.temporal_join(targets, references).collect()}
    assert got == {1: ("1:30 AM", 1), 2: ("5 PM", 1), 3: (None, 2)}


def test_anchor_support(spark):
    rows = [("What is the brand of my phone?", "My phone is new"), ("How many days did Ann Lee stay?", "A.L. or AL stayed"), ("How many days did Ann Lee stay?", "Ann stayed"), ("What was my occupation?", "my job was hard"), ("nothing", None)]
    got = values(spark, rows, "q string, t string", planner.coverage(planner.anchor_groups(F.col("q")), F.col("t"))["complete"])
    assert [c for (c,) in got] == [True, True, False, True, True]


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"id": "1"}, {"id": "2"}]}')
    (tmp_path / "b.json").write_text('[{"id": "3"}]')
    (tmp_path / "c.json").write_text('{"x": {"id": "4"}, "y": {"id": "5"}}')
    assert [sorted(r.id for r in records.read_json(spark, str(tmp_path / f), "id string").collect()) for f in ("a.json", "b.json", "c.json")] == [["1", "2"], ["3"], ["4", "5"]]
    (tmp_path / "l.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\nbroken')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_lines(spark, str(tmp_path / "l.jsonl"), "id string", strict=True).collect()
    got = values(spark, [({"b": None, "c": "x"},), ({"c": "x"},)], "m map<string,string>", records.first_present(F.col("m"), ["a", "b", "c"]))
    assert got == [(None,), ("x",)]
    with pytest.raises(Exception, match="duplicate question"):
        records.unique(spark.createDataFrame([(1,), (1,)], "id int"), "id", "question").collect()
    sliced = records.record_slice(spark.range(10).withColumn("question_type", F.when(F.col("id") % 2 == 0, "even").otherwise("odd")), "id", 3, 2, "even")
    assert [r.id for r in sliced.collect()] == [4, 6]


def test_runs(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    import hashlib

    row = runs.content_identity(spark, str(tmp_path / "f.bin")).first()
    assert (row["size"], row.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
    assert runs.fingerprint({"b": 1, "a": "é", "created_at": 5}) == runs.fingerprint({"a": "é", "b": 1, "fingerprint": "x"}) != runs.fingerprint({"a": "e", "b": 1})
    p = spark.createDataFrame([(0, "q1", "x"), (1, "q2", "y"), (2, "q3", "z")], "row_no int, question_id string, hypothesis string")
    t = spark.createDataFrame([(0, "q1", "x", 5), (1, "q2", "other", 6)], "row_no int, question_id string, hypothesis string, dataset_index int")
    w = spark.createDataFrame([(0, "q1", 5), (1, "q2", 6), (2, "q3", 7)], "row_no int, question_id string, dataset_index int")
    assert tuple(runs.completed_prefix(w, p, t).first()) == (2, 1)
    with pytest.raises(Exception, match="no reference for"):
        runs.validated_join(p, w.where("row_no = 0").drop("row_no"), "question_id").collect()


def test_entities(spark):
    from anamnesis.operators.entities import resolved

    rows = [
        ("s", 1, "ann", "My name is Ann Lee and I sing", "I", "likes", "like", "tea"),
        ("s", 2, "ann", None, "Ann Lee", "works at", "work at", "Acme"),
        ("s", 3, "bob", None, "Dr. Stone", "knows", "know", "Ann"),
        ("s", 4, "bob", None, "he", "lives in", "live in", "Rome"),
        ("s", 5, "bob", None, "Stone", "is known as", "known as", "Rocky"),
        ("s", 6, "bob", None, "Rocky", "likes", "like", "soup"),
        ("s", 7, "ann", None, "my manager", "likes", "like", "tea"),
        ("s", 8, "ann", None, "Ann Lee's manager", "sees", "see", "Bob"),
        ("t", 1, "ann", None, "Ann Lee", "likes", "like", "tea"),
        ("t", 2, None, None, None, "likes", "like", "tea"),
    ]
    got = {(r.session, r.seq): r for r in resolved(spark.createDataFrame(rows, "session string, seq long, speaker string, text string, head string, relation string, key string, tail string")).collect()}
    assert got["s", 1].head_id == got["s", 2].head_id and got["s", 1].head_name == "Ann Lee"
    assert ("s", 5) not in got and got["s", 6].head_id == got["s", 3].head_id and got["s", 6].head_name == "Rocky"
    assert got["s", 7].head_id == got["s", 8].head_id != got["s", 1].head_id
    assert got["s", 1].tail_id == got["s", 7].tail_id and ("t", 2) not in got and ("t", 1) in got


def test_streamed_chunks_and_compaction(spark, tmp_path):
    from anamnesis.streaming.ingest import chunked_stream, compacted, prior_only

    rows = spark.createDataFrame([("s", i, f"turn {i}") for i in range(5)] + [("u", 0, None)], "session string, turn long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = chunked_stream(stream).writeStream.format("memory").queryName("chunks_t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("chunks_t").count() == 6
    q = compacted(stream, "session", "turn", "text").writeStream.outputMode("update").format("memory").queryName("compact_t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.session, r.turns, r.summarised) for r in spark.table("compact_t").collect()} == {("s", 5, "turn 0\nturn 1\nturn 2"), ("u", 1, "")}
    asked = spark.createDataFrame([("s", 7, 2)], "session string, question int, at int")
    assert prior_only(rows, asked, "session", "turn", "at").count() == 2
