import pytest
from pyspark.sql import functions as F

from anamnesis.operators import candidates as C


def test_relation_keys_and_spans(spark):
    rows = spark.createDataFrame([("Where did I work before I moved?", ["studies in"]), (None, None)], "q string, r array<string>")
    assert [r[0] for r in rows.select(C.query_relation_keys(F.col("q"), F.col("r"))).collect()] == [["live in", "study in", "work at"], []]
    rows = spark.createDataFrame([("shopping at the Target (downtown)",), ("home",), (None,)], "v string")
    assert [r[0] for r in rows.select(C.place_values(F.col("v"))).collect()] == [["shopping at the Target (downtown)", "shopping at the Target", "Target"], ["home"], []]
    rows = spark.createDataFrame([("In my previous role as a marketing specialist, and I worked as an analyst.",), ("nothing",)], "t string")
    assert [r[0] for r in rows.select(C.occupations(F.col("t"))).collect()] == [["marketing specialist", "analyst"], []]


def test_temporal_and_slot_candidates(spark):
    triples = spark.createDataFrame([(1, 1, "I", "old address was", "Oak Street", "My old address was Oak Street", "user"), (1, 2, "I", "new address is", "Elm Street", "My new address is Elm Street", "user"), (1, 3, "Bob", "gave", "the lamp", "Bob gave me the lamp", "user"), (1, 4, "it", "address", "unknown", "address", "assistant")], "question int, seq int, head string, relation string, tail string, quote string, role string")
    asked = lambda text, slot, scope: spark.createDataFrame([(1, text, slot, scope)], "question int, text string, slot string, scope string")
    assert [r.tail for r in C.temporal_facts(triples, asked("What was my old address?", "x", "historical")).collect()] == ["Oak Street"]
    assert [r.tail for r in C.temporal_facts(triples, asked("What is my address now?", "x", "current")).collect()] == ["Elm Street"]
    got = C.slot_candidates(triples, asked("Who gave me the lamp?", "person or group", "current")).orderBy("rank").collect()
    assert {r.value for r in got} >= {"Bob", "the lamp"} and all(r.value != "unknown" for r in got)
    ranked = C.reranked(spark.createDataFrame([(1, 1, 2.0, 0.0), (1, 2, -2.0, 5.0)], "question int, seq int, s double, x double"), "s", "x", F.lit("user"), 5).orderBy("rank").collect()
    assert [r.seq for r in ranked] == [1, 2] and ranked[0].score == pytest.approx(0.7606, abs=1e-4)


def test_canonical_answers_and_decisions(spark):
    rows = spark.createDataFrame([("It took 20 hours.", "exact duration", "20 hours", "20 hours", "user"), ("six weeks", "exact duration", "about six weeks", "it was about six weeks", "user"), ("six weeks", "exact duration", "about six weeks", "it was about six weeks", "assistant"), ("maybe 7", "exact quantity or amount", "17", "17", "user"), ("Rome", "place or organization", "Rome", "Rome", "user"), (None, "exact duration", None, None, None)], "g string, s string, v string, q string, r string")
    c = F.col
    assert [r[0] for r in rows.select(C.canonical_answer(c("g"), c("s"), c("v"), c("q"), c("r"))).collect()] == ["20 hours", "about six weeks", "six weeks", "maybe 7", "Rome", ""]
    rows = spark.createDataFrame([("sum", "complete", "3", 1, 0), ("sum", "insufficient_evidence", None, 0, 2), ("none", "not_applicable", None, 1, 0), ("none", "not_applicable", None, 1, 2)], "o string, t string, a string, n int, k int")
    assert [r[0] for r in rows.select(C.decision(c("o"), c("t"), c("a"), c("n"), c("k"))).collect()] == ["answer", "abstain", "abstain", "generate"]


def test_ties_by_document(spark):
    """Scores that differ only by the order of their sums are ties."""
    from anamnesis.operators import lexical

    scores = spark.createDataFrame([(1, 1, 4.0), (1, 2, 1.0), (1, 3, 1.0 + 4e-16), (1, 4, 0.5)], "question int, doc int, score double")
    assert [r.doc for r in lexical.lexical_candidates(scores, 2).orderBy("rank").collect()] == [1, 2]


def test_fused_ties_by_document(spark):
    """Fused scores too."""
    from anamnesis.plans import hybrid

    legs = spark.createDataFrame([(1, 7, 0.8), (1, 8, 0.8 + 4e-16)], "question int, doc int, lexical_score double")
    dense = spark.createDataFrame([], "question int, doc int, dense_score double")
    docs = spark.createDataFrame([(7, "red fox"), (8, "fox red")], "doc int, text string")
    asked = spark.createDataFrame([(1, "red fox")], "question int, qtext string")
    assert [r.doc for r in hybrid.hybrid_search(legs, dense, None, docs, asked, 1, 0.2).collect()] == [7]


def test_nearest_of_awkward_vectors(spark, tmp_path, monkeypatch):
    """Missing, odd, short, far, equal and nearly equal vectors, in tiles smaller than the table, against the SQL."""
    import duckdb

    from anamnesis.operators import dense
    from anamnesis.plans.queries import KNN_SQL, knn_exact

    monkeypatch.setattr(dense, "ROWS", 7)
    odd = {3: None, 50: [0.6, None, 0.8], 51: [None, None, None], 52: [float("nan"), 0.0, 1.0], 53: [float("inf"), 0.0, 0.0], 54: [0.6, 0.8], 55: [], 100: None, 56: [1e200, 0.0, 0.0]}
    own = {i: odd[i] if i in odd else [0.6, 0.8, 0.0] if i % 4 == 0 else [0.6 + i % 3 * 1e-15, 0.0, 0.8] if i % 4 == 1 else [-0.6 - i, 0.0, 0.8] if i % 4 == 2 else [i / 200, 0.5, 0.1] for i in range(200)}
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", [[i, v] for i, v in own.items()])
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    said = con.execute(f"WITH {KNN_SQL} SELECT question, doc, rank, round(dense_score, 6) FROM k WHERE rank <= 20").fetchall()
    assert sorted((r.question, r.doc, r["rank"], r.dense_score) for r in knn_exact(spark, str(tmp_path)).collect()) == sorted(said) and len(said) == 80


def test_answers_of_articles_alone(spark, tmp_path):
    """Texts of articles, side by side and next to letters of any script, against the SQL."""
    import duckdb

    from anamnesis.plans.queries import ORACLE, answer_normalise

    texts = ["The a.", "the  a", "a", "a an the", "The\na", "A. the, an", "\u00e9a", "\u0436a", "a\u0301", "a_the", "the\n", "THE", "an\r\n", "\u00d7a", "\U00010400a", "", None, "!?", "anthem"]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, 0, 'user', ?)", [[i, t] for i, t in enumerate(texts)])
    con.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet'")
    said = sorted(con.execute(ORACLE["answer_normalise"]).fetchall())
    assert sorted(tuple(r) for r in answer_normalise(spark, str(tmp_path)).collect()) == said


def test_only_aliases_are_told_apart(spark):
    """Runs of words that are no alias are dropped before anything is gathered."""
    from anamnesis.operators import graph

    asked = spark.createDataFrame([(1, "a red fox and a red fox"), (1, "red fox"), (2, "no name")], "question int, text string")
    aliases = spark.createDataFrame([("red fox", 5), ("fox", 6), ("fox", 7)], "alias_key string, entity_id int")
    out = graph.link_entities(asked, aliases)
    assert sorted((r.question, r.entity_id) for r in out.collect()) == [(1, 5), (1, 6), (1, 7)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
