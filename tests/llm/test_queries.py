import pytest

SF = "/root/testdata/sf0.001"


def test_sql_agrees(spark):
    from anamnesis.llm.queries import ORACLE, QUERIES
    from tests.oracle import compare

    for name, sql in ORACLE.items():
        assert compare(spark, QUERIES[name], sql, SF) == "", name


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stage(spark, stage):
    """Each stage over the raw documents: columns, and nothing invented."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and ids
    if stage < 4:
        assert out.columns == docs.columns


def test_pipeline_runs_through(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def small_tables(spark, at, rows, labels=(), benchmark=()):
    schema = "doc_id long, text string, lang string, weight double, gumbel string, at int, rank string, digest string, known int, clean string"
    spark.createDataFrame([(i, t, "en", 1.0, "g", 2, "r", "d", 3, "c") for i, t in rows], schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, rows without ids, columns whose names operators use: what stays, and what was done to it."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    passage = "one two three four five six seven eight nine ten eleven"
    plain = "a quiet river runs past the old mill and the children play there every summer until it is dark"
    rows = [(1, plain), (2, plain), (2, plain), (None, plain + " indeed"), (3, None), (4, ""), (None, None), (5, f"so {passage} it says"), (6, "Mr Smith wrote to ann.lee@example.org about the long way home"), (7, "word " * 50_000), (8, "  \n ")]
    at = small_tables(spark, tmp_path / "a", rows, benchmark=[(1, passage), (2, None)])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        path = str(tmp_path / f"stage{_.replace(' ', '')}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {1, 3, 6, 7} and left[3].text in (None, "", "  \n ") and left[1].text == plain
    assert "Smith" not in left[6].text and "ann.lee" not in left[6].text and left[6].text.endswith("about the long way home")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(got) == set(left)
    for i, r in got.items():
        assert r.decoded_sha256 == hashlib.sha256((left[i].text or "").encode()).hexdigest() and list(r.ids) == t.encode(left[i].text or "", add_special_tokens=False).ids


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, small_tables(spark, tmp_path / "e", [])).count() == 0
