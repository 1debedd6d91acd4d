import corpus_pipeline

from .helpers import docs, prose


def test_stages_run_in_order_and_keep_columns(spark, tmp_path):
    key = "token = 'Zm9vYmFyYmF6cXV4'"
    rows = [(i, prose(120 + i, i, 90), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, rows[4][1], "en", "s0"), (101, rows[5][1] + " more", "en", "s1"), (102, "junk " * 100, "en", "s2"), (103, None, None, None), (104, prose(100, 77) + " " + key, "en", "s0")]
    df = docs(spark, rows).drop("key")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / str(n)))
        step = spark.read.parquet(str(tmp_path / str(n)))
        seen.append(step)
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert all(s.columns == df.columns for s in seen[:4])
    assert ids[0] == set(range(40)) | {100, 101, 104}
    assert ids[1] == set(range(40)) | {104} and seen[1].count() == 41
    assert seen[2].where("doc_id = 104 and text like '%<secret>%'").count() == 1
    words = sum(len(r.text.split()) for r in seen[3].collect())
    assert abs(words - 1.5 * sum(len(r.text.split()) for r in seen[2].collect())) < 400
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).columns) == sorted(seen[4].columns)
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
