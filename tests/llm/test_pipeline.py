import importlib

from echofind.llm import repetition, secret_grammar

from . import brute


def test_stages(spark, tmp_path, make, corpus):
    pipeline = importlib.import_module("corpus_pipeline")
    benchmark = spark.createDataFrame([(1, dict(corpus)[21])], "item_id long, text string")
    benchmark.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    make(corpus).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), make([]).columns
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secret_scan", "packing"]
    rules, rows = repetition.Rules(), corpus
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, f"file://{tmp_path}")
        docs.write.parquet(f"file://{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/stage{k}")
        if k == 0:
            rows = [(d, t) for d, t in rows if brute.repetition(t, rules.grams, rules.line_chars)[-1]]
        elif k == 1:
            near = brute.near([r for r in rows if r[0] is not None])
            rows = [(d, t) for d, t in rows if d is None or near[d][2]]
        elif k == 2:
            bad = {r[0] for r in brute.contamination([r for r in rows if r[0] is not None], [(1, dict(corpus)[21])]) if r[-1]}
            rows = [r for r in rows if r[0] not in bad]
            assert 21 in bad
        elif k == 3:
            rows = [(d, secret_grammar.masked(t, secret_grammar.default_model())) for d, t in rows]
        if k < 4:
            assert docs.columns == columns
            assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == sorted((str(d), t) for d, t in rows)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {d for d, _ in rows}
    assert pipeline.run(spark, f"file://{tmp_path}").count() == docs.count()
