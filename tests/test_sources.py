import json

from pyspark.sql import functions as F

from echofind.plans import analysis
from echofind.sources import readers, writers
from echofind.streaming import ingest


def test_pairs(spark, tmp_path):
    (tmp_path / "type-1.csv").write_text(" 1 , 2,1,0.5,0.25\n3,4,1,,\n")
    (tmp_path / "nonclone.csv").write_text("FUNCTION_ID_ONE, function_id_two\n5,6\n")
    found, missing = readers.catalogue(spark, f"file://{tmp_path}")
    rows = {(r.id1, r.id2, r.clone_set) for r in found.collect()}
    assert rows == {("1", "2", "type1"), ("3", "4", "type1"), ("5", "6", "nonclone")}
    assert missing == ["type2", "type3", "type4", "type5"]
    corpus = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, text string")
    assert [r.id1 for r in readers.both_exist(found, corpus).collect()] == ["1"]
    assert {(r.id, r.text) for r in readers.source_of(corpus, spark.createDataFrame([("1",), ("9",)], "id string")).collect()} == {("1", "a"), ("9", None)}


def test_snippets_and_tables(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "12.java").write_bytes(b"int a\xff;")
    row = readers.snippets(spark, f"file://{tmp_path}/src/*.java").first()
    assert row.id == "12" and row.text == "int a�;"
    df = spark.createDataFrame([(1, 0.5, 1)], "id1 int, x double, label int")
    writers.parquet(df, f"file://{tmp_path}/p")
    writers.csv(df.withColumn("id2", F.lit(2)), f"file://{tmp_path}/c")
    back, columns = readers.features_csv(spark, f"file://{tmp_path}/c")
    assert columns == ["x"] and back.count() == 1
    lacks = readers.prerequisites(spark, [f"file://{tmp_path}/p", f"file://{tmp_path}/q"], {f"file://{tmp_path}/p": ["x", "y"]})
    assert lacks == {"": [f"file://{tmp_path}/q"], f"file://{tmp_path}/p": ["y"]}
    writers.nested_json(spark, {"a": [1]}, f"file://{tmp_path}/j")
    assert json.loads(spark.read.text(f"file://{tmp_path}/j").first()[0]) == {"a": [1]}
    writers.report_json(df, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r").first().x == 0.5
    lines = writers.markdown(writers.summary(df, ["x"], 2), F.col("id1")).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["| id1 | x | label |", "|---|---|---|", "| 1 | 0.50 | 1 |"]
    calls = []
    for _ in range(2):
        readers.cached(spark, f"file://{tmp_path}/k", lambda: calls.append(1) or df)
    assert calls == [1]
    mark = readers.fingerprint(df)
    assert mark == readers.fingerprint(df.repartition(3)) != readers.fingerprint(df.union(df)) and readers.fingerprint(df.limit(0)) == "0-0"
    for params, columns in (({"h": 48, "input": mark}, ["x"]), ({"input": mark, "h": 48}, ["x"]), ({"h": 64, "input": mark}, ["x"])):
        readers.cached(spark, f"file://{tmp_path}/k2", lambda: calls.append(2) or df, params, columns)
    assert calls == [1, 2, 2]
    readers.cached(spark, f"file://{tmp_path}/k", lambda: calls.append(3) or df.withColumn("y", F.lit(1)), columns=["y"])
    assert calls == [1, 2, 2, 3]
    assert {(r.bin, r.n) for r in writers.histogram(df, "x", 0, 1, 2).collect()} == {(1, 1)}


def test_profile(spark):
    p = analysis.Profile()
    with p.stage("a"):
        sum(range(10))
    rows = p.rows(spark)
    assert p.totals(rows).first().slowest_stage == "a" and p.advice(rows).count() == 0
    assert p.advice(rows.withColumn("peak_mb", F.lit(600.0))).first().advice == "stream it"


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c")], "id int, text string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = ingest.copies(ingest.snippets(spark, f"file://{tmp_path}/in", "id int, text string"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("copies").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.class_id, r.class_size) for r in spark.table("copies").collect()} == {(1, 2), (3, 1)}
