import json

from pyspark.sql import functions as F

from quern.streaming import changes as S


def test_documents_windows_and_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"k": "a", "t": f"2024-01-01 00:0{i}:00", "v": i} for i in (0, 1, 7)] + [{"k": "b", "t": "2024-01-01 00:02:00", "v": 5}]
    (tmp_path / "in" / "x.jsonl").write_text("\n".join([*map(json.dumps, rows), "# note", "", "{broken"]))

    def docs():
        return S.documents(spark, f"file://{tmp_path}/in", "k string, t timestamp, v double").where("k is not null")

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["k"], r["start"].minute, r["n"]) for r in spark.table(name).collect())

    assert run(S.windowed(docs(), "t", ["k"], "5 minutes", "1 hour", F.count("*").alias("n")), "w") == [("a", 0, 2), ("a", 5, 1), ("b", 0, 1)]
    assert run(S.sessions(docs(), "t", ["k"], "2 minutes", "1 hour", F.count("*").alias("n")), "s") == [("a", 0, 2), ("a", 7, 1), ("b", 2, 1)]
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    S.append_to(S.first_seen(docs(), ["k"], "t", "1 hour"), out, mark).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_merge_over_batches(spark, tmp_path):
    schema = "k long, seq long, gone boolean"
    for i in range(4):
        spark.createDataFrame([(j, 10 * i + j, i == 2 and j == 1) for j in range(3) if i < 3 or j == 0], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    stream = S.tables(spark, f"{tmp_path}/in/*", schema)
    S.merge_into(stream, f"{tmp_path}/table", "k", "seq", "gone", f"{tmp_path}/mark", every=2).awaitTermination()
    assert sorted((r["k"], r["seq"]) for r in S.merged_table(spark, f"{tmp_path}/table", "k", "seq", "gone").collect()) == [(0, 30), (2, 22)]
