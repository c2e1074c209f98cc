from heaploom.functions import render
from heaploom.streaming import timeline_stream


def test_windows(spark, tmp_path):
    rows = "SELECT timestamp'2024-01-01 00:00:01' ts, 1L id, 'A' class_name, 5L self_size UNION ALL SELECT timestamp'2024-01-01 00:00:09', 1L, 'A', 7L UNION ALL SELECT timestamp'2024-01-01 00:00:11', 2L, 'B', 0L"
    spark.sql(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.sql(rows).schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("windows", timeline_stream.allocation_windows(stream), "complete"), ("firsts", timeline_stream.first_seen(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert [(r["class_name"], r["count"], r["size"]) for r in spark.table("windows").collect()] == [("A", 2, 12)]
    assert sorted(r["id"] for r in spark.table("firsts").collect()) == [1, 2]


def test_render(spark):
    df = spark.sql("SELECT 1 a, '日本' b UNION ALL SELECT 22, NULL")
    assert render.table(df.orderBy("a")) == "a   b\n1   日本\n22\n1–2 of 2"
    assert render.table(df.orderBy("a"), limit=1).endswith("1–1 of more") and render.table(df.limit(0)).endswith("no rows")
    assert render.tree(spark.sql("SELECT 0 depth, 'x' n UNION ALL SELECT 1, 'y'").orderBy("depth"), "n") == "x\n  y"
    assert '"a":1' in render.json_lines(df.orderBy("a"))
