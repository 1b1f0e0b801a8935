from pyspark.sql import functions as F

from regspark.streaming import lww


def test_last_write_wins(spark, tmp_path):
    src = tmp_path / "in"
    schema = "seq long, op string, path_norm string, name string, number long"
    batches = [[(1, "set_value", "a", "x", 1), (5, "set_value", "a", "y", 5)], [(3, "delete_value", "a", "x", None), (4, "set_value", "a", "y", 4), (6, "set_value", "b\\c", "z", 6), (7, "delete_key", "b", None, None), (8, "set_value", "b\\d", "z", 8)]]
    spark.createDataFrame(batches[0], schema).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = lww.current_values(stream).writeStream.outputMode("update").format("memory").queryName("lww").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame(batches[1], schema).coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
    finally:
        q.stop()
    last = spark.table("lww").where("path_norm = 'a'").groupBy("name").agg(F.max_by(F.struct("seq", "live", "number"), "seq").alias("v"))
    assert {r["name"]: tuple(r["v"]) for r in last.collect()} == {"x": (3, False, None), "y": (5, True, 5)}
    spark.table("lww").write.parquet(str(tmp_path / "out"))
    assert {(r.path_norm, r.name, r.number) for r in lww.alive(spark.read.parquet(str(tmp_path / "out"))).collect()} == {("a", "y", 5), ("b\\d", "z", 8)}
