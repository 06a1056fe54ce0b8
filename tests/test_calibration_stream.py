"""The last scores of each kind from a stream whose batches are in many parts."""

from ravelin.streaming import conformal


def test_parts_pass_on_only_their_last_rows(spark, tmp_path):
    schema = "kind string, score double, seq long"
    rows = [("ab"[k % 2], float(k * 37 % 101), k) for k in range(400)] + [(None, 5.0, 1), ("none", None, 1), ("none", None, 2)]
    rows += [("a", None, 500)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src := str(tmp_path / "in"))
    seen = {}
    stream = conformal.file_stream(spark, src, schema)
    query = conformal.sliding_calibration(stream, size=5).writeStream.outputMode("update").option(
        "checkpointLocation", str(tmp_path / "log")
    ).trigger(availableNow=True).foreachBatch(lambda b, _: seen.update({r["kind"]: r for r in b.collect()})).start()
    query.awaitTermination()
    last = lambda kind: [s for k, s, n in sorted(rows, key=lambda r: r[2]) if k == kind and s is not None][-5:]
    for kind, n in (("a", 200), ("b", 200), (None, 1), ("none", 0)):
        got = seen[kind]
        assert (got["n_seen"], got["window_size"]) == (n, min(n, 5))
        assert got["quantile"] == conformal.window_quantile(last(kind), 0.1)


def test_a_trimmed_plan(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, 1)], schema := "kind string, score double, seq long").write.parquet(src := str(tmp_path / "in"))
    plan = conformal.sliding_calibration(conformal.file_stream(spark, src, schema))._jdf.queryExecution().logical().toString()
    assert "MapInPandas" in plan
    assert "MapInPandas" not in conformal.sliding_calibration(conformal.file_stream(spark, src, schema), rate=0.1)._jdf.queryExecution().logical().toString()
