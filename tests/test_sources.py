"""Sources, sinks and streams, round trips where there are both."""

import json

from pyspark.sql import functions as F

from ravelin.functions import geometry
from ravelin.sources import files
from ravelin.streaming import conformal


def test_geojson(spark, tmp_path):
    payload = {"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:4326"}}, "features": [
        {"type": "Feature", "id": "f1", "properties": {"name": "one", "n": 3}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}},
        {
            "type": "Feature", "properties": {"site_id": "s2"},
            "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]], [[1, 1], [1, 2], [2, 2], [1, 1]]]}
        },
        {"type": "Feature", "id": "l3", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(payload))
    df = files.read_features(spark, str(tmp_path / "f.geojson"))
    got = {
        r["site_id"]: r
        for r in df.withColumn("area", geometry.area(F.col("geometry"))).withColumn("length", geometry.length(F.col("geometry"))).collect()
    }
    assert got["s2"]["area"] == 2.0 and got["l3"]["length"] == 5.0 and got["f1"]["crs"] == "EPSG:4326" and got["f1"]["properties"]["name"] == "one"
    files.write_geojson(df.select("site_id", "geometry", F.lit(7).alias("k")), str(tmp_path / "out"), "site_id")
    back = files.read_geojson_lines(spark, str(tmp_path / "out")).select("site_id", "geometry")
    assert {str(r) for r in back.collect()} == {str(r) for r in df.select("site_id", "geometry").collect()}


def test_points_lists_and_sampling(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "id,x,y,wkt,stationIds\n" + "".join(f"{i},{i},{'bad' if i == 3 else i * 2},POINT ({i} 1),a | b||c{i}\n" for i in range(10))
    )
    path = str(tmp_path / "p.csv")
    df = files.read_points(spark, path, "x", "y", ["id"])
    assert df.columns == ["id", "x", "y", "geometry"] and df.where(F.col("geometry.coords")[0]["y"].isNull()).count() == 1
    assert files.read_wkt_points(spark, path, "wkt").where(F.col("geometry").isNull()).isEmpty()
    assert files.read_route_lists(spark, path).first()["stationIds"] == ["a", "b", "c0"]
    ids = df.select(F.col("id").cast("int").alias("id"))
    assert sorted(r["id"] for r in files.every_nth(ids, ["id"], 3).collect()) == [0, 3, 6, 9]
    assert sorted(r["id"] for r in files.every_nth(ids, ["id"], 3, 2).collect()) == [0, 3]
    assert [len(x) for x in files.iterate(ids, 4)] == [4, 4, 2]
    files.write_delimited(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 10


def test_series_grids_and_snapshots(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"series": [{"stationId": "a", "metric": "m", "values": [1, 2.5]}]}))
    assert [(r["position"], r["value"]) for r in files.read_series(spark, str(tmp_path / "s.json")).collect()] == [(1, 1.0), (2, 2.5)]
    (tmp_path / "r.json").write_text(
        json.dumps(
            {"seriesName": "n", "siteCode": "c", "startTimestamp": "2024-01-01T00:00:00Z", "frequencyHours": 6, "stageFt": [1.0, 2.0, 3.0]}
        )
    )
    assert str(
        files.read_regular_series(spark, str(tmp_path / "r.json")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm")).first()[0]
    ) == "2024-01-01 12:00"
    (tmp_path / "g.json").write_text(json.dumps({"rasterName": "g", "cellSize": 1, "noData": -9, "grid": [[1, -9], [3, 4]]}))
    assert {
        (r["row"], r["col"]): r["value"] for r in files.read_grid(spark, str(tmp_path / "g.json")).collect()
    } == {(0, 0): 1, (0, 1): None, (1, 0): 3, (1, 1): 4}
    snap = {
        "features": [{"featureId": "f", "name": "F", "category": "c", "region": "r"}],
        "thresholds": [{"featureId": "f", "metricName": "m", "maxValue": 1.0}, {"featureId": "f", "metricName": "m", "maxValue": 2.0}],
        "observations": [
            {"observationId": "o", "featureId": "f", "observedAt": "t", "metricName": "m", "value": 1.5},
            {"observationId": "p", "featureId": "g", "metricName": "m"}
        ]
    }
    (tmp_path / "n.json").write_text(json.dumps(snap))
    got = {r["observationId"]: r for r in files.read_snapshot(spark, str(tmp_path / "n.json")).collect()}
    assert got["o"]["maxValue"] == 2.0 and got["o"]["region"] == "r" and got["p"]["name"] is None


def test_state_goes_on_over_batches(spark, tmp_path):
    schema = "kind string, score double, seq long"
    src, out, seen = str(tmp_path / "in"), str(tmp_path / "log"), []

    def run():
        stream = conformal.file_stream(spark, src, schema)
        q = conformal.sliding_calibration(
            stream, size=3, alpha=0.5, rate=0.1
        ).writeStream.outputMode("update").option("checkpointLocation", out).trigger(availableNow=True).foreachBatch(
            lambda b, _: seen.extend(b.collect())
        ).start()
        q.awaitTermination()

    spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("b", 5.0, 1)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("a", 9.0, 4), ("a", 3.0, 3)], schema).coalesce(1).write.mode("append").parquet(src)
    run()  # a new query goes on from the checkpoint
    last = seen[-1]
    assert (last["kind"], last["n_seen"], last["window_size"]) == ("a", 4, 3)
    assert last["quantile"] == conformal.window_quantile([2.0, 3.0, 9.0], last["level"])
    assert files.to_markdown(spark.createDataFrame([(1, None)], "a int, b string")).endswith("| 1 |  |")
