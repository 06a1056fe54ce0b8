"""Readers and writers: JSON features, delimited points, snapshots, series, grids, key-value text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, shapes

#: Reader options by workload.
PRESETS = {
    "small": {"maxFilesPerTrigger": "1", "maxRecordsPerBatch": 1_000},
    "medium": {"maxFilesPerTrigger": "8", "maxRecordsPerBatch": 10_000},
    "large": {"maxFilesPerTrigger": "64", "maxRecordsPerBatch": 50_000},
    "huge": {"maxFilesPerTrigger": "512", "maxRecordsPerBatch": 200_000},
}

_FEATURE = "struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
_PAYLOAD = f"struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>,features:array<{_FEATURE}>,crs:struct<properties:struct<name:string>>>"


def preset(name: str) -> dict:
    if name.lower() not in PRESETS:
        raise ValueError(f"unknown preset: {name}")
    return PRESETS[name.lower()]


def _geometry_of(g):
    """A geometry struct from a type and its coordinates as JSON text; of polygons the outer ring."""
    pairs = "array<array<double>>"
    flat = F.when(
        g["type"] == "Point", F.array(F.from_json(g["coordinates"], "array<double>"))
    ).when(g["type"] == "Polygon", F.from_json(g["coordinates"], f"array<{pairs}>")[0]).otherwise(F.from_json(g["coordinates"], pairs))
    return F.struct(g["type"].alias("type"), F.transform(flat, lambda v: geometry.vertex(v[0], v[1])).alias("coords"))


def _features(spark: SparkSession, path: str, id_name: str, name: str, geometry_of) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _PAYLOAD).alias("p"))
    own = F.array(
        F.struct(
            F.col("p.type").alias("type"), F.col("p.id").alias("id"), F.col("p.properties").alias("properties"),
            F.col("p.geometry").alias("geometry")
        )
    )
    rows = raw.select(
        F.col("p.crs.properties.name").alias("crs"),
        F.explode(F.when(F.col("p.type") == "FeatureCollection", F.col("p.features")).otherwise(own)).alias("f")
    )
    own_id = F.coalesce(F.element_at("f.properties", id_name), F.col("f.id"))
    return rows.select(own_id.alias(id_name), F.col("f.properties").alias("properties"), geometry_of(F.col("f.geometry")).alias(name), "crs")


def read_features(spark: SparkSession, path: str, id_name: str = "site_id") -> DataFrame:
    """GeoJSON files, a feature or a collection each: ``(id, properties, geometry, crs)``; of polygons the outer ring."""
    return _features(spark, path, id_name, "geometry", _geometry_of)


def read_shapes(spark: SparkSession, path: str, id_name: str = "site_id") -> DataFrame:
    """The same with all rings and parts: ``(id, properties, shape, crs)``; a geometry that is none of the six types, or broken, is null."""
    return _features(spark, path, id_name, "shape", lambda g: shapes.from_geojson(g["type"], g["coordinates"]))


def read_points(spark: SparkSession, path: str, x: str, y: str, columns: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    """Delimited text with a header; x and y become a point, other values stay text."""
    df = spark.read.csv(path, header=True, sep=delimiter)
    chosen = df if columns is None else df.select(*dict.fromkeys([*columns, x, y]))
    return chosen.withColumn("geometry", geometry.point(F.col(x).try_cast("double"), F.col(y).try_cast("double")))


def read_wkt_points(spark: SparkSession, path: str, column: str, delimiter: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=delimiter).withColumn("geometry", geometry.from_wkt_point(F.col(column)))


def every_nth(df: DataFrame, order: list[str], step: int, limit: int | None = None) -> DataFrame:
    """Rows zero, step, twice step ... of an order, numbered over sorted partitions and not in one task."""
    spark = df.sparkSession
    cols = df.columns
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    numbered = dealt.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    from ..session import settle

    numbered = settle(numbered, "numbered")
    sizes = sorted(
        (r["_part"], r["n"], r["low"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("low")).collect()
    )
    starts, seen = [], 0
    for part, n, low in sizes:
        starts.append((part, low - seen))
        seen += n
    offsets = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_part int, _shift long"))  # a row for each partition
    out = numbered.join(offsets, "_part").withColumn("_at", F.col("_id") - F.col("_shift")).where(F.col("_at") % step == 0)
    if limit is not None:
        out = out.where(F.col("_at") < step * limit)
    return out.select(*cols)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of ``{stationId, metric, values}`` in long form."""
    rows = spark.read.schema("series array<struct<stationId:string,metric:string,values:array<double>>>").json(path, multiLine=True)
    one = rows.select(F.explode("series").alias("s"))
    return one.select("s.stationId", "s.metric", F.posexplode("s.values").alias("pos", "value")).select(
        "stationId", "metric", (F.col("pos") + 1).cast("long").alias("position"), "value"
    )


def read_regular_series(spark: SparkSession, path: str) -> DataFrame:
    """Values with a start and a step in hours, as timestamps and values."""
    schema = "seriesName string, siteCode string, startTimestamp string, frequencyHours int, stageFt array<double>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    long = rows.select("seriesName", "siteCode", "startTimestamp", "frequencyHours", F.posexplode("stageFt").alias("pos", "value"))
    return long.select(
        "seriesName", "siteCode",
        (F.to_timestamp("startTimestamp") + F.make_dt_interval(hours=F.col("pos") * F.col("frequencyHours"))).alias("ts"), "value"
    )


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A raster in JSON as ``(row, col, value)``; cells of its ``noData`` value are null."""
    raw = spark.read.schema("rasterName string, cellSize int, noData int, grid array<array<int>>").json(path, multiLine=True)
    rows = raw.select("rasterName", "noData", F.posexplode("grid").alias("row", "cells"))
    cells = rows.select("rasterName", "noData", "row", F.posexplode("cells").alias("col", "value"))
    return cells.select("rasterName", "row", "col", F.nullif("value", "noData").alias("value"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Nested features, thresholds and observations as flat rows; of repeated thresholds the last counts."""
    schema = "features array<struct<featureId:string,name:string,category:string,region:string>>, thresholds array<struct<featureId:string,metricName:string,minValue:double,maxValue:double>>, observations array<struct<observationId:string,featureId:string,observedAt:string,metricName:string,value:double,status:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    seen = raw.select(F.explode("observations").alias("o")).select("o.*")
    features = raw.select(F.posexplode("features").alias("pos", "f")).groupBy("f.featureId").agg(F.max_by("f", "pos").alias("f")).select(
        "featureId", "f.name", "f.category", "f.region"
    )
    limits = raw.select(F.posexplode("thresholds").alias("pos", "t")).groupBy("t.featureId").agg(F.max_by("t", "pos").alias("t")).select(
        "featureId", F.col("t.metricName").alias("_metric"), "t.minValue", "t.maxValue"
    )
    out = seen.join(features, "featureId", "left").join(limits, "featureId", "left")
    same = F.col("_metric") == F.col("metricName")
    return out.withColumns({"minValue": F.when(same, F.col("minValue")), "maxValue": F.when(same, F.col("maxValue"))}).drop("_metric")


def read_route_lists(spark: SparkSession, path: str, column: str = "stationIds") -> DataFrame:
    """Delimited text with one column of ids joined by bars, as an array."""
    parts = F.filter(F.transform(F.split(F.col(column), r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    return spark.read.csv(path, header=True).withColumn(column, parts)


def iterate(df: DataFrame, rows: int) -> Iterator[list]:
    """Lists of rows, fetched a partition at a time."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def write_geojson(df: DataFrame, path: str, id_col: str, geometry_col: str = "geometry") -> None:
    """One feature a line, in as many files as partitions, of geometries or shapes; ``read_geojson_lines`` and ``read_shape_lines`` read them.

    Null ids and properties are left out; a null geometry is one.
    """
    own = [c for c in df.columns if c not in (id_col, geometry_col)]
    properties = F.struct(*own) if own else F.create_map().cast("map<string,string>")
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_col).cast("string").alias("id"), properties.alias("properties")))
    is_shape = "parts" in df.schema[geometry_col].dataType.names
    body = F.coalesce((shapes if is_shape else geometry).to_geojson(F.col(geometry_col)), F.lit("null"))
    line = F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(',"geometry":'), body, F.lit("}"))
    df.select(line.alias("value")).write.text(path)


def read_geojson_lines(spark: SparkSession, path: str, id_name: str = "site_id") -> DataFrame:
    """Features, one a line: ``(id, properties, geometry)``; of polygons the outer ring. A line that is no JSON is an error."""
    return _feature_lines(spark, path, id_name, "geometry", _geometry_of)


def read_shape_lines(spark: SparkSession, path: str, id_name: str = "site_id") -> DataFrame:
    """The same with all rings and parts: ``(id, properties, shape)``."""
    return _feature_lines(spark, path, id_name, "shape", lambda g: shapes.from_geojson(g["type"], g["coordinates"]))


def _feature_lines(spark: SparkSession, path: str, id_name: str, name: str, geometry_of) -> DataFrame:
    f = spark.read.text(path).select(F.from_json("value", _FEATURE, {"mode": "FAILFAST"}).alias("f"))
    return f.select(F.col("f.id").alias(id_name), F.col("f.properties").alias("properties"), geometry_of(F.col("f.geometry")).alias(name))


def write_delimited(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Text with a header; geometries as JSON text."""
    cols = [geometry.to_geojson(F.col(c)).alias(c) if t == geometry.GEOMETRY else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.csv(path, header=True, sep=delimiter)


def _report_rows(df: DataFrame, limit: int) -> tuple[list, bool]:
    """At most ``limit`` rows of a report, and whether there are more."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def to_markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report's rows as a Markdown table; nulls are empty. Rows beyond the limit are left out, which the last line then says."""
    text = lambda v: "" if v is None else str(v).replace("|", "\\|")
    rows, more = _report_rows(df, limit)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(map(text, r)) + " |" for r in rows]
    return "\n".join([*lines, *([f"\nOnly the first {limit} rows."] if more else [])])


def to_json_report(df: DataFrame, limit: int = 1000) -> str:
    """A report's rows as JSON; more rows than the limit are an error, since a cut can't be told from the text."""
    rows, more = _report_rows(df, limit)
    if more:
        raise ValueError(f"a report has at most {limit} rows; write the table instead")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=2, default=str)


def read_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Parquet, JSON lines or delimited text with a header, by the ending of the path."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.json(path)
    if kind in ("csv", "tsv", "txt"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == "tsv" else delimiter)
    raise ValueError(f"unknown kind of file: {path}")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON in files that are added to a folder."""
    df.write.mode("append").json(path)


def write_insert_sql(df: DataFrame, path: str, name: str) -> None:
    """Statements that insert the rows into a table, one a row, so that a database can be seeded; they skip rows that are there."""
    kinds = dict(df.dtypes)

    def literal(c: str):
        plain = kinds[c] in ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean") or kinds[c].startswith("decimal")
        value = F.col(c).cast("string") if plain else F.concat(
            F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")
        )
        return F.coalesce(value, F.lit("NULL"))

    values = F.concat_ws(", ", *[literal(c) for c in df.columns])
    head = f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("
    df.select(F.concat(F.lit(head), values, F.lit(") ON CONFLICT DO NOTHING;")).alias("value")).write.text(path)
