"""Readers and writers: journeys, road graphs, trip lists, scenarios, run artefacts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelattice import schema as S
from ridelattice.session import ensure_checkpoint_dir

DEFAULT_SPEED_KMH = 40.0


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files, beside the shared checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write ``df`` once as Parquet and read it back: columns are compressed, and each job reads only those it needs."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_journeys(spark: SparkSession, path: str) -> DataFrame:
    """Journeys as JSON lines with nested points, vehicle and verification."""
    j = spark.read.schema(S.JOURNEY).json(path)
    return j.withColumns({
        "departure": F.to_timestamp("departure"),
        "vehicle": F.struct(
            F.coalesce("vehicle.kind", F.lit("car")).alias("kind"), F.coalesce("vehicle.capacity", F.lit(0)).alias("capacity"),
            F.coalesce("vehicle.verified", F.lit(False)).alias("verified")),
        "verification": F.struct(
            F.coalesce("verification.identity_verified", F.lit(False)).alias("identity_verified"),
            F.coalesce("verification.vehicle_verified", F.lit(False)).alias("vehicle_verified"),
            F.coalesce("verification.safety_flags", F.array().cast("array<string>")).alias("safety_flags")),
        "seats_requested": F.coalesce("seats_requested", F.lit(1)),
    })


def flat_journeys(j: DataFrame) -> DataFrame:
    """Columns the matching jobs use."""
    return j.select(
        "journey_id", "role", F.col("start.latitude").alias("o_lat"), F.col("start.longitude").alias("o_lon"),
        F.col("destination.latitude").alias("d_lat"), F.col("destination.longitude").alias("d_lon"), "departure",
        F.col("vehicle.capacity").alias("capacity"), F.col("vehicle.verified").alias("vehicle_ok"), F.col("seats_requested").alias("seats"),
        F.col("verification.identity_verified").alias("identity_ok"), (F.size("verification.safety_flags") > 0).alias("safety_flag"), "route")


def read_road_graph(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of graph documents (``nodes`` object, ``edges`` list)."""
    g = spark.read.schema(S.GRAPH).option("multiLine", multi_line).json(path)
    nodes = g.select(F.explode("nodes").alias("node", "p")).select("node", F.col("p.latitude").alias("lat"), F.col("p.longitude").alias("lon"))
    e = g.select(F.inline("edges"))
    speed = F.coalesce("speed_kmh", F.lit(DEFAULT_SPEED_KMH))
    derived = F.when(F.col("distance_km") > 0, F.col("distance_km") / speed * 3600.0).otherwise(0.0)
    edges = e.select("u", "v", F.col("distance_km").alias("km"), speed.alias("kmh"), F.coalesce("duration_seconds", derived).alias("secs"),
                     F.coalesce("name", F.lit("")).alias("name"))
    return nodes, edges


def read_trip_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Drivers and riders of trip-list documents as one table with a role."""
    t = spark.read.schema(S.TRIP_LIST).option("multiLine", multi_line).json(path)
    part = lambda role: t.select(F.lit(role).alias("role"), F.inline(f"{role}s"))
    both = part("driver").unionByName(part("rider"))
    return both.select(
        "role", "id", F.col("start.lat").alias("o_lat"), F.col("start.lon").alias("o_lon"), F.col("destination.lat").alias("d_lat"),
        F.col("destination.lon").alias("d_lon"), F.to_timestamp("departure_iso").alias("departure"), "capacity", "route_nodes_count")


def read_scenarios(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every scenario document of a folder, missing fields filled with defaults."""
    s = spark.read.schema(S.SCENARIO).option("multiLine", multi_line).option("pathGlobFilter", "*.json").json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    fill = {
        "id": stem, "name": stem, "description": F.lit(""), "distance_km": F.lit(0.0), "duration_min": F.lit(0.0),
        "pickup": F.create_map().cast("map<string,string>"), "dropoff": F.create_map().cast("map<string,string>"),
        "route_polyline": F.array().cast("array<array<double>>"), "available_drivers": F.array().cast("array<map<string,string>>"),
        "rejected_candidates": F.array().cast("array<map<string,string>>"),
    }
    return s.select(*[F.coalesce(F.col(c), d).alias(c) for c, d in fill.items()])


def with_json(df: DataFrame, column: str, schema: str, out: str) -> DataFrame:
    """Decode a JSON text column; text that does not parse stays available in the raw column."""
    return df.withColumn(out, F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))


def write_artefacts(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Write run tables into a new folder; an existing table is never overwritten."""
    for name, df in tables.items():
        w = df.write.mode("errorifexists")
        if fmt == "csv":
            w.option("header", True).csv(f"{folder}/{name}")
        else:
            w.format(fmt).save(f"{folder}/{name}")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint: row count and SHA-256 over the count and the sum of row digests.

    A row's text holds its columns in order of their names, joined by ``|``: null is ``\\N``, fractions have six decimals. Its digest
    is the first 15 hex digits of the text's SHA-256 as an integer, so rows found twice count twice. An empty table sums to 0.
    """
    def text(f) -> Column:
        fraction = f.dataType.typeName() in ("double", "float")
        return F.coalesce(F.format_string("%.6f", F.col(f.name)) if fraction else F.col(f.name).cast("string"), F.lit("\\N"))

    row = F.concat_ws("|", *[text(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    digest = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    h = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).alias("_h"))
    return h.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("_h").cast("string")), 256).alias("sha256"))


def manifest(tables: dict[str, DataFrame], config: str, seeds: str) -> DataFrame:
    """One row per dataset with configuration, seeds and fingerprint."""
    out = None
    for name, df in tables.items():
        row = fingerprint(df).select(F.lit(name).alias("dataset"), F.lit(config).alias("config"), F.lit(seeds).alias("seeds"), "rows", "sha256")
        out = row if out is None else out.unionByName(row)
    return out


def read_runs(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Metrics files of several runs as one table; columns a run lacks are null."""
    out = None
    for run, path in paths.items():
        df = spark.read.option("header", True).schema(schema).csv(path, enforceSchema=False).withColumn("run", F.lit(run))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def journey_json(df: DataFrame, role: str, id_col: str, capacity: Column, vehicle_ok: Column, flag: Column, seats: Column, base: str) -> DataFrame:
    """Journeys of the shared tables as JSON documents of the journey format."""
    point = lambda a, b: F.struct(F.col(a).alias("latitude"), F.col(b).alias("longitude"))
    start, end = point("o_lat", "o_lon"), point("d_lat", "d_lon")
    when = F.date_format(F.to_timestamp(F.lit(base)) + F.make_dt_interval(secs=F.col("dep_s").cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    doc = F.struct(
        F.col(id_col).cast("string").alias("journey_id"), F.lit(role).alias("role"), start.alias("start"), end.alias("destination"), when.alias("departure"),
        F.array(start, end).alias("route"), F.struct(F.lit("car").alias("kind"), capacity.alias("capacity"), vehicle_ok.alias("verified")).alias("vehicle"),
        F.struct(F.col("identity_ok").alias("identity_verified"), vehicle_ok.alias("vehicle_verified"),
                 F.when(flag, F.array(F.lit("reported"))).otherwise(F.array().cast("array<string>")).alias("safety_flags")).alias("verification"),
        seats.alias("seats_requested"))
    return df.select(F.to_json(doc).alias("value"))
