"""Logical schemas of the journey, trip and evaluation tables."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])
VEHICLE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("capacity", T.IntegerType()), T.StructField("verified", T.BooleanType())])
VERIFICATION = T.StructType([
    T.StructField("identity_verified", T.BooleanType()), T.StructField("vehicle_verified", T.BooleanType()),
    T.StructField("safety_flags", T.ArrayType(T.StringType()))])
JOURNEY = T.StructType([
    T.StructField("journey_id", T.StringType()), T.StructField("role", T.StringType()), T.StructField("start", POINT),
    T.StructField("destination", POINT), T.StructField("departure", T.StringType()), T.StructField("route", T.ArrayType(POINT)),
    T.StructField("vehicle", VEHICLE), T.StructField("verification", VERIFICATION), T.StructField("seats_requested", T.IntegerType())])
GRAPH = T.StructType([
    T.StructField("nodes", T.MapType(T.StringType(), POINT)),
    T.StructField("edges", T.ArrayType(T.StructType([
        T.StructField("u", T.StringType()), T.StructField("v", T.StringType()), T.StructField("distance_km", T.DoubleType()),
        T.StructField("duration_seconds", T.DoubleType()), T.StructField("speed_kmh", T.DoubleType()), T.StructField("name", T.StringType())])))])
_SHORT_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_TRIP = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("start", _SHORT_POINT), T.StructField("destination", _SHORT_POINT),
    T.StructField("departure_iso", T.StringType()), T.StructField("capacity", T.IntegerType()), T.StructField("route_nodes_count", T.IntegerType())])
TRIP_LIST = T.StructType([T.StructField("drivers", T.ArrayType(_TRIP)), T.StructField("riders", T.ArrayType(_TRIP))])
SCENARIO = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("distance_km", T.DoubleType()), T.StructField("duration_min", T.DoubleType()),
    T.StructField("pickup", T.MapType(T.StringType(), T.StringType())), T.StructField("dropoff", T.MapType(T.StringType(), T.StringType())),
    T.StructField("route_polyline", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("available_drivers", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("rejected_candidates", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])

TRIP_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType(), False), T.StructField("origin", POINT), T.StructField("destination", POINT),
    T.StructField("departure", T.TimestampType()), T.StructField("seats", T.IntegerType())])
ROUTE_OPTION = T.StructType([
    T.StructField("route_id", T.StringType(), False), T.StructField("request_id", T.StringType()), T.StructField("distance_km", T.DoubleType()),
    T.StructField("duration_s", T.DoubleType()), T.StructField("path", T.ArrayType(POINT))])
MATCH_ASSIGNMENT = T.StructType([
    T.StructField("request_id", T.StringType(), False), T.StructField("driver_id", T.StringType(), False), T.StructField("score", T.DoubleType()),
    T.StructField("eligible", T.BooleanType()), T.StructField("reasons", T.ArrayType(T.StringType()))])
EVALUATION_RUN = T.StructType([
    T.StructField("run_id", T.StringType(), False), T.StructField("scenario", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])
