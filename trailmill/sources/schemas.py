"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

ACTIVITY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("upload_id", T.LongType()),
        T.StructField("athlete", T.StructType([T.StructField("id", T.LongType())])),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("gear_id", T.StringType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("average_speed", T.DoubleType()),
        T.StructField("max_speed", T.DoubleType()),
        T.StructField("total_elevation_gain", T.DoubleType()),
        T.StructField("elev_high", T.DoubleType()),
        T.StructField("elev_low", T.DoubleType()),
        T.StructField("moving_time", T.LongType()),
        T.StructField("elapsed_time", T.LongType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("start_date_local", T.StringType()),
        T.StructField("start_latlng", T.ArrayType(T.DoubleType())),
        T.StructField("end_latlng", T.ArrayType(T.DoubleType())),
        T.StructField("average_heartrate", T.DoubleType()),
        T.StructField("max_heartrate", T.DoubleType()),
        T.StructField("suffer_score", T.DoubleType()),
        T.StructField("id_str", T.StringType()),
        T.StructField("upload_id_str", T.StringType()),
    ]
)

GEAR = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("brand_name", T.StringType()),
        T.StructField("retired", T.BooleanType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("converted_distance", T.DoubleType()),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField("station_id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("obs_hour", T.TimestampNTZType()),
        T.StructField("temp", T.DoubleType()),
        T.StructField("rhum", T.DoubleType()),
    ]
)

# A page that failed is an object with this field instead of an activity list.
ERRORS = T.StructField("errors", T.StringType())

TABLE = T.StructType(
    [
        T.StructField("id_activity", T.LongType()),
        T.StructField("upload_id", T.LongType()),
        T.StructField("athlete.id", T.LongType()),
        T.StructField("name_activity", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("gear_id", T.StringType()),
        T.StructField("distance_activity", T.DoubleType()),
        T.StructField("average_speed", T.DoubleType()),
        T.StructField("max_speed", T.DoubleType()),
        T.StructField("total_elevation_gain", T.DoubleType()),
        T.StructField("elev_high", T.DoubleType()),
        T.StructField("elev_low", T.DoubleType()),
        T.StructField("moving_time", T.LongType()),
        T.StructField("elapsed_time", T.LongType()),
        T.StructField("average_heartrate", T.DoubleType()),
        T.StructField("max_heartrate", T.DoubleType()),
        T.StructField("suffer_score", T.DoubleType()),
        T.StructField("start_date", T.TimestampNTZType()),
        T.StructField("start_date_local", T.TimestampNTZType()),
        T.StructField("temp", T.DoubleType()),
        T.StructField("rhum", T.DoubleType()),
        T.StructField("name_gear", T.StringType()),
        T.StructField("brand_name", T.StringType()),
        T.StructField("retired", T.BooleanType()),
        T.StructField("distance_gear", T.DoubleType()),
        T.StructField("start_time_local_24h", T.StringType()),
        T.StructField("start_time_local_24h_hour", T.IntegerType()),
        T.StructField("start_time_local_12h", T.StringType()),
        T.StructField("weekday", T.StringType()),
        T.StructField("weekday_num", T.IntegerType()),
        T.StructField("month", T.StringType()),
        T.StructField("month_num", T.IntegerType()),
        T.StructField("monthly_date", T.DateType()),
        T.StructField("month_year", T.DateType()),
        T.StructField("month_year_name", T.StringType()),
        T.StructField("refresh_date", T.StringType()),
        T.StructField("year", T.IntegerType()),
    ]
)
