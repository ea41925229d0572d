"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schema import CUSTOMER_SCHEMA


# Declared types of the source tables: reading needs no job to infer them.
TABLE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLE_SCHEMAS[name]) if name in TABLE_SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, so means and medians skip it."""
    floats = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def scan_customers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The flat customer table with a declared schema, from Parquet or CSV with a header row."""
    reader = spark.read.schema(CUSTOMER_SCHEMA)
    if fmt == "csv":
        return nan_to_null(reader.option("header", True).option("enforceSchema", False).csv(path))
    return nan_to_null(reader.format(fmt).load(path))


def scan_intermediate(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Re-read a stored stage (enriched table, predictions, replies) with its schema."""
    return spark.read.schema(schema).parquet(path)
