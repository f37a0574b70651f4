"""Sources and sinks (A1, A2, A4-A10).

Every read states its schema: no inference, so a scan plans without a pass
over the data and a drifting file fails loudly instead of changing types.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas of the driver tables (one parquet file per table).
TABLE_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, "
              "props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}

# Canonical measurement schema.
MEASUREMENT_SCHEMA = ("formula string, temperature double, thermal_conductivity double, "
                      "density double, source string")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A1: parquet scan of one driver table with its declared schema."""
    return nan_to_null(spark.read.schema(TABLE_SCHEMAS[name]).parquet(table_path(sf_dir, name)))


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A1: parquet scan; a missing path gives an empty frame of ``schema``."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return nan_to_null(spark.read.schema(schema).parquet(path))


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The null rule: NaN becomes NULL once, at the source.

    pandas treats NaN and None alike; Spark aggregates propagate NaN. Only
    floating columns can hold NaN, so only those are touched.
    """
    float_cols = [f.name for f in df.schema.fields
                  if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                  and (cols is None or f.name in cols)]
    if not float_cols:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in float_cols})


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A2: CSV with a header row, typed by ``schema`` (no inference)."""
    return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))


def read_csv_as_strings(spark: SparkSession, path: str) -> DataFrame:
    """A7 first half: every column as string, names from the header."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: parquet sink."""
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: CSV sink with header; nested columns are stringified first."""
    stringify_nested(df).write.mode(mode).option("header", True).csv(path)


def convert_csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str,
                           schema: str | T.StructType, string_cols: list[str] = ()) -> DataFrame:
    """CSV to parquet with a typed schema.

    Columns read as text are cast to the declared types with ``try_cast``
    (dirty values become NULL); ``string_cols`` stay text, which is what the
    mixed-type repair amounts to.
    """
    target = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    raw = read_csv_as_strings(spark, csv_path)
    missing = [f.name for f in target.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"CSV {csv_path} lacks columns {missing}")
    cols = []
    for f in target.fields:
        if f.name in string_cols or isinstance(f.dataType, T.StringType):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name))
    out = raw.select(cols)
    write_parquet(out, parquet_path)
    return spark.read.schema(target).parquet(parquet_path)


def stringify_nested(df: DataFrame) -> DataFrame:
    """struct/array/map columns to JSON text so flat sinks accept them."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select([
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested)
        else F.col(f.name)
        for f in df.schema.fields])


def read_or_compute(spark: SparkSession, path: str, compute, csv_path: str | None = None,
                    csv_schema: str | T.StructType | None = None) -> DataFrame:
    """The stored Parquet table at ``path``; else the CSV table at
    ``csv_path`` (typed by ``csv_schema``); else compute, store, read back.

    A table counts as stored only when the writer's ``_SUCCESS`` marker is
    there, so a half-written folder from a lost job is recomputed (and
    overwritten), never read. Reading back cuts the lineage of ``compute``.
    """
    if _exists(spark, os.path.join(path, "_SUCCESS")):
        return nan_to_null(spark.read.parquet(path))
    if csv_path and csv_schema is not None and _exists(spark, csv_path):
        return read_csv(spark, csv_path, csv_schema)
    write_parquet(compute(), path)
    return nan_to_null(spark.read.parquet(path))


def clear_table(spark: SparkSession, path: str) -> bool:
    """A6 ``clear_cache``: delete a stored table through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath) and fs.delete(jpath, True))


def save_column_list(spark: SparkSession, names: list[str], path: str) -> None:
    """An ordered column list as a small table (position, name)."""
    rows = [(i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "position int, name string").coalesce(1) \
        .write.mode("overwrite").json(path)


def load_column_list(spark: SparkSession, path: str) -> list[str]:
    """Read the list back, in stored order (a list of names, tiny)."""
    rows = spark.read.schema("position int, name string").json(path).orderBy("position").collect()
    return [r.name for r in rows]


def select_listed(df: DataFrame, names: list[str]) -> DataFrame:
    """A9 ``load_selected_features``: keep listed names present in df, in list order."""
    present = set(df.columns)
    return df.select([F.col(f"`{n}`") for n in names if n in present])


def column_list_from_json(text: str) -> list[str]:
    """A9 for a JSON array file written by other tools."""
    return [str(x) for x in json.loads(text)]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))
