"""Readers and writers for the input and output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path, schema: T.StructType, **options) -> DataFrame:
    """CSV with a header under a declared schema; no inference pass."""
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def _as_windows_1252(df: DataFrame) -> DataFrame:
    """Text read as ISO-8859-1 with the control codes 80-9F turned into the signs they stand for in windows-1252."""
    codes = {chr(i): bytes([i]).decode("cp1252", "ignore") for i in range(0x80, 0xA0)}
    known = {c: sign for c, sign in codes.items() if sign}
    return df.withColumns({
        f.name: F.translate(f.name, "".join(known), "".join(known.values())) for f in df.schema if isinstance(f.dataType, T.StringType)})


def read_csv_any_encoding(spark: SparkSession, path, schema: T.StructType, **options) -> DataFrame:
    """UTF-8, or windows-1252 for those files that are not valid UTF-8.

    One scan of the text names the invalid files; only file names reach the driver, as for any read.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    states = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid")).collect()
    broken = [row["file"] for row in states if not row["valid"]]
    if not broken:
        return read_csv(spark, path, schema, **options)
    single = _as_windows_1252(read_csv(spark, broken, schema, **options, encoding="ISO-8859-1"))
    valid = [row["file"] for row in states if row["valid"]]
    return read_csv(spark, valid, schema, **options).unionByName(single) if valid else single


def normal_header(name: str) -> str:
    return name.strip().lower().replace("-", "_").replace(" ", "_")


def with_normal_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_header(c) for c in df.columns])


def rename_by_position(df: DataFrame, expected: list[str]) -> DataFrame:
    if len(df.columns) != len(expected):
        raise ValueError(f"expected {len(expected)} columns, got {len(df.columns)}")
    return df.toDF(*expected)


def as_known_table(df: DataFrame, kind: str, schemas: dict[str, T.StructType]) -> DataFrame:
    """Positional rename to the schema of ``kind``, then strict casts."""
    if kind not in schemas:
        raise ValueError(f"unknown table type {kind!r}")
    schema = schemas[kind]
    return strict_cast(rename_by_position(df, schema.fieldNames()), schema)


def strict_cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bad values raise at run time, also where the session has ANSI mode off."""
    known = set(df.columns)
    def one(field):
        value, cast = F.col(field.name), F.col(field.name).try_cast(field.dataType)
        message = F.concat(F.lit(f"bad value in {field.name}: "), value.cast("string"))
        return F.when(value.isNotNull() & cast.isNull(), F.raise_error(message)).otherwise(cast)
    return df.withColumns({f.name: one(f) for f in schema if f.name in known})


def lenient_number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def cached_read(spark: SparkSession, cache_path: str, load) -> DataFrame:
    """Read the stored copy, or load once, store it and read it back.

    A copy counts once its write has ended; what an interrupted write left behind is written anew.
    """
    if not _is_complete(spark, cache_path):
        load().write.mode("overwrite").parquet(cache_path)
    return spark.read.parquet(cache_path)


def _is_complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_split(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> str:
    """One folder per value combination; the columns move into the folder names.

    The rebalance hint gathers the rows of a value, and splits a value whose
    rows outgrow the advisory partition size over several tasks.
    """
    df.hint("rebalance", *by).write.partitionBy(*by).format(fmt).option("header", True).save(path)
    return path


def types_with_current_january(df: DataFrame, kind: str, date: str, year: int) -> DataFrame:
    """Rows of the types that have a row for January of the year."""
    january = df.where(F.col(date) == F.lit(f"{year}-01-31").cast("date")).select(kind).distinct()
    return df.join(january, kind, "left_semi")


def read_many(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Many files whose columns drift, as one table; absent columns are null.

    Files that name their columns themselves and agree on the types are one scan of
    all columns found. Others (CSV goes by position, types differ) are one branch per
    set of columns in the same order, and branches are brought together by name.
    """
    if not paths:
        raise ValueError("no files to read")
    schemas = {p: spark.read.format(fmt).option("header", True).load(p).schema for p in paths}
    columns: dict[str, T.StructField] = {}
    for field in (f for schema in schemas.values() for f in schema):
        columns.setdefault(field.name, field)
    agree = all(columns[f.name].dataType == f.dataType for schema in schemas.values() for f in schema)
    if agree and fmt in ("parquet", "orc", "json"):
        return spark.read.format(fmt).schema(T.StructType(list(columns.values()))).load(paths)
    alike: dict[str, list[str]] = {}
    for path, schema in schemas.items():
        alike.setdefault(schema.json(), []).append(path)
    frames = [spark.read.format(fmt).option("header", True).schema(schemas[same[0]]).load(same) for same in alike.values()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def append_run(spark: SparkSession, path: str, run_id: str, params: dict, metrics: dict) -> str:
    """Append a run's parameters and scores (one row each) to the runs table."""
    rows = [Row(run_id=run_id, kind="param", name=k, value=str(v)) for k, v in params.items()]
    rows += [Row(run_id=run_id, kind="metric", name=k, value=str(v)) for k, v in metrics.items()]
    schema = "run_id string, kind string, name string, value string"
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return path


def parse_settings(lines: DataFrame) -> DataFrame:
    """``key: value`` lines as rows; comments and blank lines are skipped."""
    text = _stripped(lines)
    return text.where(F.contains("line", F.lit(":"))).select(
        F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("key"),
        F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"),
    )


def parse_targets(lines: DataFrame) -> DataFrame:
    """``year|month|fund_year|amount`` lines as a table, repeated targets summed.

    Comments and blank lines are skipped. A line that is neither a target nor a setting raises.
    """
    text = _stripped(lines)
    parts = F.split("line", r"\|")
    bad = ~F.contains("line", F.lit(":")) & (F.size(parts) != 4)
    checked = text.withColumn("_ok", F.when(
        bad, F.raise_error(F.concat(F.lit("invalid configuration line: "), F.col("line")))).otherwise(F.lit(True)))
    targets = checked.where(F.col("_ok") & ~F.contains("line", F.lit(":")))
    return targets.select(
        F.trim(F.get(parts, F.lit(0))).alias("year"), F.trim(F.get(parts, F.lit(1))).alias("month"),
        F.trim(F.get(parts, F.lit(2))).alias("fund_year"), F.trim(F.get(parts, F.lit(3))).cast("double").alias("amount"),
    ).groupBy("year", "month", "fund_year").agg(F.sum("amount").alias("amount"))


def _stripped(lines: DataFrame) -> DataFrame:
    text = lines.select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("line"))
    return text.where(F.col("line") != "")

