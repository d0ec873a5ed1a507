"""Helpers shared by the operators: tables, written intermediates, text kernels, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage is cut, columns can still be pruned.

    The shuffle files of the write are dropped when it ends, for the written table takes their place.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def written_place(docs: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the number (from 0) of a row in the order in which the Parquet files behind ``docs`` were written.

    Spark reads files back in any order, but part numbers and row numbers within a file tell the order of the write.
    """
    meta = docs.metadataColumn("_metadata")
    rows = docs.withColumns({"_file": meta["file_path"], "_row": meta["row_index"]})
    part = F.regexp_extract("_file", "part-([0-9]+)[^/]*$", 1).try_cast("bigint")
    files = rows.groupBy("_file").agg(F.count("*").alias("n")).withColumn(  # one row per file
        "_before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(part, "_file")) - F.col("n")).select("_file", "_before")
    return rows.join(F.broadcast(files), "_file").withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def by_merge(side: DataFrame) -> DataFrame:
    """``side`` of a join as large as the corpus: sorted, never sent to the driver.

    Spark counts the rows behind an explode as those before it and a written table as its compressed bytes, so it would
    broadcast sides many times its own threshold.
    """
    return side.hint("merge")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


ROWS_AT_ONCE = 1_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``ROWS_AT_ONCE``."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def map_texts(df: DataFrame, kernel: Callable[[list[str]], dict[str, list]], schema: str, text: str = "text") -> DataFrame:
    """Add the columns of ``kernel(texts)`` to the other columns of ``df``; runs per Arrow batch, the text goes.

    ``schema`` is the DDL of the added columns. Batches are cut to ``ROWS_AT_ONCE`` whole rows, so memory is that many texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [f for f in df.schema.fields if f.name != text]
    added = StructType.fromDDL(schema)
    out = StructType(kept + added.fields)
    arrow_out = to_arrow_schema(out)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = kernel([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            arrays = [batch.column(batch.schema.get_field_index(n)).cast(arrow_out.field(n).type) for n in names]
            arrays += [pa.array(done[f.name], type=arrow_out.field(f.name).type) for f in added.fields]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow_out)

    return df.mapInArrow(run, out)


def key_bucket(*columns: str, bits: int = 10) -> Column:
    """Deterministic bucket 0 .. 2**bits - 1 of a row by the top bits of a hash, so bucket order is hash order."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits).cast("int")


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint): one row (node, root), root the smallest node.

    Alternates large-star and small-star steps: each step hangs the neighbours of a node on its smallest
    neighbour, so stars grow without listing the pairs of a component. Minima are aggregated map-side and the
    joins back are plain equi-joins whose hot hubs adaptive execution splits. Every second step is written to
    the shared folder. Raises if it has not settled after ``rounds`` steps, rather than returning a part.
    Self-loops are allowed; nodes without an edge do not appear.
    """
    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    signature = None
    for _ in range(rounds):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(by_merge(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(by_merge(low), "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        current = materialise(small, name)
        found = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
                            F.countDistinct("a").alias("d")).first()
        now = (found["n"], found["h"])
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
