import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schemas
from ledgerline.functions import scalars as S
from ledgerline.session import scratch_path
from ledgerline.sources import catalog as C
from ledgerline.sources import tables


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_targets_skip_comments_and_sum_duplicates(spark):
    lines = ["# a comment", "", "2025 | 1 | 2025 | 10", "2025|1|2025|5 # again", "mode: train", "2026|2|2027|1.5"]
    parsed = tables.parse_targets(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(parsed) == [("2025", "1", "2025", 15.0), ("2026", "2", "2027", 1.5)]


def test_targets_reject_other_lines(spark):
    bad = spark.createDataFrame([("what is this",)], "value string")
    with pytest.raises(Exception, match="invalid configuration line"):
        tables.parse_targets(bad).collect()


def test_settings(spark):
    lines = spark.createDataFrame([("mode: train",), ("features: a,b # note",), ("2025|1|2025|5",)], "value string")
    assert rows(tables.parse_settings(lines)) == [("features", "a,b"), ("mode", "train")]


def test_unknown_table_type_and_length(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="unknown table type"):
        tables.as_known_table(df, "other", {})
    with pytest.raises(ValueError, match="expected 2 columns"):
        tables.rename_by_position(df, ["a", "b"])


def test_strict_cast_raises_on_bad_value(spark):
    df = spark.createDataFrame([("x",)], "n string")
    with pytest.raises(Exception, match="bad value in n"):
        tables.strict_cast(df, T.StructType([T.StructField("n", T.IntegerType())])).collect()


def test_headers():
    assert tables.normal_header(" Sales-Order Sum ") == "sales_order_sum"


def test_schemas_have_the_expected_columns():
    assert schemas.BUDGET_WIDE.fieldNames()[-12:] == [str(m) for m in range(1, 13)]
    assert "order_starting_date" in schemas.SALES_ORDERS.fieldNames()


def test_encoding_fallback(spark):
    schema = T.StructType([T.StructField("name", T.StringType())])
    text = spark.createDataFrame([("café",), ("naïf",)], schema).coalesce(1)
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = scratch_path(spark, "enc")
        text.write.option("header", True).option("encoding", encoding).csv(path)
        assert rows(tables.read_csv_any_encoding(spark, path, schema)) == [("café",), ("naïf",)]


def test_catalogue_read(spark):
    path = scratch_path(spark, "cat")
    spark.createDataFrame([(1, "a")], "n int, s string").write.option("header", True).csv(path)
    catalog = spark.createDataFrame([("x", "po-3", path)], "name string, template string, path string")
    assert C.read(spark, catalog, "x", "po-3").count() == 1
    assert C.read(spark, catalog, "x", ["po-3", "po-2"]).count() == 1
    with pytest.raises(ValueError, match="not found"):
        C.read(spark, catalog, "y")
    with pytest.raises(ValueError, match="template mismatch"):
        C.read(spark, catalog, "x", "po-33")


def test_key_round_trip_and_quarantine(spark):
    key = "name^source=BW^creation_date=2025-01-31^template=po-3"
    df = C.parse_key(spark.createDataFrame([(key,)], "key string"))
    again = df.withColumn("again", C.build_key("name", "source", "creation_date", "template"))
    assert again.first().again == key
    twice = df.select(C.quarantine(C.quarantine("template")).alias("q"), C.release(C.release("template")).alias("r")).first()
    assert (twice.q, twice.r) == ("po-3?", "po-3")


def test_same_content_with_hot_group(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "id int, text string")
    found = rows(C.same_content(docs, "text", "id"), "id", "first_name", "copies")
    assert len(found) == 20 and {r[1] for r in found} == {1}


def test_sizes(spark):
    sizes = spark.createDataFrame([(5,), (2048,), (3 * 1024**2,), (5 * 1024**3,)], "s bigint")
    assert [r[0] for r in sizes.select(S.human_size("s")).collect()] == ["5B", "2.00K", "3.00M", "5.00G"]


def test_dates_and_amounts(spark):
    df = spark.createDataFrame([("31.1.2025", "1,234.5 ", 45000), ("1/2/2025", " - ", 0)], "d string, a string, n int")
    got = df.select(S.day_first_date("d"), S.parse_amount("a"), S.serial_day("n")).collect()
    assert tuple(got[0]) == (dt.date(2025, 1, 31), 1234.5, dt.date(2023, 3, 15))
    assert tuple(got[1])[:2] == (dt.date(2025, 2, 1), 0.0)


def test_hash_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    one = df.coalesce(1).select("id", S.hash_uniform("id", seed=4).alias("u"), S.hash_normal("id", seed=4).alias("z"))
    many = df.repartition(7).select("id", S.hash_uniform("id", seed=4).alias("u"), S.hash_normal("id", seed=4).alias("z"))
    assert rows(one) == rows(many)
    stats = one.agg(F.avg("u"), F.stddev("z")).first()
    assert abs(stats[0] - 0.5) < 0.05 and abs(stats[1] - 1) < 0.1


def test_runs_table_appends(spark):
    path = scratch_path(spark, "runs")
    tables.append_run(spark, path, "a", {"p": 1}, {"m": 0.5})
    tables.append_run(spark, path, "b", {}, {"m": 0.7})
    assert rows(spark.read.parquet(path)) == [("a", "metric", "m", "0.5"), ("a", "param", "p", "1"), ("b", "metric", "m", "0.7")]


def test_rows_per_object_of_files_with_other_columns(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    spark.createDataFrame([("x", 1.0)], "s string, v double").coalesce(1).write.parquet(f"{tmp_path}/sub/b.parquet")
    got = {r.path.split("/")[-2]: r.rows for r in C.rows_per_object(spark, str(tmp_path)).collect()}
    assert got == {"a.parquet": 7, "b.parquet": 1}


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_many_files_are_one_scan_where_they_agree(spark, tmp_path, fmt):
    made = [spark.createDataFrame([("a", "1")], "k string, v string"), spark.createDataFrame([("b", "2")], "k string, w string"),
            spark.createDataFrame([("3", "c")], "v string, k string")]
    paths = [tables.write_table(df, f"{tmp_path}/{fmt}{i}", fmt) for i, df in enumerate(made)]
    got = tables.read_many(spark, paths, fmt)
    assert {(r.k, r.v, r.w) for r in got.collect()} == {("a", "1", None), ("b", None, "2"), ("c", "3", None)}
    if fmt != "csv":
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_many_files_with_other_types(spark, tmp_path):
    paths = [tables.write_table(df, f"{tmp_path}/{i}") for i, df in enumerate([spark.range(2), spark.sql("SELECT 7 AS id"), spark.range(3)])]
    assert sorted(r.id for r in tables.read_many(spark, paths).collect()) == [0, 0, 1, 1, 2, 7]
    with pytest.raises(ValueError):
        tables.read_many(spark, [])
