"""Dataset catalogue: object names that carry source, creation date and template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import col, human_size
from ..session import cut_lineage

# Template name, its source, whether uploads may use it.
TEMPLATES = [
    ("monim-no-re-1", "BI", True),
    ("invoices-to-po-1", "BW", False),
    ("po-1", "BW", False),
    ("monim-by-posting-date-1", "BW", True),
    ("po-foreign-currency-1", "BW", False),
    ("po-foreign-currency-2", "BW", True),
    ("invoices-to-po-2", "BW", False),
    ("invoices-to-po-foreign-currency-1", "BW", True),
    ("po-2", "BW", False),
    ("ZH-foreign-currency-1", "BI", True),
    ("simulator-data-1", "BW", True),
    ("simulator-time-axis-1", "BW", True),
    ("NN-data-1", "BI", False),
    ("ZH-1", "BI", True),
    ("monim-by-posting-date-foreign-currency-1", "BI", True),
    ("NN-data-2", "BI", True),
    ("invoice-history-1", "BI", True),
    ("monim-no-re-1-cash", "BI", True),
    ("invoices-to-po-3", "BI", True),
    ("po-3", "BW", True),
    ("dates-po-1", "BW", True),
    ("disabled-quantity", "report", True),
    ("disabled-invoices", "BW", True),
    ("CPI", "report", True),
    ("CPI-health", "report", True),
    ("families-quantity", "report", True),
    ("orphans-invoices", "BW", True),
    ("widows-invoices", "BW", True),
    ("parents-invoices", "BW", True),
    ("po-changes-1", "BI", True),
]
NAME_RULE = "^[A-Za-z0-9_.-]{1,32}$"
BROKEN_MARK = "?"
CATALOG_SCHEMA = "name string, source string, creation_date string, template string, modified date, size bigint"


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """File names, times and sizes below a path; the content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("key"), "path",
        F.col("modificationTime").alias("modified"), F.col("length").alias("size"),
    )


def rows_per_object(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``rows`` of every Parquet file below a path that has rows; no column is read, whatever the files hold."""
    files = spark.read.schema(T.StructType([])).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    return files.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))


def build_key(name, source, creation_date, template) -> Column:
    return F.concat_ws(
        "^", col(name), F.concat(F.lit("source="), col(source)),
        F.concat(F.lit("creation_date="), col(creation_date)), F.concat(F.lit("template="), col(template)),
    )


def parse_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Adds name, source, creation_date and template read from the key by position."""
    def part(n: int) -> Column:
        return F.split_part(F.split_part(key, F.lit("^"), F.lit(n)), F.lit("="), F.lit(2))
    return df.withColumns({
        "name": F.split_part(key, F.lit("^"), F.lit(1)),
        "source": part(2), "creation_date": part(3), "template": part(4),
    })


def of_template(catalog: DataFrame, template: str) -> DataFrame:
    return catalog.where(F.col("template") == template)


def most_recent(catalog: DataFrame, n: int = 10) -> DataFrame:
    return catalog.orderBy(F.desc("modified"), "name").limit(n)


def with_readable_size(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("size_text", human_size("size"))


def total_size(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.sum("size").alias("size")).withColumn("size_text", human_size("size"))


def same_content(df: DataFrame, content: str, name: str) -> DataFrame:
    """Every object whose content another one has, with the first name holding it.

    The texts are read once: names and digests are written, and only they travel. The group's first name and size are
    an aggregate, combined map-side; the join of a content with a great many copies is split where it is skewed.
    """
    hashed = cut_lineage(df.select(name, F.md5(content).alias("digest")))
    repeated = hashed.groupBy("digest").agg(
        F.min(name).alias("first_name"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    return hashed.join(repeated, "digest")


def is_valid_name(c) -> Column:
    return F.coalesce(col(c).rlike(NAME_RULE), F.lit(False))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template string, allowed_source string, allowed boolean")


def allowed_templates(spark: SparkSession) -> DataFrame:
    return templates(spark).where("allowed").select("template", F.col("allowed_source").alias("source"))


def check_template(df: DataFrame, spark: SparkSession, template: str = "template") -> DataFrame:
    """Adds ``status`` and the source the template prescribes (null for ad-hoc ones).

    The template list is a fixed table of thirty rows, hence the broadcast.
    """
    joined = df.join(F.broadcast(templates(spark)), template, "left")
    ad_hoc = F.col(template).startswith("ad-hoc-")
    status = (
        F.when(ad_hoc & is_valid_name(template), "ad-hoc")
        .when(ad_hoc, "invalid name")
        .when(F.col("allowed").isNull(), "unknown")
        .when(F.col("allowed"), "allowed")
        .otherwise("disallowed")
    )
    source = F.when(status == "allowed", F.col("allowed_source"))
    return joined.withColumns({"status": status, "set_source": source}).drop("allowed", "allowed_source")


def quarantine(template) -> Column:
    """Append the mark unless present."""
    t = col(template)
    return F.when(t.endswith(BROKEN_MARK), t).otherwise(F.concat(t, F.lit(BROKEN_MARK)))


def release(template) -> Column:
    return F.regexp_replace(col(template), r"\?$", "")


def removable(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("template").endswith(BROKEN_MARK))


def remove(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Catalogue without the named objects; objects that are not quarantined stay."""
    gone = removable(catalog).join(names.select("name"), "name", "left_semi")
    return catalog.join(gone.select("name"), "name", "left_anti")


def taken_names(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    return candidates.join(catalog.select("name"), "name", "left_semi")


def read(spark: SparkSession, catalog: DataFrame, name: str, requested: str | list[str] | None = None, fmt="csv", **options) -> DataFrame:
    """The stored table of a catalogue name; raises on an unknown or repeated name or another template.

    ``catalog`` needs name, template and path.
    """
    found = catalog.where(F.col("name") == name).select("template", "path").limit(2).collect()
    if not found:
        raise ValueError(f"key {name!r} not found")
    if len(found) > 1:
        raise ValueError(f"key {name!r} is not unique")
    wanted = [requested] if isinstance(requested, str) else requested
    if wanted is not None and found[0].template not in wanted:
        raise ValueError(f"template mismatch: expected one of {wanted}, got {found[0].template!r}")
    return spark.read.format(fmt).options(header=True, **options).load(found[0].path)
