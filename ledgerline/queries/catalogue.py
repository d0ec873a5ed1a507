"""Dataset catalogue."""

from pyspark.sql import functions as F

from ..sources import catalog as C
from . import query
from . import roles as R
from .roles import big, txt


GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("b01_list_objects", sql=" UNION ALL ".join(
    f"SELECT '{t}.parquet' AS key, CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(*) = 0 AS BIGINT) AS empty FROM {t}" for t in GIVEN))
def _(spark, d):
    """The stored tables with the rows in their files, from the listing alone."""
    listed = C.list_objects(spark, d).where(F.col("key").endswith(".parquet"))
    rows = C.rows_per_object(spark, d)
    name = F.regexp_extract("path", r"([^/]+\.parquet)(/[^/]*)?$", 1)
    found = listed.groupBy(name.alias("key")).agg(F.sum("size").alias("size"))
    counted = rows.groupBy(name.alias("key")).agg(F.sum("rows").alias("rows"))
    both = found.join(counted, "key", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return both.select("key", big("rows").alias("rows"), big((F.col("rows") == 0).cast("int")).alias("empty"))


@query("b02_parse_keys", sql=f"WITH {R.CATALOG} SELECT name, source, creation_date, template FROM catalog")
def _(spark, d):
    return R.catalog(spark, d).select("name", "source", "creation_date", "template")


@query("b02_rebuild_keys", sql=f"WITH {R.CATALOG} SELECT md5(name || '^source=' || source || '^creation_date=' || creation_date || '^template=' || template) AS digest FROM catalog")
def _(spark, d):
    return R.catalog(spark, d).select(F.md5(C.build_key("name", "source", "creation_date", "template")).alias("digest"))


@query("b03_of_template", sql=f"WITH {R.CATALOG} SELECT name, CAST(size AS BIGINT) AS size FROM catalog WHERE template = 'po-3'")
def _(spark, d):
    return C.of_template(R.catalog(spark, d), "po-3").select("name", big("size").alias("size"))


@query("b04_most_recent", sql=f"WITH {R.CATALOG} SELECT name, CAST(modified AS VARCHAR) AS modified FROM catalog ORDER BY catalog.modified DESC, name LIMIT 10")
def _(spark, d):
    return C.most_recent(R.catalog(spark, d)).select("name", txt("modified").alias("modified"))


@query("b05_readable_size", sql=f"""
WITH {R.CATALOG} SELECT name, CASE WHEN size >= 1048576 THEN printf('%.2fM', size / 1048576.0) WHEN size >= 1024 THEN printf('%.2fK', size / 1024.0) ELSE CAST(size AS VARCHAR) || 'B' END AS size_text FROM catalog""")
def _(spark, d):
    return C.with_readable_size(R.catalog(spark, d)).select("name", "size_text")


@query("b06_total_size", sql=f"WITH {R.CATALOG} SELECT CAST(SUM(size) AS BIGINT) AS size FROM catalog")
def _(spark, d):
    return C.total_size(R.catalog(spark, d)).select("size")


@query("b07_same_content", sql="""
WITH h AS (SELECT doc_id, md5(text) AS digest FROM documents), g AS (SELECT digest, MIN(doc_id) AS first_name, COUNT(*) AS copies FROM h GROUP BY 1 HAVING COUNT(*) > 1) SELECT doc_id, first_name, CAST(copies AS BIGINT) AS copies FROM h JOIN g USING (digest)""")
def _(spark, d):
    return C.same_content(R.table(spark, d, "documents"), "text", "doc_id").select("doc_id", "first_name", "copies")


@query("b08_valid_names", sql=f"WITH {R.CATALOG} SELECT template, CAST(SUM(CASE WHEN regexp_full_match(template, '[A-Za-z0-9_.-]{{1,32}}') THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM catalog GROUP BY 1")
def _(spark, d):
    return R.catalog(spark, d).groupBy("template").agg(big(F.sum(C.is_valid_name("template").cast("int"))).alias("valid"))


_ALLOWED = "allow(template, src, ok) AS (VALUES " + ", ".join(f"('{t}', '{s}', {str(a).lower()})" for t, s, a in C.TEMPLATES) + ")"


@query("b09_template_status", sql=f"""
WITH {R.CATALOG}, {_ALLOWED} SELECT template, CASE WHEN starts_with(template, 'ad-hoc-') AND regexp_full_match(template, '[A-Za-z0-9_.-]{{1,32}}') THEN 'ad-hoc' WHEN starts_with(template, 'ad-hoc-') THEN 'invalid name' WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'allowed' ELSE 'disallowed' END AS status,
  COALESCE(CASE WHEN ok THEN src END, '') AS set_source, CAST(COUNT(*) AS BIGINT) AS cnt FROM catalog LEFT JOIN allow USING (template) GROUP BY 1, 2, 3""")
def _(spark, d):
    x = C.check_template(R.catalog(spark, d), spark)
    return x.groupBy("template", "status", F.coalesce("set_source", F.lit("")).alias("set_source")).agg(F.count("*").alias("cnt"))


@query("b10_allowed_templates_in_use", sql=f"""
WITH {R.CATALOG}, {_ALLOWED} SELECT allow.template, src AS source, CAST(COUNT(name) AS BIGINT) AS files FROM allow LEFT JOIN catalog ON catalog.template = allow.template WHERE ok GROUP BY 1, 2""")
def _(spark, d):
    used = R.catalog(spark, d).groupBy("template").agg(F.count("*").alias("files"))
    return C.allowed_templates(spark).join(used, "template", "left").select("template", "source", F.coalesce("files", F.lit(0)).alias("files"))


@query("b11_quarantine_and_release", sql=f"""
WITH {R.CATALOG} SELECT name, CASE WHEN ends_with(template, '?') THEN template ELSE template || '?' END AS broken, CASE WHEN ends_with(template, '?') THEN SUBSTR(template, 1, LENGTH(template) - 1) ELSE template END AS released FROM catalog""")
def _(spark, d):
    return R.catalog(spark, d).select("name", C.quarantine("template").alias("broken"), C.release("template").alias("released"))


@query("b12_remove_quarantined", sql=f"""
WITH {R.CATALOG} SELECT source, CAST(COUNT(*) AS BIGINT) AS left_over FROM catalog WHERE NOT (ends_with(template, '?') AND source = 'EN') GROUP BY 1""")
def _(spark, d):
    c = R.catalog(spark, d)
    return C.remove(c, c.where("source = 'EN'")).groupBy("source").agg(F.count("*").alias("left_over"))


@query("b13_taken_names", sql=f"""
WITH {R.CATALOG} SELECT 'doc-' || CAST(vec_id AS VARCHAR) AS name FROM embeddings WHERE 'doc-' || CAST(vec_id AS VARCHAR) IN (SELECT name FROM catalog WHERE source = 'EN')""")
def _(spark, d):
    wanted = R.table(spark, d, "embeddings").select(F.concat(F.lit("doc-"), txt("vec_id")).alias("name"))
    return C.taken_names(wanted, R.catalog(spark, d).where("source = 'EN'"))
