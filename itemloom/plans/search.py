"""Carrier queries for faceted search on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions import contains_literal
from itemloom.operators.sequence import compact_positions, ordered_list
from itemloom.operators.writes import soft_delete
from itemloom.sources import table


def faceted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items (parts) of one facet, found by their own code or by a related one, with the names of their source."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    code = "Brand#13"
    related = line.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).select(F.col("l_partkey").alias("p_partkey"))
    own = part.filter(F.col("p_brand") == code).select("p_partkey")
    hit = own.union(related).distinct()
    return (
        part.join(hit, "p_partkey", "left_semi")
        .filter(F.col("p_retailprice").isNotNull())
        .select("p_partkey", "p_name", "p_type", (F.col("p_size") > 25).alias("has_figure"), (F.col("p_brand") == code).alias("is_primary"))
    )


QUERIES = {"faceted_listing": faceted_listing}
ORACLE_SQL = {
    "faceted_listing": """
SELECT p_partkey, p_name, p_type, p_size > 25 AS has_figure, p_brand = 'Brand#13' AS is_primary FROM part p
WHERE p_retailprice IS NOT NULL AND (p_brand = 'Brand#13' OR EXISTS (
  SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_returnflag = 'R' AND l_quantity >= 49))""",
}


def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet values (nations) that a live source or a live reader uses."""
    used = (
        table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
        .union(table(spark, sf_dir, "customer").filter("c_acctbal > 9990").select("c_nationkey"))
    )
    return table(spark, sf_dir, "nation").join(used, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


def escaped_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a text with wildcard characters, taken literally, A-Z as a-z."""
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).filter(contains_literal(F.col("name"), "D_W"))


def soft_delete_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not soft-deleted; those labelled toxic are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    gone = table(spark, sf_dir, "labels").filter("toxic = 1")
    return soft_delete(docs, ["doc_id"], gone, "2024-01-01T00:00:00Z").filter("deleted_at IS NULL").drop("deleted_at")


def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counters, each from its own aggregate."""
    n = lambda t, c, name: table(spark, sf_dir, t).agg(F.count_if(c).alias(name))
    one = n("documents", F.lit(True), "papers")
    for t, c, name in (("orders", F.lit(True), "jobs"), ("orders", F.col("o_orderstatus") == "P", "needs_review"), ("labels", F.col("toxic") == 0, "live"), ("conversations", F.col("turn") == 0, "baskets")):
        one = one.crossJoin(n(t, c, name))  # one row each
    return one


def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a Markdown text, turns renumbered from 1, with its digest."""
    c = compact_positions(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "no")
    t = ordered_list(c, ["conv_id"], ["no"], F.concat(F.lit("## "), F.col("no").cast("string"), F.lit(". "), F.col("role"), F.lit("\n\n"), F.col("text"), F.lit("\n")), "\n")
    return t.select("conv_id", F.sha2("items", 256).alias("output_sha256"), F.char_length("items").cast("long").alias("output_chars"), F.col("n_items").alias("n_sections"))


def distinct_union_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct union of two nullable columns."""
    a = table(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") != 3, F.col("s_name")).alias("path"))
    b = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("path"))
    return a.union(b).filter("path IS NOT NULL").distinct()


def taxonomy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels with codes and their parents' codes by self-join."""
    two = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    r, na, cu = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    l1 = r.select(two(F.col("r_regionkey")).alias("code"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(1).alias("level"))
    region_of = na.select(F.col("n_nationkey").alias("k"), two(F.col("n_regionkey")).alias("rc"))
    l2 = na.select(F.concat(two(F.col("n_regionkey")), F.lit("."), two(F.col("n_nationkey"))).alias("code"), two(F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"), F.lit(2).alias("level"))
    own = F.concat(F.col("rc"), F.lit("."), two(F.col("c_nationkey")))
    l3 = cu.join(region_of, F.col("c_nationkey") == F.col("k")).select(F.concat(own, F.lit("."), F.format_string("%06d", "c_custkey")).alias("code"), own.alias("parent"), F.col("c_name").alias("name"), F.lit(3).alias("level"))
    tree = l1.unionByName(l2).unionByName(l3)
    up = tree.filter("level < 3").select(F.col("code").alias("parent"), F.col("name").alias("parent_name"))
    return tree.join(up, "parent", "left").select("code", "name", F.col("level").cast("long").alias("level"), F.col("parent").alias("parent_code"), "parent_name")


def subtree_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered children of each parent as one text."""
    n = table(spark, sf_dir, "nation")
    got = ordered_list(n, ["n_regionkey"], ["n_name"], F.col("n_name"))
    return got.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "items", "n_items")


QUERIES |= {f.__name__: f for f in (facet_values, escaped_substring_search, soft_delete_listing, dashboard_counts, markdown_export, distinct_union_paths, taxonomy_tree, subtree_candidates)}
ORACLE_SQL |= {
    "facet_values": """
SELECT n_nationkey, n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n.n_nationkey AND s_acctbal > 9000)
  OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n.n_nationkey AND c_acctbal > 9990)""",
    "escaped_substring_search": r"""
SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part
WHERE lower(replace(p_name, ' ', '_')) LIKE '%d\_w%' ESCAPE '\'""",
    "soft_delete_listing": "SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)",
    "dashboard_counts": """
SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS needs_review,
  (SELECT count(*) FROM labels WHERE toxic = 0) AS live, (SELECT count(*) FROM conversations WHERE turn = 0) AS baskets""",
    "markdown_export": """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations),
t AS (SELECT conv_id, string_agg('## ' || no || '. ' || role || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY no) AS md, count(*) AS n_sections FROM n GROUP BY conv_id)
SELECT conv_id, sha256(md) AS output_sha256, length(md) AS output_chars, n_sections FROM t""",
    "distinct_union_paths": """
SELECT s_name AS path FROM supplier WHERE s_nationkey <> 3 AND s_name IS NOT NULL UNION SELECT c_name FROM customer WHERE c_nationkey <> 3 AND c_name IS NOT NULL""",
    "taxonomy_tree": """
WITH t AS (
  SELECT lpad(r_regionkey::VARCHAR, 2, '0') AS code, NULL AS parent, r_name AS name, 1 AS level FROM region
  UNION ALL SELECT lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 2, '0'), lpad(n_regionkey::VARCHAR, 2, '0'), n_name, 2 FROM nation
  UNION ALL SELECT lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 2, '0') || '.' || lpad(c_custkey::VARCHAR, 6, '0'),
    lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 2, '0'), c_name, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT t.code, t.name, CAST(t.level AS BIGINT) AS level, t.parent AS parent_code, p.name AS parent_name FROM t LEFT JOIN t p ON p.code = t.parent AND p.level < 3""",
    "subtree_candidates": """
SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS items, count(*) AS n_items FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
}
