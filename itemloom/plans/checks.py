"""Carrier queries for document validation and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.functions import strip
from itemloom.operators import constraints
from itemloom.operators.documents import strict_object
from itemloom.operators.layout import MAIN_NUMBER
from itemloom.sources import table


def main_number_extract(spark, sf_dir):
    """Main numbers of lines; lines get a number from their place, every third a decimal, which is none."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    n = F.col("k") + 1
    text = F.when(F.col("k") % 3 == 0, F.concat(n.cast("string"), F.lit(".5 "), "line")).when(F.col("k") % 3 == 1, F.concat(n.cast("string"), F.lit("、"), "line")).otherwise(F.concat(n.cast("string"), F.lit(". "), "line"))
    number = F.regexp_extract(text, MAIN_NUMBER, 1)
    return d.select("doc_id", F.col("k").cast("long").alias("line_no"), F.nullif(number, F.lit("")).alias("question_no"))


def strict_json_events(spark, sf_dir):
    """Exactly one JSON object with exactly the keys wanted and an integer value; anything behind it makes it invalid."""
    raw = F.when(F.col("event_id") % 9 == 0, F.concat("props", F.lit(" x"))).when(F.col("event_id") % 10 == 0, F.lit('{"k": true}')).when(F.col("event_id") % 11 == 0, F.lit('{"k": 1, "j": 2}')).otherwise(F.col("props"))
    return strict_object(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", {"k": "int"}).select("event_id", "valid", "reason")


def page_manifest_check(spark, sf_dir):
    """Row rules of a page manifest: one row for each broken rule."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html", (F.col("page_id") % 7).alias("left"), (F.col("page_id") % 5 + 3).alias("right"))
    rules = {
        "box_ordered": F.col("left") < F.col("right"), "path_safe": ~F.contains("url", F.lit("..")), "within_budget": F.char_length("html") <= 4000,
        "no_fragment": ~F.contains("url", F.lit("#")), "https": F.startswith("url", F.lit("https://")),
    }
    return constraints.violations(p, ["page_id"], rules)


def fk_violations(spark, sf_dir):
    """References that lead nowhere, after some keys were moved."""
    t = lambda n: table(spark, sf_dir, n)
    moved = lambda c: F.when(F.col(c) % 97 == 0, F.col(c) + 1_000_000_000).otherwise(F.col(c)).alias(c)
    rel = [
        ("orders.customer", t("orders").select(moved("o_custkey")), "o_custkey", t("customer"), "c_custkey"),
        ("lineitem.order", t("lineitem").select(moved("l_orderkey")), "l_orderkey", t("orders"), "o_orderkey"),
        ("lineitem.part", t("lineitem").select(moved("l_partkey")), "l_partkey", t("part"), "p_partkey"),
        ("nation.region", t("nation").select("n_regionkey"), "n_regionkey", t("region"), "r_regionkey"),
        ("labels.document", t("labels").select(moved("doc_id")), "doc_id", t("documents"), "doc_id"),
    ]
    return constraints.union_all([constraints.dangling(c, ck, p, pk, n) for n, c, ck, p, pk in rel])


def uniqueness_violations(spark, sf_dir):
    return constraints.repeated_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")), ["l_orderkey", "l_linenumber"])


def batch_set_equality(spark, sf_dir):
    """Whether the turns of a conversation are exactly 0..n-1, each once, as declared by its last turn."""
    c = table(spark, sf_dir, "conversations").filter("NOT (conv_id % 6 = 1 AND turn = 1)").select("conv_id", "turn")
    want = c.groupBy("conv_id").agg(F.max("turn").alias("m")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("turn"))
    return constraints.same_sets(c, want, ["conv_id"], "turn")


def stripped_names(spark, sf_dir):
    """White space at both ends goes, empty texts count as missing."""
    n = F.concat(F.lit(" \t"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_name")), F.lit(" \n"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.nullif(strip(n), F.lit("")).alias("name"))


QUERIES = {f.__name__: f for f in (main_number_extract, strict_json_events, page_manifest_check, fk_violations, uniqueness_violations, batch_set_equality, stripped_names)}
_MOVED = "CASE WHEN {0} % 97 = 0 THEN {0} + 1000000000 ELSE {0} END"


def _dangling(name: str, child: str, key: str, parent: str, parent_key: str, moved: bool = True) -> str:
    k = _MOVED.format(key) if moved else key
    return f"SELECT '{name}' AS relation, CAST(k AS BIGINT) AS missing, count(*) AS n FROM (SELECT {k} AS k FROM {child}) WHERE k IS NOT NULL AND k NOT IN (SELECT {parent_key} FROM {parent}) GROUP BY k"


ORACLE_SQL = {
    "main_number_extract": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents),
t AS (SELECT doc_id, k, CASE k % 3 WHEN 0 THEN (k + 1) || '.5 ' || line WHEN 1 THEN (k + 1) || '、' || line ELSE (k + 1) || '. ' || line END AS t FROM l)
SELECT doc_id, k AS line_no, nullif(regexp_extract(t, '^([1-9][0-9]{0,2})(?:[.．、]|题)(?:[^0-9]|$)', 1), '') AS question_no FROM t""",
    "strict_json_events": """
WITH r AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN props || ' x' WHEN event_id % 10 = 0 THEN '{"k": true}' WHEN event_id % 11 = 0 THEN '{"k": 1, "j": 2}' ELSE props END AS raw FROM events),
j AS (SELECT *, CASE WHEN NOT json_valid(raw) THEN 'not_json' WHEN list_sort(json_keys(CASE WHEN json_valid(raw) THEN raw ELSE '{}' END)) <> ['k'] THEN 'keys'
  WHEN json_type(CASE WHEN json_valid(raw) THEN raw ELSE '{}' END, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'type:k' END AS reason FROM r)
SELECT event_id, reason IS NULL AS valid, reason FROM j""",
    "page_manifest_check": """
WITH p AS (SELECT page_id, url, html, page_id % 7 < page_id % 5 + 3 AS a FROM pages),
r AS (SELECT page_id, unnest([CASE WHEN NOT a THEN 'box_ordered' END, CASE WHEN contains(url, '..') THEN 'path_safe' END, CASE WHEN length(html) > 4000 THEN 'within_budget' END,
  CASE WHEN contains(url, '#') THEN 'no_fragment' END, CASE WHEN NOT starts_with(url, 'https://') THEN 'https' END]) AS rule FROM p)
SELECT * FROM r WHERE rule IS NOT NULL""",
    "fk_violations": " UNION ALL ".join([_dangling("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), _dangling("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey"), _dangling("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey"), _dangling("nation.region", "nation", "n_regionkey", "region", "r_regionkey", False), _dangling("labels.document", "labels", "doc_id", "documents", "doc_id")]),
    "uniqueness_violations": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "batch_set_equality": """
WITH c AS (SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 6 = 1 AND turn = 1))
SELECT conv_id, count(*) = max(turn) + 1 AND count(DISTINCT turn) = count(*) AND min(turn) = 0 AS equal FROM c GROUP BY conv_id""",
    "stripped_names": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer",
}
