"""Carrier queries for ordering, windows and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.operators import sequence as seq
from itemloom.sources import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order, line, quantity; one row a (order, line), as the table repeats some."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("long").alias("number"))
    return li.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("line"), "number")


LINES = "(SELECT l_orderkey AS job, CAST(l_linenumber AS BIGINT) AS line, CAST(min(l_quantity) AS BIGINT) AS number FROM lineitem GROUP BY ALL)"


def position_compaction(spark, sf_dir):
    """Positions 1..n after every second turn went."""
    c = table(spark, sf_dir, "conversations").filter("turn % 2 = 0").select("conv_id", "turn", "role")
    return seq.compact_positions(c, ["conv_id"], ["turn"])


def adjacent_swap(spark, sf_dir):
    """Turn 3 of every conversation moves up by one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return seq.swap_up(c, ["conv_id"], "turn", F.col("turn") == 3)


def prev_next_navigation(spark, sf_dir):
    return seq.neighbours(table(spark, sf_dir, "conversations").filter("role <> 'system'").select("conv_id", "turn"), ["conv_id"], "turn")


def latest_row_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return seq.latest(e, ["user_id"], ["event_id"], ["event_id", "event_type", "value"])


def version_chain(spark, sf_dir):
    """A customer's orders as versions."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return seq.version_chain(o, ["o_custkey"], "o_orderkey")


def sequence_anomalies(spark, sf_dir):
    return seq.anomalies(_lines(spark, sf_dir), ["job"], ["line"], "number")


def region_spans(spark, sf_dir):
    """Every slot from a line to the next, with the line it belongs to."""
    d = _lines(spark, sf_dir).withColumn("at", F.col("line") * 2)
    return seq.spans(d, ["job"], "at").select("job", "line", "slot")


def projection_islands(spark, sf_dir):
    """Runs of quiet hours by event type, the two longest (later first among equals) of each, in order of time."""
    e = table(spark, sf_dir, "events").select("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour"))
    quiet = e.groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("ink")).filter("ink < 3")
    runs = seq.islands(quiet, ["event_type"], "hour")
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("length"), F.desc("first")))
    top = runs.withColumn("r", rank).filter("r <= 2").drop("r")
    return seq.compact_positions(top, ["event_type"], ["first"], "no").select("event_type", "first", "last", "length", "no")


def running_budget(spark, sf_dir):
    """Characters up to each document of its source, and whether the budget still holds."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return seq.running_total(d, ["source"], "doc_id", "n_chars").select("source", "doc_id", "running_total", (F.col("running_total") <= 50_000).alias("within_budget"))


def contact_sheet_groups(spark, sf_dir):
    """Documents in sheets of four by number."""
    d = table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 4) * 4 + 1).alias("sheet"), "doc_id")
    return seq.ordered_list(d, ["sheet"], ["doc_id"], F.col("doc_id").cast("string"))


def fill_down_headings(spark, sf_dir):
    """Every fifth line of a document as a heading; lines know their heading and their number below it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    d = d.select("doc_id", F.col("line_no").cast("long").alias("line_no"))
    return seq.fill_down(d, ["doc_id"], "line_no", F.col("line_no") % 5 == 1)


def ordered_child_collect(spark, sf_dir):
    return seq.ordered_list(_lines(spark, sf_dir), ["job"], ["line"], F.concat_ws(":", "line", "number"))


def ordered_dedup(spark, sf_dir):
    """Each user's event types in order of first sight."""
    return seq.first_seen(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


def column_assignment(spark, sf_dir):
    """The first of three bands that a point lies in; points in none stay out."""
    bands = [(0, 900.0, 1100.0), (1, 1050.0, 1400.0), (2, 1300.0, 1600.0)]
    p = F.col("p_retailprice")
    inside = [F.when((p >= a) & (p < b) & (F.col("p_size") < 45), F.lit(k)) for k, a, b in bands]
    d = table(spark, sf_dir, "part").select("p_partkey", F.coalesce(*inside).cast("long").alias("column_index"), sum(F.when(x.isNotNull(), 1).otherwise(0) for x in inside).cast("long").alias("n_columns"))
    return d.filter("column_index IS NOT NULL")


QUERIES = {f.__name__: f for f in (position_compaction, adjacent_swap, prev_next_navigation, latest_row_per_key, version_chain, sequence_anomalies, region_spans, projection_islands, running_budget, contact_sheet_groups, fill_down_headings, ordered_child_collect, ordered_dedup, column_assignment)}
ORACLE_SQL = {
    "position_compaction": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations WHERE turn % 2 = 0",
    "adjacent_swap": """
WITH n AS (SELECT conv_id, turn, row_number() OVER w AS i, lead(turn = 3) OVER w AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN turn = 3 AND i > 1 THEN i - 1 WHEN f THEN i + 1 ELSE i END AS new_position FROM n""",
    "prev_next_navigation": """
SELECT conv_id, turn, lag(turn) OVER w AS previous_no, lead(turn) OVER w AS next_no FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "latest_row_per_key": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "version_chain": """
SELECT o_custkey, o_orderkey, row_number() OVER w AS version_no, lag(o_orderkey) OVER w AS previous_version,
  CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 'current' ELSE 'superseded' END AS version_status
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "sequence_anomalies": f"""
WITH b AS (SELECT *, lag(number) OVER (PARTITION BY job ORDER BY line) AS p, row_number() OVER (PARTITION BY job, number ORDER BY line) > 1 AS seen FROM {LINES})
SELECT job, line, number,
  CASE WHEN p IS NULL THEN '' ELSE concat_ws(',', CASE WHEN seen THEN 'duplicate' END, CASE WHEN number <= p THEN 'reverse' END, CASE WHEN number > p + 1 THEN 'gap' END) END AS warnings,
  CASE WHEN p IS NULL OR number > p + 1 THEN 'medium' WHEN seen OR number <= p THEN 'low' ELSE 'medium' END AS confidence FROM b""",
    "region_spans": f"""
WITH b AS (SELECT job, line, line * 2 AS a, coalesce(lead(line * 2) OVER (PARTITION BY job ORDER BY line) - 1, line * 2) AS z FROM {LINES})
SELECT job, line, unnest(generate_series(a, greatest(a, z))) AS slot FROM b""",
    "projection_islands": """
WITH q AS (SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour FROM events GROUP BY ALL HAVING count(*) < 3),
r AS (SELECT event_type, hour, hour - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS run FROM q),
i AS (SELECT event_type, min(hour) AS first, max(hour) AS last, count(*) AS length FROM r GROUP BY event_type, run),
t AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY length DESC, first DESC) <= 2)
SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first) AS no FROM t""",
    "running_budget": """
WITH r AS (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total FROM documents)
SELECT *, running_total <= 50000 AS within_budget FROM r""",
    "contact_sheet_groups": "SELECT doc_id // 4 * 4 + 1 AS sheet, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS items, count(*) AS n_items FROM documents GROUP BY ALL",
    "fill_down_headings": """
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
h AS (SELECT *, last_value(CASE WHEN line_no % 5 = 1 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading_no FROM l)
SELECT *, CASE WHEN line_no % 5 <> 1 AND heading_no IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, heading_no ORDER BY line_no) - 1 END AS child_no FROM h""",
    "ordered_child_collect": f"SELECT job, string_agg(line || ':' || number, ',' ORDER BY line) AS items, count(*) AS n_items FROM {LINES} GROUP BY job",
    "ordered_dedup": """
WITH f AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS rank FROM f""",
    "column_assignment": """
WITH p AS (SELECT p_partkey, p_size < 45 AND p_retailprice >= 900 AND p_retailprice < 1100 AS a, p_size < 45 AND p_retailprice >= 1050 AND p_retailprice < 1400 AS b,
  p_size < 45 AND p_retailprice >= 1300 AND p_retailprice < 1600 AS c FROM part)
SELECT p_partkey, CAST(CASE WHEN a THEN 0 WHEN b THEN 1 ELSE 2 END AS BIGINT) AS column_index, CAST(a::INT + b::INT + c::INT AS BIGINT) AS n_columns FROM p WHERE a OR b OR c""",
}
