"""Carrier queries for stores and files, table rules, boards, runners and text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.functions import display_name, is_question_number, labelled, pixel_box, safe_path, zoned_time
from itemloom.operators import batches, constraints, documents, layout, review, runners, stages, taxonomy
from itemloom.plans.admissions import _D, _docs, _flag, _k, _pick
from itemloom.plans.papers import _reasons, _texts
from itemloom.sources import generations, table, work_folder

NOW = "2024-01-30 12:00:00"


def generation_roundtrip(spark, sf_dir):
    """Two generations of a store: a table replaced, another kept, a rejected and a stale writer without effect."""
    root = work_folder(spark, "store")
    assert generations.current(spark, root) is None and generations.read(spark, root, "nation") is None
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    first = generations.publish(spark, root, {"nation": nation, "region": region})
    refs = lambda t: constraints.dangling(t["nation"], "n_regionkey", t["region"], "r_regionkey", "region")
    refs.__name__ = "references"
    generations.publish(spark, root, {"nation": nation.filter("n_nationkey % 2 = 0")}, expected=first["number"], checks=[refs])
    for tables, expected, error in (({"nation": nation.withColumn("n_regionkey", F.lit(99))}, 2, generations.Rejected), ({"nation": nation}, first["number"], generations.Conflict)):
        try:
            generations.publish(spark, root, tables, expected=expected, checks=[refs])
            raise AssertionError("published")
        except error:
            pass
    n = generations.read(spark, root, "nation")
    return n.join(generations.read(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def artifact_scan(spark, sf_dir):
    """Files of JSON documents: digest, size cap, parsing that turns damaged texts to null, and what changed since."""
    folder = work_folder(spark, "files")
    k = F.col("s_suppkey")
    text = F.concat(F.lit('{"name": "'), "s_name", F.lit('"}'), F.when(k % 3 == 0, " more").when(k % 5 == 0, F.repeat(F.lit(" "), 200)).otherwise(""))
    d = table(spark, sf_dir, "supplier").filter("s_suppkey <= 12").select("s_suppkey", text.alias("value"))
    d.write.partitionBy("s_suppkey").text(f"{folder}/a")
    d.withColumn("value", F.when(k % 4 == 0, "{}").otherwise(F.col("value"))).filter("s_suppkey <> 7").write.partitionBy("s_suppkey").text(f"{folder}/b")
    known = lambda df: df.withColumn("path", F.regexp_extract("path", "s_suppkey=([0-9]+)", 1))
    a, b = known(generations.artifacts(spark, f"{folder}/a", 200)), known(generations.artifacts(spark, f"{folder}/b", 200))
    changed = generations.changed_artifacts(a, b).withColumn("changed", F.lit(True))
    d = a.join(generations.documents(a, "name string"), "path").join(changed, "path", "left")
    return d.select(F.col("path").cast("long").alias("s_suppkey"), "length", "sha256", F.col("document.name").alias("name"), F.col("changed").isNotNull().alias("changed"))


def paper_intake(spark, sf_dir):
    """Incoming PDF files: bad headers, repeats, files known by their digest, and archive paths of new ones."""
    folder = work_folder(spark, "papers")
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 5 == 0, "%PDX-").otherwise("%PDF-"), (k % 7).cast("string"))
    table(spark, sf_dir, "supplier").filter("s_suppkey <= 10").select("s_suppkey", text.alias("value")).write.partitionBy("s_suppkey").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("long").alias("k"), "path", "content")
    jvm, names = spark.sparkContext._jvm, {}
    for r in files.select("k", "path").collect():  # ten files
        p = jvm.org.apache.hadoop.fs.Path(r["path"])
        to = jvm.org.apache.hadoop.fs.Path(f"{folder}/in/{r['k']:03d}.{'PDF' if r['k'] % 2 else 'txt' if r['k'] == 8 else 'pdf'}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(to.getParent())
        names[r["k"]] = fs.rename(p, to)
    known = spark.range(1).select(F.sha2(F.lit("%PDF-3\n"), 256).alias("sha256"))
    d = generations.intake(spark, f"{folder}/in", known, "TJ", 2025, "YK")
    return d.select(F.regexp_extract("path", r"([0-9]+)\.\w+$", 1).cast("long").alias("s_suppkey"), "outcome", "archive_path")


def seed_roundtrip(spark, sf_dir):
    """A dictionary as the JSON text of a seed file, read again."""
    text = generations.seed_text(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey")
    return generations.seed_rows(text, "n_nationkey int, n_name string, n_regionkey int")


def backup_check(spark, sf_dir):
    """Faults of a backup: a changed table, one that is missing, a reference that leads nowhere."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "supplier", "part")}
    copy = {"region": t["region"], "nation": t["nation"].filter("n_nationkey <> 3"), "supplier": t["supplier"]}
    return generations.backup_faults(t, copy, [("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")])


def _runs(spark, sf_dir):
    k = F.col("o_orderkey")
    sha = lambda n: F.when(k % n != 0, F.sha2(k.cast("string"), 256))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", status.alias("status"), sha(7).alias("source_manifest_sha256"), F.when(k % 13 == 0, "short").otherwise(sha(11)).alias("output_manifest_sha256"), F.when(k % 17 != 0, "t").alias("completed_at"), (k % 19).alias("processed_pages"), F.when(k % 5 == 0, k % 19 + 1).otherwise(k % 19).alias("total_pages"),
        F.when(k % 3 == 0, k % 9).alias("page_start"), F.when(k % 4 != 1, k % 7).alias("page_end"), F.when(k % 6 != 0, F.sha2(F.lit("t"), 256)).alias("claim_token"), F.when(k % 23 != 0, "l").alias("lease_expires_at"), F.when(k % 2 == 0, "completed").otherwise("applying").alias("stage"),
    )


def table_rule_breaks(spark, sf_dir):
    """Rows that break the CHECK rules of three tables."""
    d = _runs(spark, sf_dir)
    out = None
    for name in ("import_layout_analysis_runs", "import_jobs", "import_web_admission_runs"):
        one = constraints.violations(d, ["o_orderkey"], constraints.table_rules(name)).select("o_orderkey", F.lit(name).alias("table"), "rule")
        out = one if out is None else out.unionByName(one)
    return out


def bank_rule_breaks(spark, sf_dir):
    """Rows that break the CHECK rules of questions, re-audits and classification drafts."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(
        k, F.when(k % 2 == 0, "missing").otherwise("given").alias("answer_status"), F.when(k % 6 < 3, "x").alias("answer_markdown"), F.when(k % 3 == 0, "usable").otherwise("draft").alias("usability_status"), F.lit("passed").alias("text_review_status"),
        F.when(k % 5 == 0, None).otherwise("passed").alias("figure_review_status"), F.when(k % 7 == 0, "pending").otherwise("passed").alias("answer_review_status"), F.when(k % 8 == 0, "t").alias("deleted_at"), F.when(k % 16 < 10, "r").alias("deletion_reason"), F.lit(None).cast("string").alias("deletion_note"),
        F.when(k % 4 == 0, "completed").when(k % 4 == 1, "approved").otherwise("pending").alias("status"), F.when(k % 9 == 0, "passed").alias("decision"), (k % 5).alias("reviewed_draft_version"), F.when(k % 11 != 0, k % 5 + 1).otherwise(9).alias("approved_draft_version"),
        F.when(k % 4 == 1, "human").alias("approval_source"), F.when(k % 13 != 0, "t").alias("reviewed_at"),
    )
    out = None
    for name in ("questions", "corrected_draft_reaudits", "candidate_knowledge_classification_drafts"):
        one = constraints.violations(d, ["p_partkey"], constraints.table_rules(name)).select("p_partkey", F.lit(name).alias("table"), "rule")
        out = one if out is None else out.unionByName(one)
    return out


def runs_without_job(spark, sf_dir):
    """Completed runs of jobs that are not completed."""
    o = table(spark, sf_dir, "orders")
    runs = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "completed").otherwise("processing").alias("status"))
    jobs = o.filter("o_orderkey % 9 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    return constraints.runs_without_job(runs, jobs, "o_orderkey").select("o_orderkey")


def _board(spark, sf_dir):
    """Orders as jobs with a run of each of six stages, some missing."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    jobs = o.select("o_orderkey", F.when(k % 4 == 0, "needs_review").when(k % 4 == 1, "completed").otherwise("pending").alias("job_status"))
    runs = {}
    for n, stage in enumerate(stages.STAGES):
        m = 3 + n
        runs[stage] = o.filter(k % (m + 4) != 0).select("o_orderkey", F.when(k % m == 0, "processing").when(k % m == 1, "failed").otherwise("completed").alias("status"), F.when(k % (m + 8) != 0, F.lit(stage)).alias("output_sha256"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return stages.stage_board(jobs, runs, "o_orderkey", {"crops": lines})


def six_stage_board(spark, sf_dir):
    return _board(spark, sf_dir).select("o_orderkey", "job_status", *[f"{s}_status" for s in stages.STAGES], "n_crops")


def claimable_stages(spark, sf_dir):
    """Which stages of which jobs may be claimed."""
    return _board(spark, sf_dir).select("o_orderkey", *[stages.claimable(s).alias(s) for s in stages.STAGES])


def retryable_jobs(spark, sf_dir):
    """Jobs with a receipt whose automatic work broke off."""
    receipts = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey")
    return stages.retryable(receipts, _board(spark, sf_dir), "o_orderkey")


def review_summaries(spark, sf_dir):
    """Counts of a review by source, without what was deleted; and rows of one audit status."""
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    rows = d.select("source", _flag(7).alias("deleted"), _pick(["high", "high", "medium"], 4).alias("confidence"), F.when(~_flag(5), _flag(3)).alias("figure_required"), F.when(_flag(11), _texts("look")).when(_flag(13), None).otherwise(_texts()).alias("hints"), _pick(["auto_pass", "human_required"], 3).alias("audit_status"))
    count = lambda s, n: stages.with_status(rows, s).groupBy("source").agg(F.count(F.lit(1)).alias(n))
    out = stages.review_summary(rows, ["source"])
    for s, n in ((None, "n_default"), ("auto_pass", "n_auto"), ("all", "n_all")):
        one = count(s, n).withColumnRenamed("source", "_s")
        out = out.join(one, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn(n, F.coalesce(n, F.lit(0)).cast("long"))
    return out


def candidate_numbers(spark, sf_dir):
    """Number sets of jobs, whole only if every number is canonical and none repeats."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL")
    t = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), "01").when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "1").otherwise((F.col("turn") + 1).cast("string"))
    d = stages.batch_numbers(c.select("conv_id", "turn").distinct().select("conv_id", t.alias("no")), "conv_id", "no")
    return d.select("conv_id", F.array_join("numbers", ",").alias("numbers"), "whole")


def knowledge_choices(spark, sf_dir):
    """Evidence over a draft's codes, related codes without the primary, and what a review does."""
    active = _texts("a", "b", "c")
    draft = F.when(_flag(2), _texts("a", "x")).otherwise(_texts("a", "b"))
    code = stages.knowledge_overlay(draft, F.when(~_flag(3), _texts("c")), active)
    rel = stages.related_codes(F.lit("b"), F.when(_flag(5), _texts("b", "c", "c", "b")).otherwise(_texts("c", "a")))
    act = stages.classification_review(F.when(~_flag(7), "a"), _pick(["a", "b", "x"], 4), active)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(code, ",").alias("codes"), F.array_join(rel, ",").alias("related"), act.alias("review"))


def text_forms(spark, sf_dir):
    """Labels, display names, canonical numbers, zoned times and safe paths."""
    names = {"pending": "Waiting", "completed": "Done"}
    stamp = _pick(["2024-01-30T12:04:00Z", "2024-01-30T12:06:00+00:00", "2024-01-30T12:00:00", "x", "2024-01-30T13:00:00+01:00"], 6)
    number = _pick(["1", "01", "999", "1000", "１"], 6)
    path = _pick(["a/b.png", "../b.png", "a/../b.png", "/a.png", "a\\b.png", "a.jpg", ".png", "a..b.png"], 9)
    return _docs(spark, sf_dir).select(
        "doc_id", labelled(_pick(["（1）", ""], 3), _pick(["stem", " ", ""], 4)).alias("labelled"), display_name(_pick(["pending", "completed", "odd"], 4), names).alias("name"), F.coalesce(is_question_number(number), F.lit(False)).alias("number"),
        zoned_time(stamp, NOW).alias("in_time"), safe_path(path).alias("safe"), F.format_string("page_%03d.png", _k() % 1200).alias("page"), F.coalesce(_pick(["2024"], 2), F.lit("year unknown")).alias("year"),
    )


def figure_boxes(spark, sf_dir):
    """Normalised boxes in pixels, with a margin kept on the page, and faults of boxes."""
    k = F.col("p_partkey")
    box = pixel_box(F.array(k % 10 / F.lit(16.0), k % 7 / F.lit(8.0), (k % 10 + 2) / F.lit(8.0), (k % 7 + 1) / F.lit(8.0)), 1000, 800)
    d = table(spark, sf_dir, "part").select("p_partkey", box.alias("box")).withColumn("wide", layout.with_margin(F.col("box"), F.lit(1000), F.lit(800), 20))
    odd = F.struct((k % 5).alias("l"), F.lit(0).alias("t"), (k % 7).alias("r"), (k % 11).alias("b"))
    cols = [F.col(f"{b}.{c}").cast("long").alias(f"{b}_{c}") for b in ("box", "wide") for c in "ltrb"]
    return d.select("p_partkey", *cols, layout.box_fault(odd, F.lit(5), F.lit(9)).alias("fault"))


def asset_registrations(spark, sf_dir):
    """Assets registered again by identity: the same, changed, their path taken, or new."""
    k = F.col("p_partkey")
    row = lambda path, sha: [k, F.lit("figure").alias("kind"), path.alias("path"), sha.alias("sha256")]
    p = table(spark, sf_dir, "part")
    known = p.filter("p_partkey % 3 <> 0").select(*row(F.concat(F.lit("p"), k.cast("string")), F.lit("a")))
    new = p.select(*row(F.when(k % 6 == 0, F.concat(F.lit("p"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("p"), k.cast("string"))), F.when(k % 5 == 0, None).otherwise("a")))
    return layout.register_assets(known, new, ["p_partkey", "kind"], "path", ["sha256"]).select("p_partkey", "outcome")


class _Marks(runners.RecordedRunner):
    """Answers with the stage and the prompt's length; some prompts fail."""

    def run(self, stage: str, prompt: str) -> str:
        if prompt.endswith("7"):
            raise TimeoutError
        return f"{stage}:{len(prompt)}"


def runner_answers(spark, sf_dir):
    """Prompts of four stages to runners, failures as rows, recorded answers, and run ids."""
    d = table(spark, sf_dir, "nation").select("n_nationkey", runners.prompt("Split the pages.", pages=F.col("n_nationkey"), note=F.lit(None), name=F.col("n_nationkey")).alias("prompt"))
    recorded = d.filter("n_nationkey % 2 = 0").select("n_nationkey", F.sha2(F.when(F.col("n_nationkey") == 4, F.lit("old")).otherwise(F.col("prompt")), 256).alias("prompt_sha256"), F.lit("kept").alias("answer"))
    out = None
    for stage in ("split", "transcribe", "audit", "proposal"):
        one = runners.run_stage(d, _Marks({}), stage).withColumn("stage", F.lit(stage))
        out = one if out is None else out.unionByName(one)
    out = runners.recorded_answers(out.withColumnRenamed("answer", "said"), recorded, ["n_nationkey"])
    return out.select("n_nationkey", "stage", "said", F.col("answer_error").alias("error"), F.col("answer").alias("recorded"), runners.run_id("run", F.col("stage"), F.col("prompt")).alias("run_id"))


def audit_head_check(spark, sf_dir):
    """What an audit says of itself, against its questions."""
    k = F.col("job_id")
    q = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").cast("string").alias("source_question_no"), F.array((F.col("o_custkey") % 3 + 1).cast("int")).alias("source_pages"))
    h = q.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min("source_question_no").alias("first")).select(
        "job_id", F.when(k % 5 == 0, "me").otherwise(batches.AUDITOR).alias("auditor"), F.lit(batches.AUDIT_KIND).alias("scope_kind"), F.array(F.when(k % 7 == 0, 9).otherwise(k % 3 + 1).cast("int")).alias("scope_pages"), (F.col("n") + (k % 11 == 0).cast("int")).alias("question_count"),
        F.when(k % 13 == 0, _texts("none")).otherwise(F.array("first")).alias("sample_nos"), F.when(k % 17 == 0, " ").otherwise("chance").alias("sample_reason"), F.when(k % 19 == 0, _texts("")).otherwise(_texts("fine")).alias("global_findings"), F.when(k % 23 == 0, _texts("reviewed")).otherwise(_texts("not_reviewed")).alias("knowledge_checks"),
    )
    return batches.audit_heads(h, q, "job_id").select("job_id", F.array_join("reasons", ",").alias("reasons"))


def page_boxes(spark, sf_dir):
    """Columns of pages checked against their sizes and each other: order, overlap, bounds."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select((k % 50).alias("page"), k.alias("column_index"), (k * 7 % 90).alias("l"), F.lit(0).cast("long").alias("t"), (k * 7 % 90 + k % 13).alias("r"), F.lit(50).cast("long").alias("b"))
    return layout.column_faults(c, spark.range(50).select(F.col("id").alias("page"), F.lit(95).cast("long").alias("width"), F.lit(50).cast("long").alias("height")), ["page"])


def region_faults(spark, sf_dir):
    """Pages with two anchors, at one height on every third, and with one beside its columns on others."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    long = lambda x: F.lit(x).cast("long")
    cols = c.select("conv_id", "turn", long(0).alias("column_index"), long(0).alias("l"), long(5).alias("t"), long(500).alias("r"), long(900).alias("b"))
    found = None
    for n, (column, y) in enumerate(((0, long(10)), (0, F.when(F.col("turn") % 3 == 0, 10).otherwise(500).cast("long")), (5, long(20)))):
        one = (c.filter("turn % 4 = 1") if column else c).select("conv_id", "turn", long(column).alias("column_index"), long(n).alias("x"), y.alias("y"), (F.col("turn") * 3 + n + 1).cast("string").alias("question_no"))
        found = one if found is None else found.unionByName(one)
    return layout.region_faults(found, cols, ["conv_id"], "turn", 11)


def strict_rows(spark, sf_dir):
    """Objects with typed fields (numbers, truth values, lists), one value and nothing behind it."""
    text = F.concat(F.lit('{"a": '), _pick(["1", "1.5", "true", '"x"', "1e400", "NaN"], 7), F.lit(', "b": '), _pick(["[]", "{}", "null"], 5), F.lit("}"), F.when(_flag(11), " x").otherwise(""))
    d = documents.strict_object(_docs(spark, sf_dir).select("doc_id", text.alias("text")), "text", {"a": "float", "b": "list"})
    return d.select("doc_id", "reason", "valid", review.first_rule([(F.col("reason").isNull(), "take"), (F.col("reason") == "missing", "ask")], "refuse").alias("action"))


def topic_scopes(spark, sf_dir):
    """Points of each chosen topic."""
    points = table(spark, sf_dir, "nation").select(F.format_string("%02d", F.col("n_nationkey")).alias("code"), F.col("n_regionkey").cast("string").alias("parent_code"))
    return taxonomy.allowed_codes(points).select("parent_code", F.array_join("allowed", ",").alias("allowed"))


_FNS = (
    generation_roundtrip, artifact_scan, paper_intake, seed_roundtrip, backup_check, table_rule_breaks, bank_rule_breaks, runs_without_job, six_stage_board, claimable_stages, retryable_jobs, review_summaries, candidate_numbers,
    knowledge_choices, text_forms, figure_boxes, asset_registrations, runner_answers, audit_head_check, page_boxes, region_faults, strict_rows, topic_scopes,
)
QUERIES = {f.__name__: f for f in _FNS}


def _status(n: int) -> str:
    m = 3 + n
    return f"CASE WHEN k % {m + 4} = 0 THEN NULL WHEN k % {m} = 0 THEN 'processing' WHEN k % {m} = 1 THEN 'failed' ELSE 'completed' END"


_BOARD = f"""b AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'completed' ELSE 'pending' END AS job_status FROM orders),
s AS (SELECT *, {", ".join(f"{_status(n)} AS {x}_status" for n, x in enumerate(stages.STAGES))} FROM b)"""
_BEFORE = {"layout": 0, "split": 0, "candidates": 2, "audit": 3, "admission": 4}
_CLAIM = {x: f"coalesce({x}_status, '') NOT IN ('processing', 'completed') AND job_status <> 'completed'" + (f" AND coalesce({stages.STAGES[_BEFORE[x]]}_status, '') = 'completed' AND k % {3 + _BEFORE[x] + 8} <> 0" if x in _BEFORE else "") for x in stages.STAGES}
_PROMPT = "concat('Split the pages.', chr(10), 'pages: ', k, chr(10), 'note: ', chr(10), 'name: ', k)"
ORACLE_SQL = {
    "generation_roundtrip": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0",
    "artifact_scan": """
WITH d AS (SELECT s_suppkey AS k, s_name, concat('{"name": "', s_name, '"}', CASE WHEN s_suppkey % 3 = 0 THEN ' more' WHEN s_suppkey % 5 = 0 THEN repeat(' ', 200) ELSE '' END, chr(10)) AS t FROM supplier WHERE s_suppkey <= 12)
SELECT k AS s_suppkey, strlen(t) AS length, CASE WHEN strlen(t) <= 200 THEN sha256(t) END AS sha256, CASE WHEN strlen(t) <= 200 AND k % 3 <> 0 THEN s_name END AS name, k % 4 = 0 OR k = 7 OR strlen(t) > 200 AS changed FROM d""",
    "paper_intake": """
WITH d AS (SELECT s_suppkey AS k, sha256(concat(CASE WHEN s_suppkey % 5 = 0 THEN '%PDX-' ELSE '%PDF-' END, s_suppkey % 7, chr(10))) AS h FROM supplier WHERE s_suppkey <= 10),
o AS (SELECT *, CASE WHEN k = 8 THEN 'bad_name' WHEN k % 5 = 0 THEN 'bad_header' WHEN k % 7 = 3 THEN 'known' WHEN k <> min(k) OVER (PARTITION BY h) THEN 'repeated' ELSE 'new' END AS outcome FROM d)
SELECT k AS s_suppkey, outcome, CASE WHEN outcome = 'new' THEN 'raw_papers/TJ/2025/2025-TJ-YK-' || substr(h, 1, 12) || '.pdf' END AS archive_path FROM o""",
    "seed_roundtrip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "backup_check": """
SELECT 'nation' AS "table", 'rows' AS fault FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'part', 'missing' UNION ALL SELECT 'supplier', 'reference:s_nationkey' WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = 3)""",
    "table_rule_breaks": """
WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 END AS a, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey % 7 END AS b FROM orders)
SELECT k AS o_orderkey, 'import_layout_analysis_runs' AS "table", 'completed' AS rule FROM r WHERE s = 'F' AND (k % 7 = 0 OR (k % 11 = 0 AND k % 13 <> 0) OR k % 17 = 0 OR k % 5 = 0)
UNION ALL SELECT k, 'import_layout_analysis_runs', 'digest' FROM r WHERE k % 13 = 0
UNION ALL SELECT k, 'import_jobs', 'page_range' FROM r WHERE (a IS NULL) <> (b IS NULL) UNION ALL SELECT k, 'import_jobs', 'page_order' FROM r WHERE NOT (a IS NULL OR (a >= 1 AND a <= b))
UNION ALL SELECT k, 'import_web_admission_runs', 'claim' FROM r WHERE (s = 'O') <> (k % 6 <> 0 AND k % 23 <> 0)
UNION ALL SELECT k, 'import_web_admission_runs', 'completed' FROM r WHERE s = 'F' AND NOT (k % 2 = 0 AND k % 17 <> 0)""",
    "bank_rule_breaks": """
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS p_partkey, 'questions' AS "table", 'answer' AS rule FROM p WHERE (k % 2 = 0) <> (k % 6 >= 3) UNION ALL SELECT k, 'questions', 'usable' FROM p WHERE k % 3 = 0 AND (k % 5 = 0 OR k % 7 = 0)
UNION ALL SELECT k, 'questions', 'deletion' FROM p WHERE NOT ((k % 8 <> 0 AND k % 16 >= 10) OR k % 16 < 10)
UNION ALL SELECT k, 'corrected_draft_reaudits', 'decision' FROM p WHERE (k % 4 = 0) <> (k % 9 = 0) UNION ALL SELECT k, 'corrected_draft_reaudits', 'version' FROM p WHERE k % 11 = 0
UNION ALL SELECT k, 'candidate_knowledge_classification_drafts', 'approval' FROM p WHERE k % 4 = 1 AND k % 13 = 0""",
    "runs_without_job": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND NOT (o_orderkey % 9 <> 0 AND o_orderstatus = 'F')",
    "six_stage_board": f"WITH {_BOARD}, l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT k AS o_orderkey, job_status, {', '.join(f'{x}_status' for x in stages.STAGES)}, coalesce(n, 0) AS n_crops FROM s LEFT JOIN l ON l_orderkey = k",
    "claimable_stages": f"WITH {_BOARD} SELECT k AS o_orderkey, {', '.join(f'{c} AS {x}' for x, c in _CLAIM.items())} FROM s",
    "retryable_jobs": f"WITH {_BOARD} SELECT k AS o_orderkey FROM s WHERE k % 3 <> 0 AND job_status = 'pending' AND coalesce(split_status, 'pending') IN ('pending', 'processing') AND coalesce(render_status, 'processing') IN ('processing', 'completed')",
    "review_summaries": """
WITH d AS (SELECT source, doc_id AS k FROM documents WHERE doc_id IS NOT NULL)
SELECT source, count(*) AS total, count(*) FILTER (WHERE k % 7 = 0) AS n_deleted, count(*) FILTER (WHERE k % 7 <> 0 AND k % 4 < 2) AS n_high, count(*) FILTER (WHERE k % 7 <> 0 AND k % 4 = 2) AS n_medium, count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 <> 0 AND k % 3 = 0) AS n_figures,
  count(*) FILTER (WHERE k % 7 <> 0 AND k % 11 = 0) AS n_focus, count(*) FILTER (WHERE k % 3 = 1) AS n_default, count(*) FILTER (WHERE k % 3 = 0) AS n_auto, count(*) AS n_all FROM d GROUP BY source""",
    "candidate_numbers": """
WITH c AS (SELECT DISTINCT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN '01' WHEN conv_id % 7 = 0 AND turn = 1 THEN '1' ELSE (turn + 1)::VARCHAR END AS no FROM conversations WHERE conv_id IS NOT NULL)
SELECT conv_id, (SELECT string_agg(no, ',' ORDER BY no) FROM (SELECT DISTINCT conv_id, no FROM c) x WHERE x.conv_id = c.conv_id) AS numbers, bool_and(no <> '01') AND count(*) = count(DISTINCT no) AS whole FROM c GROUP BY conv_id""",
    "knowledge_choices": f"""
SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'a,b' WHEN doc_id % 3 = 0 THEN 'a,x' ELSE 'c' END AS codes, CASE WHEN doc_id % 5 = 0 THEN 'c' ELSE 'c,a' END AS related,
  CASE WHEN doc_id % 4 > 1 THEN 'rejected' WHEN doc_id % 4 = 0 AND doc_id % 7 <> 0 THEN 'confirmed' ELSE 'changed' END AS review FROM {_D}""",
    "text_forms": f"""
SELECT doc_id, trim(concat(CASE doc_id % 3 WHEN 0 THEN '（1）' ELSE '' END, ' ', CASE doc_id % 4 WHEN 0 THEN 'stem' ELSE '' END)) AS labelled, CASE doc_id % 4 WHEN 0 THEN 'Waiting' WHEN 1 THEN 'Done' WHEN 2 THEN 'odd' END AS name, doc_id % 6 IN (0, 2) AS number,
  doc_id % 6 IN (0, 4) AS in_time, doc_id % 9 IN (0, 7) AS safe, 'page_' || CASE WHEN doc_id % 1200 < 1000 THEN lpad((doc_id % 1200)::VARCHAR, 3, '0') ELSE (doc_id % 1200)::VARCHAR END || '.png' AS page, CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE 'year unknown' END AS year FROM {_D}""",
    "figure_boxes": """
WITH b AS (SELECT p_partkey AS k, floor(p_partkey % 10 / 16.0 * 1000)::BIGINT AS l, floor(p_partkey % 7 / 8.0 * 800)::BIGINT AS t, least(1000, ceil((p_partkey % 10 + 2) / 8.0 * 1000))::BIGINT AS r, least(800, ceil((p_partkey % 7 + 1) / 8.0 * 800))::BIGINT AS b FROM part)
SELECT k AS p_partkey, l AS box_l, t AS box_t, r AS box_r, b AS box_b, greatest(0, l - 20) AS wide_l, greatest(0, t - 20) AS wide_t, least(1000, r + 20) AS wide_r, least(800, b + 20) AS wide_b,
  CASE WHEN NOT (k % 5 < k % 7 AND 0 < k % 11) THEN 'order' WHEN k % 7 > 5 OR k % 11 > 9 THEN 'outside' END AS fault FROM b""",
    "asset_registrations": """
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN 'registered' WHEN p_partkey % 3 <> 0 THEN 'changed' WHEN p_partkey % 6 = 0 AND (p_partkey + 1) IN (SELECT p_partkey FROM part) THEN 'path_taken' ELSE 'new' END AS outcome FROM part""",
    "runner_answers": f"""
WITH n AS (SELECT n_nationkey AS k FROM nation), p AS (SELECT k, {_PROMPT} AS t FROM n), s(stage) AS (VALUES ('split'), ('transcribe'), ('audit'), ('proposal'))
SELECT k AS n_nationkey, stage, CASE WHEN k % 10 <> 7 THEN stage || ':' || length(t) END AS said, CASE WHEN k % 10 = 7 THEN 'TimeoutError' END AS error, CASE WHEN k % 2 = 0 AND k <> 4 THEN 'kept' END AS recorded,
  'run-' || substr(sha256(concat(stage, chr(10), t)), 1, 24) AS run_id FROM p, s""",
    "audit_head_check": _reasons([("auditor", "job_id % 5 = 0"), ("scope", "job_id % 7 = 0"), ("question_count", "job_id % 11 = 0"), ("sample", "job_id % 13 = 0 OR job_id % 17 = 0"), ("findings", "job_id % 19 = 0"), ("knowledge", "job_id % 23 = 0")], "(SELECT DISTINCT o_custkey AS job_id FROM orders)", "job_id"),
    "page_boxes": """
WITH c AS (SELECT p_partkey % 50 AS page, p_partkey AS column_index, p_partkey * 7 % 90 AS l, p_partkey * 7 % 90 + p_partkey % 13 AS r FROM part), w AS (SELECT *, max(r) OVER (PARTITION BY page ORDER BY column_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT page, column_index, CASE WHEN l >= r THEN 'order' WHEN r > 95 THEN 'outside' WHEN l < before THEN 'overlap' END AS fault FROM w WHERE l >= r OR r > 95 OR l < before""",
    "region_faults": """
WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, (turn * 3 + 1)::VARCHAR AS question_no, 'no_region' AS fault FROM c WHERE turn % 3 = 0 UNION ALL SELECT conv_id, (turn * 3 + 3)::VARCHAR, 'no_column' FROM c WHERE turn % 4 = 1
UNION ALL SELECT conv_id, NULL, 'too_many' FROM c GROUP BY conv_id HAVING sum(CASE WHEN turn % 4 = 1 THEN 3 ELSE 2 END) > 11""",
    "strict_rows": f"""
WITH d AS (SELECT doc_id, doc_id % 7 AS a, doc_id % 5 AS b FROM {_D}),
r AS (SELECT doc_id, CASE WHEN a > 5 OR b > 2 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'not_json' WHEN a > 1 THEN 'type:a' WHEN b > 0 THEN 'type:b' END AS reason FROM d)
SELECT doc_id, reason, reason IS NULL AS valid, CASE WHEN reason IS NULL THEN 'take' WHEN reason = 'missing' THEN 'ask' ELSE 'refuse' END AS action FROM r""",
    "topic_scopes": "SELECT n_regionkey::VARCHAR AS parent_code, string_agg(lpad(n_nationkey::VARCHAR, 2, '0'), ',' ORDER BY n_nationkey) AS allowed FROM nation GROUP BY 1",
}
