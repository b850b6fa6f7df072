"""Carrier queries for documents of batches: signed manifests, reviews, transcriptions, classifications, and their digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.operators import admission, batches, classification, digests, documents, manifests, stages, taxonomy
from itemloom.plans.admissions import _D, _docs, _flag, _k, _pick
from itemloom.sources import table

KEY = b"carrier key"


def _hmac_sql(text: str, key: bytes = KEY) -> str:
    """HMAC-SHA256 of a text in hex, from plain digests."""
    pad = key.ljust(64, b"\0")
    blob = lambda x: "from_hex('" + bytes(b ^ x for b in pad).hex() + "')"
    return f"sha256({blob(0x5C)} || from_hex(sha256({blob(0x36)} || encode({text}))))"


def _texts(*values: str):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>") if values else F.array().cast("array<string>")


def crop_manifest_check(spark, sf_dir):
    """Signed crop manifests of two pages and two questions, each wrong in other ways."""
    k, sha = _k(), F.sha2(_k().cast("string"), 256)
    page = lambda n, p, w: F.struct(n.alias("page_number"), p.alias("relative_path"), w.alias("pixel_width"), F.lit(200).alias("pixel_height"), sha.alias("sha256"))
    one = page(F.lit(1), F.when(_flag(7), "../pages/1.png").otherwise("pages/1.png"), F.when(_flag(11), 0).otherwise(100))
    two = page(F.when(_flag(13), 1).otherwise(2), F.lit("pages/2.png"), F.lit(100))
    box = lambda right: F.array(F.lit(0), F.lit(0), right, F.lit(50))
    region = lambda n, right: F.struct(n.alias("page_number"), box(right).alias("bbox"))
    question = lambda no, regions, mode, gap, ground, n: F.struct(no.alias("question_no"), F.when(_flag(17), "Q1.png").otherwise(F.format_string("question_crops/Q%03d.png", no)).alias("output_relative_path"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.lit(5).alias("byte_size"), sha.alias("sha256"), F.lit("generated").alias("crop_status"), F.when(_flag(19), "done").otherwise("needs_fix").alias("review_status"), _texts("w").alias("warnings"), regions.alias("regions"), mode.alias("mode"), gap.alias("separator_height"), ground.alias("background"), n.alias("region_count"))
    none = F.lit(None)
    first = question(F.lit(3), F.array(region(F.lit(1), F.when(_flag(23), 101).otherwise(F.when(_flag(11), 1).otherwise(100)))), F.lit("single"), none.cast("int"), none.cast("string"), F.when(_flag(29), 2).otherwise(1))
    second = question(F.when(_flag(31), 2).otherwise(4), F.array(region(F.lit(1), F.when(_flag(11), 1).otherwise(50)), region(F.when(_flag(37), 9).otherwise(1), F.when(_flag(11), 1).otherwise(50))), F.lit("vertical"), F.lit(8), F.lit("white"), F.lit(2))
    d = _docs(spark, sf_dir).withColumn("payload", F.concat(F.lit("doc "), k.cast("string")))
    d = documents.signed(d, "payload", KEY, "signature_now").select(
        "doc_id", F.when(_flag(41), 1).otherwise(2).alias("version"), F.substring(sha, 1, F.when(_flag(43), 31).otherwise(32)).alias("generation_id"), F.when(_flag(47), 3).otherwise(2).alias("question_count"),
        F.when(_flag(5), F.lower(F.hex(F.lit("x")))).otherwise(F.col("signature_now")).alias("signature"), "signature_now", F.array(one, two).alias("pages"), F.array(first, second).alias("questions"),
    )
    return manifests.crop_manifests(d, "doc_id").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def signatures(spark, sf_dir):
    """HMAC-SHA256 of texts, and of canonical JSON."""
    d = table(spark, sf_dir, "events").select("event_id", "props")
    d = documents.signed(documents.canonical(d, "props"), "canonical", KEY)
    return d.select("event_id", "canonical", "signature")


def crop_review_check(spark, sf_dir):
    """Reviews of crops: coverage, order, states and warnings."""
    sha = F.sha2(_k().cast("string"), 256)
    q = lambda no, s, w: F.struct(no.alias("question_no"), s.alias("status"), w.alias("warnings"))
    many = F.array_repeat(F.lit("w"), 21)
    said = F.when(_flag(5), many).when(_flag(5, 1), _texts(" ")).when(_flag(5, 2), F.array(F.repeat(F.lit("w"), 501))).otherwise(_texts("fine"))
    rows = F.array(q(F.lit(1), F.when(_flag(7), "passed").otherwise("ai_review_passed"), said), q(F.when(_flag(11), 3).otherwise(2), F.lit("needs_recrop"), _texts()), q(F.when(_flag(11), 2).otherwise(3), F.lit("needs_recrop"), _texts()))
    d = _docs(spark, sf_dir).select(
        "doc_id", F.when(_flag(13), 2).otherwise(1).alias("version"), F.substring(sha, 1, 32).alias("generation_id"), F.when(_flag(17), "x").otherwise(sha).alias("manifest_sha256"), F.when(_flag(19), "-run").otherwise("run:1").alias("reviewer_run_id"),
        F.when(_flag(23), F.slice(rows, 1, 0)).otherwise(rows).alias("questions"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("expected"),
    )
    return manifests.crop_reviews(d, "doc_id").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def warning_merge(spark, sf_dir):
    """Old and new warnings as one list, refused if it is too long; and the hints for a reviewer."""
    w = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda x: F.concat(F.lit("w"), x.cast("string")))
    both = manifests.merged_warnings(w(_k() % 15 + 1), F.concat(F.array(F.lit("w1"), F.lit("new")), F.transform(w(_k() % 11 + 1), lambda x: F.concat(F.lit("n"), x))))
    hints = stages.guidance([F.array(F.when(_flag(2), "a"), F.lit("b")), F.array(F.when(_flag(3), "a").otherwise("c"), F.lit("b")), w(_k() % 15 + 1)])
    return _docs(spark, sf_dir).select("doc_id", F.array_join(both, ",").alias("merged"), F.array_join(hints, ",").alias("hints"))


def crop_tallies(spark, sf_dir):
    s = F.col("o_orderpriority")
    state = F.when(s.startswith("1"), "ai_review_passed").when(s.startswith("2"), "needs_recrop").when(s.startswith("3"), "needs_fix").otherwise("pending_ai_review")
    return manifests.crop_tallies(table(spark, sf_dir, "orders").select("o_custkey", state.alias("review_status")), "o_custkey")


def upload_check(spark, sf_dir):
    """Staged uploads against their signed manifest."""
    k = _k()
    name = _pick(["a.pdf", "b.PDF", "dir/c.pdf", "x.txt", ".pdf"], 6)
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("token "), k.cast("string")).alias("token"), F.coalesce(name, F.lit("paper.pdf")).alias("original_filename"))
    d = documents.signed(d, "token", KEY, "signature_now").withColumns({
        "requested_token": F.when(_flag(7), "other").otherwise(F.col("token")), "stored_filename": F.when(_flag(6, 2), "c.pdf").when(_flag(11), "other.pdf").otherwise(F.col("original_filename")),
        "signature": F.when(_flag(13), None).otherwise(F.col("signature_now")), "size": F.when(_flag(17), 0).otherwise(9), "sha256": F.sha2("token", 256), "page_count": F.when(_flag(19), 0).otherwise(4),
        "file_size": F.when(_flag(17), 0).when(_flag(23), 8).otherwise(9), "file_sha256": F.sha2(F.when(_flag(29), "x").otherwise(F.col("token")), 256), "file_pages": F.when(_flag(2), F.when(_flag(31), 5).otherwise(4)),
    })
    return manifests.upload_manifests(d).join(d.select("token", "doc_id"), "token").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def staged_uploads(spark, sf_dir):
    """Turns of a conversation as chunks of an upload: size, digest, and whether all came within the cap."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max(F.coalesce("text", F.lit(""))).alias("content")).filter("NOT (conv_id % 5 = 0 AND turn = 1)")
    return manifests.staged(c.select("conv_id", (F.col("turn") + 1).alias("no"), "content"), "conv_id", 1200)


def legacy_audit_check(spark, sf_dir):
    """Audits of the older shape: customers' orders as entries."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), k.cast("string").alias("source_question_no"), k)
    status = F.when(k % 97 == 0, "other").when(k % 3 == 0, "auto_pass").when(k % 3 == 1, "disputed").otherwise("human_required")
    entries = o.filter("o_orderkey % 101 <> 0").select("job_id", "source_question_no", status.alias("audit_status"), F.when(k % 89 == 0, F.array(F.lit(None).cast("string"))).otherwise(_texts()).alias("issues"), _texts("x").alias("suggested_corrections"), F.when(k % 83 == 0, 0).otherwise(1).alias("evidence_page"))
    n = lambda m: F.count_if(k % 3 == m).cast("int")
    j = F.col("job_id")
    declared = o.groupBy("job_id").agg((F.count(F.lit(1)) + (j % 13 == 0).cast("int")).alias("question_count"), F.struct(n(0).alias("auto_pass"), (n(1) + (j % 7 == 0).cast("int")).alias("disputed"), n(2).alias("human_required")).alias("counts"), F.min("source_question_no").alias("_min"))
    declared = declared.withColumns({"sample_nos": F.when(j % 4 == 0, F.array("_min")).when(j % 4 == 1, _texts("none")), "sample_reason": F.when(j % 4 < 2, "chance")})
    return manifests.legacy_audits(entries, declared, o).select("job_id", F.array_join("reasons", ",").alias("reasons"))


def transcription_check(spark, sf_dir):
    """Transcribed questions: numbers, types, options, subquestions and pages as expected."""
    no = F.when(_flag(5), (_k() % 8 + 2).cast("string")).when(_flag(7), "01").otherwise((_k() % 8 + 1).cast("string"))
    option = lambda c, t: F.struct(F.lit(c).alias("code"), t.alias("content"))
    options = F.array(option("A", F.lit("x")), F.when(_flag(11), option(" a", F.lit("y"))).otherwise(option("B", F.when(_flag(13), " ").otherwise("y"))))
    sub = lambda x, t: F.struct(x.alias("label"), t.alias("stem_markdown"))
    subs = F.when(_flag(3), F.array(sub(F.lit("(1)"), F.lit("s")), sub(F.when(_flag(17), "(1)").otherwise("(2)"), F.lit("t")))).otherwise(F.array().cast("array<struct<label:string,stem_markdown:string>>"))
    q = _docs(spark, sf_dir).filter("doc_id % 41 <> 0").select(
        F.floor(_k() / 8).alias("job_id"), (_k() % 8 + 1).alias("position"), no.alias("source_question_no"), F.when(_flag(19), "").otherwise("stem").alias("stem_markdown"), F.when(_flag(2), "single_choice").when(_flag(23), "essay").otherwise("solution").alias("question_type_code"),
        F.when(_flag(2) | _flag(29), options).otherwise(F.slice(options, 1, 0)).alias("options"), subs.alias("subquestions"), F.when(_flag(31), F.array(F.lit(2), F.lit(1))).when(_flag(37), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("source_pages"),
        F.when(~_flag(43), _flag(4)).alias("figure_required"), F.when(_flag(47), "sure").otherwise("high").alias("extraction_confidence"), _texts().alias("warnings"),
    )
    e = _docs(spark, sf_dir).filter("doc_id % 53 <> 0").select(F.floor(_k() / 8).alias("job_id"), (_k() % 8 + 1).alias("position"), (_k() % 8 + 1).alias("question_no"), F.array(F.lit(1), F.lit(2)).alias("pages"))
    return batches.candidates(q, e).select("job_id", "position", F.array_join("reasons", ",").alias("reasons"))


def edited_structure_check(spark, sf_dir):
    option = lambda c: F.struct(c.alias("code"), F.lit("x").alias("content"))
    first, second = option(F.lit("A")), option(F.when(_flag(5), " a ").when(_flag(7), "B+").otherwise("B"))
    subs = F.array(F.struct(F.when(~_flag(13), "l").alias("label"), F.lit("s").alias("stem")))
    related = F.when(_flag(11), F.array(F.lit(None).cast("string"))).otherwise(_texts("K1"))
    reasons = admission.edited_structure(F.when(_flag(3), F.array(first)).otherwise(F.array(first, second)), related, subs, _flag(2))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(reasons, ",").alias("reasons"))


def edit_check(spark, sf_dir):
    """Edits that touch fixed fields or change nothing."""
    old = _docs(spark, sf_dir).select("doc_id", (_k() % 3).alias("pages"), F.lit("a").alias("figure"), F.when(_flag(5), None).otherwise("stem").alias("stem"))
    new = old.filter("doc_id % 17 <> 0").withColumns({"pages": F.when(_flag(7), 9).otherwise(F.col("pages")), "figure": F.when(_flag(11), None).otherwise(F.col("figure")), "stem": F.when(_flag(2), "other").otherwise(F.col("stem"))})
    return batches.edit_reasons(old, new, ["doc_id"], ["pages", "figure"], ["stem"]).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def approval_check(spark, sf_dir):
    """Why a person may not approve a question."""
    option = lambda c, t: F.struct(c.alias("code"), t.alias("content"))
    picture = F.lit(batches.IMAGE_OPTION)
    plain = F.array(option(F.lit("A"), F.lit("x")), option(F.when(_flag(5), "a ").otherwise("B"), F.lit("y")))
    options = F.when(_flag(3), F.array(option(F.lit("A"), picture), option(F.lit("B"), picture))).when(_flag(7), F.slice(plain, 1, 1)).otherwise(plain)
    q = _docs(spark, sf_dir).select("doc_id", F.when(_flag(11), "　").otherwise("s").alias("stem_markdown"), F.when(_flag(13), "essay").when(_flag(2), "single_choice").otherwise("solution").alias("question_type_code"), F.when(_flag(17), "K9").otherwise("K1").alias("primary_knowledge_point_code"), options.alias("options"), _flag(4).alias("figure_required"), F.when(_flag(9), None).otherwise(True).alias("has_crop"), (_k() % 8 != 0).alias("has_figure"))
    points = spark.createDataFrame([("K1",), ("K2",)], "code string")
    return batches.approval_reasons(q, batches.TYPES, points).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def form_arrays(spark, sf_dir):
    """Parallel arrays of a form as rows: equal lengths, indexes unique and in range."""
    d = _docs(spark, sf_dir).select("doc_id", F.array(F.lit(0), F.when(_flag(3), 0).when(_flag(5), 2).otherwise(1)).alias("source"), F.when(_flag(7), F.array(F.lit("a"))).otherwise(_texts("a", "b")).alias("text"))
    return batches.form_rows(d, ["doc_id"], ["source", "text"], "source").select("doc_id", "valid", F.col("position").cast("long").alias("position"), F.col("source").cast("long").alias("source"), "text")


def classification_evidence(spark, sf_dir):
    """Entries of classification evidence, of the older shape too."""
    related = F.when(_flag(3), _texts("b", "b")).when(_flag(5), _texts("a")).when(_flag(7), _texts("b", "c", "d")).otherwise(_texts("b", "c"))
    source = _pick(["human", "local_double_pass", "other"], 4)
    reviewer = F.when(_flag(4, 0), F.when(_flag(8), "someone").otherwise("teacher_human_review")).when(_flag(4, 1), "local_double_pass").when(_flag(4, 2), "x")
    r = classification.evidence_entry(F.when(_flag(11), "01").otherwise("7"), F.when(~_flag(13), "a"), related, F.repeat(F.lit("r"), F.when(_flag(17), 201).otherwise(200).cast("int")), source, reviewer)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(r, ",").alias("reasons"))


def subtree_outputs(spark, sf_dir):
    """Model outputs: topics among all, points below the topic that was chosen; texts that are no such document give no row."""
    points = spark.range(60).select(F.format_string("%02d.%02d", F.floor(F.col("id") / 10), F.col("id") % 10).alias("code"), F.format_string("%02d", F.floor(F.col("id") / 10)).alias("parent_code"))
    allowed = taxonomy.allowed_codes(points)
    topic = F.format_string("%02d", _k() % 6)
    point = F.format_string("%02d.%02d", F.when(_flag(5), (_k() + 1) % 6).otherwise(_k() % 6), _k() % 10)
    row = F.struct(_k().cast("string").alias("source_question_no"), point.alias("primary_code"), F.array(F.format_string("%02d.%02d", _k() % 6, F.when(_flag(7), _k() % 10).otherwise((_k() + 1) % 10)), F.format_string("%02d.%02d", F.when(_flag(11), 9).otherwise(_k() % 6), (_k() + 2) % 10)).alias("related_codes"), F.when(_flag(13), "sure").otherwise("low").alias("confidence"), F.when(_flag(17), "").otherwise("because").alias("reason"))
    text = F.to_json(F.struct(F.array(row).alias("questions")))
    d = _docs(spark, sf_dir).select("doc_id", topic.alias("parent_code"), F.when(_flag(19), F.lit("{}")).otherwise(text).alias("answer"))
    out = manifests.output_rows(d, "answer", "level3", ["doc_id", "parent_code"]).join(allowed, "parent_code")
    two = classification.level2_reasons(F.when(_flag(23), "99").otherwise(F.col("parent_code")), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda x: F.lpad(x.cast("string"), 2, "0")), F.col("confidence"), F.col("reason"))
    return out.select("doc_id", F.array_join(two, ",").alias("level2"), F.array_join(classification.level3_reasons(F.col("primary_code"), F.col("related_codes"), F.col("allowed"), F.col("confidence"), F.col("reason")), ",").alias("level3"))


def _classified(spark, sf_dir):
    """Orders as classified questions of customers."""
    k = F.col("o_orderkey")
    p = lambda n: F.concat(F.lit("K"), (k % n).cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"), k.cast("string").alias("question_no"), p(4).alias("final_primary"), p(6).alias("proposal"), p(9).alias("verifier"), F.array(p(3)).alias("final_related"),
        F.when(k % 3 == 0, "approved").otherwise("pending").alias("status"), F.when(k % 3 == 0, F.when(k % 2 == 0, "human").otherwise("local_double_pass")).alias("approval_source"), F.lit("why").alias("proposal_reason"),
        F.when(k % 5 == 0, p(7)).otherwise(p(4)).alias("primary"), F.when(k % 7 == 0, F.array(p(2))).otherwise(F.array(p(3))).alias("related"), F.when(k % 11 != 0, k % 4 == 1).alias("approve"),
    )


def double_passes(spark, sf_dir):
    """Agreement of two passes on primary and related points, both sure, and the topic's choice too."""
    k = F.col("o_orderkey")
    sure = lambda n: F.when(k % n == 0, "medium").otherwise("high")
    s = classification.double_pass((k % 2), (k % 4), F.array(k % 3), F.when(k % 13 == 0, None).otherwise(F.array(k % 3)), sure(5), sure(7), sure(11))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("status"))


def classification_reviews(spark, sf_dir):
    """What a person's choice does to a classification."""
    return classification.review(_classified(spark, sf_dir)).select("question_no", "status", "approval_source", "human_note", "changed")


def classification_page(spark, sf_dir):
    """Names of three codes from one dictionary, pending ones first, then by number."""
    points = spark.range(7).select(F.concat(F.lit("K"), F.col("id").cast("string")).alias("code"), F.concat(F.lit("point "), F.col("id").cast("string")).alias("name"))
    d = classification.with_names(_classified(spark, sf_dir), points, ["final_primary", "proposal", "verifier"])
    return classification.review_order(d).limit(500).select("question_no", "status", "final_primary_name", "proposal_name", "verifier_name")


def classification_counts(spark, sf_dir):
    return classification.counters(_classified(spark, sf_dir), "job_id")


def taxonomy_faults(spark, sf_dir):
    """A small taxonomy with faults, and a keyed upsert that writes only what changed."""
    rows = [("01", "a", 1, None), ("02", "b", 1, "01"), ("01.01", "c", 2, "01"), ("01.02", "c", 2, "01"), ("03.01", "d", 2, "03"), ("01.01.01", "e", 3, "01.01"), ("01.01.02", "f", 4, "01.01"), ("02", "g", 1, None)]
    points = spark.createDataFrame(rows, "code string, name string, level int, parent_code string")
    new = points.filter("code <> '01.02'").dropDuplicates(["code"]).withColumn("name", F.when(F.col("code") == "01.01.01", "E").otherwise(F.col("name"))).select("code", "name")
    more = spark.createDataFrame([("09", "z")], "code string, name string")
    acts = taxonomy.changes(points.filter("name <> 'g'").select("code", "name"), new.filter("code <> '02'").union(more), ["name"])
    return taxonomy.hierarchy_faults(points).select("code", F.col("fault").alias("what")).unionByName(acts.select("code", F.col("action").alias("what")))


def subquestion_answers(spark, sf_dir):
    """Answer digests: sensitive to each text and to the order of subquestions."""
    sub = lambda x: F.struct(F.lit(x).alias("label"), F.lit("s").alias("stem"), F.when(_flag(3), "a").alias("answer"), F.lit(None).cast("string").alias("analysis"))
    subs = F.when(_flag(4), F.array(sub("2"), sub("1"))).when(_flag(4, 1), None).otherwise(F.array(sub("1"), sub("2")))
    text = digests.answer_text(_k().cast("string"), F.when(_flag(5), "x"), F.lit("y"), subs)
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text, 256).alias("digest"))


def code_digests(spark, sf_dir):
    """Digests of code lists, which ignore order, and of inputs, which do not."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("Q-"), F.col("o_orderkey").cast("string")).alias("code"), F.col("o_orderkey").cast("string").alias("no"), "o_orderstatus")
    d = digests.input_digest(o, ["o_custkey"], "no", [F.col("no"), F.col("o_orderstatus")]).withColumnRenamed("digest", "input_digest")
    return digests.code_digest(o, ["o_custkey"], "code").join(d, "o_custkey")


def batch_digests(spark, sf_dir):
    """One digest a customer over several tables, without exempt columns."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), "c_name")
    return digests.tables_digest({"questions": (o, ["o_orderkey", "o_orderstatus"]), "papers": (c, ["c_name"])}, "job")


def digest_drift(spark, sf_dir):
    """Groups whose rows changed since their digests were stored; an exempt column does not count."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    now = o.filter(k % 97 != 0).withColumn("o_orderstatus", F.when(k % 89 == 0, None).otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.lit("exempt"))
    now = now.filter("o_custkey % 50 <> 0").unionByName(now.limit(0))
    cols = [F.col("o_orderkey"), F.col("o_orderstatus")]
    return digests.drifted(digests.group_digest(o, ["o_custkey"], cols), digests.group_digest(now, ["o_custkey"], cols), ["o_custkey"])


def database_drift(spark, sf_dir):
    """Whether whole tables still have their digest: the same rows in another order do, one changed or repeated row does not."""
    o = table(spark, sf_dir, "orders")
    k, cols = F.col("o_orderkey"), [F.col("o_orderkey"), F.col("o_orderstatus")]
    cases = {"same": o.orderBy(F.desc("o_orderkey")), "changed": o.withColumn("o_orderstatus", F.when(k == 7, "X").otherwise(F.col("o_orderstatus"))), "repeated": o.union(o.filter("o_orderkey = 7")), "exempt": o.withColumn("o_orderpriority", F.lit("x"))}
    base = digests.table_digest(o, cols).select(F.col("digest").alias("_d"))
    out = None
    for name, df in cases.items():
        one = digests.table_digest(df, cols).join(F.broadcast(base)).select(F.lit(name).alias("name"), (F.col("digest") != F.col("_d")).alias("drift"))
        out = one if out is None else out.unionByName(one)
    return out


def page_order(spark, sf_dir):
    """Regions whose place is before that of the region before them."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").select("conv_id", "turn").distinct().withColumns({"page": F.floor(F.col("turn") / 2), "y": (F.col("turn") * 7 + F.col("conv_id")) % 5})
    return manifests.out_of_order(c, ["conv_id"], "turn", ["page", "y"])


def unknown_form_keys(spark, sf_dir):
    k = F.when(_flag(2), _texts("stem", "evil", "type", "evil")).when(_flag(3), _texts("stem")).otherwise(_texts("b", "a"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(manifests.unknown_keys(k, ["stem", "type"]), ",").alias("unknown"))


def affected_sheets(spark, sf_dir):
    """Contact sheets that a changed or recovered crop touches."""
    d = _docs(spark, sf_dir).filter("doc_id > 0")
    return manifests.affected_groups(d.filter("doc_id % 17 = 0"), d.filter("doc_id % 29 = 0"), "doc_id")


def page_dimensions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", manifests.page_pixels(F.col("p_size") * F.lit(1.5)).alias("pixels"), manifests.page_pixels(F.lit(612.0) + F.col("p_size"), 144).alias("other"))


_FNS = (
    crop_manifest_check, signatures, crop_review_check, warning_merge, crop_tallies, upload_check, staged_uploads, legacy_audit_check, transcription_check, edited_structure_check, edit_check, approval_check, form_arrays, classification_evidence,
    subtree_outputs, double_passes, classification_reviews, classification_page, classification_counts, taxonomy_faults, subquestion_answers, code_digests, batch_digests, digest_drift, database_drift, page_order, unknown_form_keys, affected_sheets, page_dimensions,
)
QUERIES = {f.__name__: f for f in _FNS}


def _reasons(rules: list[tuple[str, str]], source: str = _D, key: str = "doc_id") -> str:
    """SQL of key, reasons: the names of the conditions that hold, in order."""
    return f"SELECT {key}, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in rules)}) AS reasons FROM {source}"


ORACLE_SQL = {
    "crop_manifest_check": _reasons([
        ("signature", "doc_id % 5 = 0"), ("version", "doc_id % 41 = 0"), ("generation", "doc_id % 43 = 0"), ("count", "doc_id % 47 = 0"), ("pages", "doc_id % 7 = 0 OR doc_id % 11 = 0"), ("page_order", "doc_id % 13 = 0"), ("question_order", "doc_id % 31 = 0"),
        ("output", "doc_id % 17 = 0"), ("crop", "doc_id % 19 = 0"), ("region", "doc_id % 11 = 0 OR doc_id % 23 = 0 OR doc_id % 37 = 0"), ("composition", "doc_id % 29 = 0"),
    ]),
    "signatures": f"WITH e AS (SELECT event_id, '{{\"k\":' || json_extract_string(props, '$.k') || '}}' AS canonical FROM events) SELECT event_id, canonical, {_hmac_sql('canonical')} AS signature FROM e",
    "crop_review_check": _reasons([
        ("version", "doc_id % 13 = 0"), ("input", "doc_id % 17 = 0"), ("reviewer", "doc_id % 19 = 0"), ("count", "doc_id % 23 = 0"), ("question", "doc_id % 7 = 0 AND doc_id % 23 <> 0"), ("warnings", "doc_id % 5 < 3 AND doc_id % 23 <> 0"),
        ("order", "doc_id % 11 = 0 AND doc_id % 23 <> 0"), ("coverage", "doc_id % 11 = 0 OR doc_id % 23 = 0"),
    ]),
    "warning_merge": f"""
WITH d AS (SELECT doc_id, list_transform(range(1, doc_id % 15 + 2), lambda x: 'w' || x) AS a, list_transform(range(1, doc_id % 11 + 2), lambda x: 'nw' || x) AS b FROM {_D})
SELECT doc_id, CASE WHEN len(a) + 1 + len(b) <= 20 THEN array_to_string(list_concat(a, ['new'], b), ',') END AS merged,
  array_to_string(list_slice(list_concat(CASE WHEN doc_id % 2 = 0 THEN ['a', 'b'] ELSE ['b'] END, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN [] WHEN doc_id % 3 = 0 THEN ['a'] ELSE ['c'] END, a), 1, 8), ',') AS hints FROM d""",
    "crop_tallies": "SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS n_passed, count(*) FILTER (WHERE o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%') AS n_needs_recrop, count(*) FILTER (WHERE o_orderpriority NOT SIMILAR TO '[123].*') AS n_pending FROM orders GROUP BY 1",
    "upload_check": _reasons([
        ("signature", "doc_id % 13 = 0"), ("token", "doc_id % 7 = 0"), ("name", "doc_id % 6 IN (3, 4) OR (doc_id % 11 = 0 AND doc_id % 6 <> 2)"), ("fields", "doc_id % 17 = 0 OR doc_id % 19 = 0"),
        ("changed", "(doc_id % 23 = 0 AND doc_id % 17 <> 0) OR doc_id % 29 = 0"), ("pages", "doc_id % 2 = 0 AND CASE WHEN doc_id % 31 = 0 THEN 5 ELSE 4 END <> CASE WHEN doc_id % 19 = 0 THEN 0 ELSE 4 END"),
    ]),
    "staged_uploads": """
WITH c AS (SELECT conv_id, turn, max(coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL HAVING NOT (conv_id % 5 = 0 AND turn = 1)),
j AS (SELECT conv_id, string_agg(t, '' ORDER BY turn) AS t, count(*) AS n, min(turn) AS first, max(turn) AS last FROM c GROUP BY conv_id)
SELECT conv_id, strlen(t) AS size, sha256(t) AS sha256, first = 0 AND last + 1 = n AND strlen(t) <= 1200 AS accepted FROM j""",
    "legacy_audit_check": """
WITH o AS (SELECT o_custkey AS job_id, o_orderkey AS k FROM orders), j AS (SELECT job_id, bool_or(k % 101 <> 0 AND (k % 97 = 0 OR k % 89 = 0 OR k % 83 = 0)) AS bad, bool_or(k % 101 = 0) AS lost, bool_and(k % 101 = 0) AS none, min(k::VARCHAR) AS first,
  bool_or(k % 101 = 0 OR k % 97 = 0) AS fewer, count(*) AS n FROM o GROUP BY 1), s AS (SELECT j.*, EXISTS (SELECT 1 FROM o WHERE o.job_id = j.job_id AND k::VARCHAR = first AND k % 101 <> 0) AS seen FROM j)
SELECT job_id, concat_ws(',', CASE WHEN bad OR none THEN 'entry' END, CASE WHEN lost THEN 'numbers' END, CASE WHEN job_id % 13 = 0 OR lost THEN 'question_count' END, CASE WHEN job_id % 7 = 0 OR fewer THEN 'counts' END,
  CASE WHEN (job_id % 4 = 0 AND NOT seen) OR job_id % 4 = 1 THEN 'sample' END) AS reasons FROM s""",
    "transcription_check": f"""
WITH d AS (SELECT *, doc_id % 41 <> 0 AS got, doc_id % 53 <> 0 AS want, (doc_id % 8 + 1)::VARCHAR AS own, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 8 + 2)::VARCHAR WHEN doc_id % 7 = 0 THEN '01' ELSE (doc_id % 8 + 1)::VARCHAR END AS no FROM {_D}),
c AS (SELECT *, count(*) FILTER (WHERE got) OVER (PARTITION BY doc_id // 8, CASE WHEN got THEN no END) AS copies FROM d WHERE got OR want)
SELECT doc_id // 8 AS job_id, doc_id % 8 + 1 AS position, CASE WHEN NOT got THEN 'missing' ELSE concat_ws(',', CASE WHEN NOT want THEN 'unexpected' END, CASE WHEN NOT want OR no <> own THEN 'number' END, CASE WHEN copies > 1 THEN 'repeated' END,
  CASE WHEN doc_id % 19 = 0 THEN 'stem' END, CASE WHEN doc_id % 23 = 0 AND doc_id % 2 <> 0 THEN 'type' END, CASE WHEN doc_id % 29 = 0 AND doc_id % 2 <> 0 THEN 'options' END,
  CASE WHEN (doc_id % 2 = 0 OR doc_id % 29 = 0) AND doc_id % 13 = 0 AND doc_id % 11 <> 0 THEN 'option_text' END, CASE WHEN (doc_id % 2 = 0 OR doc_id % 29 = 0) AND doc_id % 11 = 0 THEN 'option_codes' END,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 17 = 0 THEN 'labels' END, CASE WHEN NOT want OR doc_id % 31 = 0 OR doc_id % 37 = 0 THEN 'pages' END, CASE WHEN doc_id % 47 = 0 THEN 'confidence' END, CASE WHEN doc_id % 43 = 0 THEN 'figure' END) END AS reasons FROM c""",
    "edited_structure_check": _reasons([("option_code", "doc_id % 3 <> 0 AND doc_id % 7 = 0 AND doc_id % 5 <> 0"), ("repeated_codes", "doc_id % 3 <> 0 AND doc_id % 5 = 0"), ("related", "doc_id % 11 = 0"), ("too_few_options", "doc_id % 2 = 0 AND doc_id % 3 = 0"), ("subquestions", "doc_id % 13 = 0")]),
    "edit_check": _reasons([("fixed:pages", "doc_id % 7 = 0"), ("fixed:figure", "doc_id % 11 = 0"), ("unchanged", "doc_id % 2 <> 0")], f"(SELECT * FROM {_D} WHERE doc_id % 17 <> 0)"),
    "approval_check": _reasons([
        ("empty_stem", "doc_id % 11 = 0"), ("type", "doc_id % 13 = 0"), ("knowledge_point", "doc_id % 17 = 0"), ("too_few_options", "doc_id % 2 = 0 AND doc_id % 13 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 = 0"),
        ("repeated_codes", "doc_id % 2 = 0 AND doc_id % 13 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0"), ("missing_crop", "doc_id % 3 = 0 AND doc_id % 9 = 0"), ("missing_figure", "doc_id % 4 = 0 AND doc_id % 8 = 0"),
    ]),
    "form_arrays": f"""
SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS valid, p AS position, CASE WHEN p = 1 OR doc_id % 3 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS source,
  CASE WHEN p = 1 THEN 'a' WHEN doc_id % 7 <> 0 THEN 'b' END AS text FROM {_D}, (VALUES (1::BIGINT), (2::BIGINT)) v(p)""",
    "classification_evidence": _reasons([
        ("number", "doc_id % 11 = 0"), ("primary", "doc_id % 13 = 0"), ("related", "doc_id % 3 = 0 OR (doc_id % 5 <> 0 AND doc_id % 7 = 0)"), ("primary_in_related", "doc_id % 3 <> 0 AND doc_id % 5 = 0 AND doc_id % 13 <> 0"),
        ("reason", "doc_id % 17 = 0"), ("reviewer", "doc_id % 4 = 2 OR doc_id % 8 = 0"),
    ]),
    "subtree_outputs": f"""
WITH d AS (SELECT * FROM {_D} WHERE doc_id % 19 <> 0), r AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN doc_id % 10 ELSE (doc_id + 1) % 10 END AS r1, CASE WHEN doc_id % 11 = 0 THEN 9 ELSE doc_id % 6 END AS t2 FROM d)
SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 23 = 0 THEN 'code' END, CASE WHEN doc_id % 13 = 0 THEN 'confidence' END, CASE WHEN doc_id % 17 = 0 THEN 'reason' END) AS level2,
  concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'code' END, CASE WHEN t2 = 9 THEN 'related' END, CASE WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 'primary_in_related' END, CASE WHEN doc_id % 13 = 0 THEN 'confidence' END, CASE WHEN doc_id % 17 = 0 THEN 'reason' END) AS level3 FROM r""",
    "double_passes": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = o_orderkey % 4 AND o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'approved' ELSE 'pending' END AS status FROM orders",
    "classification_reviews": """
WITH o AS (SELECT o_orderkey AS k, (k % 5 = 0 AND k % 7 <> k % 4) OR (k % 7 = 0 AND k % 2 <> k % 3) AS changed, k % 3 = 0 AS was, coalesce(CASE WHEN k % 11 <> 0 THEN k % 4 = 1 END, false) AS approve, CASE WHEN k % 5 = 0 THEN 'K' || (k % 7) ELSE 'K' || (k % 4) END AS p FROM orders),
s AS (SELECT *, CASE WHEN approve OR (was AND NOT changed) THEN 'approved' ELSE 'pending' END AS status FROM o),
t AS (SELECT *, CASE WHEN status = 'pending' THEN NULL WHEN changed OR (approve AND NOT was) THEN 'human' WHEN was THEN CASE WHEN k % 2 = 0 THEN 'human' ELSE 'local_double_pass' END END AS approval_source FROM s)
SELECT k::VARCHAR AS question_no, status, approval_source, CASE WHEN changed OR approval_source = 'human' THEN concat(CASE status WHEN 'approved' THEN 'reviewed: ' ELSE 'draft: ' END, p, '; proposal: why') END AS human_note, changed FROM t""",
    "classification_page": """
WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k::VARCHAR AS question_no, CASE WHEN k % 3 = 0 THEN 'approved' ELSE 'pending' END AS status, 'point ' || (k % 4) AS final_primary_name, 'point ' || (k % 6) AS proposal_name,
  CASE WHEN k % 9 < 7 THEN 'point ' || (k % 9) END AS verifier_name FROM o ORDER BY CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, k LIMIT 500""",
    "classification_counts": """
SELECT o_custkey AS job_id, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS n_pending, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_approved, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 1) AS n_auto FROM orders GROUP BY 1""",
    "taxonomy_faults": """
WITH p(code, name, level, parent) AS (VALUES ('01', 'a', 1, NULL), ('02', 'b', 1, '01'), ('01.01', 'c', 2, '01'), ('01.02', 'c', 2, '01'), ('03.01', 'd', 2, '03'), ('01.01.01', 'e', 3, '01.01'), ('01.01.02', 'f', 4, '01.01'), ('02', 'g', 1, NULL)),
k AS (SELECT * FROM p WHERE name <> 'g'), n AS (SELECT code, CASE code WHEN '01.01.01' THEN 'E' ELSE name END AS name FROM p WHERE code NOT IN ('01.02', '02') UNION ALL SELECT '09', 'z')
SELECT code, 'level' AS what FROM p WHERE level NOT BETWEEN 1 AND 3 UNION ALL SELECT code, 'parent_of_module' FROM p WHERE level = 1 AND parent IS NOT NULL
UNION ALL SELECT code, 'parent' FROM p WHERE level > 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.code = p.parent AND q.level = p.level - 1)
UNION ALL SELECT code, 'repeated_code' FROM p GROUP BY code HAVING count(*) > 1
UNION ALL SELECT code, 'repeated_name' FROM (SELECT code, row_number() OVER (PARTITION BY parent, name ORDER BY code) AS r FROM p) WHERE r > 1
UNION ALL SELECT coalesce(k.code, n.code), CASE WHEN k.code IS NULL THEN 'insert' WHEN n.code IS NULL THEN 'absent' WHEN k.name = n.name THEN 'keep' ELSE 'update' END FROM k FULL JOIN n ON k.code = n.code""",
    "subquestion_answers": f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE '' END AS a FROM {_D}),
s AS (SELECT *, '{{"analysis_markdown":"","answer_markdown":"' || a || '","label":"1","stem_markdown":"s"}}' AS one, '{{"analysis_markdown":"","answer_markdown":"' || a || '","label":"2","stem_markdown":"s"}}' AS two FROM d)
SELECT doc_id, sha256(concat('{{"analysis_markdown":"y","answer_markdown":"', CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END, '","source_question_no":"', doc_id, '","subquestions":[',
  CASE WHEN doc_id % 4 = 0 THEN two || ',' || one WHEN doc_id % 4 = 1 THEN '' ELSE one || ',' || two END, ']}}')) AS digest FROM s""",
    "code_digests": """
SELECT o_custkey, sha256('["' || string_agg('Q-' || o_orderkey, '","' ORDER BY 'Q-' || o_orderkey) || '"]') AS digest, sha256(string_agg(o_orderkey || '|' || coalesce(o_orderstatus, '\\N'), chr(10) ORDER BY o_orderkey)) AS input_digest FROM orders GROUP BY 1""",
    "batch_digests": """
WITH o AS (SELECT o_custkey AS job, 'questions:' || count(*) || ':' || sha256(string_agg(t, chr(10) ORDER BY t)) AS p FROM (SELECT o_custkey, o_orderkey || '|' || o_orderstatus AS t FROM orders) GROUP BY 1),
c AS (SELECT c_custkey AS job, 'papers:1:' || sha256(c_name) AS p FROM customer), u AS (SELECT * FROM o UNION ALL SELECT * FROM c) SELECT job, sha256(string_agg(p, chr(10) ORDER BY p)) AS digest FROM u GROUP BY 1""",
    "digest_drift": """
WITH o AS (SELECT o_custkey, bool_or(o_orderkey % 97 = 0 OR o_orderkey % 89 = 0) AS hit, bool_and(o_orderkey % 97 = 0) AS none FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN none OR o_custkey % 50 = 0 THEN 'missing' WHEN hit THEN 'changed' ELSE 'none' END AS drift FROM o""",
    "database_drift": """
WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders), c AS (SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'X' ELSE o_orderstatus END FROM orders), r AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE o_orderkey = 7)
SELECT 'same' AS name, false AS drift UNION ALL SELECT 'exempt', false UNION ALL SELECT 'changed', EXISTS (SELECT * FROM b EXCEPT ALL SELECT * FROM c) UNION ALL SELECT 'repeated', EXISTS (SELECT * FROM r EXCEPT ALL SELECT * FROM b)""",
    "page_order": """
WITH c AS (SELECT DISTINCT conv_id, turn, turn // 2 AS page, (turn * 7 + conv_id) % 5 AS y FROM conversations WHERE conv_id IS NOT NULL), l AS (SELECT *, lag(page) OVER w AS p, lag(y) OVER w AS q FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, page, y, coalesce(page < p OR (page = p AND y < q), false) AS disorder FROM l""",
    "unknown_form_keys": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'evil' WHEN doc_id % 3 = 0 THEN '' ELSE 'b,a' END AS unknown FROM {_D}",
    "affected_sheets": f"SELECT DISTINCT (doc_id - 1) // 4 * 4 + 1 AS first_no FROM {_D} WHERE doc_id > 0 AND (doc_id % 17 = 0 OR doc_id % 29 = 0)",
    "page_dimensions": "SELECT p_partkey, ceil(p_size * 1.5 * 300 / 72)::BIGINT AS pixels, ceil((612.0 + p_size) * 144 / 72)::BIGINT AS other FROM part",
}
