"""Records of a portfolio over the test tables: orders are documents, lines their fields, each query through the package's operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.functions import labels, text
from pactlake.operators import analysis, clause_conflicts, cross_contract, findings, geometry, handoffs, records, retrieval, sinks, statutes
from pactlake.operators import portfolio as pf
from pactlake.plans.clauses import table
from pactlake.session import ensure_checkpoint_dir, saved, shared_dir
from pactlake.sources import files
from pactlake.streaming import jobs as queue
from pactlake.versions import Change, Store

AS_OF = "1996-06-30"
KEYS = ("parties", "expiration_date", "governing_law", "renewal_term", "notice_period_to_terminate_renewal", "exclusivity", "insurance")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: F is ready, O degraded, P processing; types by key mod 7, one of them unknown; every tenth customer nameless."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    kinds = F.element_at(F.array(*(F.lit(x) for x in ("nda", "lease", "msa", "distribution", "other", "invoice", None))), (k % 7 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "degraded").otherwise("processing")
    named = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return named.select(k.alias("id"), F.concat(F.lit("order-"), k.cast("string"), F.lit(".pdf")).alias("filename"), status.alias("status"), kinds.alias("doc_type"), F.when(F.col("o_custkey") % 10 != 0, F.col("c_name")).alias("counterparty"), F.col("o_orderdate").alias("uploaded_at"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 1 to 7 of an order are its fields; the least part p of a line says the value (none if p mod 7 = 0), the tier (p mod 6, the sixth unknown) and the anchors, the line and the next one."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 7").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    li = li.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d")), F.col("l_orderkey") == F.col("o_orderkey"))
    p, n = F.col("p"), F.col("l_linenumber").cast("int")
    key = F.element_at(F.array(*map(F.lit, KEYS)), n)
    said = (
        F.when(n == 1, F.concat(F.lit("Customer Number"), F.col("o_custkey").cast("string"), F.lit(" Ltd and Owner"), F.col("o_custkey").cast("string"), F.lit(" Pte"))).when(n == 2, F.date_format(F.date_add("d", (p % 500).cast("int")), "MMMM d, yyyy"))
        .when(n == 3, F.when(p % 2 == 0, "laws of Singapore").otherwise("laws of Delaware")).when(n == 4, F.format_string("(%d) months", (p % 36).cast("int"))).when(n == 5, F.format_string("%d days", (p % 90).cast("int")))
        .when(n == 6, F.concat(F.lit("exclusive use of Machine M"), p.cast("string"))).otherwise(F.concat(F.lit("insured for part "), p.cast("string")))
    )
    li = li.select("l_orderkey", "l_linenumber", "p", key.alias("key"), F.when(p % 7 != 0, said).alias("value"))
    key, value = F.col("key"), F.col("value")
    tier = F.element_at(F.array(*map(F.lit, (*labels.TIERS, "guessed"))), (p % 6 + 1).cast("int"))
    line = lambda k: F.format_string("L%04d", k)
    return li.select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_orderkey").alias("document_id"), key.alias("field_key"), value.alias("value_verbatim"), text.normalize_value(key, value, value).alias("value_normalized"), tier.alias("confidence_tier"),
        F.when(p % 3 == 0, "benchmark").otherwise("contract_text").alias("claim_type"), F.when(value.isNull() & (p % 2 == 0), F.when(p % 4 == 0, "illegible").otherwise("not_found")).alias("absence_reason"), F.array(line(n + 1), line(n)).alias("anchor_line_ids"), F.concat(F.lit("Clause "), n.cast("string")).alias("clause_label"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 7").select("l_orderkey", F.col("l_linenumber").cast("int").alias("n")).distinct()
    return li.select(F.col("l_orderkey").alias("document_id"), F.format_string("L%04d", "n").alias("line_id"), (F.floor((F.col("n") - 1) / 3) + 1).cast("int").alias("page_number"), F.concat(F.lit("line "), F.col("n").cast("string")).alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event 90 days after an order, to be acted on 30 days before, but for key mod 3 = 0; each eleventh a day late."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.date_add(F.col("o_orderdate").cast("date"), 90)
    status = F.element_at(F.array(F.lit("open"), F.lit("acknowledged"), F.lit("dismissed")), (k % 5 % 3 + 1).cast("int"))
    return o.select(k.alias("id"), k.alias("document_id"), day.alias("event_date"), F.when(k % 3 != 0, F.date_add(day, F.when(k % 11 == 0, 1).otherwise(-30))).alias("action_by_date"), F.element_at(F.array(*map(F.lit, labels.TIERS)), (k % 5 + 1).cast("int")).alias("confidence_tier"), status.alias("status"))


def field_rows(spark, sf_dir):
    f = fields(spark, sf_dir)
    n = F.col("value_normalized")
    return f.select("id", "field_key", "value_verbatim", n["date"].alias("date"), n["days"].alias("days"), n["months"].alias("months"), "confidence_tier", "absence_reason", labels.coarse_label(F.col("value_verbatim"), F.col("confidence_tier")).alias("label"))


def field_reasons(spark, sf_dir):
    f, none = fields(spark, sf_dir), F.lit(None)
    c = F.col
    why = labels.review_reasons(c("confidence_tier"), F.lit(False), c("absence_reason"), c("clause_label"), (c("id") % 10) / 10, none.cast("double"), none.cast("array<string>"), c("claim_type"), F.lit(0), c("value_verbatim"))
    line = labels.benchmark_sentence(c("claim_type"), F.when(c("id") % 3 == 0, "below").when(c("id") % 3 == 1, "above"), F.lit("30 to 60 days"))
    return f.select("id", F.array_join(why, ",").alias("reasons"), line.alias("benchmark"))


def citation_pages(spark, sf_dir):
    return records.citation_pages(fields(spark, sf_dir), lines(spark, sf_dir))


def record_integrity(spark, sf_dir):
    return records.integrity(fields(spark, sf_dir), lines(spark, sf_dir), events(spark, sf_dir))


def record_list(spark, sf_dir):
    """The second page of twenty documents that are ready or degraded, by name."""
    out = records.document_list(documents(spark, sf_dir), events(spark, sf_dir), fields(spark, sf_dir), "ready, degraded", None, "order-1", "name", records.encode_cursor(20), 20)
    return out.select(F.col("nth").cast("bigint").alias("nth"), "id", "filename", "term_end", "next_action", "needs_review", "has_more")


def record_pages(spark, sf_dir):
    """The third page of thirty documents, the newest first, by the keys of the two pages before; many are of one day."""
    cursor, tables = None, (documents(spark, sf_dir), events(spark, sf_dir), fields(spark, sf_dir))
    for _ in range(2):
        last = records.document_list(*tables, cursor=cursor, limit=30).select("nth", "cursor").orderBy(F.desc("nth")).first()
        cursor = last.cursor if last else cursor
    out = records.document_list(*tables, cursor=cursor, limit=30)
    return out.select(F.col("nth").cast("bigint").alias("nth"), "id", "filename", "term_end", "next_action", "needs_review", "has_more")


def record_detail(spark, sf_dir):
    d, f, ln = documents(spark, sf_dir), fields(spark, sf_dir), lines(spark, sf_dir)
    pages = ln.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n_lines"))
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    out = records.document_detail(d, pages, f, ln, jobs)
    listed = F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["field_key"], F.coalesce(x["citation_page"].cast("string"), F.lit("-")))), ",")
    return out.select("id", F.size("pages").alias("n_pages"), listed.alias("fields"), F.col("job.status").alias("job_status"), F.col("job.id").alias("job_id"))


def record_edits(spark, sf_dir):
    """Every seventh field is edited: by its number to one of the four states, with a value of its own every other time."""
    f, k = fields(spark, sf_dir), F.col("id")
    state = F.element_at(F.array(*map(F.lit, ("quoted", "inferred", "evaluation_required", "na"))), (k % 4 + 1).cast("int"))
    e = f.filter(k % 7 == 0).select("id", "document_id", state.alias("state"), (k % 2 == 0).alias("has_value"), F.lit("edited").alias("value"), F.lit(False).alias("has_clause"), F.lit(None).cast("string").alias("clause_label"), F.lit("reviewer").alias("edited_by"))
    return records.edit_fields(f, e, "2024-01-01 00:00:00").select("id", "value_verbatim", "confidence_tier", "absence_reason", "human_edited", "edited_by")


def record_calendar(spark, sf_dir):
    who = documents(spark, sf_dir).select(F.col("id").alias("document_id"), "counterparty")
    return records.calendar_from_fields(fields(spark, sf_dir), who).select("document_id", "event_type", "event_date", "action_by_date", "title", "confidence_tier")


def upcoming_events(spark, sf_dir):
    return records.upcoming(events(spark, sf_dir), AS_OF).select("id", "effective", "n_overdue")


def event_patches(spark, sf_dir):
    e = events(spark, sf_dir)
    p = e.filter("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "dismissed").otherwise("lost").alias("status"))
    return records.update_status(e, p).select("id", "status")


def event_dtos(spark, sf_dir):
    return records.event_dto(events(spark, sf_dir))


def upload_outcomes(spark, sf_dir):
    """Documents as uploads after those of one source: what was created, known already, and empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.length("text").alias("n"))
    e = pf.insert_absent(d.filter("source = 'src0'"), d.filter("source <> 'src0'"), ["sha256"], [F.col("doc_id")])
    return records.upload_outcomes(e.select(F.when(F.col("n") < 40, "unsupported").otherwise("queued").alias("status"), "duplicate"))


def display_words(spark, sf_dir):
    """Days of orders as people read them, from a day in the middle."""
    day, at = F.col("o_orderdate").cast("date"), F.lit(AS_OF).cast("date")
    who = F.concat(F.lit("anna.b-"), F.col("o_orderkey").cast("string"), F.lit("@example.org"))
    reason = F.element_at(F.array(F.lit("governing_law_excluded"), F.lit("other_cause"), F.lit(None).cast("string")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.relative_days(day, at).alias("said"), labels.display_date(day).alias("shown"), labels.date_band(day, at).alias("band"), labels.initials(who).alias("initials"), labels.reason_label(reason).alias("reason"))


def law_names(spark, sf_dir):
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, "the Laws of England and").when(k == 1, "under the law of the State of New York, and nothing else").when(k == 2, "laws of France with exceptions").when(k == 3, "no such words").otherwise("laws of Ontario")
    party = F.concat(F.col("c_name"), F.when(k < 2, ", a company").when(k == 2, " (the Buyer)").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", text.governing_law(said).alias("law"), text.party_name(party).alias("party"))


def page_boxes(spark, sf_dir):
    """Boxes of lines in pixels to the grid of a thousand and to points."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_quantity").cast("int").alias("x")).distinct()
    return li.select("l_orderkey", "line", "x", text.to_grid(F.col("x") * 17, F.lit(2550)).alias("grid"), text.to_points(F.col("x") * 17, 300).alias("points"))


def ocr_means(spark, sf_dir):
    """Lines as recognised words of an order's pages (three lines each), the discount as confidence, -1 for the flag N; odd pages are native."""
    li = table(spark, sf_dir, "lineitem")
    page = (F.floor((F.col("l_linenumber") - 1) / 3) + 1).cast("int")
    w = li.select(F.col("l_orderkey").alias("doc_id"), page.alias("page"), F.when(page % 2 == 0, "ocr").otherwise("native").alias("source"), F.when(F.col("l_returnflag") == "N", -1.0).otherwise(F.col("l_discount") * 1000).alias("confidence"))
    return records.page_confidence(w).select("doc_id", "page", "source", F.round("ocr_mean", 3).alias("ocr_mean"), labels.ocr_band(F.col("ocr_mean") * 10).alias("band"))


def provenances(spark, sf_dir):
    d = documents(spark, sf_dir)
    name = F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ("pdf", "DOCX", "png", "txt"))), (F.col("id") % 4 + 1).cast("int")))
    return d.select("id", records.provenance(name, F.when(F.col("id") % 3 == 0, F.col("id") % 2 == 0)).alias("p")).select("id", "p.*")


def party_choice(spark, sf_dir):
    """The other side of each order: its lines' flags and parts name parties, the customer's own name is the hint."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").cast("int").alias("ord"), F.concat(F.lit("Firm "), F.upper("l_returnflag"), F.lit(" Ltd, a party")).alias("said"), (F.col("l_linestatus") == "O").alias("is_grounded"))
    one = li.groupBy("contract_id", "ord").agg(F.max("said").alias("said"), F.max("is_grounded").alias("is_grounded"))
    hints = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contract_id"), F.when(F.col("o_orderkey") % 2 == 0, "firm a").otherwise("").alias("hint"))
    return records.counterparties(one, hints)


def _answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A page for each document of ten words and more: the words, each 100 wide; answers quote the fourth to the ninth, and one says what isn't there."""
    ws = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contract_id"), ws.alias("w")).filter(F.size("w") >= 10)
    words = d.select("contract_id", F.lit(1).alias("page"), F.posexplode("w").alias("word_ord", "text")).withColumns({"x_min": F.col("word_ord") * 100, "y_min": F.lit(10), "x_max": F.col("word_ord") * 100 + 90, "y_max": F.lit(40), "width_px": F.lit(6000), "height_px": F.lit(3300)})
    quote = F.array_join(F.slice("w", 4, 6), " ")
    said = F.array(F.struct(F.lit("parties").alias("category"), quote.alias("text")), F.struct(F.lit("insurance").alias("category"), F.lit("zzqx vvkw qqjj xxzz kkww").alias("text")))
    answers = d.select("contract_id", F.posexplode(said).alias("ord", "x")).select("contract_id", "x.category", F.lit(0).alias("ord"), F.lit(1).alias("page"), "x.text", F.lit("").alias("clause"))
    return words, answers


def analyze_findings(spark, sf_dir):
    """Forty-one findings for each document of ten words and more, counted by answer and evidence; and whether the quote was met whole."""
    words, answers = _answers(spark, sf_dir)
    found, x = analysis.analyze(answers.select("contract_id").distinct(), words, answers, findings.dimension(spark))
    counts = found.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") == "present").alias("present"), F.max(F.when(F.col("category") == "insurance", F.col("evidence_status"))).alias("insurance"))
    exact = x.filter("category = 'parties'").select("contract_id", (F.col("recall") == 100).alias("met_all"))
    return counts.join(exact, "contract_id")


def finding_matrix(spark, sf_dir):
    """For each of the forty-one categories how often it is present, by the package's findings over the fields of all orders."""
    c, f = documents(spark, sf_dir).select(F.col("id").alias("contract_id")), fields(spark, sf_dir).filter("value_verbatim is not null")
    x = f.select(F.col("document_id").alias("contract_id"), F.col("field_key").alias("category"), F.lit(0).alias("ord"), F.col("value_verbatim").alias("vlm_text"), (F.col("confidence_tier") != "unverified").alias("is_grounded"))
    found = findings.findings(c, x, findings.dimension(spark))
    return found.groupBy("category", "category_ord", "answer", "evidence_status", "needs_review").agg(F.count(F.lit(1)).alias("n"), F.min("summary").alias("least"))


def finding_fields(spark, sf_dir):
    """Field rows of findings: the values of orders' fields read again from what model and page said."""
    c, f = documents(spark, sf_dir).select(F.col("id").alias("contract_id")), fields(spark, sf_dir).filter("value_verbatim is not null")
    x = f.select(F.col("document_id").alias("contract_id"), F.col("field_key").alias("category"), F.lit(0).alias("ord"), F.lit("a model's words").alias("vlm_text"), F.concat(F.lit(" "), "value_verbatim").alias("supporting_text"), (F.col("confidence_tier") != "unverified").alias("is_grounded"), (F.col("id") % 100).cast("double").alias("score"), F.lit(1).alias("page"), F.lit("").alias("clause"))
    out = findings.fields(findings.findings(c, x, findings.dimension(spark)), x)
    n = F.col("value_normalized")
    return out.filter(F.col("category").isin(*KEYS)).select("contract_id", "category", "value_verbatim", n["date"].alias("date"), n["days"].alias("days"), n["months"].alias("months"), "confidence_tier", "absence_reason", "consistency_score")


def document_classes(spark, sf_dir):
    """Types of the texts, with the number of present categories by key."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", records.doc_type(F.when(k % 5 == 0, "Mutual NDA"), F.col("text"), (k % 4).cast("bigint"), k % 3 == 0).alias("t"), records.looks_like_invoice(F.col("source"), F.col("text")).alias("is_invoice"))
    return d.select("doc_id", "t.*", "is_invoice")


def _clauses(spark, sf_dir) -> DataFrame:
    """Nations as statute chunks."""
    p, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    kinds = F.element_at(F.array(F.array(F.lit("nda"), F.lit("services")), F.array(F.lit("lease")), F.array(F.lit("other_commercial"), F.lit("distribution"))), (k % 3 + 1).cast("int"))
    chunk = p.select(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.col("n_name").alias("source"), F.col("n_name").alias("provision"), F.lit("w").alias("exact_wording"), F.lit(None).cast("string").alias("summary"), F.when(k % 4 == 1, "case_law_gloss").otherwise("statute_text").alias("authority_basis"),
        F.when(k % 9 == 0, "dependency_unavailable").alias("engine_status"), F.array(F.struct(F.lit("f").alias("target_field"), F.when(k % 2 == 0, "cuad_native").otherwise("cuad_gap").alias("status"))).alias("extraction_schema_status"), F.lit(None).cast("array<string>").alias("target_fields"), kinds.alias("applicable_contract_types"))
    return statutes.clauses(files.statute_chunks(chunk))


def _notes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("c"), (F.col("event_id") % 25).cast("string")).alias("clause_key"), F.col("user_id").alias("document_id"), F.col("event_id").alias("created_at"), F.lit("note").alias("kind"), F.col("event_type").alias("author"), F.col("event_type").alias("body"))


def statute_list(spark, sf_dir):
    return statutes.listing(_clauses(spark, sf_dir), _notes(spark, sf_dir)).select("clause_key", "ai_status", "na_reason", "n_annotations")


def statute_review(spark, sf_dir):
    """Each event verifies a clause; the last decides. Clauses are then read anew and keep their review."""
    c = _clauses(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    what = F.element_at(F.array(*map(F.lit, ("agree", "disagree", "manual_review", "nonsense"))), (F.col("event_id") % 4 + 1).cast("int"))
    acts = e.select(F.concat(F.lit("c"), (F.col("event_id") % 25).cast("string")).alias("clause_key"), what.alias("action"), F.lit("r").alias("author"), F.lit(None).cast("string").alias("note"), F.col("event_id").alias("created_at"))
    after, trail = statutes.verify(c.withColumn("review_status", F.lit("open")), _notes(spark, sf_dir).drop("document_id").limit(0), acts)
    n = trail.groupBy("clause_key").agg(F.count(F.lit(1)).alias("n_actions"))
    return statutes.refresh(after, c.filter("clause_key <> 'c7'")).join(n, "clause_key", "left").select("clause_key", "review_status", "n_actions")


def statute_applicable(spark, sf_dir):
    d, f = documents(spark, sf_dir), fields(spark, sf_dir)
    law = f.filter("field_key = 'governing_law'").select(F.col("document_id").alias("id"), F.col("value_verbatim").alias("governing_law"))
    docs = d.join(law, "id", "left").select("id", "doc_type", "governing_law")
    ev = table(spark, sf_dir, "events")
    reviews = pf.latest(ev, ["user_id"], [F.desc("event_id")]).select(F.col("user_id").alias("document_id"), F.concat(F.lit("c"), (F.col("event_id") % 25).cast("string")).alias("clause_key"), F.lit("overridden").alias("review_status"))
    out = statutes.applicable(docs, _clauses(spark, sf_dir), reviews, _notes(spark, sf_dir))
    return out.select("document_id", "clause_key", "jurisdiction", "status", "reason", "review_status", F.coalesce(F.size("annotations"), F.lit(-1)).alias("n_notes"))


def retrieval_fields(spark, sf_dir):
    """Contracts whose notice is of at least 45 days, as a question's parameters say it."""
    p = retrieval.Params.parse({"field_key": "notice_period_to_terminate_renewal", "comparator": "gte", "threshold": 45, "bogus": 1})
    out = retrieval.retrieve(documents(spark, sf_dir), fields(spark, sf_dir), p)
    return out.select("id", "filename", "doc_type", F.array_join(F.transform("fields", lambda x: F.concat_ws("|", x["value"], x["confidence_tier"])), ";").alias("fields"))


def retrieval_party(spark, sf_dir):
    """Leases with a name in the counterparty, the file or the parties clause."""
    p = retrieval.Params.parse({"doc_type": "lease", "counterparty": "number1"})
    return retrieval.retrieve(documents(spark, sf_dir), fields(spark, sf_dir), p).select("id", "filename", "counterparty")


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The portfolio's conflicts from its records, with records and fields; not numbered, as nothing reads the numbers."""
    d, f = documents(spark, sf_dir), fields(spark, sf_dir)
    facts = saved(handoffs.cited_fields(cross_contract.contract_facts(*handoffs.portfolio_tables(d, f, lines(spark, sf_dir))), f, d), "facts")
    return handoffs.conflict_rows(cross_contract.merged_pairs(facts).withColumn("conflict_id", F.lit(None).cast("string")), f, d), d, f


def record_conflicts(spark, sf_dir):
    rows, _, _ = _run(spark, sf_dir)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("conflict_type", "severity", "confidence_tier", listed("document_ids"), listed("field_ids"))


def record_briefs(spark, sf_dir):
    rows, _, _ = _run(spark, sf_dir)
    return handoffs.briefs(rows).select("trigger", F.sha2("question", 256).alias("question_sha256"), F.array_join(F.transform("document_ids", lambda x: x.cast("string")), ",").alias("document_ids"))


def clause_scopes(spark, sf_dir):
    """Pairs of scopes that need a person's judgement: of one kind, one of them unresolved."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).alias("canonical_id")).distinct()
    return clause_conflicts.scope_judgements(li.withColumnRenamed("l_orderkey", "contract_id"), "contract_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def job_states(spark, sf_dir):
    """Events as a stream of job events would tell them: the latest state of each job, stalled ones reaped."""
    kinds = F.create_map(*(F.lit(x) for kv in {"click": "running", "view": "queued", "purchase": "done"}.items() for x in kv))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.coalesce(kinds[F.col("event_type")], F.lit("failed")).alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("error"))
    return queue.reap(queue.latest_state(e), "2024-01-31 12:00:00").select("job_id", "status", "attempts")


def failed_documents(spark, sf_dir):
    d = documents(spark, sf_dir).select("id", "status", F.lit(None).cast("string").alias("error"))
    j = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), F.lit("failed").alias("status"))
    return queue.fail_documents(d, j)


def isolated_jobs(spark, sf_dir):
    """Work on each customer that fails for a negative balance and goes on with the others."""

    def work(r: dict) -> str:
        if r["c_acctbal"] < 0:
            raise ValueError(f"balance of {r['c_custkey']}")
        return r["c_mktsegment"]

    return queue.isolated(table(spark, sf_dir, "customer"), work, "c_custkey", 8)


def written_documents(spark, sf_dir):
    """Order counts by customer's nation, written, replaced for some nations and read again."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{os.path.basename(tempfile.mktemp())}"
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("document_id")).agg(F.count(F.lit(1)).alias("n"))
    sinks.replace_documents(c, path)
    for _ in range(2):
        sinks.replace_documents(c.filter("document_id < 5").withColumn("n", F.col("n") * 10), path)
    return spark.read.parquet(path).select(F.col("document_id").cast("int").alias("document_id"), "n")


def versioned_documents(spark, sf_dir):
    """Orders of each customer and an audit, which change together: customers of one segment are reviewed by a batch that is handed over twice."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 8)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey", F.lit("new").alias("state"))
    ids = o.select("document_id").distinct()
    store.update(lambda now: Change(ids, {"orders": o}, {"audit": ids.withColumn("what", F.lit("made"))}))
    some = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("document_id")).join(ids, "document_id", "left_semi")
    review = lambda now: Change(some, {"orders": now.of("orders", some).withColumn("state", F.lit("reviewed"))}, {"audit": some.withColumn("what", F.lit("reviewed"))})
    for _ in range(2):
        now = store.update(review, batch=("reviews", 0))
    n = now.read("orders").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("state") == "reviewed").alias("n_reviewed"))
    return n.join(now.read("audit").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_changes")), "document_id")


def folded_boxes(spark, sf_dir):
    """Lines folded from the words of documents, with their boxes."""
    from pactlake.plans import textual

    return geometry.fold_lines(textual._words(spark, sf_dir)).select("doc_id", F.col("page").cast("bigint").alias("page"), F.col("line").cast("bigint").alias("line"), *(F.col(c).cast("bigint").alias(c) for c in ("x_min", "y_min", "x_max", "y_max")))


QUERIES = {f.__name__: f for f in (
    field_rows, field_reasons, citation_pages, record_integrity, record_list, record_pages, record_detail, record_edits, record_calendar, upcoming_events, event_patches, event_dtos, upload_outcomes, display_words, law_names, page_boxes,
    ocr_means, provenances, party_choice, analyze_findings, finding_matrix, finding_fields, document_classes, statute_list, statute_review, statute_applicable, retrieval_fields, retrieval_party, record_conflicts, record_briefs,
    clause_scopes, job_states, failed_documents, isolated_jobs, written_documents, versioned_documents, folded_boxes,
)}

_D = """d AS (SELECT o_orderkey AS id, o_custkey AS u, 'order-' || o_orderkey || '.pdf' AS filename, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'degraded' ELSE 'processing' END AS status,
  ['nda', 'lease', 'msa', 'distribution', 'other', 'invoice', NULL][(o_orderkey % 7 + 1)::INT] AS doc_type, CASE WHEN o_custkey % 10 <> 0 THEN c_name END AS counterparty, o_orderdate::DATE AS day FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""
_F = f"""{_D}, p AS (SELECT l_orderkey AS k, l_linenumber::INT AS n, min(l_partkey) AS p FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1, 2),
 g AS (SELECT *, CASE n WHEN 2 THEN (day + (p % 500)::INT)::DATE END AS nd FROM p JOIN d ON d.id = k),
 f AS (SELECT k * 10 + n AS id, k AS document_id, n, p, ['parties', 'expiration_date', 'governing_law', 'renewal_term', 'notice_period_to_terminate_renewal', 'exclusivity', 'insurance'][n] AS field_key,
  CASE WHEN p % 7 <> 0 THEN CASE n WHEN 1 THEN 'Customer Number' || u || ' Ltd and Owner' || u || ' Pte' WHEN 2 THEN strftime(nd, '%B %-d, %Y') WHEN 3 THEN CASE WHEN p % 2 = 0 THEN 'laws of Singapore' ELSE 'laws of Delaware' END WHEN 4 THEN '(' || p % 36 || ') months' WHEN 5 THEN p % 90 || ' days'
    WHEN 6 THEN 'exclusive use of Machine M' || p ELSE 'insured for part ' || p END END AS value_verbatim,
  CASE WHEN p % 7 <> 0 THEN nd END AS date, CASE WHEN p % 7 <> 0 AND n = 5 THEN (p % 90)::INT END AS days, CASE WHEN p % 7 <> 0 AND n = 4 THEN (p % 36)::INT END AS months,
  ['verbatim', 'normalised', 'assembled', 'inferred', 'unverified', 'guessed'][(p % 6 + 1)::INT] AS confidence_tier, CASE WHEN p % 3 = 0 THEN 'benchmark' ELSE 'contract_text' END AS claim_type,
  CASE WHEN p % 7 = 0 AND p % 2 = 0 THEN CASE WHEN p % 4 = 0 THEN 'illegible' ELSE 'not_found' END END AS absence_reason FROM g),
 l AS (SELECT DISTINCT l_orderkey AS document_id, l_linenumber::INT AS n, ((l_linenumber - 1) // 3 + 1)::INT AS page FROM lineitem WHERE l_linenumber <= 7),
 c AS (SELECT f.id, coalesce(a.page, b.page) AS citation_page FROM f LEFT JOIN l a ON a.document_id = f.document_id AND a.n = f.n + 1 LEFT JOIN l b ON b.document_id = f.document_id AND b.n = f.n),
 e AS (SELECT o_orderkey AS id, (o_orderdate::DATE + 90)::DATE AS event_date, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderdate::DATE + 90 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE -30 END)::DATE END AS action_by_date,
  ['verbatim', 'normalised', 'assembled', 'inferred', 'unverified'][(o_orderkey % 5 + 1)::INT] AS confidence_tier, ['open', 'acknowledged', 'dismissed'][(o_orderkey % 5 % 3 + 1)::INT] AS status FROM orders)"""
_C = """s AS (SELECT 'c' || n_nationkey AS clause_key, n_nationkey AS k, n_name AS source, n_name AS provision, CASE WHEN n_nationkey % 9 = 0 THEN 'NA' WHEN n_nationkey % 4 = 1 THEN 'Inferred' WHEN n_nationkey % 2 = 0 THEN 'Quoted' ELSE 'Evaluation Required' END AS ai_status,
  [['nda', 'services'], ['lease'], ['other_commercial', 'distribution']][(n_nationkey % 3 + 1)::INT] AS types FROM nation)"""
_RUN = f"""WITH {_F}, k AS (SELECT id, u, day, filename, counterparty FROM d WHERE status IN ('ready', 'degraded') AND (doc_type IS NULL OR doc_type NOT IN ('not_a_contract', 'invoice'))),
 v AS (SELECT f.* FROM f WHERE value_verbatim IS NOT NULL AND document_id IN (SELECT id FROM k)),
 a AS (SELECT document_id AS k, p, id AS fid, value_verbatim AS q, confidence_tier AS t FROM v WHERE field_key = 'exclusivity'),
 x AS (SELECT document_id AS k, date AS e, id AS fid, value_verbatim AS q, confidence_tier AS t FROM v WHERE field_key = 'expiration_date'),
 r AS (SELECT document_id AS k, id AS fid, value_verbatim AS q, confidence_tier AS t FROM v WHERE field_key = 'renewal_term'),
 w AS (SELECT document_id AS k, lower(substr(value_verbatim, 9)) AS law, id AS fid, value_verbatim AS q, confidence_tier AS t FROM v WHERE field_key = 'governing_law'),
 nm AS (SELECT id AS k, 'c' || u AS name FROM k WHERE counterparty IS NOT NULL UNION SELECT document_id, 'p' || u FROM v JOIN d ON d.id = document_id WHERE field_key = 'parties'),
 gp AS (SELECT a.k AS a, b.k AS b, true AS e, NULL AS p FROM nm a JOIN nm b ON a.name = b.name AND a.k < b.k UNION SELECT a.k, b.k, false, a.p FROM a JOIN a b ON a.p = b.p AND a.k < b.k),
 h AS (SELECT a, b, bool_or(e) AS e, bool_or(p IS NOT NULL) AS s FROM gp GROUP BY 1, 2),
 z AS (SELECT h.a, h.b, 'Exclusivity / Double-Grant Conflict' AS type, 'Critical' AS sev, x.q AS qa, y.q AS qb, x.fid AS fa, y.fid AS fb, 6 AS ca, 6 AS cb, CASE WHEN NOT s OR 'unverified' IN (x.t, y.t) THEN 'Low' WHEN x.t IN ('verbatim', 'normalised') AND y.t IN ('verbatim', 'normalised') THEN 'High' ELSE 'Medium' END AS conf
   FROM h JOIN a x ON x.k = h.a JOIN a y ON y.k = h.b LEFT JOIN x xa ON xa.k = h.a LEFT JOIN x xb ON xb.k = h.b
  UNION ALL SELECT h.a, h.b, 'Term / Renewal Conflict', 'Significant', r.q, xb.q, r.fid, xb.fid, 4, 2, 'Low' FROM h JOIN r ON r.k = h.a JOIN x xa ON xa.k = h.a JOIN x xb ON xb.k = h.b WHERE h.e AND xa.e > xb.e
  UNION ALL SELECT h.a, h.b, 'Governing Law / Forum Conflict', 'Administrative', x.q, y.q, x.fid, y.fid, 3, 3, CASE WHEN x.t IN ('verbatim', 'normalised') AND y.t IN ('verbatim', 'normalised') THEN 'High' ELSE 'Medium' END FROM h JOIN w x ON x.k = h.a JOIN w y ON y.k = h.b WHERE h.e AND x.law <> y.law)"""
_LI = "l AS (SELECT doc_id, (i - 1) // 40 + 1 AS page, (i - 1) % 40 + 1 AS line, x AS text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(x, i))"

ORACLE = {
    "field_rows": f"WITH {_F} SELECT id, field_key, value_verbatim, date, days, months, confidence_tier, absence_reason, CASE WHEN value_verbatim IS NULL THEN 'na' WHEN confidence_tier = 'unverified' THEN 'evaluation_required' WHEN confidence_tier IN ('verbatim', 'normalised') THEN 'quoted' ELSE 'inferred' END AS label FROM f",
    "field_reasons": f"""WITH {_F} SELECT id, concat_ws(',', CASE WHEN confidence_tier = 'unverified' THEN 'quote_not_found' END, CASE WHEN absence_reason = 'illegible' THEN 'illegible' END, CASE WHEN confidence_tier = 'assembled' THEN 'assembled' END, CASE WHEN n < 7 THEN 'passes_disagree' END,
   CASE WHEN claim_type = 'benchmark' THEN 'own_range' END, CASE WHEN confidence_tier = 'inferred' AND value_verbatim IS NOT NULL THEN 'no_verbatim_text' END) AS reasons,
   CASE WHEN claim_type = 'benchmark' THEN ['Below', 'Above', 'Within'][(id % 3 + 1)::INT] || ' our reference range of 30 to 60 days.' END AS benchmark FROM f""",
    "citation_pages": f"WITH {_F} SELECT id, citation_page FROM c",
    "record_integrity": f"""WITH {_F} SELECT 'dangling_anchor' AS kind, f.id, printf('L%04d', m) AS detail FROM f, (VALUES (0), (1)) v(j), LATERAL (SELECT f.n + j AS m) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.document_id = f.document_id AND l.n = m)
 UNION ALL SELECT 'bad_tier', id, confidence_tier FROM f WHERE p % 6 = 5 UNION ALL SELECT 'missing_absence', id, NULL FROM f WHERE p % 7 = 0 AND p % 2 <> 0 UNION ALL SELECT 'late_action', id, action_by_date::VARCHAR FROM e WHERE action_by_date > event_date""",
    "record_list": f"""WITH {_F}, q AS (SELECT *, row_number() OVER (ORDER BY filename, id) - 21 AS nth FROM d WHERE status <> 'processing' AND filename LIKE '%order-1%' QUALIFY nth BETWEEN 0 AND 20)
 SELECT nth, q.id, filename, (SELECT coalesce(date::VARCHAR, value_verbatim) FROM f WHERE f.document_id = q.id AND n = 2) AS term_end, (SELECT coalesce(action_by_date, event_date) FROM e WHERE e.id = q.id AND e.status <> 'dismissed') AS next_action,
   EXISTS (SELECT 1 FROM f WHERE f.document_id = q.id AND (confidence_tier IN ('unverified', 'inferred') OR absence_reason = 'illegible')) OR status = 'degraded' AS needs_review, (SELECT max(nth) FROM q) = 20 AS has_more FROM q WHERE nth < 20""",
    "record_pages": f"""WITH {_F}, q AS (SELECT *, row_number() OVER (ORDER BY day DESC, id) - 61 AS nth FROM d QUALIFY nth BETWEEN 0 AND 30)
 SELECT nth, q.id, filename, (SELECT coalesce(date::VARCHAR, value_verbatim) FROM f WHERE f.document_id = q.id AND n = 2) AS term_end, (SELECT coalesce(action_by_date, event_date) FROM e WHERE e.id = q.id AND e.status <> 'dismissed') AS next_action,
   EXISTS (SELECT 1 FROM f WHERE f.document_id = q.id AND (confidence_tier IN ('unverified', 'inferred') OR absence_reason = 'illegible')) OR status = 'degraded' AS needs_review, (SELECT max(nth) FROM q) = 30 AS has_more FROM q WHERE nth < 30""",
    "record_detail": f"""WITH {_F}, j AS (SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
 SELECT d.id, (SELECT nullif(count(DISTINCT page), 0) FROM l WHERE l.document_id = d.id)::INT AS n_pages, (SELECT string_agg(field_key || ':' || coalesce(citation_page::VARCHAR, '-'), ',' ORDER BY field_key) FROM f JOIN c USING (id) WHERE f.document_id = d.id) AS fields, event_type AS job_status, event_id AS job_id FROM d LEFT JOIN j ON user_id = d.id""",
    "record_edits": f"""WITH {_F}, x AS (SELECT *, id % 7 = 0 AS hit, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 2 = 0 THEN 'edited' ELSE value_verbatim END AS v FROM f)
 SELECT id, CASE WHEN hit THEN v ELSE value_verbatim END AS value_verbatim, CASE WHEN hit THEN ['verbatim', 'inferred', 'unverified', 'inferred'][(id % 4 + 1)::INT] ELSE confidence_tier END AS confidence_tier,
   CASE WHEN hit THEN CASE WHEN v IS NULL THEN 'not_present' END ELSE absence_reason END AS absence_reason, hit AS human_edited, CASE WHEN hit THEN 'reviewer' END AS edited_by FROM x""",
    "record_calendar": f"""WITH {_F}, u AS (SELECT document_id, max(date) AS x, max(days) AS nd, bool_or(months IS NOT NULL) AS rn FROM f WHERE confidence_tier <> 'unverified' GROUP BY 1)
 SELECT document_id, CASE WHEN rn THEN 'auto_renewal' ELSE 'expiry' END AS event_type, x AS event_date, (x - nd)::DATE AS action_by_date, CASE WHEN rn THEN 'Renewal decision for ' || coalesce(counterparty, 'the counterparty') ELSE 'Agreement with ' || coalesce(counterparty, 'the counterparty') || ' expires' END AS title,
   CASE WHEN rn AND nd IS NOT NULL THEN 'assembled' ELSE 'normalised' END AS confidence_tier FROM u JOIN d ON d.id = document_id WHERE x IS NOT NULL""",
    "upcoming_events": f"""WITH {_F}, q AS (SELECT *, coalesce(action_by_date, event_date) AS effective FROM e WHERE status <> 'dismissed')
 SELECT id, effective, (SELECT count(*) FROM q WHERE effective < DATE '{AS_OF}') AS n_overdue FROM q WHERE effective BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 90 ORDER BY effective, event_date, id LIMIT 6""",
    "event_patches": f"WITH {_F} SELECT id, CASE WHEN id % 8 = 0 THEN 'dismissed' ELSE status END AS status FROM e",
    "event_dtos": f"""WITH {_F} SELECT id, '{{"id":"' || id || '","documentId":"' || id || '","eventDate":"' || event_date || '","actionByDate":' || coalesce('"' || action_by_date || '"', 'null') || ',"confidenceTier":"' || confidence_tier || '","status":"' || status || '"}}' AS dto FROM e""",
    "upload_outcomes": """WITH d AS (SELECT doc_id, source, sha256(text) AS h, length(text) AS n FROM documents), e AS (SELECT n, row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 OR h IN (SELECT h FROM d WHERE source = 'src0') AS dup FROM d WHERE source <> 'src0')
 SELECT count(*) FILTER (NOT dup AND n >= 40) AS created, count(*) FILTER (dup) AS duplicates, count(*) FILTER (NOT dup AND n < 40) AS rejected, CASE WHEN bool_and(dup) THEN 200 ELSE 201 END AS code FROM e""",
    "display_words": f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE - DATE '{AS_OF}' AS n FROM orders)
 SELECT o_orderkey, CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'tomorrow' WHEN n = -1 THEN 'overdue by 1 day' WHEN n < 0 THEN 'overdue by ' || -n || ' days' ELSE 'in ' || n || ' days' END AS said, strftime(d, '%d %b %Y') AS shown,
   CASE WHEN n < 0 THEN 'overdue' WHEN n <= 7 THEN 'this_week' WHEN n <= 30 THEN 'next_30' WHEN n <= 60 THEN 'next_60' WHEN n <= 90 THEN 'in_90' ELSE 'later' END AS band, 'AB' AS initials, ['Governing law excludes this statute', 'other cause', NULL][(o_orderkey % 3 + 1)::INT] AS reason FROM o""",
    "law_names": "SELECT c_custkey, ['england', 'new york', 'france', NULL, 'ontario'][(c_custkey % 5 + 1)::INT] AS law, c_name AS party FROM customer",
    "page_boxes": "SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS line, l_quantity::INT AS x, (l_quantity::INT * 17 / 2550 * 1000)::DOUBLE AS grid, round_even(l_quantity::INT * 17 * 72 / 300.0, 2)::DOUBLE AS points FROM lineitem",
    "ocr_means": """WITH w AS (SELECT l_orderkey AS doc_id, ((l_linenumber - 1) // 3 + 1)::INT AS page, CASE WHEN l_returnflag <> 'N' THEN l_discount * 1000 END AS c FROM lineitem), m AS (SELECT doc_id, page, CASE WHEN page % 2 = 0 THEN 'ocr' ELSE 'native' END AS source, CASE WHEN page % 2 = 0 THEN round_even(avg(c) / 100, 3) END AS ocr_mean FROM w GROUP BY 1, 2)
 SELECT *, CASE WHEN ocr_mean * 10 >= 0.85 THEN 'high' WHEN ocr_mean * 10 >= 0.7 THEN 'moderate' WHEN ocr_mean IS NOT NULL THEN 'low' END AS band FROM m""",
    "provenances": """SELECT id, q AS quality, o AS ocr_applied, CASE WHEN q = 'degraded' THEN 'degraded' ELSE 'ready' END AS status FROM (SELECT id, o, CASE WHEN id % 4 IN (1, 3) THEN 'text_only' WHEN o THEN 'degraded' ELSE 'exact' END AS q FROM (SELECT o_orderkey AS id, o_orderkey % 6 = 0 AS o FROM orders))""",
    "party_choice": """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, max('Firm ' || l_returnflag || ' Ltd') AS name, max(l_linestatus) = 'O' AS g FROM lineitem GROUP BY 1, 2), q AS (SELECT k, name, min((CASE WHEN g THEN 0 ELSE 1 END) * 100 + n) AS o FROM p GROUP BY 1, 2),
 r AS (SELECT k, array_agg(name ORDER BY o) AS ns FROM q GROUP BY 1) SELECT k AS contract_id, CASE WHEN k % 2 = 0 THEN coalesce(list_filter(ns, lambda x: x <> 'Firm A Ltd')[1], ns[2], ns[1]) ELSE coalesce(ns[2], ns[1]) END AS counterparty FROM r""",
    "analyze_findings": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents)
 SELECT doc_id AS contract_id, 41::BIGINT AS n, 2::BIGINT AS present, 'unresolved' AS insurance, NOT list_bool_or(list_transform(w[4:9], lambda x: regexp_replace(x, '[^\p{L}\p{N}\p{M}_]+', '', 'g') = '')) AS met_all FROM d WHERE len(w) >= 10""",
    "finding_matrix": f"""WITH {_F}, k(o, c) AS (SELECT unnest(range(41))::INT, unnest({list(findings.CATEGORIES)!r})), m AS (SELECT c, o, value_verbatim AS v, confidence_tier <> 'unverified' AS g FROM d CROSS JOIN k LEFT JOIN f ON f.document_id = d.id AND f.field_key = c AND value_verbatim IS NOT NULL)
 SELECT c AS category, o AS category_ord, CASE WHEN v IS NULL THEN 'unresolved' ELSE 'present' END AS answer, CASE WHEN g THEN 'direct' ELSE 'unresolved' END AS evidence_status, NOT coalesce(g, false) AS needs_review, count(*) AS n, min(coalesce(v, '')) AS least FROM m GROUP BY 1, 2, 3, 4, 5""",
    "finding_fields": f"""WITH {_F}, k AS (SELECT id, unnest(['parties', 'expiration_date', 'governing_law', 'renewal_term', 'notice_period_to_terminate_renewal', 'exclusivity', 'insurance']) AS c FROM d)
 SELECT k.id AS contract_id, c AS category, value_verbatim, date, nullif(days, 0) AS days, nullif(months, 0) AS months, CASE WHEN value_verbatim IS NULL THEN 'inferred' WHEN confidence_tier = 'unverified' THEN 'unverified' WHEN coalesce(date::VARCHAR, nullif(days, 0)::VARCHAR, nullif(months, 0)::VARCHAR) IS NOT NULL THEN 'normalised' ELSE 'verbatim' END AS confidence_tier,
   CASE WHEN value_verbatim IS NULL THEN 'not_found' END AS absence_reason, CASE WHEN value_verbatim IS NOT NULL THEN round((f.id % 100) / 100.0, 3)::DOUBLE END AS consistency_score FROM k LEFT JOIN f ON f.document_id = k.id AND f.field_key = c""",
    "document_classes": """WITH h AS (SELECT doc_id, source, text, (CASE WHEN doc_id % 5 = 0 THEN 'mutual nda' ELSE '' END) || chr(10) || lower(left(text, 4000)) AS s FROM documents)
 SELECT doc_id, CASE WHEN doc_id % 4 <= 1 AND doc_id % 3 <> 0 THEN 'not_a_contract' WHEN regexp_matches(s, 'non-disclosure|nondisclosure|confidentiality agreement|mutual nda') THEN 'nda' WHEN regexp_matches(s, 'lease|landlord|tenant|leased premises|demised premises') THEN 'lease'
   WHEN regexp_matches(s, 'distribution agreement|distributor|reseller agreement') THEN 'distribution' WHEN regexp_matches(s, 'employment agreement|employee|the employee shall|job title') THEN 'employment' WHEN regexp_matches(s, 'master services agreement|services agreement|statement of work|master service') THEN 'msa' ELSE 'other' END AS doc_type,
   CASE WHEN (doc_id % 4 <= 1 AND doc_id % 3 <> 0) OR NOT regexp_matches(s, 'non-disclosure|nondisclosure|confidentiality agreement|mutual nda|lease|landlord|tenant|distribution agreement|distributor|reseller agreement|employment agreement|employee|job title|services agreement|statement of work|master service') THEN 0.6 ELSE 0.75 END::DOUBLE AS confidence,
   contains(lower(source), 'invoice') OR contains(lower(left(text, 400)), 'invoice') OR (SELECT count(*) FROM (VALUES ('bill to'), ('amount due'), ('remittance'), ('invoice number'), ('invoice no'), ('purchase order')) v(k) WHERE contains(lower(text), k)) >= 2 AS is_invoice FROM h""",
    "statute_list": f"WITH {_C} SELECT clause_key, ai_status, CASE WHEN ai_status = 'NA' THEN 'dependency_unavailable' END AS na_reason, (SELECT count(*) FROM events WHERE event_id % 25 = k) AS n_annotations FROM s",
    "statute_review": f"""WITH {_C}, a AS (SELECT event_id % 25 AS k, event_id AS e, ['human_verified', 'overridden', 'manual_review'][(event_id % 4 + 1)::INT] AS r FROM events WHERE event_id % 4 < 3)
 SELECT clause_key, coalesce((SELECT arg_max(r, e) FROM a WHERE a.k = s.k), 'open') AS review_status, (SELECT nullif(count(*), 0) FROM a WHERE a.k = s.k) AS n_actions FROM s""",
    "statute_applicable": f"""WITH {_F}, {_C}, t(doc_type, y) AS (VALUES ('nda', ['nda']), ('lease', ['lease', 'goods_hire']), ('msa', ['services', 'other_commercial']), ('distribution', ['distribution', 'other_commercial']), ('employment', ['employment']), ('other', ['other_commercial', 'ip_agreement'])),
 q AS (SELECT d.id, y, CASE WHEN v IS NULL THEN 'silent' WHEN v LIKE '%Singapore%' THEN 'singapore' ELSE 'excluded' END AS jur FROM d JOIN t USING (doc_type) LEFT JOIN (SELECT document_id, value_verbatim AS v FROM f WHERE n = 3) ON document_id = d.id),
 r AS (SELECT user_id, 'c' || (event_id % 25) AS clause_key FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), nn AS (SELECT user_id, 'c' || (event_id % 25) AS clause_key, count(*)::INT AS m FROM events GROUP BY ALL)
 SELECT q.id AS document_id, s.clause_key, jur AS jurisdiction, CASE WHEN jur = 'excluded' THEN 'NA' ELSE ai_status END AS status, CASE WHEN ai_status = 'NA' THEN 'dependency_unavailable' WHEN jur = 'excluded' THEN 'governing_law_excluded' END AS reason,
   CASE WHEN r.user_id IS NULL THEN 'open' ELSE 'overridden' END AS review_status, coalesce(m, -1) AS n_notes FROM q JOIN s ON list_has_any(y, types) LEFT JOIN r ON r.user_id = q.id AND r.clause_key = s.clause_key LEFT JOIN nn ON nn.user_id = q.id AND nn.clause_key = s.clause_key""",
    "retrieval_fields": f"""WITH {_F}, q AS (SELECT * FROM d WHERE status <> 'processing' AND doc_type NOT IN ('not_a_contract', 'invoice') ORDER BY id LIMIT 200)
 SELECT q.id, filename, doc_type, value_verbatim || '|' || confidence_tier AS fields FROM q JOIN f ON f.document_id = q.id AND n = 5 AND days >= 45 AND confidence_tier <> 'unverified' ORDER BY q.id LIMIT 50""",
    "retrieval_party": f"""WITH {_F} SELECT id, filename, counterparty FROM d WHERE status <> 'processing' AND doc_type = 'lease' AND (coalesce(contains(lower(counterparty), 'number1'), false) OR contains(filename, 'number1') OR id IN (SELECT document_id FROM f WHERE n = 1 AND contains(lower(value_verbatim), 'number1'))) ORDER BY id LIMIT 50""",
    "record_conflicts": f"""{_RUN} SELECT type AS conflict_type, CASE sev WHEN 'Critical' THEN 'high' WHEN 'Significant' THEN 'medium' ELSE 'low' END AS severity, CASE conf WHEN 'High' THEN 'verbatim' WHEN 'Medium' THEN 'assembled' ELSE 'inferred' END AS confidence_tier,
   a || ',' || b AS document_ids, fa || ',' || fb AS field_ids FROM z""",
    "record_briefs": f"""{_RUN} SELECT 'conflict:' || type AS trigger, sha256('Clause ' || ca || ' of order-' || a || '.pdf states "' || qa || '" while Clause ' || cb || ' of order-' || b || '.pdf states "' || qb || '". Which agreement governs, and does this create a breach?') AS question_sha256,
   a || ',' || b AS document_ids FROM z WHERE sev <> 'Administrative'""",
    "clause_scopes": """WITH s AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS kind, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END AS c FROM lineitem), n AS (SELECT k, kind, count(*) AS n, count(c) AS m FROM s GROUP BY 1, 2)
 SELECT kind, sum((n * (n - 1) - m * (m - 1)) / 2)::BIGINT AS n FROM n GROUP BY 1 HAVING sum((n * (n - 1) - m * (m - 1)) / 2) > 0""",
    "job_states": """WITH e AS (SELECT user_id AS job_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status, (event_id % 5)::INT AS attempts, ts, event_id FROM events),
 s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, list_position(['queued', 'running', 'done', 'failed'], status) DESC) = 1)
 SELECT job_id, CASE WHEN status = 'running' AND ts < TIMESTAMP '2024-01-31 11:45:00' THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE status END AS status, attempts FROM s""",
    "failed_documents": f"""WITH {_D}, x AS (SELECT *, status = 'processing' AND id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS gone FROM d) SELECT id, CASE WHEN gone THEN 'failed' ELSE status END AS status, CASE WHEN gone THEN 'Processing stalled and exceeded retries' END AS error FROM x""",
    "isolated_jobs": "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS done, CASE WHEN c_acctbal < 0 THEN 'balance of ' || c_custkey END AS error FROM customer",
    "versioned_documents": """SELECT o_custkey AS document_id, count(*) AS n_orders, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_reviewed, max(CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END)::BIGINT AS n_changes
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "written_documents": "SELECT c_nationkey AS document_id, count(*) * CASE WHEN c_nationkey < 5 THEN 10 ELSE 1 END AS n FROM customer GROUP BY 1",
    "folded_boxes": f"""WITH {_LI}, w AS (SELECT doc_id, page, line, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM l), g AS (SELECT * FROM w WHERE len(w) > 0)
 SELECT doc_id, page::BIGINT AS page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS line, 0::BIGINT AS x_min, (line * 50)::BIGINT AS y_min, ((len(w) - 1) * 100 + 90)::BIGINT AS x_max, (line * 50 + 30 + least(len(w) - 1, 2))::BIGINT AS y_max FROM g WHERE trim(array_to_string(w, ' ')) <> ''""",
}
