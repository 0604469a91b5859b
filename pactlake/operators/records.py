"""Documents and their fields as the portfolio keeps them: lists, details, edits, integrity, classification.

Tables: documents(id, filename, status, doc_type, counterparty, uploaded_at), fields(id, document_id, field_key,
value_verbatim, value_normalized struct<date,days,months>, confidence_tier, claim_type, absence_reason,
anchor_line_ids, clause_label), lines(document_id, line_id, page_number, text), events(id, document_id, event_date,
action_by_date, confidence_tier, status), jobs(id, document_id, status, created_at).
"""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions import labels, text
from pactlake.operators.portfolio import latest

# Keywords of document types, the first that has one decides; signs of an invoice; suffixes of files that are text.
DOC_TYPES = (
    ("nda", ("non-disclosure", "nondisclosure", "confidentiality agreement", "mutual nda")),
    ("lease", ("lease", "landlord", "tenant", "leased premises", "demised premises")),
    ("distribution", ("distribution agreement", "distributor", "reseller agreement")),
    ("employment", ("employment agreement", "employee", "the employee shall", "job title")),
    ("msa", ("master services agreement", "services agreement", "statement of work", "master service")),
)
INVOICE_SIGNS = ("bill to", "amount due", "remittance", "invoice number", "invoice no", "purchase order")
TEXT_SUFFIXES = ("docx", "doc", "rtf", "odt", "html", "htm", "txt")
OPEN = ("open", "acknowledged")
NOT_CONTRACTS = ("not_a_contract", "invoice")


def looks_like_invoice(filename: Column, body: Column) -> Column:
    """By the file's name, the first 400 characters, or two signs in the text."""
    low = F.lower(body)
    signs = sum((low.contains(s).cast("int") for s in INVOICE_SIGNS), F.lit(0))
    return F.coalesce(F.lower(filename).contains("invoice"), F.lit(False)) | F.coalesce(F.lower(F.substring(body, 1, 400)).contains("invoice") | (signs >= 2), F.lit(False))


def doc_type(name: Column, body: Column, present: Column, has_parties: Column) -> Column:
    """struct(doc_type, confidence): no contract if at most one category is present and no parties; else the first kind of which the name or the first 4000 characters have a word."""
    head = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, 4000)))
    kind, sure = F.lit("other"), F.lit(0.6)
    for k, words in reversed(DOC_TYPES):
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(head, w))
        kind, sure = F.when(hit, k).otherwise(kind), F.when(hit, 0.75).otherwise(sure)
    none = (present <= 1) & ~has_parties
    return F.struct(F.when(none, "not_a_contract").otherwise(kind).alias("doc_type"), F.when(none, 0.6).otherwise(sure).alias("confidence"))


def html_text(html: Column) -> Column:
    """The words of a page without scripts, styles and tags, single spaces between."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " "))


def provenance(filename: Column, any_ocr: Column) -> Column:
    """struct(quality, ocr_applied, status) of a document by its suffix and whether a page was recognised."""
    suffix, ocr = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1)), F.coalesce(any_ocr, F.lit(False))
    textual = suffix.isin(*TEXT_SUFFIXES)
    quality = F.when(textual, "text_only").when(ocr, "degraded").otherwise("exact")
    return F.struct(quality.alias("quality"), ocr.alias("ocr_applied"), F.when(quality == "degraded", "degraded").otherwise("ready").alias("status"))


def warnings(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in rules)))


def page_confidence(words: DataFrame) -> DataFrame:
    """doc_id, page, source and the mean confidence of recognised pages, 0 to 1; unreadable confidences (below 0) don't count."""
    mean = F.avg(F.when((F.col("source") == "ocr") & (F.col("confidence") >= 0), F.col("confidence")))
    return words.groupBy("doc_id", "page").agg(F.min("source").alias("source"), F.bround(mean / 100, 3).alias("ocr_mean"))


def document_confidence(pages: DataFrame) -> DataFrame:
    """The mean of the means of a document's pages."""
    return pages.groupBy("doc_id").agg(F.avg("ocr_mean").alias("ocr_mean"))


def counterparties(parties: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """parties(contract_id, ord, said, is_grounded) to contract_id and counterparty.

    Names differ regardless of case, grounded ones come first. With a hint(contract_id, hint) of the own side it is
    the first that doesn't hold the hint, otherwise the second or the only one.
    """
    named = parties.withColumn("name", text.party_name(F.col("said"))).filter("name <> ''")
    firsts = named.groupBy("contract_id", F.lower("name").alias("key")).agg(F.min(F.struct((~F.col("is_grounded")).alias("late"), "ord", "name")).alias("f"))
    listed = firsts.groupBy("contract_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["name"]).alias("names"))
    second = F.coalesce(F.get("names", F.lit(1)), F.get("names", F.lit(0)))
    if hints is None:
        return listed.select("contract_id", second.alias("counterparty"))
    met = listed.join(hints, "contract_id", "left")
    other = F.get(F.filter("names", lambda n: ~F.contains(F.lower(n), F.lower("hint"))), F.lit(0))
    return met.select("contract_id", F.coalesce(F.when(F.col("hint") != "", other), second).alias("counterparty"))


def citation_pages(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """id and citation_page, that of a field's first anchor that is a line of its document; null if none is."""
    at = fields.select("id", "document_id", F.posexplode("anchor_line_ids").alias("pos", "line_id")).join(lines.select("document_id", "line_id", "page_number"), ["document_id", "line_id"])
    first = at.groupBy("id").agg(F.min_by("page_number", "pos").alias("citation_page"))
    return fields.select("id").join(first, "id", "left")


def next_actions(events: DataFrame) -> DataFrame:
    """The first day to act on of each document, by its open and acknowledged events."""
    return events.filter(F.col("status").isin(*OPEN)).groupBy("document_id").agg(F.min(F.coalesce("action_by_date", "event_date")).alias("next_action"))


def unsure_documents(fields: DataFrame) -> DataFrame:
    """Documents with an unverified, inferred or illegible field."""
    return fields.filter(F.col("confidence_tier").isin("unverified", "inferred") | F.coalesce(F.col("absence_reason") == "illegible", F.lit(False))).select("document_id").distinct()


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(str(offset).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    """The offset in a cursor; 0 for none and for what isn't one."""
    try:
        return max(0, int(base64.urlsafe_b64decode((cursor or "") + "==").decode()))
    except ValueError:
        return 0


#: Orders of lists: their column, and whether it ascends; equal ones go by id. Nulls are first where it ascends and last where not.
ORDERS = {"recent": ("uploaded_at", False), "oldest": ("uploaded_at", True), "name": ("filename", True)}


def key_cursor(sort: str) -> Column:
    """A cursor to what comes after a row in the order: the order, the row's key and its id."""
    told = F.to_json(F.array(F.lit(sort), F.col(ORDERS[sort][0]).cast("string"), F.col("id").cast("string")), {"ignoreNullFields": "false"})
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(told, "UTF-8")), r"\s", ""), "+/", "-_"), F.lit("="))


def after_cursor(documents: DataFrame, cursor: str | None, sort: str) -> DataFrame | None:
    """The documents after the row that a key cursor names, be it still there or not; None for a cursor that isn't one, ValueError for one of another order."""
    try:
        order, key, at = json.loads(base64.urlsafe_b64decode((cursor or "") + "=="))
    except (ValueError, TypeError):
        return None
    if order != sort:
        raise ValueError(f"a cursor of the order {order}, not {sort}")
    name, ascends = ORDERS[sort]
    c, value = F.col(name), F.lit(key).cast(documents.schema[name].dataType)
    further = F.col("id") > F.lit(at).cast(documents.schema["id"].dataType)
    if key is None:
        return documents.filter((c.isNull() & further) | c.isNotNull() if ascends else c.isNull() & further)
    if ascends:
        return documents.filter((c >= value) & ((c > value) | further))
    return documents.filter(((c <= value) & ((c < value) | further)) | c.isNull())


def document_list(documents: DataFrame, events: DataFrame, fields: DataFrame, status: str | None = None, doc_type: str | None = None, search: str | None = None, sort: str = "recent", cursor: str | None = None, limit: int = 50) -> DataFrame:
    """A page of documents in order with term_end, next_action, needs_review, nth, has_more and cursor.

    The cursor of a page's last row gives the next page by a filter on the key, so that each page reads like the first
    and rows that come or go don't shift it; a cursor of `encode_cursor` counts rows from the start.
    status: comma-separated; search: part of the file name or counterparty, whatever the case; sort: recent, oldest or name.
    """
    kept = documents
    if status:
        kept = kept.filter(F.col("status").isin(*(s.strip() for s in status.split(","))))
    if doc_type:
        kept = kept.filter(F.col("doc_type") == doc_type)
    if search:
        kept = kept.filter(F.lower("filename").contains(search.lower()) | F.coalesce(F.lower("counterparty").contains(search.lower()), F.lit(False)))
    name, ascends = ORDERS[sort]
    order, rest = F.asc(name) if ascends else F.desc(name), after_cursor(kept, cursor, sort)
    page = (kept.orderBy(order, "id").offset(decode_cursor(cursor)) if rest is None else rest.orderBy(order, "id")).limit(limit + 1)
    listed = page.groupBy().agg(F.collect_list(F.struct(*documents.columns)).alias("rows"))  # at most a page and one row
    shown = listed.select((F.size("rows") > limit).alias("has_more"), F.posexplode(F.slice("rows", 1, limit)).alias("nth", "d")).select("nth", "has_more", "d.*").withColumn("cursor", key_cursor(sort))
    ends = fields.filter("field_key = 'expiration_date'").groupBy(F.col("document_id").alias("id")).agg(F.max_by(F.coalesce(F.col("value_normalized.date").cast("string"), "value_verbatim"), F.col("id")).alias("term_end"))
    acts, unsure = next_actions(events).withColumnRenamed("document_id", "id"), unsure_documents(fields).select(F.col("document_id").alias("id"), F.lit(True).alias("unsure"))
    few = F.broadcast(shown.select("id"))  # a page
    for more in (ends, acts, unsure):
        shown = shown.join(more.join(few, "id", "left_semi"), "id", "left")
    return shown.withColumn("needs_review", F.coalesce("unsure", F.lit(False)) | (F.col("status") == "degraded")).drop("unsure")


def review_queue(listed: DataFrame) -> DataFrame:
    """Documents to review by their next action, those without one last."""
    return listed.filter("needs_review").orderBy(F.asc_nulls_last("next_action"), "id")


def upcoming(events: DataFrame, as_of: str, days: int = 90, show: int = 6) -> DataFrame:
    """The first open events within the days to come, and how many are overdue, beside each."""
    today = F.lit(as_of).cast("date")
    live = events.filter(F.col("status").isin(*OPEN)).withColumn("effective", F.coalesce("action_by_date", "event_date"))
    late = live.agg(F.count_if(F.col("effective") < today).alias("n_overdue"))
    return live.filter((F.col("effective") >= today) & (F.col("effective") <= F.date_add(today, days))).orderBy("effective", "event_date", "id").limit(show).crossJoin(F.broadcast(late))  # one row


def document_detail(documents: DataFrame, pages: DataFrame, fields: DataFrame, lines: DataFrame, jobs: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """A row for each document with its pages, its fields by key with citation pages, its latest job and invoice match."""
    of_pages = pages.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("page_number", *(c for c in pages.columns if c not in ("page_number", "document_id"))))).alias("pages"))
    cited = fields.join(citation_pages(fields, lines), "id")
    shown = F.struct("field_key", F.col("id"), "value_verbatim", "confidence_tier", "claim_type", "absence_reason", "clause_label", "citation_page")
    of_fields = cited.groupBy("document_id").agg(F.array_sort(F.collect_list(shown)).alias("fields")).withColumnRenamed("document_id", "id")
    newest = lambda rows, order: latest(rows, ["document_id"], order)
    job = newest(jobs, [F.desc("created_at"), F.desc("id")]).select(F.col("document_id").alias("id"), F.struct(*(c for c in jobs.columns if c != "document_id")).alias("job"))
    out = documents
    for more in (of_pages, of_fields, job):
        out = out.join(more, "id", "left")
    if matches is not None:
        best = newest(matches, [F.desc("created_at"), F.desc("id")]).select(F.col("document_id").alias("id"), "contract_id", F.struct("status", "confidence_tier", "reasons").alias("match"))
        named = documents.select(F.col("id").alias("contract_id"), F.struct("id", "filename", "counterparty").alias("contract"))
        out = out.join(best.join(named, "contract_id", "left").drop("contract_id"), "id", "left")
    return out


def anchors_of(lines: DataFrame, document_id, line_ids: str) -> DataFrame:
    """The lines of a document that a comma-separated list names."""
    wanted = [s.strip() for s in line_ids.split(",") if s.strip()]
    return lines.filter((F.col("document_id") == document_id) & F.col("line_id").isin(*wanted)) if wanted else lines.limit(0)


def status_of(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """id, status, stage and progress of each document by its latest job."""
    job = latest(jobs, ["document_id"], [F.desc("created_at"), F.desc("id")]).select(F.col("document_id").alias("id"), "stage", "progress")
    return documents.select("id", "status").join(job, "id", "left").withColumn("progress", F.coalesce("progress", F.lit(0.0)))


def edit_fields(fields: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """Fields with edits(id, document_id, state, has_value, value, has_clause, clause_label, edited_by) taken in.

    The state gives the tier; na, or a null value, makes the field absent. An edit that names another document changes nothing.
    Of several edits of one field the last holds, by the column `at` if there is one; of equal ones the greatest by its values.
    """
    said = ("state", "has_value", "value", "has_clause", "clause_label", "edited_by")
    last = edits.groupBy("id", "document_id").agg(F.max(F.struct(*(c for c in ("at",) if c in edits.columns), *said)).alias("e"))
    e = last.select("id", "document_id", *(F.col(f"e.{c}").alias(f"e_{c}") for c in said))
    met = fields.join(e, ["id", "document_id"], "left")
    hit = F.col("e_state").isNotNull()
    value = F.when(F.col("e_state") == "na", None).when(F.col("e_has_value"), F.col("e_value")).otherwise(F.col("value_verbatim"))
    new = {
        "value_verbatim": value, "confidence_tier": labels.mapped(F.col("e_state"), labels.EDIT_TIERS, "inferred"), "absence_reason": F.when(value.isNull(), "not_present"),
        "clause_label": F.when(F.col("e_has_clause"), F.col("e_clause_label")).otherwise(F.col("clause_label")),
    }
    said = {"human_edited": F.lit(True), "edited_by": F.col("e_edited_by"), "edited_at": F.lit(now).cast("timestamp")}
    plain = {"human_edited": F.lit(False), "edited_by": F.lit(None).cast("string"), "edited_at": F.lit(None).cast("timestamp")}
    for c in said:
        new[c] = said[c]
        if c not in fields.columns:
            met = met.withColumn(c, plain[c])
    return met.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in dict.fromkeys([*fields.columns, *said])))


def integrity(fields: DataFrame, lines: DataFrame, events: DataFrame) -> DataFrame:
    """kind, id and detail of each violation: dangling anchors, unknown tiers, absent values without a reason, actions due after their event."""
    at = fields.select("id", "document_id", F.explode("anchor_line_ids").alias("line_id"))
    dangling = at.join(lines.select("document_id", "line_id").distinct(), ["document_id", "line_id"], "left_anti").select(F.lit("dangling_anchor").alias("kind"), "id", F.col("line_id").alias("detail"))
    tier = fields.filter(~F.col("confidence_tier").isin(*labels.TIERS)).select(F.lit("bad_tier").alias("kind"), "id", F.col("confidence_tier").alias("detail"))
    none = fields.filter(F.col("value_verbatim").isNull() & (F.coalesce("absence_reason", F.lit("")) == "")).select(F.lit("missing_absence").alias("kind"), "id", F.lit(None).cast("string").alias("detail"))
    late = events.filter("action_by_date > event_date").select(F.lit("late_action").alias("kind"), "id", F.col("action_by_date").cast("string").alias("detail"))
    return dangling.unionByName(tier).unionByName(none).unionByName(late)


def update_status(rows: DataFrame, patches: DataFrame, allowed: Sequence[str] = ("open", "acknowledged", "dismissed")) -> DataFrame:
    """Rows with the status of patches(id, status) where it is an allowed one: the last of an id by the column `at` if there is one, of equal ones the greatest."""
    last = F.max(F.struct(*(c for c in ("at",) if c in patches.columns), "status"))
    p = patches.filter(F.col("status").isin(*allowed)).groupBy("id").agg(last.alias("p")).select("id", F.col("p.status").alias("__new"))
    return rows.join(p, "id", "left").withColumn("status", F.coalesce("__new", "status")).select(*rows.columns)


def upload_outcomes(entries: DataFrame) -> DataFrame:
    """created, duplicates, rejected and the response's code, of entries(status, duplicate), in one row."""
    again = F.coalesce("duplicate", F.lit(False))
    bad = ~again & (F.col("status") == "unsupported")
    return entries.agg(F.count_if(~again & ~bad).alias("created"), F.count_if(again).alias("duplicates"), F.count_if(bad).alias("rejected"), F.when(F.bool_and(again), 200).otherwise(201).alias("code"))


def field_dto(fields: DataFrame) -> DataFrame:
    """Fields as JSON objects, a tier and a claim in each; days without a time."""
    shown = F.struct(
        F.col("id").cast("string").alias("id"), F.col("document_id").cast("string").alias("documentId"), F.col("field_key").alias("fieldKey"), F.col("value_verbatim").alias("valueVerbatim"),
        F.coalesce("confidence_tier", F.lit("unverified")).alias("confidenceTier"), F.coalesce("claim_type", F.lit("contract_text")).alias("claimType"), F.col("absence_reason").alias("absenceReason"),
        F.coalesce("anchor_line_ids", F.array().cast("array<string>")).alias("anchorLineIds"), F.col("clause_label").alias("clauseLabel"))
    return fields.select("id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("dto"))


def event_dto(events: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    shown = F.struct(F.col("id").cast("string").alias("id"), F.col("document_id").cast("string").alias("documentId"), day("event_date").alias("eventDate"), day("action_by_date").alias("actionByDate"), F.col("confidence_tier").alias("confidenceTier"), "status")
    return events.select("id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("dto"))


def storage_path(root: str, digest: Column, suffix: Column) -> Column:
    """Where a file of a content goes: root/originals/ab/digest.suffix."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.lit("originals"), F.substring(digest, 1, 2), F.concat(digest, F.lit("."), suffix))


def calendar_from_fields(fields: DataFrame, who: DataFrame | None = None) -> DataFrame:
    """An event for each document with a usable expiry: unverified values count for nothing, a read renewal makes it an auto-renewal, a notice moves the day to act."""
    usable = F.when(F.col("confidence_tier") != "unverified", F.col("value_normalized"))
    pick = lambda key, part: F.max(F.when(F.col("field_key") == key, usable[part]))
    renewed = F.max(F.when((F.col("field_key") == "renewal_term") & usable.isNotNull() & F.col("value_verbatim").isNotNull(), F.lit(True)))
    one = fields.groupBy("document_id").agg(pick("expiration_date", "date").alias("event_date"), pick("notice_period_to_terminate_renewal", "days").alias("notice"), F.coalesce(renewed, F.lit(False)).alias("renews")).filter("event_date is not null")
    act = F.when(F.col("notice").isNotNull(), F.date_sub("event_date", F.col("notice")))
    named = one.join(who, "document_id", "left") if who is not None else one.withColumn("counterparty", F.lit(None).cast("string"))
    name = F.coalesce("counterparty", F.lit("the counterparty"))
    title = F.when(F.col("renews"), F.concat(F.lit("Renewal decision for "), name)).otherwise(F.concat(F.lit("Agreement with "), name, F.lit(" expires")))
    tier = F.when(F.col("renews") & act.isNotNull(), "assembled").otherwise("normalised")
    return named.select("document_id", F.when(F.col("renews"), "auto_renewal").otherwise("expiry").alias("event_type"), "event_date", act.alias("action_by_date"), title.alias("title"), tier.alias("confidence_tier"), F.lit("open").alias("status"))
