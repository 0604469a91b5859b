"""One document from words and answers to its findings: phrases are located, extractions assembled, categories answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlake.operators import findings, geometry, grounding, records
from pactlake.session import saved
from pactlake.sources import files

GRID = 1000


def located(words: DataFrame, answers: DataFrame, threshold: float = grounding.THRESHOLD) -> DataFrame:
    """contract_id, category, ord, found, score, recall, mass, verified and bbox of each answer on a page that has words.

    words(contract_id, page, word_ord, text, x_min, y_min, x_max, y_max, width_px, height_px); the box, on a grid of
    1000 by 1000, is around all words from the first that was met to the last.
    """
    key = F.concat_ws(":", F.col("contract_id").cast("string"), F.col("page").cast("string"))
    pages = words.groupBy("contract_id", "page", key.alias("page_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_ord", "text", "x_min", "y_min", "x_max", "y_max"))), lambda w: w).alias("w"), F.max("width_px").alias("width"), F.max("height_px").alias("height"))
    asked = answers.select(key.alias("page_key"), F.xxhash64("contract_id", "category", "ord").alias("phrase_id"), F.col("text").alias("phrase"), "contract_id", "category", "ord")
    met = grounding.ground_phrases(pages.select("page_key", F.transform("w", lambda w: w["text"]).alias("words")), asked.select("page_key", "phrase_id", "phrase"), threshold)
    span = F.slice("w", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    edge = lambda c, f, whole: f(F.transform(span, lambda w: w[c])) * GRID / F.col(whole)
    box = F.array(edge("x_min", F.array_min, "width"), edge("y_min", F.array_min, "height"), edge("x_max", F.array_max, "width"), edge("y_max", F.array_max, "height"))
    out = met.join(asked.drop("phrase"), ["page_key", "phrase_id"]).join(pages.select("page_key", "w", "width", "height"), "page_key")
    return out.select("contract_id", "category", "ord", F.col("text").alias("found"), "score", "recall", "mass", "verified", F.when(F.col("first").isNotNull(), box).alias("bbox"))


def analyze(contracts: DataFrame, words: DataFrame, answers: DataFrame, dimension: DataFrame, threshold: float = grounding.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """findings and extractions of contracts(contract_id), by answers(contract_id, category, ord, page, text, clause)."""
    extractions = findings.assembled(answers, located(words, answers, threshold))
    return findings.findings(contracts, extractions, dimension), extractions


def documents(found: DataFrame, extractions: DataFrame, about: DataFrame) -> DataFrame:
    """A row for each contract with its analysis as nested columns; about(contract_id, source_file, total_pages). It is what `contract_files` reads."""
    e = F.struct(
        "ord", "vlm_text", F.struct("page", F.col("bbox").alias("bbox_1000")).alias("location"), F.struct("page", "clause", F.col("supporting_text").alias("exact_supporting_text")).alias("source"),
        F.struct(F.col("supporting_text").alias("ocr_text"), "score", "recall", F.col("mass").alias("evidence_mass"), "is_grounded").alias("ocr_verification"))
    listed = extractions.groupBy("contract_id", "category").agg(F.array_sort(F.collect_list(e), lambda x, y: F.when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0)).alias("e"))
    plain = F.transform("e", lambda x: x.dropFields("ord"))
    one = F.struct("answer", "summary", "evidence_status", F.struct(F.col("needs_review").alias("flagged"), F.when(F.col("needs_review"), "not located on its page, or nothing found").otherwise("").alias("reason")).alias("review_flag"), F.coalesce(plain, F.array().cast(listed.select(plain).schema[0].dataType)).alias("extractions"))
    rows = found.join(listed, ["contract_id", "category"], "left").groupBy("contract_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("category_ord", "category", F.to_json(one).alias("f")))), lambda x: F.struct(x["category"].alias("k"), x["f"].alias("v")))).alias("m"))
    kind = found.join(listed, ["contract_id", "category"], "left").select(one.alias("x")).schema["x"].dataType
    return about.join(rows, "contract_id").select("contract_id", F.struct("source_file", "total_pages").alias("document_metadata"), F.transform_values("m", lambda _, v: F.from_json(v, kind)).alias("cuad_findings"))


def said_by(bodies: DataFrame, dimension: DataFrame) -> DataFrame:
    """answers, as `analyze` takes them, in a model's recorded bodies(contract_id, page, body): numbered by page and place within a category."""
    said = files.recorded_answers(bodies.withColumnRenamed("contract_id", "doc_id"), dimension)
    nth = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("page", "ord")) - 1
    return said.withColumn("nth", nth).select(F.col("doc_id").alias("contract_id"), "category", F.col("nth").alias("ord"), "page", "text", "clause")


NO_WORDS = "The document has no words"
DEGRADED = "Scanned document: its values were recognised and are less certain."
NO_CONTRACT = "This does not look like a contract, so no terms were taken from it."
SUSPECT = "Some values could not be found on their page and may be wrong."


def rows_of(uploads: DataFrame, words: DataFrame, bodies: DataFrame, threshold: float = grounding.THRESHOLD) -> dict[str, DataFrame]:
    """The portfolio's rows of uploads(document_id, filename): documents, fields, lines, extractions and events.

    words(document_id, page, word_ord, text, x_min, y_min, x_max, y_max, width_px, height_px, source), bodies(document_id,
    page, body). Each upload has a row in documents: one without words failed, one that isn't a contract has lines
    only. Fields are anchored to the lines that the box of their best extraction touches.
    """
    key = "document_id"
    dim = findings.dimension(uploads.sparkSession)
    own = words.join(uploads.select(key), key, "left_semi")
    w = own.withColumnRenamed(key, "contract_id")
    said = said_by(bodies.join(uploads.select(key), key, "left_semi").withColumnRenamed(key, "contract_id"), dim)
    extractions = saved(findings.assembled(said, located(w, said, threshold)), "extractions")
    found = saved(findings.findings(uploads.select(F.col(key).alias("contract_id")), extractions, dim), "found")

    folded = geometry.fold_lines(own.select(F.col(key).cast("string").alias("doc_id"), "page", "text", "x_min", "y_min", "x_max", "y_max"))
    lines = saved(geometry.line_offsets(folded), "lines")
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    pages = own.groupBy(key).agg(F.count_distinct("page").cast("int").alias("page_count"), F.bool_or(F.col("source") == "ocr").alias("any_ocr"))

    counts = findings.present_counts(found).withColumnRenamed("contract_id", key)
    names = found.filter("category = 'document_name'").select(F.col("contract_id").alias(key), F.col("summary").alias("name"))
    parties = extractions.filter("category = 'parties'").select("contract_id", "ord", F.coalesce(F.nullif("supporting_text", F.lit("")), "vlm_text").alias("said"), "is_grounded")
    other = records.counterparties(parties).withColumnRenamed("contract_id", key)
    at = uploads.select(key, "filename").join(whole.select(F.col("doc_id").cast(uploads.schema[key].dataType).alias(key), "body"), key, "left")
    at = at.join(pages, key, "left").join(counts, key, "left").join(names, key, "left").join(other, key, "left")
    body = F.coalesce("body", F.lit(""))
    kind = records.doc_type(F.col("name"), body, F.coalesce("n_present", F.lit(0)), F.coalesce("has_parties", F.lit(False)))
    at = at.withColumns({"k": kind, "p": records.provenance(F.col("filename"), F.col("any_ocr")), "none": F.col("page_count").isNull(), "invoice": records.looks_like_invoice(F.col("filename"), body)})
    at = at.withColumn("doc_type", F.when(F.col("invoice"), "invoice").otherwise(F.col("k.doc_type")))
    at = at.withColumn("is_contract", ~F.col("none") & ~F.col("doc_type").isin(*records.NOT_CONTRACTS))

    contracts = at.filter("is_contract").select(F.col(key).alias("contract_id"), "counterparty")
    its = lambda rows: rows.join(contracts.select("contract_id"), "contract_id", "left_semi").withColumnRenamed("contract_id", key)
    field_id = F.concat_ws(":", F.col(key).cast("string"), F.col("category"))
    fields = its(findings.fields(found, extractions)).withColumn("id", field_id).withColumnRenamed("category", "field_key")
    best = F.max_by(F.struct("page", "bbox"), F.struct("is_grounded", "score", -F.col("ord")))
    boxes = its(extractions).groupBy(key, "category").agg(best.alias("b")).withColumn("field_id", field_id)
    sizes = own.groupBy(key, "page").agg(F.max("width_px").alias("w"), F.max("height_px").alias("h"))
    boxes = boxes.select(key, "field_id", "b.page", "b.bbox").join(sizes, [key, "page"])
    edge = lambda i, size: F.col("bbox")[i] * F.col(size) / GRID
    boxes = boxes.select(F.col(key).cast("string").alias("doc_id"), "page", "field_id", edge(0, "w").alias("x0"), edge(1, "h").alias("y0"), edge(2, "w").alias("x1"), edge(3, "h").alias("y1"))
    met = geometry.anchors(boxes, lines).select(F.col("field_id").alias("id"), "anchors")
    anchored = F.when(F.col("confidence_tier") == "inferred", F.array().cast("array<string>")).otherwise(F.coalesce("anchors", F.array().cast("array<string>")))
    fields = fields.join(met, "id", "left").withColumn("anchor_line_ids", anchored).drop("anchors")

    unsure = fields.filter("confidence_tier = 'unverified'").select(key).distinct().withColumn("unsure", F.lit(True))
    told = records.warnings((F.col("p.quality") == "degraded", DEGRADED), (~F.col("is_contract") & ~F.col("invoice"), NO_CONTRACT), (F.coalesce("unsure", F.lit(False)), SUSPECT))
    fails = F.col("none")
    documents = at.join(unsure, key, "left").select(
        key, "filename", F.when(fails, "failed").otherwise(F.col("p.status")).alias("status"), F.when(fails, NO_WORDS).alias("error"), F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.when(~fails, F.col("doc_type")).alias("doc_type"), F.when(~fails & ~F.col("invoice"), F.col("k.confidence")).alias("doc_type_conf"), F.when(F.col("is_contract"), F.col("counterparty")).alias("counterparty"),
        F.when(~fails, F.col("p.quality")).alias("provenance"), F.coalesce("any_ocr", F.lit(False)).alias("ocr_applied"), F.when(~fails, told).otherwise(F.array().cast("array<string>")).alias("warnings"))
    kept = lines.withColumn(key, F.col("doc_id").cast(uploads.schema[key].dataType)).withColumnRenamed("page", "page_number").drop("doc_id")
    events = records.calendar_from_fields(fields, contracts.withColumnRenamed("contract_id", key))
    return {"documents": documents, "fields": fields, "lines": kept, "extractions": its(extractions), "events": events}
