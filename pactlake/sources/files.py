"""Readers: uploads with their kind, contract and statute JSON, page words, recorded model answers."""

from __future__ import annotations

import os
import random
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.functions.text import json_object

# What goes to which converter, the size limit, and the first bytes of known kinds.
OFFICE = ("docx", "doc", "rtf", "odt")
IMAGE = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "gif", "webp")
ROUTES = {"pdf": ("pdf",), "office": OFFICE, "html": ("html", "htm"), "image": IMAGE}
MAX_BYTES = 50 * 1024 * 1024
MAGIC = (("25504446", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("49492A00", "tiff"), ("4D4D002A", "tiff"))
ZIP, OOXML_FIRST = "504B0304", "[Content_Types].xml"
CONTRACT = (
    "contract_id string, document_metadata struct<source_file:string,total_pages:int>, counterparties array<string>, assets array<string>, contract_family string, amends string, "
    "cuad_findings map<string,struct<answer:string,summary:string,evidence_status:string,extractions:array<struct<vlm_text:string,location:struct<page:int,bbox_1000:array<double>>,"
    "source:struct<page:int,clause:string,exact_supporting_text:string>,ocr_verification:struct<score:double,recall:double,evidence_mass:double,is_grounded:boolean>>>>>"
)
STATUTE = "id string, source string, provision string, exact_wording string, summary string, authority_basis string, engine_status string, extraction_schema_status array<struct<target_field:string,status:string>>, target_fields array<string>, applicable_contract_types array<string>, case_citation string"


def route(path: Column) -> Column:
    """The converter of a file by its suffix; null if there is none."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for name, suffixes in ROUTES.items():
        out = F.when(suffix.isin(*suffixes), name).otherwise(out)
    return out


def _valid_head(content: Column, n: int = 512) -> Column:
    """The first n bytes as text, a code point that the cut parts left out; null if they aren't UTF-8."""
    whole = F.octet_length(content) <= n
    cuts = [F.try_validate_utf8(F.substring(content, 1, n - less).cast("string")) for less in range(4)]
    return F.when(whole, cuts[0]).otherwise(F.coalesce(*cuts))


def sniff(content: Column) -> Column:
    """The kind of a file by its first bytes: a known magic, a zip whose first entry tells of an office file, or text.

    Text is UTF-8 without NUL and U+FFFD of which over 95 % is printable: code points counted against UTF-16 units. An empty file is text.
    """
    hexed, said = F.hex(F.substring(content, 1, 8)), _valid_head(content)
    printable = F.length(F.regexp_replace(said, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    units = 2 * F.length(said) - F.length(F.regexp_replace(said, r"[\x{10000}-\x{10FFFF}]", ""))
    plain = ~said.contains("\x00") & ~said.contains("\ufffd") & (printable > 0.95 * units)
    out = F.when((F.octet_length(content) == 0) | plain, "text")
    size = F.hex(F.substring(content, 27, 2)) == f"{len(OOXML_FIRST):02X}00"
    first = F.substring(content, 31, len(OOXML_FIRST)) == F.lit(OOXML_FIRST.encode())
    out = F.when(hexed.startswith(ZIP) & size & first, "ooxml").otherwise(out)
    for start, kind in reversed(MAGIC):
        out = F.when(hexed.startswith(start), kind).otherwise(out)
    return out


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256, kind, route and status of each file; too large and unknown ones are `unsupported` under a key of their own."""
    f = spark.read.format("binaryFile").load(folder)
    kind = sniff(F.col("content"))
    bad = F.when(F.col("length") > MAX_BYTES, "too_large").when(kind.isNull(), "unknown_type")
    digest = F.sha2("content", 256)
    return f.select("path", F.col("length").alias("bytes"), F.when(bad.isNull(), digest).otherwise(F.concat(F.lit("unsupported:"), digest)).alias("sha256"), kind.alias("kind"), route(F.col("path")).alias("route"), F.when(bad.isNull(), "queued").otherwise("unsupported").alias("status"), bad.alias("reason"))


def _known(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).isin("NA", ""), None).otherwise(c)


def contract_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Contracts of JSON files with doc_ord, by the order of the paths or of the files' names; an id that is missing is the source file's name, or the file's own. NA and blank values are null.

    Files are told apart by their whole paths; a path that is named twice is read once.
    """
    local = lambda p: re.sub(r"^file:/+", "/", p) if re.match(r"\w+:", p) else os.path.abspath(p)
    if not isinstance(paths, str):
        first: dict[str, str] = {}
        for p in paths:
            first.setdefault(local(p), p)
        paths = list(first.values())
    raw = spark.read.schema(CONTRACT).option("multiLine", True).json(paths)
    whole = F.regexp_replace(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    raw = raw.withColumns({"whole": whole, "file": F.regexp_extract(whole, r"([^/]+)$", 1)})
    if isinstance(paths, str):
        raw = raw.orderBy("file", "whole").withColumn("doc_ord", F.monotonically_increasing_id())
    else:
        place = F.create_map(*(F.lit(x) for k, p in enumerate(paths) for x in (local(p), k)))
        raw = raw.withColumn("doc_ord", place[F.col("whole")].cast("bigint"))
    return named_contracts(raw)


def named_contracts(raw: DataFrame) -> DataFrame:
    """Contracts as they are read, with the file's name in file and their place in doc_ord: ids filled in, NA and blank values null."""
    said = lambda c: F.nullif(c, F.lit(""))
    listed = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: _known(x).isNotNull()).alias(c)
    ids = F.coalesce(said(F.col("contract_id")), said(F.col("document_metadata.source_file")), F.regexp_replace("file", r"\.[^.]*$", ""))
    return raw.select(ids.alias("contract_id"), "doc_ord", F.coalesce(said(F.col("document_metadata.source_file")), ids).alias("source_file"), listed("counterparties"), listed("assets"), _known(F.trim("contract_family")).alias("family"), _known(F.trim("amends")).alias("amends"), "cuad_findings")


def contract_tables(contracts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, findings and extractions of contracts as `contract_files` reads them."""
    f = contracts.select("contract_id", F.explode("cuad_findings").alias("category", "f"))
    findings = f.select("contract_id", "category", "f.answer", "f.summary", F.coalesce("f.evidence_status", F.lit("unresolved")).alias("evidence_status"))
    e = f.select("contract_id", "category", F.posexplode("f.extractions").alias("ord", "e"))
    extractions = e.select("contract_id", "category", "ord", "e.vlm_text", F.col("e.source.exact_supporting_text").alias("supporting_text"), F.coalesce(F.nullif("e.source.page", F.lit(0)), "e.location.page").alias("page"), F.nullif("e.source.clause", F.lit("")).alias("clause"), F.coalesce("e.ocr_verification.is_grounded", F.lit(False)).alias("is_grounded"))
    return contracts.drop("cuad_findings"), findings, extractions


def statute_chunks(raw: DataFrame) -> DataFrame:
    """Chunks with the statuses of their fields as an array, for `statutes.clauses`."""
    return raw.withColumn("statuses", F.transform("extraction_schema_status", lambda x: x["status"]))


def statute_files(spark: SparkSession, folder: str) -> DataFrame:
    """Statute chunks of JSON arrays; rows without an id go."""
    return spark.read.schema(STATUTE).option("multiLine", True).json(folder).filter("id is not null and id <> ''")


def native_words(words: DataFrame, dims: DataFrame) -> DataFrame:
    """Words of the text layer in points to pixels of the rendered page; pages without a word give none."""
    scaled = words.filter(F.trim("text") != "").join(dims, ["doc_id", "page"])
    at = lambda c, p: F.bround(F.col(c) * F.col(f"{p}_px") / F.col(f"{p}_pt")).cast("int")
    return scaled.select("doc_id", "page", "word_ord", "text", at("x0", "width").alias("x_min"), at("y0", "height").alias("y_min"), at("x1", "width").alias("x_max"), at("y1", "height").alias("y_max"), F.lit(100.0).alias("confidence"), F.lit("native").alias("source"))


def ocr_words(tokens: DataFrame) -> DataFrame:
    """Recognised tokens with left, top, width and height; blank ones go, a confidence that isn't a number is -1."""
    return tokens.filter(F.trim("text") != "").select("doc_id", "page", "word_ord", "text", F.col("left").alias("x_min"), F.col("top").alias("y_min"), (F.col("left") + F.col("width")).alias("x_max"), (F.col("top") + F.col("height")).alias("y_max"), F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)).alias("confidence"), F.lit("ocr").alias("source"))


def page_words(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Native words, and recognised ones of the pages that have none."""
    have = native.select("doc_id", "page").distinct()
    return native.unionByName(ocr.join(have, ["doc_id", "page"], "left_anti"))


ANSWER = "array<struct<category:string,text:string,clause:string,confidence:double>>"


def recorded_answers(responses: DataFrame, categories: DataFrame) -> DataFrame:
    """Extractions in recorded model answers(doc_id, page, body): malformed bodies, unknown categories and empty texts give none."""
    body = json_object(F.col("body"))
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    rows = responses.select("doc_id", "page", F.posexplode(F.from_json(listed, ANSWER, {"mode": "PERMISSIVE"})).alias("ord", "x")).select("doc_id", "page", "ord", "x.*")
    return rows.filter(F.trim("text") != "").join(F.broadcast(categories.select("category")), "category", "left_semi")  # forty-one rows


CONVERTED = "path string, route string, pdf binary, n_pages int, error string"


def pdf_pages(raw: bytes) -> int:
    """Pages that a PDF's plain objects tell of; ValueError if it is none or has none. Compressed object streams need a reader of their own."""
    if not raw.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    n = sum(not raw[i + len(b"/Type"):].lstrip().startswith(b"/Pages") and raw[i + len(b"/Type"):].lstrip().startswith(b"/Page") for i in _places(raw, b"/Type"))
    if not n:
        raise ValueError("a PDF without a page")
    return n


def _places(raw: bytes, what: bytes) -> Iterator[int]:
    at = raw.find(what)
    while at >= 0:
        yield at
        at = raw.find(what, at + 1)


def convert(files: DataFrame, converters: Mapping[str, Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """files(path, content) as PDF: those of a route with a converter through it, PDFs as they are; what fails has an error and stops nothing.

    Converters for office files, web pages and images are programs that a cluster may have; none comes with this package.
    """
    known = dict(converters or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                pdf = n = error = None
                try:
                    if r.route is None:
                        raise ValueError("no converter takes this kind of file")
                    if r.route != "pdf" and r.route not in known:
                        raise ValueError(f"no converter for {r.route} here")
                    pdf = bytes(r.content) if r.route == "pdf" else known[r.route](bytes(r.content))
                    n = pdf_pages(pdf)
                except Exception as wrong:  # a poisoned file is a row of its own
                    pdf, error = None, str(wrong)[:2000]
                rows.append((r.path, r.route, pdf, n, error))
            yield pd.DataFrame(rows, columns=["path", "route", "pdf", "n_pages", "error"]).astype({"n_pages": "Int32"})

    return files.select("path", route(F.col("path")).alias("route"), "content").mapInPandas(run, CONVERTED)


class Provider(Protocol):
    """Answers a prompt about a page; `retryable` says whether asking again may help after an error."""

    def ask(self, page: bytes | None, prompt: str) -> str: ...

    def retryable(self, error: Exception) -> bool: ...


#: Seconds between attempts and what a server says when it may answer later.
BACKOFF, RETRY_STATUS = (1.0, 2.0, 4.0), (429, 500, 502, 503, 504)


def asked(provider: Provider, page: bytes | None, prompt: str, wait: Callable[[float], Any] = time.sleep) -> str:
    """An answer after four attempts at most; an error that asking again can't mend is raised at once."""
    for pause in (*BACKOFF, None):
        try:
            return provider.ask(page, prompt)
        except Exception as error:
            if pause is None or not provider.retryable(error):
                raise
            wait(pause)
    raise AssertionError


def answers(pages: DataFrame, prompts: DataFrame, make: Callable[[], Provider], tasks: int) -> DataFrame:
    """pages(doc_id, page, image) asked each of prompts(category, prompt): doc_id, page, category, body and error; one that fails leaves the others.

    One prompt asks about all categories at once, forty-one ask about each. A task makes its own provider.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                body = error = None
                try:
                    body = asked(provider, r.image, r.prompt)
                except Exception as wrong:
                    error = str(wrong)[:2000]
                rows.append((r.doc_id, r.page, r.category, body, error))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "category", "body", "error"])

    each = pages.crossJoin(F.broadcast(prompts)).select("doc_id", "page", "category", "image", "prompt")  # one prompt, or forty-one
    kind = pages.schema["doc_id"].dataType.simpleString()
    return each.repartition(tasks).mapInPandas(run, f"doc_id {kind}, page int, category string, body string, error string")


def settings(lines: Sequence[str], environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines of a settings file: the environment's values come first, then the first line of each key; quotes around values and comments go."""
    out: dict[str, str] = dict(environment or {})
    for line in lines:
        k, sign, v = line.strip().removeprefix("export ").partition("=")
        if sign and not k.startswith("#") and k.strip() not in out:
            v = v.strip()
            out[k.strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    return out


def demo_corpus(spark: SparkSession, contracts: int, as_of: str, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, lines and fields of made-up contracts of nine kinds, the same for the same seed: terms around as_of, each third one renewing."""
    rnd, kinds = random.Random(seed), ("nda", "lease", "msa", "distribution", "employment", "other", "other", "invoice", "not_a_contract")
    rows = [(i, f"contract-{i:05}.pdf", "ready" if rnd.random() < 0.9 else "degraded", kinds[i % 9], f"Party {rnd.randrange(contracts)} Ltd", rnd.randrange(-400, 400), rnd.choice([30, 60, 90])) for i in range(contracts)]
    d = spark.createDataFrame(rows, "id bigint, filename string, status string, doc_type string, counterparty string, days int, notice int")
    end = F.date_add(F.lit(as_of).cast("date"), F.col("days"))
    said = F.array(
        F.struct(F.lit("parties").alias("k"), F.concat("counterparty", F.lit(" and Owner Pte")).alias("v")), F.struct(F.lit("expiration_date").alias("k"), F.date_format(end, "MMMM d, yyyy").alias("v")),
        F.struct(F.lit("notice_period_to_terminate_renewal").alias("k"), F.format_string("(%d) days", "notice").alias("v")), F.struct(F.lit("renewal_term").alias("k"), F.when(F.col("id") % 3 == 0, "one (1) year").alias("v")))
    f = d.select(F.col("id").alias("document_id"), F.posexplode(said).alias("n", "x")).select("document_id", (F.col("n") + 1).alias("line"), F.col("x.k").alias("field_key"), F.col("x.v").alias("value_verbatim"))
    line_id = F.format_string("L%04d", "line")
    lines = f.filter("value_verbatim is not null").select("document_id", line_id.alias("line_id"), F.lit(1).alias("page_number"), F.col("value_verbatim").alias("text"))
    fields = f.select((F.col("document_id") * 10 + F.col("line")).alias("id"), "document_id", "field_key", "value_verbatim", F.when(F.col("value_verbatim").isNull(), "inferred").otherwise("verbatim").alias("confidence_tier"), F.when(F.col("value_verbatim").isNull(), "not_found").alias("absence_reason"), F.when(F.col("value_verbatim").isNotNull(), F.array(line_id)).otherwise(F.array().cast("array<string>")).alias("anchor_line_ids"))
    return d.drop("days", "notice"), lines, fields
