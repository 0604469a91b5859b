"""Operators on small tables with known answers."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pactlake.functions import labels, text
from pactlake.operators import clause_conflicts, findings, geometry, grounding, portfolio, records, retrieval, sinks, vocabulary
from pactlake.sources import files
from pactlake.streaming import jobs

D = dt.date


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("said", "field", "conflict"), [
    ("signed 2026-03-15.", D(2026, 3, 15), D(2026, 3, 15)), ("2026/3/5", D(2026, 3, 5), D(2026, 3, 5)), ("Mar. 15th 2026", D(2026, 3, 15), D(2026, 3, 15)), ("March 15, 2026", D(2026, 3, 15), D(2026, 3, 15)),
    ("15th day of March, 2026", D(2026, 3, 15), None), ("3/15/2026", D(2026, 3, 15), None), ("2024-02-30 and March 1, 2024", None, None), ("no date", None, None), (None, None, None), ("", None, None),
])
def test_dates(spark, said, field, conflict):
    df = spark.createDataFrame([(said,)], "t string").select(text.parse_date(F.col("t")).alias("a"), text.parse_date(F.col("t"), False).alias("b")).first()
    assert (df.a, df.b) == (field, conflict)


@pytest.mark.parametrize(("said", "days", "months"), [
    ("thirty (30) days", 30, None), ("two weeks", 14, None), ("twenty-four (24) months", 720, 24), ("3 years", 1095, 36), ("30 days' notice per year", 30, 360), ("soon", None, None), (None, None, None),
])
def test_durations(spark, said, days, months):
    r = spark.createDataFrame([(said,)], "t string").select(text.duration_days(F.col("t")).alias("a"), text.duration_months(F.col("t")).alias("b")).first()
    assert (r.a, r.b) == (days, months)


def test_names(spark):
    assert one(spark, text.normalize_entity(F.col("n")), n='The Acme "Flooring" Co., Ltd. (the Buyer)') == "acme flooring"
    assert one(spark, text.normalize_invoice_party(F.col("n")), n="Co. Ltd") == "co ltd"
    assert one(spark, text.match_method(F.col("a"), F.col("b")), a="acme", b="acme distribution") == "fuzzy"
    assert one(spark, text.match_method(F.col("a"), F.col("b")), a="north distribution", b="acme distribution") is None
    assert one(spark, text.entities_match(F.col("a"), F.col("b")), a="buyer", b="buyer north") is False
    assert one(spark, F.to_json(text.party_names(F.col("t"))), t="Acme Inc and Beta LLC; X, Gamma Ltd") == '["Acme Inc","Beta LLC","Gamma Ltd"]'
    assert one(spark, F.to_json(text.asset_phrases(F.col("t"))), t="the Blue Harbor Trademarks and This Agreement") == '["blue harbor trademarks"]'
    assert one(spark, text.to_number(F.col("t")), t="USD -1,234.50") == -1234.5
    assert one(spark, text.clean_token(F.col("t")), t="«Étage»,") == "étage"
    assert [one(spark, text.jurisdiction(F.col("t")), t=x) for x in ("", "Laws of Singapore", "Delaware")] == ["silent", "singapore", "excluded"]


def test_labels(spark):
    df = spark.createDataFrame([(d,) for d in ("2024-01-01", "2024-01-09", "2024-01-10", "2024-04-09", "2024-04-10")], "d string")
    got = [r.b for r in df.select(labels.date_band(F.to_date("d"), F.lit("2024-01-02").cast("date")).alias("b")).collect()]
    assert got == ["overdue", "this_week", "next_30", "later", "later"]
    assert one(spark, labels.worst(F.col("a"), F.col("b")), a="high", b="low") == "low"
    assert one(spark, labels.ocr_band(F.col("a")), a=0.7) == "moderate"
    assert one(spark, labels.worse_percent(F.col("v"), F.col("a"), "higher_better"), v=80.0, a=100.0) == 20
    assert one(spark, labels.relative_days(F.to_date("a"), F.to_date("b")), a="2024-01-02", b="2024-01-01") == "tomorrow"
    assert [one(spark, labels.relative_days(F.to_date("a"), F.to_date("b")), a=x, b="2024-01-10") for x in ("2024-01-10", "2024-01-09", "2024-01-02", "2024-01-20")] == ["today", "overdue by 1 day", "overdue by 8 days", "in 10 days"]


def test_clause_engine(spark):
    rows = [("A", 1, "room", True, False, D(2026, 1, 1), D(2026, 5, 31)), ("B", 1, "room", True, False, D(2026, 5, 31), None), ("C", 1, "room", True, False, D(2025, 1, 1), D(2025, 12, 31)), ("D", 1, None, True, False, None, None), ("E", 1, "room", True, True, None, None)]
    c = spark.createDataFrame(rows, "contract_id string, clause_id int, asset_id string, is_exclusive boolean, superseded boolean, start date, end date")
    assert [(r.contract_id_a, r.contract_id_b) for r in clause_conflicts.asset_overlap(c).collect()] == [("A", "B")]
    m = spark.createDataFrame([("A", 1, "p", "u", 1000.0, None, None)], "contract_id string, clause_id int, party_id string, unit string, quantity double, start date, end date")
    n = spark.createDataFrame([("B", 1, "p", "u", 700.0, None, None), ("C", 1, "p", "u", 500.0, None, None), ("D", 1, "p", "SGD", 900.0, None, None)], m.schema)
    r = clause_conflicts.summed_commitments(m, n).first()
    assert (r.total, r.n_commitments, r.largest.contract_id) == (1200.0, 2, "B")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "contract_id_a string, contract_id_b string")
    fam = spark.createDataFrame([("A", "f", None), ("B", "f", "A"), ("C", "f", None)], "contract_id string, family_id string, amends_contract_id string")
    assert [tuple(r) for r in clause_conflicts.family_suppressed(pairs, fam).collect()] == [("A", "C")]


PAGE = "this agreement shall be governed by the laws of the state of delaware without regard to conflict of laws principles and 42 other filler words follow here".split()


def _learnt(words, *phrases):
    """A page that knows what matches the words of the phrases, by comparing all of them."""
    page = grounding.Page(words)
    for t in {t for p in phrases for t in p.split()}:
        page.learn((t, w, 200.0 * vocabulary._common(t, w) / (len(t) + len(w))) for w in set(words) if _near(t, w))
    return page


def _locate(phrase, words, threshold=85.0):
    return grounding.locate(phrase.split(), _learnt(words, phrase), words, threshold)


def test_grounding():
    words = [w.lower().strip(".,") for w in PAGE]
    exact = _locate("governed by the laws of the state of delaware", words)
    assert exact["verified"] and exact["recall"] == 100.0 and exact["text"].startswith("governed by")
    assert _locate("goverened by the lawz of the state of delawere", words)["recall"] >= 75
    assert not _locate("insurance must be carried at all times", words)["verified"]
    common = ["the"] * 50 + ["of"] * 50
    assert not _locate("the of", common)["verified"]
    assert _locate("alpha beta gamma", ["gamma", "beta", "alpha"])["recall"] == pytest.approx(100 / 3)
    assert [grounding.needed(n, 85.0) for n in (1, 3, 6, 7, 20, 40)] == [1, 3, 6, 6, 17, 34]


def test_grounding_frame(spark):
    pages = spark.createDataFrame([("d1", PAGE), ("d2", [])], "page_key string, words array<string>")
    phrases = spark.createDataFrame([("d1", 1, "laws of the state of delaware"), ("d1", 2, "nothing like it"), ("d2", 3, "laws"), ("d3", 4, "laws"), ("d1", 5, "  "), ("d1", 6, None), ("d1", 7, "statte of delawere")], "page_key string, phrase_id bigint, phrase string")
    got = {r.phrase_id: r for r in grounding.ground_phrases(pages, phrases).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 7} and got[1].verified and not got[2].verified and got[3].first is None
    assert got[5].score == 0 and got[6].first is None and got[7].recall > 60


def _near(a, b):
    """Two words match, by the plain table of common subsequences."""
    if a == b or min(len(a), len(b)) <= 2:
        return a == b
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return 200 * row[-1] >= 80 * (len(a) + len(b))


def test_vocabularies_lose_no_pair(spark, monkeypatch):
    """All pairs of random words and of misspelt ones, short, long and about the bound between both ways, by brute force."""
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdé😀") for _ in range(n)) for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 20, 70] for _ in range(6)]

    def worse(w):
        out = list(w)
        for _ in range(rnd.randint(1, max(1, len(w) // 4))):
            at = rnd.randrange(len(out) + 1)
            out[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "a", "é"])
        return "".join(out)

    words = sorted({*base, *(worse(w) for w in base for _ in range(4))} - {""})
    tokens = sorted({*base[::2], *(worse(w) for w in base)} - {""})
    t, w = spark.createDataFrame([(x,) for x in tokens], "token string"), spark.createDataFrame([(x,) for x in words], "word string")
    got = {(r.token, r.word): r.ratio for r in vocabulary.matching(t, w).collect()}
    want = {(x, y) for x in tokens for y in words if _near(x, y)}
    assert set(got) == want and len(want) > 500
    assert all(got[x, x] == 100 for x in set(tokens) & set(words))
    assert vocabulary.matching(t.limit(0), w).count() == 0 and vocabulary.matching(t, w.limit(0)).count() == 0


def test_common_lengths():
    rnd = random.Random(2)
    a, b = (["".join(rnd.choice("abc😀") for _ in range(rnd.choice([0, 1, 5, 30, 63, 64, 90]))) for _ in range(200)] for _ in range(2))
    assert vocabulary.common_lengths(a, b).tolist() == [vocabulary._common(x, y) for x, y in zip(a, b, strict=True)]


def test_grounding_anywhere_misses_nothing(spark):
    """What is found equals what holding every phrase against every page finds, words altered as a scan alters them."""
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("abdeghiklmnoprstu") for _ in range(rnd.randint(2, 13))) for _ in range(160)]
    pages = [[rnd.choice(vocab) for _ in range(rnd.randint(0, 120))] for _ in range(40)]
    phrases = []
    for _ in range(60):
        page = rnd.choice([p for p in pages if len(p) > 30])
        at = rnd.randrange(len(page) - 12)
        out = []
        for w in page[at : at + rnd.randint(1, 12)]:
            k = rnd.randrange(len(w))
            out.append(rnd.choice([w, w, w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "z" + w[k + 1 :], "--"]))
        phrases.append(" ".join(out))
    phrases += ["", "  ", "!! ??", "governng law off singapore applis here todai and tomorow"]
    pages.append("governing law of singapore applies here today and tomorrow".split() + [f"w{i}" for i in range(30)])
    got = grounding.ground_anywhere(
        spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "page_key string, words array<string>"),
        spark.createDataFrame(list(enumerate(phrases)), "phrase_id bigint, phrase string"),
    ).collect()
    clean = lambda t: "".join(c for c in t if c.isalnum()).lower()
    want = {}
    for j, phrase in enumerate(phrases):
        tokens = [clean(t) for t in phrase.split()]
        for i, p in enumerate(pages):
            if tokens and p and (x := grounding.locate(tokens, _learnt(p, " ".join(tokens)), p))["verified"]:
                want[str(i), j] = (x["text"], round(x["score"], 9), x["first"], x["last"])
    assert {(r.page_key, r.phrase_id): (r.text, round(r.score, 9), r["first"], r["last"]) for r in got} == want
    assert len(want) > 10 and ("40", 63) in want


def test_geometry(spark):
    words = spark.createDataFrame([(1, 1, "world", 60, 10, 100, 30), (1, 1, "hello", 0, 12, 50, 32), (1, 1, "below", 0, 60, 50, 80), (1, 1, " ", 0, 200, 5, 210)], "doc_id bigint, page int, text string, x_min int, y_min int, x_max int, y_max int")
    lines = geometry.fold_lines(words)
    assert [(r.line, r.text) for r in lines.orderBy("line").collect()] == [(1, "hello world"), (2, "below")]
    placed = geometry.line_offsets(lines)
    assert [(r.line_id, r.char_start, r.char_end) for r in placed.orderBy("line").collect()] == [("L0001", 0, 11), ("L0002", 12, 17)]
    fields = spark.createDataFrame([(1, 1, "f", 0, 0, 200, 70), (1, 1, "g", 5, 5, 5, 90)], "doc_id bigint, page int, field_id string, x0 int, y0 int, x1 int, y1 int")
    assert [(r.field_id, r.anchors) for r in geometry.anchors(fields, placed).collect()] == [("f", ["L0001", "L0002"])]


def test_findings(spark):
    dim = findings.dimension(spark)
    c = spark.createDataFrame([("A",), ("B",)], "contract_id string")
    x = spark.createDataFrame([("A", "parties", 0, "guess", False, 50.0, None, 1, "1", "", ), ("A", "parties", 1, "Acme and Beta", True, 97.0, None, 2, "2", "Acme and Beta"), ("A", "insurance", 0, "made up", False, 20.0, None, 1, None, None)],
        "contract_id string, category string, ord int, vlm_text string, is_grounded boolean, score double, normalized string, page int, clause string, supporting_text string")
    f = findings.findings(c, x, dim)
    assert f.count() == 82
    got = {(r.contract_id, r.category): r for r in f.collect()}
    assert (got["A", "parties"].answer, got["A", "parties"].evidence_status, got["A", "parties"].summary) == ("present", "direct", "Acme and Beta")
    assert (got["A", "insurance"].answer, got["A", "insurance"].evidence_status, got["B", "parties"].answer) == ("present", "unresolved", "unresolved")
    rows = {(r.contract_id, r.category): r for r in findings.fields(f, x).collect()}
    assert (rows["A", "parties"].confidence_tier, rows["A", "parties"].consistency_score) == ("verbatim", 0.97)
    assert rows["A", "insurance"].confidence_tier == "unverified" and rows["B", "insurance"].absence_reason == "not_found"
    cited = {r.category: r for r in findings.citations(x).collect()}
    assert (cited["parties"].page, cited["insurance"].clause, cited["insurance"].quote) == (2, "—", "made up")


def test_invoices(spark):
    inv = spark.createDataFrame([(1, "Acme Ltd", D(2024, 1, 5)), (2, "Acme Distribution", D(2025, 1, 5)), (3, "Nobody", D(2024, 1, 5)), (4, "Two Inc", D(2024, 1, 1)), (5, None, None), (6, "Acme", None)], "invoice_id int, vendor string, invoice_date date")
    con = spark.createDataFrame([(10, "ACME", D(2024, 1, 1), D(2024, 12, 31)), (20, "Two", None, None), (21, "Two Co", None, None)], "contract_id int, party string, start date, end date")
    got = {r.invoice_id: (r.status, r.tier) for r in portfolio.reconcile_invoices(inv, con).collect()}
    assert got[1] == ("HIGH_CONFIDENCE_MATCH", "normalised") and got[2] == ("DATE_MISMATCH_REVIEW", "inferred") and got[3][0] == got[5][0] == "MISSING_CONTRACT_ROGUE"
    assert got[4][0] == "MULTIPLE_CONTRACTS_REVIEW" and got[6][0] == "DATE_MISMATCH_REVIEW"


def test_invoice_names_inside_others(spark):
    """A name inside another one matches, within a word too, and a name in the parties clause as well as the counterparty."""
    inv = spark.createDataFrame([(1, "Acmeworks"), (2, "Zeta Group of Companies"), (3, "A"), (4, "lpha"), (5, "gamma north")], "invoice_id int, vendor string").withColumn("invoice_date", F.lit("2024-01-05").cast("date"))
    con = spark.createDataFrame([(10, "Acmeworksglobal Ltd", None), (20, "Other", "Zeta Group"), (30, "north big gamma", None)], "contract_id int, party string, parties string").withColumns({"start": F.lit("2024-01-01").cast("date"), "end": F.lit("2024-12-31").cast("date")})
    got = {r.invoice_id: (r.status, r.contract_id, r.method, r.reason) for r in portfolio.reconcile_invoices(inv, con).collect()}
    assert got[1] == ("HIGH_CONFIDENCE_MATCH", 10, "fuzzy", "inside_term") and got[2][1:3] == (20, "fuzzy") and got[5][1:3] == (30, "fuzzy")
    assert got[3][0] == "MULTIPLE_CONTRACTS_REVIEW" and got[4] == ("MISSING_CONTRACT_ROGUE", None, None, "no_contract_of_vendor")


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, v string").write.partitionBy("document_id").parquet(path)
    for _ in range(2):
        sinks.replace_documents(spark.createDataFrame([(2, "c"), (3, "d")], "document_id int, v string"), path)
    assert sorted((r.document_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.write_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "u").mkdir()
    for name, raw in (("a.pdf", b"%PDF-1.4 x"), ("b.txt", b"plain text\n"), ("c.bin", bytes(range(256))), ("d.PNG", b"\x89PNG\r\n\x1a\n")):
        (tmp_path / "u" / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.uploads(spark, str(tmp_path / "u")).collect()}
    assert [(got[n].kind, got[n].route, got[n].status) for n in ("a.pdf", "b.txt", "c.bin", "d.PNG")] == [("pdf", "pdf", "queued"), ("text", None, "queued"), (None, None, "unsupported"), ("png", "image", "queued")]
    (tmp_path / "lease one.json").write_text(json.dumps({"contract_id": "NA", "counterparties": ["Acme", " na "], "contract_family": ""}))
    r = files.contract_files(spark, str(tmp_path / "lease one.json")).first()
    assert (r.counterparties, r.family, r.contract_id) == (["Acme"], None, "NA")
    (tmp_path / "lease two.json").write_text("{}")
    assert files.contract_files(spark, str(tmp_path / "lease two.json")).first().contract_id == "lease two"
    body = spark.createDataFrame([("d", 1, '```json\n[{"category":"parties","text":"Acme"},{"category":"nope","text":"x"},{"category":"parties","text":" "}]\n```'), ("d", 2, "sorry"), ("d", 3, '{"category":"insurance","text":"yes"}')], "doc_id string, page int, body string")
    assert sorted((r.page, r.category) for r in files.recorded_answers(body, findings.dimension(spark)).collect()) == [(1, "parties"), (3, "insurance")]
    native = files.native_words(spark.createDataFrame([("d", 1, 0, "Hi", 72.0, 72.0, 144.0, 90.0), ("d", 2, 0, " ", 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, word_ord int, text string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([("d", 1, 612.0, 792.0, 2550, 3300), ("d", 2, 612.0, 792.0, 2550, 3300)], "doc_id string, page int, width_pt double, height_pt double, width_px int, height_px int"))
    ocr = files.ocr_words(spark.createDataFrame([("d", 1, 0, "no", 1, 1, 5, 5, "90"), ("d", 2, 0, "scan", 1, 1, 5, 5, "x")], "doc_id string, page int, word_ord int, text string, left int, top int, width int, height int, conf string"))
    words = {r.page: r for r in files.page_words(native, ocr).collect()}
    assert (words[1].x_min, words[1].source, words[2].source, words[2].confidence) == (300, "native", "ocr", -1.0)


def test_streaming_matches_batch(spark, tmp_path):
    rows = [(1, "queued", 0, "2024-01-01 00:00:00"), (1, "running", 1, "2024-01-01 00:01:00"), (2, "queued", 0, "2024-01-01 00:00:30"), (3, "running", 3, "2024-01-01 00:00:40"), (9, "queued", 0, "2024-01-01 02:00:00")]
    events = spark.createDataFrame(rows, "job_id bigint, status string, attempts int, ts string").withColumns({"ts": F.to_timestamp("ts"), "error": F.lit(None).cast("string")})
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    state = jobs.reap(jobs.latest_state(events), "2024-01-01 01:00:00")
    assert {r.job_id: r.status for r in state.collect()} == {1: "queued", 2: "queued", 3: "failed", 9: "queued"}
    seen = []
    stream = spark.readStream.schema(jobs.EVENT).parquet(str(tmp_path / "e"))
    jobs.run_batches(stream, lambda b: seen.extend(r.job_id for r in b.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert seen == [1, 2, 9]
    late = jobs.stalled_jobs(stream).writeStream.format("memory").queryName("stalled").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    late.awaitTermination(120)
    assert {(r.job_id, r.status) for r in spark.table("stalled").collect()} == {(1, "queued"), (3, "failed")}


def test_record_edges(spark):
    assert [records.decode_cursor(x) for x in (None, "", "!!", records.encode_cursor(40))] == [0, 0, 0, 40]
    d = spark.createDataFrame([(1, "b", "ready", "nda", None, "2024-01-01"), (2, "a", "ready", "nda", "Acme", "2024-01-02"), (3, "c", "failed", None, "x", "2024-01-03")], "id bigint, filename string, status string, doc_type string, counterparty string, uploaded_at string")
    f = spark.createDataFrame([], "id bigint, document_id bigint, field_key string, value_verbatim string, value_normalized struct<date:date,days:int,months:int>, confidence_tier string, absence_reason string")
    e = spark.createDataFrame([], "id bigint, document_id bigint, event_date date, action_by_date date, status string")
    page = lambda **k: [(r.id, r.has_more) for r in records.document_list(d, e, f, **k).orderBy("nth").collect()]
    assert page(limit=2) == [(3, True), (2, True)] and page(limit=2, cursor=records.encode_cursor(2)) == [(1, False)]
    assert page(sort="name", status="ready") == [(2, False), (1, False)] and page(search="ACM") == [(2, False)] and page(doc_type="lease") == []
    ln = spark.createDataFrame([(1, "L1"), (1, "L2"), (2, "L1")], "document_id bigint, line_id string")
    assert records.anchors_of(ln, 1, " L1, ,L9").count() == 1 and records.anchors_of(ln, 1, " ").count() == 0
    assert one(spark, records.storage_path("/s/", F.col("d"), F.lit("pdf")), d="abcd") == "/s/originals/ab/abcd.pdf"


def test_retrieval_params(spark):
    p = retrieval.Params.parse({"doc_type": "nda", "threshold": 3, "drop": "table"})
    assert (p.doc_type, p.threshold) == ("nda", 3)
    for bad in ({"doc_type": "x"}, {"counterparty": ""}, {"threshold": "3"}, {"threshold": True}, {"date_from": "2024-1-1"}, {"field_key": "drop table"}, [], None):
        with pytest.raises(ValueError):
            retrieval.Params.parse(bad)
    d = spark.createDataFrame([(1, "a.pdf", "ready", "nda", "Acme"), (2, "b.pdf", "ready", None, "Acme")], "id bigint, filename string, status string, doc_type string, counterparty string")
    f = spark.createDataFrame([(1, 1, "renewal_term", "one year", (None, None, 12), "normalised", "Clause 2")], "id bigint, document_id bigint, field_key string, value_verbatim string, value_normalized struct<date:date,days:int,months:int>, confidence_tier string, clause_label string")
    ask = lambda said, writer=None: retrieval.answer(d, f, "?", lambda _: said, writer)
    assert ask("nonsense")["status"] == "answered" and ask({"status": "need_clarification"})["question"]
    assert ask({"status": "ready", "params": {"doc_type": "x"}})["status"] == "need_clarification"
    assert ask({"status": "ready", "params": {"field_key": "renewal_term", "comparator": "gte", "threshold": 12}})["answer"] == "1 matching contract(s):\n• Acme — renewal_term: one year (Clause 2)"
    assert ask({"status": "ready", "params": {"counterparty": "nobody"}})["answer"] == "No matching contracts were found."

    def down(*_):
        raise OSError("no answer")

    assert ask({"status": "ready"}, down)["answer"].startswith("1 matching")


def test_providers(spark):
    class Flaky:
        def __init__(self):
            self.left = 2

        def ask(self, page, prompt):
            if prompt == "bad":
                raise ValueError("no")
            if self.left:
                self.left -= 1
                raise TimeoutError("later")
            return prompt.upper()

        def retryable(self, error):
            return isinstance(error, TimeoutError)

    waits = []
    assert files.asked(Flaky(), None, "x", waits.append) == "X" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        files.asked(Flaky(), None, "bad", waits.append)
    assert waits == [1.0, 2.0]
    pages = spark.createDataFrame([("d", 1, b""), ("d", 2, b"")], "doc_id string, page int, image binary")
    prompts = spark.createDataFrame([("parties", "good"), ("insurance", "bad")], "category string, prompt string")

    class Calm:
        def ask(self, page, prompt):
            if prompt == "bad":
                raise ValueError("no")
            return prompt

        def retryable(self, error):
            return False

    got = files.answers(pages, prompts, Calm, 2).collect()
    assert sorted((r.page, r.category, r.body, r.error) for r in got) == [(1, "insurance", None, "no"), (1, "parties", "good", None), (2, "insurance", None, "no"), (2, "parties", "good", None)]


def test_conversion(spark):
    pdf = b"%PDF-1.4 << /Type /Pages >> << /Type /Page >> << /Type/Page >>"
    rows = spark.createDataFrame([("a.pdf", pdf), ("b.pdf", b"no"), ("c.docx", b"x"), ("d.zip", b"x"), ("e.html", b"<p>")], "path string, content binary")
    got = {r.path: (r.route, r.n_pages, r.error) for r in files.convert(rows, {"html": lambda raw: pdf + raw}).collect()}
    assert got["a.pdf"] == ("pdf", 2, None) and got["e.html"] == ("html", 2, None)
    assert got["b.pdf"][2] == "not a PDF" and got["c.docx"][2] == "no converter for office here" and got["d.zip"][0] is None and got["d.zip"][2]


def test_settings_and_demo(spark):
    assert files.settings(["A=1", "# B=2", "export C='x y'", "A=3", "D"], {"C": "env"}) == {"C": "env", "A": "1"}
    d, ln, f = files.demo_corpus(spark, 18, "2026-01-01")
    assert (d.count(), f.count()) == (18, 72) and records.integrity(f, ln, spark.createDataFrame([], "id bigint, event_date date, action_by_date date")).count() == 0
    assert d.exceptAll(files.demo_corpus(spark, 18, "2026-01-01")[0]).count() == 0


def test_job_handling(spark, tmp_path):
    states = spark.createDataFrame([(1, "queued", 1, None), (2, "done", 1, None)], "job_id bigint, status string, attempts int, error string")
    assert [(r.job_id, r.status, r.attempts) for r in jobs.claim(states, "2024-01-01 00:00:00").collect()] == [(1, "running", 2)]
    assert jobs.recheck(spark, 9, "2024-01-01 00:00:00").first().status == "queued"
    e = spark.createDataFrame([(1, "queued", 0, "2024-01-01 00:00:00")], "job_id bigint, status string, attempts int, ts string").withColumns({"ts": F.to_timestamp("ts"), "error": F.lit(None).cast("string")})
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    idle = []
    for n, waiting in enumerate((lambda: states, lambda: states.filter("status = 'done'"), None)):
        stream = spark.readStream.schema(jobs.EVENT).parquet(str(tmp_path / "e"))
        jobs.run_batches(stream, lambda b: None, str(tmp_path / f"c{n}"), idle=lambda b, n=n: idle.append(n), waiting=waiting).awaitTermination(120)
    assert idle == [1, 2]


def test_scopes(spark):
    s = spark.createDataFrame([("k", 1), ("k", None), ("k", None), ("j", None)], "kind string, canonical_id int")
    assert clause_conflicts.scope_judgements(s).count() == 3
    assert one(spark, clause_conflicts.explain_sum(F.col("a"), F.lit("units"), F.lit(2), F.col("b")), a=1200.0, b=0.5) == "Commitments of 1200 units in 2 clauses exceed the ceiling of 0.5."
    c = spark.createDataFrame([(1, [("a",), ("a",), (None,), ("b",)])], "clause_id int, scopes array<struct<canonical_id:string>>")
    assert sorted(r.asset_id for r in clause_conflicts.scoped(c).collect()) == ["a", "b"] and c.filter(clause_conflicts.covers(F.lit("b"), "scopes")).count() == 1


def test_kinds_of_files(spark):
    """Empty files, zips that aren't office files, cut magics, wide characters and code points that a cut parts."""
    office = b"PK\x03\x04" + bytes(22) + (19).to_bytes(2, "little") + bytes(2) + b"[Content_Types].xml"
    cases = [
        (b"", "text"), (b"plain\n", "text"), (b"%PDF-1.7", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\x89PNG", None), (b"\xff\xd8\xff\xe0", "jpeg"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"),
        (office, "ooxml"), (b"PK\x03\x04" + bytes(60), None), (b"a\x00b", None), (b"\xff\xfe", None), ("\ufffd".encode(), None), (b"\x01\x02\x03abc", None),
        (("x" * 98 + "😀").encode(), "text"), ("😀😀 ok".encode(), None), (("x" * 511 + "é" * 9).encode(), "text"), (("x" * 510 + "😀" * 9).encode(), "text"), ("\x7f\x80ok".encode(), "text"),
    ]
    df = spark.createDataFrame([(i, bytearray(raw)) for i, (raw, _) in enumerate(cases)], "i int, content binary")
    got = {r.i: r.k for r in df.select("i", files.sniff(F.col("content")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, k in cases]


def test_contract_files_of_one_name(spark, tmp_path):
    """Files of one base name in two folders, names with signs, and a path that is named twice."""
    paths = []
    for i, name in enumerate(["b/x.json", "a/x.json", "a/y + z é.json"]):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(json.dumps({"contract_id": f"c{i}", "cuad_findings": {}}))
        paths.append(str(at))
    got = files.contract_files(spark, [*paths, paths[0], f"file://{paths[1]}"]).orderBy("doc_ord").collect()
    assert [(r.contract_id, r.doc_ord) for r in got] == [("c0", 0), ("c1", 1), ("c2", 2)]
    assert [r.contract_id for r in files.contract_files(spark, str(tmp_path / "a")).orderBy("doc_ord").collect()] == ["c1", "c2"]


def test_grid_keeps_fractions(spark):
    assert one(spark, text.to_grid(F.col("x"), F.col("w")), x=1, w=3) == pytest.approx(1000 / 3)


def test_last_edit_holds(spark):
    fields = spark.createDataFrame([(1, 7, "old", "verbatim", None, "c"), (2, 7, "kept", "verbatim", None, "c")], "id int, document_id int, value_verbatim string, confidence_tier string, absence_reason string, clause_label string")
    edits = spark.createDataFrame([(1, 7, "a", True, "first", False, None, "p", 1), (1, 7, "a", True, "second", False, None, "q", 2), (1, 8, "a", True, "other", False, None, "r", 3)], "id int, document_id int, state string, has_value boolean, value string, has_clause boolean, clause_label string, edited_by string, at int")
    got = {r.id: r for r in records.edit_fields(fields, edits, "2024-01-01").collect()}
    assert len(got) == 2 and (got[1].value_verbatim, got[1].edited_by) == ("second", "q") and not got[2].human_edited
    assert records.edit_fields(fields, edits.drop("at"), "2024-01-01").count() == 2
    rows = spark.createDataFrame([(1, "open"), (2, "open")], "id int, status string")
    patches = spark.createDataFrame([(1, "dismissed", 1), (1, "acknowledged", 2), (2, "nonsense", 3)], "id int, status string, at int")
    assert {(r.id, r.status) for r in records.update_status(rows, patches).collect()} == {(1, "acknowledged"), (2, "open")}


def test_words_near_on_a_page():
    """Words of a page against tokens, by counts of characters first, are all pairs that match; long words and odd characters too."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdé😀") for _ in range(rnd.choice((0, 2, 3, 4, 5, 6, 9, 12)))) for _ in range(400)] + ["ab" * 40, "ab" * 39 + "b", "termination", "terminatio", "\x00ab"]
    tokens = words[::9] + ["terminaton", "ab" * 38]
    matches = lambda t, w: t != w and min(len(t), len(w)) > 2 and 200 * vocabulary._common(t, w) >= 80 * (len(t) + len(w))
    want = {(t, w): 200.0 * vocabulary._common(t, w) / (len(t) + len(w)) for t in tokens for w in words if matches(t, w)}
    got = list(vocabulary.near(tokens, words))
    assert dict(((t, w), r) for t, w, r in got) == want and len(got) == len(want) > 20
    assert not list(vocabulary.near([], words)) and not list(vocabulary.near(tokens, []))


def test_phrases_are_compared_on_their_page_only(spark, monkeypatch):
    """Which words of all pages match all tokens is not asked for, as a phrase meets its own page alone."""
    monkeypatch.setattr(vocabulary, "nearly_equal", None)
    pages = spark.createDataFrame([("a", "the suplier shall deliver goods promptly".split()), ("b", "supplier".split())], "page_key string, words array<string>")
    phrases = spark.createDataFrame([("a", 1, "supplier shall deliverr"), ("b", 2, "deliver goods")], "page_key string, phrase_id bigint, phrase string")
    got = {r.phrase_id: (r.recall, r["text"]) for r in grounding.ground_phrases(pages, phrases).collect()}
    assert got == {1: (100.0, "suplier shall deliver"), 2: (0.0, "")}
