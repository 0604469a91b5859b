"""Contracts against each other: facts, registries, the checks of pairs, merging, the report, files and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from pactlake import cli
from pactlake.operators import cross_contract as cc
from pactlake.operators import entities, handoffs, sinks
from pactlake.sources import files


def contract(i, findings, parties=("Acme Flooring Inc", "Beta LLC"), **more):
    """A file as the analysis of a document leaves it; findings: category to a quote, or to (quote, grounded, answer, evidence)."""
    out = {}
    for category, f in findings.items():
        quote, grounded, answer, evidence = f if isinstance(f, tuple) else (f, True, "present", "direct")
        e = [] if quote is None else [{"vlm_text": quote, "location": {"page": 3, "bbox_1000": [0, 0, 1, 1]}, "source": {"page": 3, "clause": "Clause 1", "exact_supporting_text": quote}, "ocr_verification": {"score": 99.0, "recall": 100.0, "evidence_mass": 5.0, "is_grounded": grounded}}]
        out[category] = {"answer": answer, "summary": "", "evidence_status": evidence, "extractions": e}
    return {"contract_id": i, "document_metadata": {"source_file": f"{i}.pdf", "total_pages": 3}, "counterparties": list(parties), "assets": [], "cuad_findings": out} | more


@pytest.fixture
def loaded(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))

    def load(*contracts):
        paths = []
        for k, c in enumerate(contracts):
            paths.append(str(tmp_path / f"{k} of {len(contracts)}.json"))
            with open(paths[-1], "w") as f:
                json.dump(c, f)
        return files.contract_tables(files.contract_files(spark, paths)), paths

    return load


def found(tables):
    rows = cc.check_pairs(cc.contract_facts(*tables)).collect()
    return sorted((r.a, r.b, r.type, r.severity, r.confidence, r.subject) for r in rows)


MARKS = "the exclusive use of the Blue Harbor Trademarks"


def test_shared_exclusivity(loaded):
    tables, _ = loaded(contract("A", {"exclusivity": MARKS}), contract("B", {"exclusivity": MARKS + " in Asia"}, parties=("Other Corp",)))
    assert found(tables) == [("A", "B", "Exclusivity / Double-Grant Conflict", "Critical", "High", "blue harbor trademarks")]


CASES = [
    ({"exclusivity": "a non-exclusive right"}, {"exclusivity": "sole"}, []),  # the left one isn't exclusive
    ({"exclusivity": "sole"}, {"exclusivity": "a non-exclusive right"}, [("Exclusivity / Double-Grant Conflict", "Low")]),  # the right one counts, and no asset is shared
    ({"exclusivity": "sole", "expiration_date": "2020-01-01"}, {"exclusivity": "sole too", "effective_date": "2021-01-01"}, []),
    ({"most_favored_nation": "best price"}, {"revenue_profit_sharing": "ten per cent"}, [("MFN Conflict", "High")]),
    ({"most_favored_nation": ("best price", False, "present", "direct")}, {"price_restrictions": "fixed"}, [("MFN Conflict", "Medium")]),
    ({"exclusivity": (MARKS, True, "unresolved", "unresolved")}, {"exclusivity": MARKS}, []),
    ({"exclusivity": (MARKS, True, "present", "unresolved")}, {"exclusivity": MARKS}, [("Exclusivity / Double-Grant Conflict", "Low")]),
    ({"license_grant": MARKS + " worldwide"}, {"exclusivity": (MARKS + ", worldwide", True, "absent", "direct")}, [("Territorial / Field-of-Use Overlap", "High")]),
    ({"anti_assignment": "Subject to the other Agreement"}, {"expiration_date": "2030-01-01"}, [("Contingency / Dependency Conflict", "Low")]),
    ({"anti_assignment": "subject to\nthe agreement"}, {"expiration_date": "2030-01-01"}, []),
    ({"ip_ownership_assignment": MARKS}, {"joint_ip_ownership": MARKS}, [("IP Ownership / License-Stack Conflict", "High")]),
    ({"ip_ownership_assignment": "all work"}, {"license_grant": "a licence"}, [("IP Ownership / License-Stack Conflict", "Low")]),
    ({"license_grant": MARKS}, {"license_grant": MARKS}, [("Party Role Contradiction", "Low")]),
    ({"license_grant": MARKS, "non_transferable_license": "may not pass it on"}, {"license_grant": MARKS}, []),
    ({"renewal_term": "renews", "expiration_date": "June 1, 2030"}, {"expiration_date": "2029/01/01"}, [("Term / Renewal Conflict", "Low")]),
    ({"renewal_term": "renews", "expiration_date": "2028-01-01"}, {"expiration_date": "2029/01/01"}, []),
    ({"governing_law": "the laws of England and Wales"}, {"governing_law": "laws of the State of New York."}, [("Governing Law / Forum Conflict", "High")]),
    ({"governing_law": "the laws of England and Wales"}, {"governing_law": "law of England."}, []),
    ({"cap_on_liability": "capped"}, {"uncapped_liability": "open"}, []),  # needs an asset
    ({"license_grant": MARKS, "non_transferable_license": "no", "cap_on_liability": "capped"}, {"license_grant": MARKS, "third_party_beneficiary": "others"}, [("Liability / Indemnity Conflict", "High")]),
    ({"license_grant": MARKS, "non_transferable_license": "no", "anti_assignment": "never"}, {"license_grant": MARKS, "change_of_control": "may"}, [("Assignment / Change-of-Control Conflict", "High")]),
    ({"license_grant": MARKS, "non_transferable_license": "no", "non_compete": (None, True, "present", "direct"), "no_solicit_of_customers": "none"}, {"license_grant": MARKS}, []),  # the first restraint has no quote
    ({"license_grant": MARKS, "non_transferable_license": "no", "no_solicit_of_customers": "none"}, {"license_grant": MARKS}, [("Non-Compete / Non-Solicit Overlap", "High")]),
    ({"exclusivity": "sole"}, {"exclusivity": " \n"}, []),  # a blank quote
]


def test_checks(loaded):
    """Each case is a pair with parties and an asset of its own, so that one run tells of all."""
    own = lambda f, k: {c: tuple(x.replace("Harbor", f"Harbor{k}") if isinstance(x, str) else x for x in v) if isinstance(v, tuple) else v.replace("Harbor", f"Harbor{k}") for c, v in f.items()}
    pairs = [contract(f"{k}{side}", own(f, k), (f"Acme{k} Flooring{k} Inc", f"Beta{k} LLC")) for k, case in enumerate(CASES) for side, f in zip("ab", case)]
    tables, _ = loaded(*pairs)
    got = found(tables)
    for k, (_, _, want) in enumerate(CASES):
        assert [(t, c) for a, b, t, _, c, _ in got if (a, b) == (f"{k}a", f"{k}b")] == want, k
    assert all(a[:-1] == b[:-1] for a, b, *_ in got)


def test_first_financial_is_cited(loaded):
    own = {"license_grant": MARKS, "non_transferable_license": "no"}
    tables, _ = loaded(contract("A", own | {"revenue_profit_sharing": "share", "price_restrictions": "price", "volume_restriction": "volume"}), contract("B", own | {"price_restrictions": "their price", "minimum_commitment": "their minimum"}))
    rows = {r.type: r for r in cc.check_pairs(cc.contract_facts(*tables)).collect()}
    r = rows["Financial Commitment Conflict"]
    assert (r.cite_a.quote, r.cite_b.quote, r.cite_a.page, r.cite_a.clause) == ("volume", "their minimum", 3, "Clause 1")
    assert r.entities == ["acme flooring", "beta"] and r.subject == "acme flooring; beta"


def test_no_link_and_common_parties(loaded):
    tables, _ = loaded(contract("A", {"exclusivity": "sole"}), contract("B", {"exclusivity": "sole"}, parties=("Someone",)))
    assert found(tables) == []
    several = [contract(f"C{i}", {"exclusivity": f"sole {i}"}, parties=("Owner Holdings", f"Party{i // 2} Ltd")) for i in range(6)]
    tables, _ = loaded(*several)
    assert [(a, b, s) for a, b, *_, s in found(tables)] == [("C0", "C1", "party0"), ("C2", "C3", "party1"), ("C4", "C5", "party2")]
    rows = cc.check_pairs(cc.contract_facts(*tables)).collect()
    assert {tuple(r.entities) for r in rows} == {("owner", f"party{i}") for i in range(3)}  # those that many share are named all the same
    usual = entities.common_entities(cc.entity_registry(cc.contract_facts(*tables)), 6).collect()
    assert [(r.entity_id, r.aliases, r.contracts) for r in usual] == [("owner", ["Owner Holdings"], [f"C{i}" for i in range(6)])]


def test_merge_and_report(spark, loaded):
    grant = {"exclusivity": MARKS + " worldwide"}
    tables, _ = loaded(contract("A", grant), contract("B", grant | {"exclusivity": MARKS + " worldwide too"}), contract("C", {"governing_law": "laws of Ohio."}, ("Gamma Co",)), contract("D", {"governing_law": "laws of Utah."}, ("Gamma Ltd",)))
    merged = cc.merge_conflicts(cc.check_pairs(cc.contract_facts(*tables)))
    rows = cc.report(merged, 1).orderBy("conflict_id").collect()
    assert [(r.conflict_id, r.a, r.b, r.type, r.severity, r.confidence) for r in rows] == [
        ("C-001", "A", "B", "Exclusivity / Double-Grant Conflict; Territorial / Field-of-Use Overlap", "Critical", "High"), ("C-002", "C", "D", "Governing Law / Forum Conflict", "Administrative", "High")]
    many = spark.range(2500).select(F.lit("x").alias("a"), F.lit("y").alias("b"), F.col("id").alias("doc_ord_a"), F.col("id").alias("doc_ord_b"), F.lit(0).alias("check_ord"), *(F.lit("t").alias(c) for c in ("type", "severity", "confidence", "subject", "entities", "quotes", "cite_a", "cite_b", "description", "recommended_action")), (F.col("id") % 3).cast("int").alias("sr"), F.lit(0).alias("cr"))
    ids = [r.conflict_id for r in cc.report(many).orderBy("sr", "doc_ord_a").collect()]
    assert ids == [f"C-{k:03d}" for k in range(1, 2501)]


def test_edges(loaded):
    tables, _ = loaded(contract("A", {"expiration_date": "2020-01-01"}, contract_family="F", amends="B"), contract("B", {}, contract_family="F", amends="gone"), contract("C", {"effective_date": "2021-01-01"}, parties=("Acme Flooring Ltd",), contract_family="NA", amends=" "))
    rows = cc.dependency_edges(cc.contract_facts(*tables)).collect()
    assert sorted((r.source, r.target, r.kind) for r in rows) == [("A", "B", "amends"), ("A", "B", "family"), ("A", "B", "inferred"), ("B", "A", "family"), ("B", "C", "inferred")]


def test_obligations(loaded):
    tables, _ = loaded(contract("A", {"exclusivity": "sole", "insurance": "insured", "non_compete": ("no", True, "unresolved", "direct"), "rofr_rofo_rofn": (None, True, "present", "direct")}))
    rows = cc.obligation_registry(tables[1], cc.contract_facts(*tables)).collect()
    assert sorted((r.category, r.evidence and r.evidence.quote) for r in rows) == [("exclusivity", "sole"), ("rofr_rofo_rofn", None)]


def test_registry_order(spark, tmp_path):
    """A name joins the first cluster that has a matching alias."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    m = spark.createDataFrame([(1, 0, "Acme Flooring"), (2, 0, "Acme Rail"), (3, 0, "ACME"), (4, 0, "Buyer"), (5, 0, "Buyer North")], "contract_id int, ord int, raw string")
    got = {r.cluster: (r.aliases, r.contracts) for r in entities.entity_clusters(m).collect()}
    assert got == {"acme flooring": (["ACME", "Acme Flooring"], [1, 3]), "acme rail": (["Acme Rail"], [2]), "buyer": (["Buyer"], [4]), "buyer north": (["Buyer North"], [5])}


def test_command_line(loaded, tmp_path, capsys, spark):
    _, paths = loaded(contract("A", {"exclusivity": MARKS}), contract("B", {"exclusivity": MARKS}))
    out, said = tmp_path / "r.json", tmp_path / "r.md"
    assert cli.main(["conflicts", *paths, "--output", str(out), "--markdown", str(said)], spark) == 0
    r = json.loads(out.read_text())
    assert r["contracts_examined"] == ["A", "B"] and [c["conflict_id"] for c in r["conflicts"]] == ["C-001"]
    assert r["conflicts"][0]["evidence"][1] == {"contract_id": "B", "page": 3, "clause": "Clause 1", "quote": MARKS}
    assert {e["entity_id"] for e in r["entity_registry"]} == {"acme flooring", "beta"} and r["dependency_edges"][0]["kind"] == "inferred"
    assert "| C-001 | Exclusivity / Double-Grant Conflict | Critical | High | A, B |" in said.read_text()
    assert cli.main(["conflicts", paths[0]], spark) == 1 and cli.main(["conflicts", paths[0], "/none.json"], spark) == 1
    assert "two" in capsys.readouterr().err


def test_analyze_command(tmp_path, spark):
    """Two lines of words and three recorded answers: two are located, a made-up one isn't; the result goes into the comparison again."""
    tokens = "DISTRIBUTION AGREEMENT between Acme and Beta This Agreement shall be governed by the laws of Singapore".split()
    words = [{"page": 1, "word_ord": k, "text": t, "x_min": 100 + 60 * k, "y_min": 10, "x_max": 150 + 60 * k, "y_max": 40, "width_px": 2550, "height_px": 3300} for k, t in enumerate(tokens)]
    said = [{"category": "document_name", "text": "DISTRIBUTION AGREEMENT", "clause": "Title"}, {"category": "governing_law", "text": "governed by the laws of Singapore", "clause": "9"}, {"category": "insurance", "text": "five million of marine cover at all times"}, {"category": "nonsense", "text": "x"}]
    (tmp_path / "deal.words.json").write_text(json.dumps(words))
    (tmp_path / "deal.answers.json").write_text(json.dumps([{"page": 1, "body": "```json\n" + json.dumps(said) + "\n```"}, {"page": 2, "body": "nothing to say"}]))
    out = tmp_path / "deal.json"
    args = ["analyze", str(tmp_path / "deal.words.json"), "--answers", str(tmp_path / "deal.answers.json"), "--output", str(out)]
    assert cli.main(args, spark) == 0
    r = json.loads(out.read_text())
    f = r["cuad_findings"]
    assert len(f) == 41 and r["contract_id"] == "deal" and r["document_metadata"]["total_pages"] == 1
    assert (f["governing_law"]["answer"], f["governing_law"]["evidence_status"], f["insurance"]["evidence_status"], f["parties"]["answer"]) == ("present", "direct", "unresolved", "unresolved")
    e = f["governing_law"]["extractions"][0]
    assert e["ocr_verification"]["is_grounded"] and e["source"]["clause"] == "9" and e["location"]["bbox_1000"][0] == pytest.approx((100 + 60 * 10) / 2550 * 1000)
    assert f["document_name"]["extractions"][0]["source"] == {"page": 1, "clause": "Title", "exact_supporting_text": "DISTRIBUTION AGREEMENT"}  # two words are too little evidence to ground it
    assert f["insurance"]["extractions"][0]["source"]["clause"] == "Unlabeled" and f["insurance"]["review_flag"]["flagged"]
    _, findings, extractions = files.contract_tables(files.contract_files(spark, [str(out)]))
    assert findings.count() == 41 and extractions.filter("is_grounded").count() == 1
    assert cli.main(["analyze", "/none.json", "--answers", "/none.json", "--output", str(out)], spark) == 1


def test_conflict_rows_and_briefs(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    d = spark.createDataFrame([(1, "a.pdf", "ready", "nda", "Acme Ltd"), (2, "b.pdf", "degraded", None, "Acme Ltd"), (3, "c.pdf", "ready", "invoice", "Acme Ltd"), (4, "d.pdf", "failed", "nda", "Acme Ltd")], "id bigint, filename string, status string, doc_type string, counterparty string")
    long = "exclusive " + "x" * 500
    f = spark.createDataFrame([(10, 1, "exclusivity", long, "verbatim", ["L1", "L0"], "Clause 3"), (20, 2, "exclusivity", "sole rights", "unverified", ["L9"], None), (30, 3, "exclusivity", "sole", "verbatim", [], None), (40, 4, "exclusivity", "sole", "verbatim", [], None)], "id bigint, document_id bigint, field_key string, value_verbatim string, confidence_tier string, anchor_line_ids array<string>, clause_label string")
    ln = spark.createDataFrame([(1, "L0", 7)], "document_id bigint, line_id string, page_number int")
    report = cc.report(cc.merge_conflicts(cc.check_pairs(cc.contract_facts(*handoffs.portfolio_tables(d, f, ln)))))
    r = report.first()
    assert (r.a, r.b, r.cite_a.page, r.cite_b.page, r.confidence) == (1, 2, 7, 0, "Low") and report.count() == 1
    rows = handoffs.conflict_rows(report, f, d)
    c = rows.first()
    assert (c.severity, c.confidence_tier, c.document_ids, c.field_ids, c.source) == ("high", "inferred", [1, 2], [10, 20], "cross_contract")
    b = handoffs.briefs(rows).first()
    assert b.established[0].label == "a.pdf — Clause 3" and b.question.startswith('Clause 3 of a.pdf states "exclusive xxx') and b.question.count("x" * 120) == 1 and "x" * 141 not in b.question
    old = spark.createDataFrame([("manual", "m"), ("cross_contract", "old")], "source string, conflict_type string")
    assert sorted(x.conflict_type for x in handoffs.replace_conflicts(old, rows).collect()) == [c.conflict_type, "m"]
    made = spark.createDataFrame([(1, "exclusivity_breach", "S.", [1, 2], [20, 10]), (2, "other", "T.", [1], [10]), (3, "other", "U.", [1, 2], [10, 20])], "id bigint, conflict_type string, summary string, document_ids array<bigint>, field_ids array<bigint>")
    said = {x.id: x.question for x in handoffs.brief_of(made, f, d).collect()}
    assert said[1].startswith("Two agreements promise exclusivity in one territory: b.pdf in A clause, a.pdf in Clause 3.") and said[2] == "T. Whose terms hold?" and said[3].endswith('b.pdf (a clause) says "sole rights". Whose terms hold?')


def test_markdown_without_conflicts(loaded):
    tables, _ = loaded(contract("A", {}), contract("B", {}))
    said = sinks.markdown_report(cc.report(cc.merge_conflicts(cc.check_pairs(cc.contract_facts(*tables)))), ["A", "B"])
    assert "Contracts examined: A, B" in said and "No cross-contract conflicts" in said
