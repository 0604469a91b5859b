"""Pairs are judged where they meet: once each, whatever they share, and without a shuffle of their rows."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pactlake.operators import cross_contract as cc
from pactlake.operators import entities
from pactlake.session import saved

NAMES = ("Acme Flooring Ltd", "Acme Flooring Asia", "Acme", "Beta Trading", "Trading Beta", "Gamma Ltd", "Delta Works", "Epsilon Mills", "Ltd")


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(5)
    docs = [(k, k, rng.sample(NAMES, rng.randint(0, 3)), None, None) for k in range(30)]
    parts = [(k, c, f"exclusive use of Machine M{m} worldwide and of Machine M{(m * 7) % 4}") for k in range(30) for c in ("exclusivity", "license_grant") if rng.random() < 0.7 for m in (rng.randrange(5),)]
    found = [(k, c, "present", "", "direct") for k, c, _ in parts]
    told = [(k, c, 0, None, t, 1, None, True) for k, c, t in parts]
    tables = (
        spark.createDataFrame(docs, "contract_id bigint, doc_ord bigint, counterparties array<string>, family string, amends bigint"),
        spark.createDataFrame(found, "contract_id bigint, category string, answer string, summary string, evidence_status string"),
        spark.createDataFrame(told, "contract_id bigint, category string, ord int, vlm_text string, supporting_text string, page int, clause string, is_grounded boolean"),
    )
    return saved(cc.contract_facts(*tables), "facts")


def test_each_pair_once_with_all_it_shares(facts, spark):
    rows = cc.check_pairs(facts).collect()
    assert len(rows) > 50 and len({(r.a, r.b, r.check_ord) for r in rows}) == len(rows)
    of = {r.contract_id: r for r in facts.collect()}
    names = spark.createDataFrame([(n,) for n in sorted({n for r in of.values() for n in r.names})], "name string")
    met = {(r.x, r.y) for r in entities.matching_names(names).collect()}
    usual = {r.x for r in cc.usual_names(facts).collect()}
    told = {(r.a, r.b): r for r in rows if r.check_ord == 0}
    both = lambda a, b: sorted(x for x in of[a].names if any((x, y) in met for y in of[b].names))
    for a, b in itertools.combinations(range(30), 2):
        shared = set(of[a].assets) & set(of[b].assets)
        if all("exclusivity" in of[k].present for k in (a, b)) and (shared or set(both(a, b)) - usual):
            assert told.pop((a, b)).entities == (both(a, b) or [cc.NOBODY])
    assert not told


def test_names_match_as_their_pairs_do(spark):
    names = spark.createDataFrame([(n.lower(),) for n in (*NAMES, "acme acme", "ltd ltd acme")], "name string")
    two = names.select(F.col("name").alias("x")).crossJoin(names.select(F.col("name").alias("y"))).filter(entities.names_match(F.col("x"), F.col("y")))
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, entities.matching_names(names).collect()))


def test_merged_where_they_meet(facts):
    key = ["a", "b", "check_ord"]
    one, two = (df.orderBy(*key) for df in (cc.merged_pairs(facts), cc.merge_conflicts(cc.check_pairs(facts))))
    assert one.select(two.columns).collect() == two.collect() and one.count() > 50


def test_no_shuffle_of_pairs(facts):
    for found in (cc.check_pairs(facts), cc.merged_pairs(facts)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(key#" in plan or "hashpartitioning(kind#" in plan or "BroadcastHashJoin" in plan
        assert "hashpartitioning(a#" not in plan and "hashpartitioning(b#" not in plan


def test_both_sides_read_one_shuffle(facts, spark):
    set_to = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    try:
        for found in (cc.check_pairs(facts), cc.merged_pairs(facts)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "ReusedExchange" in plan and "hashpartitioning(kind#" in plan
    finally:
        for k in set_to:
            spark.conf.unset(k)


def test_facts_of_contracts_in_one_shuffle(spark):
    found = spark.createDataFrame([(1, "exclusivity", "present", "", "direct"), (1, "exclusivity", "unresolved", "", "direct"), (2, "parties", "present", "", "direct")], "contract_id bigint, category string, answer string, summary string, evidence_status string")
    told = spark.createDataFrame([(2, "parties", 0, None, "Acme and Beta", 1, None, True), (3, "non_compete", 0, "x", "", 1, None, True)], "contract_id bigint, category string, ord int, vlm_text string, supporting_text string, page int, clause string, is_grounded boolean")
    docs = spark.createDataFrame([(k, k, [], None, None) for k in (1, 2, 3, 4)], "contract_id bigint, doc_ord bigint, counterparties array<string>, family string, amends bigint")
    facts = cc.contract_facts(docs, found, told)
    rows = {r.contract_id: r for r in facts.collect()}
    assert (rows[1].present, rows[1].unresolved, rows[1].cites) == (["exclusivity"], ["exclusivity"], {})
    assert rows[2].names == ["acme", "beta"] and rows[2].cites["parties"].firm and rows[4].cites is None
    assert rows[3].present == [] and rows[3].unresolved == [] and rows[3].cites["non_compete"].quote == "x" and not rows[3].cites["non_compete"].firm
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [contract_id" in plan and "FullOuter" not in plan


def test_obligations_without_facts(spark):
    found = spark.createDataFrame([(1, "exclusivity", "present", "s", "direct"), (1, "parties", "present", "", "direct"), (2, "non_compete", "unresolved", "", "unresolved"), (3, "non_compete", "present", None, "direct")], "contract_id bigint, category string, answer string, summary string, evidence_status string")
    told = spark.createDataFrame([(1, "exclusivity", 1, "v", "", 2, "C", True), (1, "exclusivity", 0, "w", "said ", 1, None, False), (2, "non_compete", 0, "x", "", 1, None, True)], "contract_id bigint, category string, ord int, vlm_text string, supporting_text string, page int, clause string, is_grounded boolean")
    docs = spark.createDataFrame([(k, k, ["Acme"], None, None) for k in (1, 2, 3)], "contract_id bigint, doc_ord bigint, counterparties array<string>, family string, amends bigint")
    full = cc.obligation_registry(found, cc.contract_facts(docs, found, told))
    slim = cc.cited_obligations(found, told)
    assert slim.orderBy("contract_id").collect() == full.orderBy("contract_id").collect() and slim.count() == 2
    facts, dated = cc.contract_facts(docs, found, told), cc.dated_facts(docs, found, told)
    assert dated.orderBy("contract_id").collect() == facts.select(dated.columns).orderBy("contract_id").collect()


def test_pairs_are_judged_by_compiled_code(spark):
    """Where no names but equal ones match and none is usual, no function over arrays that Spark doesn't compile is in what judges pairs; stages too big for Java's compiler are run by operators."""
    docs = spark.createDataFrame([(k, k, [f"Solo {k // 2}"], None, None) for k in range(12)], "contract_id bigint, doc_ord bigint, counterparties array<string>, family string, amends bigint")
    found = spark.createDataFrame([(k, "governing_law", "present", "", "direct") for k in range(12)], "contract_id bigint, category string, answer string, summary string, evidence_status string")
    told = spark.createDataFrame([(k, "governing_law", 0, None, f"laws of {('Ohio', 'Utah')[k % 2]}.", 1, None, True) for k in range(12)], "contract_id bigint, category string, ord int, vlm_text string, supporting_text string, page int, clause string, is_grounded boolean")
    rows = cc.check_pairs(saved(cc.contract_facts(docs, found, told), "facts"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "lambda" not in above and "Union" not in above and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == str(cc.HUGE)
    assert sorted((r.a, r.b, r.type) for r in rows.collect()) == [(k, k + 1, "Governing Law / Forum Conflict") for k in range(0, 12, 2)]
