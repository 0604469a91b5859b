"""Joins and sums over periods against plain loops, and hot keys whose pairs would be too many."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pactlake.operators import clause_conflicts as cc

DAY = dt.date(2026, 1, 1)
CLAUSES = "contract_id string, clause_id int, asset_id string, is_exclusive boolean, superseded boolean, start date, end date"
SUMS = "contract_id string, clause_id int, party_id string, unit string, quantity double, start date, end date"


@pytest.fixture(autouse=True, params=[cc.PER_ROW, 0])
def crowd(request, monkeypatch):
    """Keys as they are, and all of them taken for crowded ones."""
    monkeypatch.setattr(cc, "PER_ROW", request.param)


def period(r):
    start = None if r.random() < 0.1 else DAY + dt.timedelta(r.randrange(-400, 400))
    length = r.choice((0, 1, 5, 30, 31, 32, 33, 700, 40000, -3))
    return start, None if r.random() < 0.15 else (start or DAY) + dt.timedelta(length)


def meet(a, b):
    return (a[1] is None or b[0] is None or a[1] >= b[0]) and (b[1] is None or a[0] is None or b[1] >= a[0])


def test_pairs_equal_a_loop(spark):
    r = random.Random(1)
    rows = [(r.choice(("A", "B", "C", "D")), n, r.choice(("x", "y", None)), r.random() < 0.9, r.random() < 0.1, *period(r)) for n in range(90)]
    rows += rows[:2]
    live = [x for x in rows if x[3] and not x[4] and x[2]]
    want = sorted((a[1], b[1]) for a in live for b in live if a[2] == b[2] and a[0] < b[0] and meet(a[5:], b[5:]))
    got = cc.asset_overlap(spark.createDataFrame(rows, CLAUSES))
    assert got.columns == ["asset_id", "contract_id_a", "clause_id_a", "start_a", "end_a", "contract_id_b", "clause_id_b", "start_b", "end_b"]
    assert sorted((x.clause_id_a, x.clause_id_b) for x in got.collect()) == want and want
    kinds = spark.createDataFrame(rows, CLAUSES).selectExpr("contract_id", "clause_id", "asset_id as party_id", "if(clause_id % 3 = 0, 'mfn', if(clause_id % 3 = 1, 'pricing', null)) as kind", "start", "end")
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[2] and a[2] == b[2] and a[0] != b[0] and a[1] % 3 == 0 and b[1] % 3 == 1 and meet(a[5:], b[5:]))
    assert sorted((x.clause_id_a, x.clause_id_b) for x in cc.price_trigger(kinds).collect()) == want and want


def test_sums_equal_a_loop(spark):
    r = random.Random(2)
    rows = lambda size, most: [(r.choice(("A", "B", "C", None)), n, r.choice(("p", "q", None)), r.choice(("u", "u", "v")), r.choice((0.1, 0.2, 2.5, 7.0, 7.0, None)) if most is None else r.choice(most), *period(r)) for n in range(size)]
    ceilings, made = rows(50, (0.0, 3.0, 20.0)), rows(80, None)
    ceilings += ceilings[:1]
    want = {}
    for c in ceilings:
        for m in made:
            if c[0] and m[0] and c[0] != m[0] and c[2] and c[2:4] == m[2:4] and m[4] is not None and meet(c[5:], m[5:]):
                want.setdefault((c[2], c[3], c[0], c[1], c[4]), []).append((m[4], m[0], m[1]))
    want = {k: (pytest.approx(sum(x[0] for x in v)), len(v), min((-q, *rest) for q, *rest in v)[1:]) for k, v in want.items() if sum(round(10 * x[0]) for x in v) > 10 * k[4]}
    got = cc.summed_commitments(spark.createDataFrame(ceilings, SUMS), spark.createDataFrame(made, SUMS)).collect()
    assert {(x.party_id, x.unit, x.contract_id_c, x.clause_id_c, x.quantity_c): (x.total, x.n_commitments, (x.largest.contract_id, x.largest.clause_id)) for x in got} == want and want


def rows_out_of_joins(df):
    """The most rows that a join of the plan that ran gave out."""
    df.collect()
    plan, most, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(p.plan())
            continue
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


def test_a_hot_asset_makes_few_candidates(spark):
    """100,000 clauses of one asset, one behind the other, of which only neighbours meet: 10^10 pairs, or some rows for each clause."""
    n = 100_000
    day = lambda c: F.date_add(F.lit("1700-01-01").cast("date"), c.cast("int"))
    some = spark.range(n).select(F.col("id").alias("contract_id"), F.lit(1).alias("clause_id"), F.lit("a").alias("asset_id"), F.lit(True).alias("is_exclusive"), F.lit(False).alias("superseded"), day(2 * F.col("id")).alias("start"), day(2 * F.col("id") + 2).alias("end"))
    met = cc.asset_overlap(some)
    assert met.count() == n - 1
    assert rows_out_of_joins(cc.asset_overlap(some)) <= 4 * n


def test_a_hot_party_is_summed_without_pairs(spark):
    """20,000 ceilings and 20,000 commitments of one party that all meet: 4 * 10^8 pairs."""
    n = 20_000
    rows = spark.range(n).select(F.concat(F.lit("c"), "id").alias("contract_id"), F.lit(1).alias("clause_id"), F.lit("p").alias("party_id"), F.lit("u").alias("unit"), F.col("id").cast("double").alias("quantity"), F.lit("2026-01-01").cast("date").alias("start"), F.lit("2026-12-31").cast("date").alias("end"))
    out = cc.summed_commitments(rows, rows)
    x = out.filter("contract_id_c = 'c19999'").first()
    assert out.count() == n and (x.total, x.n_commitments, x.largest.contract_id) == (n * (n - 1) / 2 - 19999, n - 1, "c19998")
    assert out.filter("contract_id_c = 'c7'").first().largest.contract_id == "c19999"
    assert rows_out_of_joins(out) <= 60 * n
