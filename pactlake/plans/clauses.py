"""Clause-engine queries: an order is a contract, its lines are clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.operators import clause_conflicts as cc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clause_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clause for each (order, line, part, flag): it runs from the first ship date for its largest quantity in days."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    grouped = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").agg(F.min("l_shipdate").cast("date").alias("start"), F.max("l_quantity").alias("quantity"))
    return grouped.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").cast("bigint").alias("clause_id"), F.col("l_partkey").alias("asset_id"),
        F.col("o_custkey").alias("party_id"), F.col("l_returnflag").alias("flag"), "quantity", "start",
        F.date_add("start", F.col("quantity").cast("int")).alias("end"),
    )


_CLAUSES = """clauses AS (
  SELECT l_orderkey AS contract_id, l_linenumber::BIGINT AS clause_id, l_partkey AS asset_id, o_custkey AS party_id, l_returnflag AS flag,
    max(l_quantity) AS quantity, min(l_shipdate)::DATE AS s, (min(l_shipdate)::DATE + max(l_quantity)::INT)::DATE AS e
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5)"""


def asset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = clause_view(spark, sf_dir).withColumns({"is_exclusive": F.col("flag") == "A", "superseded": F.lit(False)})
    return cc.asset_overlap(view).select(
        F.col("asset_id"), F.col("contract_id_a"), F.col("clause_id_a"), F.col("contract_id_b"), F.col("clause_id_b"),
        F.greatest("start_a", "start_b").alias("overlap_start"), F.least("end_a", "end_b").alias("overlap_end"),
    )


def mfn_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = clause_view(spark, sf_dir).withColumn("kind", F.expr("CASE flag WHEN 'A' THEN 'mfn' WHEN 'R' THEN 'pricing' END"))
    return cc.price_trigger(view).select("party_id", "contract_id_a", "clause_id_a", "contract_id_b", "clause_id_b")


def cumulative_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = clause_view(spark, sf_dir).withColumn("unit", F.lit("units"))
    cols = ("contract_id", "clause_id", "asset_id", "party_id", "unit", "quantity", "start", "end")
    ceil = view.filter("flag = 'N'").select(*cols)
    firm = view.filter("flag = 'R'").select(*cols)
    key = lambda d: d.withColumn("clause_id", F.col("clause_id") * 1000000000 + F.col("asset_id")).drop("asset_id")
    out = cc.summed_commitments(key(ceil), key(firm))
    return out.select("party_id", F.col("contract_id_c").alias("contract_id"), F.col("clause_id_c").alias("clause_key"), F.col("quantity_c").alias("ceiling"), F.round("total", 6).alias("total"), F.col("n_commitments").cast("bigint").alias("n_commitments"), F.col("largest.contract_id").alias("largest_contract_id"), F.col("largest.clause_id").alias("largest_clause_key"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both passes under their tags, with the number of conflicts of each contract pair."""
    a = asset_overlap(spark, sf_dir).select(F.lit("asset").alias("pass"), "contract_id_a", "contract_id_b")
    b = mfn_trigger(spark, sf_dir).select(F.lit("party").alias("pass"), "contract_id_a", "contract_id_b")
    return a.unionByName(b).groupBy("pass", "contract_id_a", "contract_id_b").agg(F.count(F.lit(1)).alias("n_conflicts"))


def amendment_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset conflicts without pairs inside a family (customer and month), where the later order amends the one before it."""
    orders = table(spark, sf_dir, "orders")
    family = F.concat_ws("-", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMM"))
    base = orders.select(F.col("o_orderkey").alias("contract_id"), family.alias("family_id"))
    from pyspark.sql import Window

    contracts = base.withColumn("amends_contract_id", F.lag("contract_id").over(Window.partitionBy("family_id").orderBy("contract_id")))
    view = clause_view(spark, sf_dir)
    pairs = view.select("party_id", F.col("contract_id").alias("contract_id_a")).distinct()
    both = pairs.join(pairs.withColumnRenamed("contract_id_a", "contract_id_b"), "party_id").filter("contract_id_a < contract_id_b")
    return cc.family_suppressed(both, contracts).select("party_id", "contract_id_a", "contract_id_b")


QUERIES = {f.__name__: f for f in (asset_overlap, mfn_trigger, cumulative_commitment, review_queue, amendment_suppressed)}

_ASSET = """asset AS (SELECT a.asset_id, a.contract_id AS contract_id_a, a.clause_id AS clause_id_a, b.contract_id AS contract_id_b, b.clause_id AS clause_id_b,
    greatest(a.s, b.s) AS overlap_start, least(a.e, b.e) AS overlap_end
  FROM clauses a JOIN clauses b ON a.asset_id = b.asset_id AND a.contract_id < b.contract_id AND a.flag = 'A' AND b.flag = 'A' AND a.e >= b.s AND b.e >= a.s)"""
_MFN = """mfn AS (SELECT a.party_id, a.contract_id AS contract_id_a, a.clause_id AS clause_id_a, b.contract_id AS contract_id_b, b.clause_id AS clause_id_b
  FROM clauses a JOIN clauses b ON a.party_id = b.party_id AND a.contract_id <> b.contract_id AND a.flag = 'A' AND b.flag = 'R' AND a.e >= b.s AND b.e >= a.s)"""

ORACLE = {
    "asset_overlap": f"WITH {_CLAUSES}, {_ASSET} SELECT * FROM asset",
    "mfn_trigger": f"WITH {_CLAUSES}, {_MFN} SELECT * FROM mfn",
    "cumulative_commitment": f"""WITH {_CLAUSES},
 k AS (SELECT *, clause_id * 1000000000 + asset_id AS key FROM clauses),
 m AS (SELECT c.party_id, c.contract_id, c.key AS clause_key, c.quantity AS ceiling, m.quantity AS q, m.contract_id AS mc, m.key AS mk
   FROM k c JOIN k m ON c.party_id = m.party_id AND c.contract_id <> m.contract_id AND c.flag = 'N' AND m.flag = 'R' AND c.e >= m.s AND m.e >= c.s),
 r AS (SELECT *, row_number() OVER (PARTITION BY contract_id, clause_key ORDER BY q DESC, mc, mk) AS rn FROM m)
 SELECT party_id, contract_id, clause_key, ceiling, round(sum(q), 6) AS total, count(*) AS n_commitments,
   max(CASE WHEN rn = 1 THEN mc END) AS largest_contract_id, max(CASE WHEN rn = 1 THEN mk END) AS largest_clause_key
 FROM r GROUP BY 1, 2, 3, 4 HAVING sum(q) > ceiling""",
    "review_queue": f"""WITH {_CLAUSES}, {_ASSET}, {_MFN},
 u AS (SELECT 'asset' AS pass, contract_id_a, contract_id_b FROM asset UNION ALL SELECT 'party', contract_id_a, contract_id_b FROM mfn)
 SELECT pass, contract_id_a, contract_id_b, count(*) AS n_conflicts FROM u GROUP BY ALL""",
    "amendment_suppressed": """WITH c AS (SELECT o_orderkey AS id, o_custkey || '-' || strftime(o_orderdate, '%Y%m') AS fam FROM orders),
 c2 AS (SELECT *, lag(id) OVER (PARTITION BY fam ORDER BY id) AS am FROM c),
 p AS (SELECT DISTINCT o_custkey AS party_id, o_orderkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
 SELECT a.party_id, a.id AS contract_id_a, b.id AS contract_id_b FROM p a JOIN p b ON a.party_id = b.party_id AND a.id < b.id
 JOIN c2 x ON x.id = a.id JOIN c2 y ON y.id = b.id
 WHERE NOT coalesce(x.fam = y.fam AND (coalesce(x.am = b.id, false) OR coalesce(y.am = a.id, false)), false)""",
}
