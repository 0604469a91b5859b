"""Portfolio queries: orders are contracts, customers counterparties, lines clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlake.functions import labels
from pactlake.operators import portfolio as pf
from pactlake.plans.clauses import table

AS_OF = "1998-06-30"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order runs from its date for 30 days times its last line number; a priority of 1 or 2 gives notice days, status F a renewal."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.sum("l_quantity").alias("q"))
    start = F.col("o_orderdate").cast("date")
    return o.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("party_id"), start.alias("start"), F.date_add(start, (F.col("n") * 30).cast("int")).alias("expiry"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), (F.col("n") * 15).cast("int")).alias("notice_days"),
        F.when(F.col("o_orderstatus") == "F", F.col("n").cast("int")).alias("renewal_months"), "o_orderstatus", "o_totalprice", "q",
    )


_C = """c AS (SELECT o_orderkey AS contract_id, o_custkey AS party_id, o_orderdate::DATE AS s, (o_orderdate::DATE + 30 * n::INT)::DATE AS x,
   CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN (15 * n)::INT END AS nd, CASE WHEN o_orderstatus = 'F' THEN n::INT END AS rm, o_orderstatus, o_totalprice, q
  FROM orders JOIN (SELECT l_orderkey, max(l_linenumber) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_E = """e AS (SELECT contract_id, CASE WHEN rm IS NOT NULL THEN 'auto_renewal' ELSE 'expiry' END AS event_type, x AS event_date, (x - nd)::DATE AS action_by,
   CASE WHEN rm IS NOT NULL AND nd IS NOT NULL THEN 'assembled' ELSE 'normalised' END AS tier FROM c)"""


def calendar_events(spark, sf_dir):
    return pf.calendar_events(contracts(spark, sf_dir))


def calendar_window(spark, sf_dir):
    return pf.calendar_window(calendar_events(spark, sf_dir), AS_OF)


def calendar_bands(spark, sf_dir):
    e = calendar_events(spark, sf_dir).withColumn("band", labels.date_band(F.coalesce("action_by", "event_date"), F.lit(AS_OF).cast("date")))
    return e.groupBy("band", "tier").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("action_by", "event_date")).alias("first_day"))


def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def scalar_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count_distinct("o_custkey").alias("parties"))


def portfolio_summary(spark, sf_dir):
    """Tracked contracts, actions within 90 days (overdue ones included), overdue ones, contracts to review and in process, in one row."""
    e = calendar_events(spark, sf_dir).withColumn("d", F.coalesce("action_by", "event_date"))
    day = F.lit(AS_OF).cast("date")
    acts = e.agg(F.count_if(F.col("d") <= F.date_add(day, 90)).alias("actions_next_90"), F.count_if(F.col("d") < day).alias("overdue"))
    o = table(spark, sf_dir, "orders")
    counts = o.agg(F.greatest(F.lit(0), F.count_if(F.col("o_orderstatus").isin("F", "O")) - F.count_if(F.col("o_totalprice") < 1000)).cast("bigint").alias("tracked"), F.count_if(F.col("o_orderstatus") == "P").alias("processing"))
    unsure = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_discount > 0.08").select(F.col("l_orderkey").alias("id"))
    review = unsure.union(e.filter(F.col("tier") == "assembled").select("contract_id")).agg(F.count_distinct("id").alias("to_review"))
    return acts.crossJoin(counts).crossJoin(review)  # one row each


def document_page(spark, sf_dir):
    """The third page of 25 contracts, the newest first, each with its next action; has_more from one row more."""
    e = calendar_events(spark, sf_dir).groupBy("contract_id").agg(F.min(F.coalesce("action_by", "event_date")).alias("next_action"))
    page = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(26)
    nth = page.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("bigint"))  # 26 rows
    nth = nth.withColumn("has_more", F.max("nth").over(Window.partitionBy(F.lit(1))) > 25).filter("nth <= 25")
    return nth.join(e, F.col("o_orderkey") == F.col("contract_id"), "left").select("nth", F.col("o_orderkey").alias("contract_id"), "next_action", "has_more")


def document_detail(spark, sf_dir):
    """Each contract with its clauses in order and its party's name."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    got = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_returnflag"])), ",").alias("clauses"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("contract_id"), F.col("c_name").alias("party"), "clauses")


_CATEGORIES = {"term": "neutral", "renewal": "lower_better", "notice": "higher_better"}


def _values(spark, sf_dir) -> DataFrame:
    c = contracts(spark, sf_dir)
    rows = [("term", pf.term_months(F.col("start"), F.col("expiry"))), ("renewal", F.col("renewal_months")), ("notice", F.col("notice_days"))]
    return c.select("contract_id", F.explode(F.array(*(F.struct(F.lit(k).alias("category"), v.cast("double").alias("value")) for k, v in rows))).alias("x")).select("contract_id", "x.*").filter("value is not null")


def benchmarks(spark, sf_dir):
    active = contracts(spark, sf_dir).filter(F.col("o_orderstatus").isin("F", "O") & (F.col("expiry") >= F.lit(AS_OF).cast("date"))).select("contract_id")
    return pf.benchmarks(_values(spark, sf_dir), active, _CATEGORIES).withColumn("average", F.round("average", 6))


def portfolio_stats(spark, sf_dir):
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    return _values(spark, sf_dir).groupBy("category").agg(tenth(F.avg("value")).alias("average"), F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))


def term_length(spark, sf_dir):
    return contracts(spark, sf_dir).select("contract_id", pf.term_months(F.col("start"), F.col("expiry")).alias("months"))


def _fields(spark, sf_dir) -> DataFrame:
    c = contracts(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("party_id") == F.col("c_custkey"), "left")
    return c.withColumns({"name": F.col("c_name"), "absent": F.col("notice_days").isNull(), "tier": F.when(F.col("renewal_months").isNull(), "normalised").otherwise("unverified")})


def _retrieved(spark, sf_dir, predicate: dict, name: str | None = None) -> DataFrame:
    f = _fields(spark, sf_dir)
    test = pf.field_matches(predicate, F.col("absent"), F.col("tier"), F.col("notice_days"), F.col("expiry"))
    return pf.retrieve(f, test, name).select("contract_id", "name", "notice_days", "expiry")


def retrieval_numeric(spark, sf_dir):
    return _retrieved(spark, sf_dir, {"op": "gte", "value": 45})


def retrieval_date(spark, sf_dir):
    return _retrieved(spark, sf_dir, {"from": "1996-01-01", "to": "1998-12-31"})


def retrieval_absent(spark, sf_dir):
    return _retrieved(spark, sf_dir, {"state": "absent"})


def retrieval_name(spark, sf_dir):
    return _retrieved(spark, sf_dir, {"state": "present"}, "CUSTOMER#00000001")


def invoice_reconcile(spark, sf_dir):
    """Lines as invoices of their suppliers against the suppliers' first orders as contracts of 60 days."""
    s, li, o = (table(spark, sf_dir, t) for t in ("supplier", "lineitem", "orders"))
    firsts = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("start"), F.min("o_orderkey").alias("contract_id"))
    deals = firsts.join(s, F.col("l_suppkey") == F.col("s_suppkey")).filter("s_suppkey % 5 != 0").select("contract_id", F.concat("s_name", F.lit(" Pte. Ltd.")).alias("party"), "start", F.date_add("start", 60).alias("end"), F.col("s_suppkey"))
    deals = deals.select((F.col("contract_id") * 100000 + F.col("s_suppkey")).alias("contract_id"), "party", "start", "end")
    invoices = li.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").cast("date").alias("invoice_date")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("invoice_id"), F.concat("s_name", F.lit(", Inc")).alias("vendor"), "invoice_date")
    return pf.reconcile_invoices(invoices, deals)  # names of suppliers differ in a number of nine digits


def upload_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return pf.insert_absent(d.filter("source = 'src0'"), d.filter("source <> 'src0'"), ["sha256"], [F.col("doc_id")]).select("doc_id", "sha256", "duplicate")


def upsert_latest(spark, sf_dir):
    """Reviews: labels, then for orders' customers their latest state; the newer wins."""
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("state"))
    new = pf.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("state"))
    return pf.upsert(old, new, ["id"])


def cascade_delete(spark, sf_dir):
    """Lines and events left when customers of nation 3 and their orders go: lines go with orders, events lose their user."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").filter("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    gone = o.select(F.col("o_orderkey").alias("k"))
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    ev = table(spark, sf_dir, "events").withColumnRenamed("user_id", "k")
    out = pf.cascade_delete(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"), gone, {"lines": li, "events": ev}, "k", ["events"])
    return out["lines"].groupBy(F.lit("lines").alias("part"), "k").agg(F.count(F.lit(1)).alias("n")).unionByName(out["events"].groupBy(F.lit("events").alias("part"), "k").agg(F.count(F.lit(1)).alias("n")))


def replace_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("size"))
    new = d.filter("source = 'src1'").select("doc_id", (F.col("size") * 2).alias("size"))
    return pf.replace_source(d, "src1", new)


def hydrate_arrays(spark, sf_dir):
    """Contracts with their parts' names in the order of lines; parts whose key ends in 7 dangle."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    parts = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 7").select("p_partkey", "p_name")
    return pf.hydrate(li, "l_orderkey", "ids", parts, "p_partkey", "p_name").select("l_orderkey", F.array_join("values", "|").alias("names"))


def integrity(spark, sf_dir):
    """Violations: labels without a document, lines shipped before their order, orders of a non-positive price, parts without a size."""
    d, lb, li, o, p = (table(spark, sf_dir, t) for t in ("documents", "labels", "lineitem", "orders", "part"))
    a = lb.join(d, "doc_id", "left_anti").select(F.lit("dangling_label").alias("kind"), F.col("doc_id").alias("id"))
    early = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate").select(F.lit("early_ship").alias("kind"), F.col("l_orderkey").alias("id"))
    price = o.filter("o_totalprice <= 0").select(F.lit("bad_price").alias("kind"), F.col("o_orderkey").alias("id"))
    size = p.filter("p_size is null or p_size <= 0").select(F.lit("bad_size").alias("kind"), F.col("p_partkey").alias("id"))
    return a.unionByName(early).unionByName(price).unionByName(size).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))


def id_sets(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = o.filter("o_totalprice > 150000").select(F.col("o_orderkey").alias("id")).distinct()
    b = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return a.union(b).distinct().withColumn("op", F.lit("union")).unionByName(a.intersect(b).withColumn("op", F.lit("intersect"))).unionByName(a.exceptAll(b).withColumn("op", F.lit("except")))


def dependency_edges(spark, sf_dir):
    """Contracts of one customer whose 60 days from the order date meet, each pair once."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    b = o.select("o_custkey", F.col("k").alias("k2"), F.col("d").alias("d2"))
    return o.join(b, "o_custkey").filter("k < k2 and abs(date_diff(d, d2)) <= 60").select(F.col("o_custkey").alias("party_id"), F.col("k").alias("contract_id_a"), F.col("k2").alias("contract_id_b"))


def best_extraction(spark, sf_dir):
    """Of each order the line with the flag A first, then the largest discount, then the first."""
    li = table(spark, sf_dir, "lineitem")
    order = [F.desc(F.col("l_returnflag") == "A"), F.desc("l_discount"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")]
    return pf.latest(li, ["l_orderkey"], order).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_partkey", "l_discount")


def conflict_list(spark, sf_dir):
    """All orders by status text, then the newest."""
    return table(spark, sf_dir, "orders").orderBy("o_orderstatus", F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus")


def job_state(spark, sf_dir):
    """The latest event of each user as a job's state."""
    return pf.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


def reaped_jobs(spark, sf_dir):
    """Jobs that stood still for 15 minutes: to be queued again with less than 3 events that day, else failed."""
    e = table(spark, sf_dir, "events")
    one = e.groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")).alias("attempts"))
    return one.filter(F.col("last") < F.expr("timestamp_ntz'2024-01-31 12:00:00' - interval 15 minutes")).select("user_id", "attempts", F.when(F.col("attempts") < 3, "queued").otherwise("failed").alias("state"))


def claim_order(spark, sf_dir):
    """The 50 jobs that waited longest."""
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(50).select("event_id", "user_id")


def chat_threads(spark, sf_dir):
    """Turns, roles in order, and the last text's length of each conversation."""
    c = table(spark, sf_dir, "conversations")
    last = pf.latest(c, ["conv_id"], [F.desc("turn"), F.desc(F.length("text")), F.col("role")]).select("conv_id", F.length("text").cast("bigint").alias("last_length"))
    roles = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))
    return roles.join(last, "conv_id")


QUERIES = {f.__name__: f for f in (
    calendar_events, calendar_window, calendar_bands, status_counts, scalar_counts, portfolio_summary, document_page, document_detail, benchmarks, portfolio_stats, term_length,
    retrieval_numeric, retrieval_date, retrieval_absent, retrieval_name, invoice_reconcile, upload_dedupe, upsert_latest, cascade_delete, replace_by_source, hydrate_arrays, integrity, id_sets,
    dependency_edges, best_extraction, conflict_list, job_state, reaped_jobs, claim_order, chat_threads,
)}

_V = """v AS (SELECT contract_id, 'term' AS category, CASE WHEN floor((x - s) / 30.44 + 0.5) > 0 THEN floor((x - s) / 30.44 + 0.5) END::DOUBLE AS value FROM c
   UNION ALL SELECT contract_id, 'renewal', rm::DOUBLE FROM c UNION ALL SELECT contract_id, 'notice', nd::DOUBLE FROM c),
 w AS (SELECT * FROM v WHERE value IS NOT NULL)"""
_BAND = f"CASE WHEN d - DATE '{AS_OF}' < 0 THEN 'overdue' WHEN d - DATE '{AS_OF}' <= 7 THEN 'this_week' WHEN d - DATE '{AS_OF}' <= 30 THEN 'next_30' WHEN d - DATE '{AS_OF}' <= 60 THEN 'next_60' WHEN d - DATE '{AS_OF}' <= 90 THEN 'in_90' ELSE 'later' END"


def _retrieval(where: str, name: str = "") -> str:
    return f"""WITH {_C}, f AS (SELECT contract_id, c_name AS name, nd AS notice_days, x AS expiry, rm FROM c LEFT JOIN customer ON c_custkey = party_id {name} ORDER BY contract_id LIMIT 200)
 SELECT contract_id, name, notice_days, expiry FROM f WHERE {where} ORDER BY contract_id LIMIT 50"""


ORACLE = {
    "calendar_events": f"WITH {_C}, {_E} SELECT * FROM e",
    "calendar_window": f"WITH {_C}, {_E}, g AS (SELECT *, coalesce(action_by, event_date) AS d FROM e) SELECT contract_id, event_type, event_date, action_by, tier, d AS effective, {_BAND} AS band FROM g WHERE d <= DATE '{AS_OF}' + 90",
    "calendar_bands": f"WITH {_C}, {_E}, g AS (SELECT *, coalesce(action_by, event_date) AS d FROM e) SELECT {_BAND} AS band, tier, count(*) AS n, min(d) AS first_day FROM g GROUP BY 1, 2",
    "status_counts": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "scalar_counts": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 200000) AS large, count(DISTINCT o_custkey) AS parties FROM orders",
    "portfolio_summary": f"""WITH {_C}, {_E}, g AS (SELECT *, coalesce(action_by, event_date) AS d FROM e)
 SELECT * FROM (SELECT count(*) FILTER (d <= DATE '{AS_OF}' + 90) AS actions_next_90, count(*) FILTER (d < DATE '{AS_OF}') AS overdue FROM g),
  (SELECT greatest(0, count(*) FILTER (o_orderstatus IN ('F', 'O')) - count(*) FILTER (o_totalprice < 1000))::BIGINT AS tracked, count(*) FILTER (o_orderstatus = 'P') AS processing FROM orders),
  (SELECT count(DISTINCT id) AS to_review FROM (SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 UNION ALL SELECT contract_id FROM e WHERE tier = 'assembled'))""",
    "document_page": f"""WITH {_C}, {_E}, p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 50 AS nth FROM orders QUALIFY nth BETWEEN 1 AND 26)
 SELECT nth, o_orderkey AS contract_id, (SELECT min(coalesce(action_by, event_date)) FROM e WHERE e.contract_id = o_orderkey) AS next_action, (SELECT max(nth) FROM p) > 25 AS has_more FROM p WHERE nth <= 25""",
    "document_detail": """SELECT o_orderkey AS contract_id, c_name AS party, clauses FROM orders LEFT JOIN customer ON c_custkey = o_custkey
 LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS clauses FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "benchmarks": f"""WITH {_C}, {_V}, a AS (SELECT contract_id FROM c WHERE o_orderstatus IN ('F', 'O') AND x >= DATE '{AS_OF}'),
 m AS (SELECT category, avg(value) AS average FROM w SEMI JOIN a USING (contract_id) GROUP BY 1),
 r AS (SELECT w.*, average, CASE WHEN category = 'term' OR average <= 0 THEN 0 ELSE greatest(0, floor((CASE category WHEN 'notice' THEN average - value ELSE value - average END) / average * 100 + 0.5)) END::BIGINT AS percent_worse FROM w LEFT JOIN m USING (category))
 SELECT contract_id, category, value, round(average, 6) AS average, CASE WHEN average IS NULL AND category <> 'term' THEN NULL ELSE percent_worse END AS percent_worse, CASE WHEN percent_worse <= 0 THEN 'green' WHEN percent_worse <= 15 THEN 'yellow' WHEN percent_worse > 15 THEN 'red' END AS risk FROM r""",
    "portfolio_stats": f"WITH {_C}, {_V} SELECT category, floor(avg(value) * 10 + 0.5) / 10 AS average, min(value) AS least, max(value) AS most, count(*) AS n FROM w GROUP BY 1",
    "term_length": f"WITH {_C} SELECT contract_id, CASE WHEN floor((x - s) / 30.44 + 0.5) > 0 THEN floor((x - s) / 30.44 + 0.5) END::BIGINT AS months FROM c",
    "retrieval_numeric": _retrieval("notice_days IS NOT NULL AND rm IS NULL AND notice_days >= 45"),
    "retrieval_date": _retrieval("notice_days IS NOT NULL AND rm IS NULL AND expiry BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"),
    "retrieval_absent": _retrieval("notice_days IS NULL"),
    "retrieval_name": _retrieval("notice_days IS NOT NULL", "WHERE contains(lower(c_name), 'customer#00000001')"),
    "invoice_reconcile": """WITH f AS (SELECT l_suppkey AS k, min(o_orderdate::DATE) AS s, min(o_orderkey) AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
 d AS (SELECT o * 100000 + k AS contract_id, k, s, (s + 60)::DATE AS e FROM f JOIN supplier ON s_suppkey = k WHERE k % 5 <> 0),
 i AS (SELECT l_orderkey * 100000 + l_suppkey AS invoice_id, l_suppkey AS k, s_name || ', Inc' AS vendor, min(l_shipdate)::DATE AS invoice_date FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
 SELECT invoice_id, vendor, invoice_date, CASE WHEN d.k IS NULL THEN 'MISSING_CONTRACT_ROGUE' WHEN invoice_date BETWEEN s AND e THEN 'HIGH_CONFIDENCE_MATCH' ELSE 'DATE_MISMATCH_REVIEW' END AS status,
  CASE WHEN invoice_date BETWEEN s AND e THEN 'normalised' ELSE 'inferred' END AS tier, contract_id, CASE WHEN contract_id IS NOT NULL THEN 'exact' END AS method,
  CASE WHEN d.k IS NULL THEN 'no_contract_of_vendor' WHEN invoice_date BETWEEN s AND e THEN 'inside_term' ELSE 'outside_term' END AS reason FROM i LEFT JOIN d USING (k)""",
    "upload_dedupe": """WITH d AS (SELECT doc_id, source, sha256(text) AS sha256 FROM documents)
 SELECT doc_id, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) > 1 OR sha256 IN (SELECT sha256 FROM d WHERE source = 'src0') AS duplicate FROM d WHERE source <> 'src0'""",
    "upsert_latest": """WITH n AS (SELECT o_custkey AS id, o_orderkey AS state FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
 SELECT * FROM n UNION ALL SELECT doc_id, quality::BIGINT FROM labels WHERE doc_id NOT IN (SELECT id FROM n)""",
    "cascade_delete": """WITH g AS (SELECT o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey AND c_nationkey = 3)
 SELECT 'lines' AS part, l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM g) GROUP BY ALL
 UNION ALL SELECT 'events', CASE WHEN user_id NOT IN (SELECT k FROM g) THEN user_id END, count(*) FROM events GROUP BY ALL""",
    "replace_by_source": "SELECT doc_id, source, length(text)::BIGINT * CASE WHEN source = 'src1' THEN 2 ELSE 1 END AS size FROM documents",
    "hydrate_arrays": """SELECT l_orderkey, coalesce(string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey) FILTER (p_name IS NOT NULL), '') AS names
 FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 7) ON p_partkey = l_partkey GROUP BY 1""",
    "integrity": """SELECT kind, id, count(*) AS n FROM (SELECT 'dangling_label' AS kind, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT 'early_ship', l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
 UNION ALL SELECT 'bad_price', o_orderkey FROM orders WHERE o_totalprice <= 0 UNION ALL SELECT 'bad_size', p_partkey FROM part WHERE p_size IS NULL OR p_size <= 0) GROUP BY ALL""",
    "id_sets": """WITH a AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_totalprice > 150000), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')
 SELECT id, 'union' AS op FROM (FROM a UNION FROM b) UNION ALL SELECT id, 'intersect' FROM (FROM a INTERSECT FROM b) UNION ALL SELECT id, 'except' FROM (FROM a EXCEPT FROM b)""",
    "dependency_edges": "SELECT a.o_custkey AS party_id, a.o_orderkey AS contract_id_a, b.o_orderkey AS contract_id_b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_orderdate::DATE - b.o_orderdate::DATE) <= 60",
    "best_extraction": "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'A' DESC, l_discount DESC, l_linenumber, l_partkey, l_quantity) = 1",
    "conflict_list": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderdate DESC, o_orderkey",
    "job_state": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "reaped_jobs": """SELECT user_id, attempts, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS state FROM
 (SELECT user_id, max(ts) AS last, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS attempts FROM events GROUP BY 1) WHERE last < TIMESTAMP '2024-01-31 11:45:00'""",
    "claim_order": "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 50",
    "chat_threads": """WITH l AS (SELECT conv_id, length(text)::BIGINT AS last_length FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC, role) = 1)
 SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn, role) AS roles, any_value(last_length) AS last_length FROM conversations JOIN l USING (conv_id) GROUP BY 1""",
}
