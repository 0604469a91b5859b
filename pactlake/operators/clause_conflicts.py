"""Conflicts between structured clauses: overlapping grants, price triggers, summed commitments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Closed intervals meet; a null end is open on that side."""
    return F.coalesce(end_a >= start_b, F.lit(True)) & F.coalesce(end_b >= start_a, F.lit(True))


def _side(df: DataFrame, side: str, key: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c == key else f"{c}_{side}") for c in df.columns))


PER_ROW = 64  # rows that bins and blocks may make of one
SPAN = 32  # the most bins of one level that an interval lies in
FAR_PAST, FAR_FUTURE = -(10**6), 10**7  # days before and after all dates


def _days(df: DataFrame) -> DataFrame:
    """The rows with lo and hi, their periods in days; an open end is far away. Periods that end before they begin meet what holds both ends, as `overlaps` says."""
    lo = F.coalesce(F.unix_date("start"), F.lit(FAR_PAST)).cast("bigint")
    hi = F.coalesce(F.unix_date("end"), F.lit(FAR_FUTURE)).cast("bigint")
    return df.withColumns({"lo": lo, "hi": hi})


def _by_crowd(a: DataFrame, b: DataFrame, on: list[str]) -> list[tuple[DataFrame, DataFrame]]:
    """The rows of keys whose pairs are at most 64 for each row, and those of keys that have more; rows of a key that one side lacks go."""
    n = a.groupBy(*on).agg(F.count(F.lit(1)).alias("na")).join(b.groupBy(*on).agg(F.count(F.lit(1)).alias("nb")), on)
    n = n.select(*on, (F.col("na").cast("double") * F.col("nb") > PER_ROW * (F.col("na") + F.col("nb"))).alias("__many"))
    side = lambda rows, many: rows.join(n, on).filter(F.col("__many") == many).select(*rows.columns)
    return [(side(a, many), side(b, many)) for many in (False, True)]


def meeting(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows of two tables, with columns lo_a, hi_a, lo_b and hi_b of days beside their own, of equal keys whose periods meet: each once.

    Keys of few rows are joined as they are, which makes at most 64 pairs for each row; crowded ones by bins.
    """
    (few_a, few_b), crowded = _by_crowd(a, b, on)
    plain = few_a.join(few_b, on).filter((F.col("hi_a") >= F.col("lo_b")) & (F.col("hi_b") >= F.col("lo_a")))
    return plain.unionByName(_binned(*crowded, on).select(*plain.columns))


def _binned(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The pairs of `meeting`, without making all pairs of a key.

    A period has the level at which it lies in at most 32 bins of 2^level days. Two periods meet first at the later start,
    which both hold; so the one that starts later sends its start to the bins of each level that the other side has, and
    the earlier one waits in the bins it covers. A pair is found in the bin of its later start only, so candidates are
    those that share a bin, not all of a key. Levels are at most 24, and a level that a key doesn't have costs no row that
    joins. A period that ends before it begins is sent as two points, to be compared as the rule says.
    """
    level = lambda s: F.greatest(F.lit(0), F.ceil(F.log2((F.col(f"hi_{s}") - F.col(f"lo_{s}") + 1) / (SPAN - 1)))).cast("int")
    straight_a, straight_b = a.filter("hi_a >= lo_a").withColumn("lv_a", level("a")), b.filter("hi_b >= lo_b").withColumn("lv_b", level("b"))

    def half(holds: DataFrame, starts: DataFrame, h: str, s: str, strict: bool) -> DataFrame:
        """Pairs in which the one that holds begins first, or at the same time too unless strict."""
        have = holds.select(*on, F.col(f"lv_{h}").alias("lv")).distinct()
        wide = F.lit(2).cast("bigint")
        bins = F.sequence(F.floor(F.col(f"lo_{h}") / F.pow(wide, f"lv_{h}")), F.floor(F.col(f"hi_{h}") / F.pow(wide, f"lv_{h}")))
        waiting = holds.withColumn("bin", F.explode(bins)).withColumnRenamed(f"lv_{h}", "lv")
        sent = starts.join(have, on).withColumn("bin", F.floor(F.col(f"lo_{s}") / F.pow(wide, "lv"))).drop(f"lv_{s}")
        order = F.col(f"lo_{h}") < F.col(f"lo_{s}") if strict else F.col(f"lo_{h}") <= F.col(f"lo_{s}")
        return waiting.join(sent, [*on, "lv", "bin"]).filter(order & (F.col(f"hi_{h}") >= F.col(f"lo_{s}"))).drop("lv", "bin")

    first = half(straight_a, straight_b, "a", "b", False)
    out = first.unionByName(half(straight_b, straight_a, "b", "a", True).select(*first.columns))
    meets = (F.col("hi_a") >= F.col("lo_b")) & (F.col("hi_b") >= F.col("lo_a"))
    turned_a, turned_b = a.filter("hi_a < lo_a"), b.filter("hi_b < lo_b")  # no clause that makes sense
    out = out.unionByName(turned_a.join(b, on).filter(meets).select(*first.columns))
    return out.unionByName(a.filter("hi_a >= lo_a").join(turned_b, on).filter(meets).select(*first.columns))


def asset_overlap(clauses: DataFrame) -> DataFrame:
    """Pairs of exclusive clauses of two contracts on one asset whose periods meet.

    clauses(contract_id, clause_id, asset_id, is_exclusive, superseded, start, end); a null asset
    matches nothing, a superseded clause takes no part.
    """
    live = _days(clauses.filter(F.col("is_exclusive") & ~F.col("superseded")).select("contract_id", "clause_id", "asset_id", "start", "end"))
    met = meeting(_side(live, "a", "asset_id"), _side(live, "b", "asset_id"), ["asset_id"])
    return met.filter(F.col("contract_id_a") < F.col("contract_id_b")).drop("lo_a", "hi_a", "lo_b", "hi_b")


def price_trigger(clauses: DataFrame) -> DataFrame:
    """Most-favoured clauses against pricing clauses of other contracts of the same party, both ways.

    clauses(contract_id, clause_id, party_id, kind, start, end), kind 'mfn' or 'pricing'.
    """
    part = _days(clauses.select("contract_id", "clause_id", "party_id", "start", "end", "kind"))
    holder = _side(part.filter("kind = 'mfn'").drop("kind"), "a", "party_id")
    price = _side(part.filter("kind = 'pricing'").drop("kind"), "b", "party_id")
    return meeting(holder, price, ["party_id"]).filter(F.col("contract_id_a") != F.col("contract_id_b")).drop("lo_a", "hi_a", "lo_b", "hi_b")


LEVELS = 24  # 2^24 days hold all periods
EXACT = "decimal(30,9)"


def _blocks(lo: str, hi: str) -> Column:
    """The fewest aligned blocks (lv, k), of days k 2^lv to (k + 1) 2^lv - 1, that make up the days lo to hi, none below 0."""
    first, last = f"(({lo} + shiftleft(1L, l) - 1) div shiftleft(1L, l))", f"(({hi} + 1) div shiftleft(1L, l))"
    block = lambda odd, k: f"if({first} < {last} and {odd} % 2 = 1, named_struct('lv', l, 'k', {k}), null)"
    return F.expr(f"flatten(transform(sequence(0, {LEVELS}), l -> filter(array({block(first, first)}, {block(last, f'{last} - 1')}), x -> x is not null)))")


def summed_commitments(ceilings: DataFrame, commitments: DataFrame) -> DataFrame:
    """Ceilings that commitments of other contracts of the party, in the same unit and in overlapping periods, exceed together.

    Both: (contract_id, clause_id, party_id, unit, quantity, start, end). The largest commitment is named; of equals the
    first by contract and clause. Rows without a contract, and commitments without a quantity, take no part; sums are exact
    to nine decimals.

    A party and unit with at most 64 pairs for each row has its pairs made. In a crowded one no ceiling meets a commitment:
    one meets a period if it starts in it, or before it and holds its first day. So
    commitments are summed for aligned blocks of starts, and for the blocks that make up the days after their start;
    a ceiling reads the blocks of its own days, and those that hold its first day. What its own contract has in these
    blocks is taken off again; each block knows its largest commitment, and the largest of another contract than that.
    Rows grow with the logarithm of the periods' length, also where one party has very many of both.
    """
    at = ["party_id", "unit"]
    node = [*at, "side", "lv", "k"]
    c = _days(ceilings.filter("contract_id is not null")).select(*at, F.col("contract_id").alias("contract_id_c"), F.col("clause_id").alias("clause_id_c"), F.col("quantity").alias("quantity_c"), (F.col("lo") - FAR_PAST).alias("lo"), (F.col("hi") - FAR_PAST).alias("hi"))
    best = F.struct((-F.col("quantity")).alias("q"), "contract_id", "clause_id")
    m = _days(commitments.filter("contract_id is not null and quantity is not null")).select(*at, "contract_id", F.col("quantity").cast(EXACT).alias("s"), best.alias("best"), (F.col("lo") - FAR_PAST).alias("lo"), (F.col("hi") - FAR_PAST).alias("hi"))
    few, (c, m) = _by_crowd(c, m, at)
    c, turned_c = c.filter("lo <= hi"), c.filter("lo > hi")
    m, turned_m = m.filter("lo <= hi"), m.filter("lo > hi")
    own = ["contract_id_c", "clause_id_c", "quantity_c"]

    reads = c.select(*at, *own, F.lit("start").alias("side"), F.inline(_blocks("lo", "hi")))
    holds = m.select(*at, "contract_id", "s", "best", F.lit("after").alias("side"), F.inline(_blocks("(lo + 1)", "hi")))
    within = F.floor(F.col("lo") / F.pow(F.lit(2.0), "lv")).alias("k")
    starts = m.join(reads.select(*at, "lv").distinct(), at).select(*at, "contract_id", "s", "best", F.lit("start").alias("side"), "lv", within)
    points = c.join(holds.select(*at, "lv").distinct(), at).select(*at, *own, F.lit("after").alias("side"), "lv", within)
    asked = reads.unionByName(points)

    each = starts.unionByName(holds).groupBy(*node, "contract_id").agg(F.sum("s").cast("decimal(38,9)").alias("s"), F.count(F.lit(1)).alias("n"), F.min("best").alias("best"))
    whole = each.groupBy(*node).agg(F.sum("s").cast("decimal(38,9)").alias("s"), F.sum("n").alias("n"), F.min("best").alias("first"))
    other = each.join(whole.select(*node, F.col("first.contract_id").alias("__of")), node).filter("contract_id <> __of").groupBy(*node).agg(F.min("best").alias("second"))
    told = whole.join(other, node, "left")

    largest = F.when(F.col("first.contract_id") != F.col("contract_id_c"), F.col("first")).otherwise(F.col("second"))
    met = asked.join(told, node).select(*at, *own, "s", "n", largest.alias("largest"))
    mine = asked.join(each.withColumnRenamed("contract_id", "contract_id_c"), [*node, "contract_id_c"]).select(*at, *own, (-F.col("s")).alias("s"), (-F.col("n")).alias("n"), F.lit(None).cast(met.schema["largest"].dataType).alias("largest"))

    def pairs(ceiling: DataFrame, made: DataFrame) -> DataFrame:
        both = ceiling.join(made.withColumnsRenamed({"lo": "lo_m", "hi": "hi_m"}), at).filter("contract_id <> contract_id_c and hi >= lo_m and hi_m >= lo")
        return both.select(*at, *own, F.col("s").cast("decimal(38,9)").alias("s"), F.lit(1).cast("bigint").alias("n"), F.col("best").alias("largest"))

    parts = pairs(*few).unionByName(met).unionByName(mine).unionByName(pairs(turned_c, m.unionByName(turned_m))).unionByName(pairs(c, turned_m))  # periods that end before they begin are few
    summed = parts.groupBy(*at, *own).agg(F.sum("s").cast("double").alias("total"), F.sum("n").alias("n_commitments"), F.min("largest").alias("largest"))
    return summed.filter((F.col("n_commitments") > 0) & (F.col("total") > F.col("quantity_c")))


def family_suppressed(pairs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Pairs(contract_id_a, contract_id_b) without those where one amends the other inside a family.

    contracts(contract_id, family_id, amends_contract_id)
    """
    a = contracts.select(F.col("contract_id").alias("contract_id_a"), F.col("family_id").alias("family_a"), F.col("amends_contract_id").alias("amends_a"))
    b = contracts.select(F.col("contract_id").alias("contract_id_b"), F.col("family_id").alias("family_b"), F.col("amends_contract_id").alias("amends_b"))
    both = pairs.join(a, "contract_id_a", "left").join(b, "contract_id_b", "left")
    related = F.coalesce((F.col("family_a") == F.col("family_b")) & ((F.col("amends_a") == F.col("contract_id_b")) | (F.col("amends_b") == F.col("contract_id_a")) | False), F.lit(False))
    return both.filter(~related).select(*pairs.columns)


def scope_judgements(scopes: DataFrame, *keys: str) -> DataFrame:
    """Pairs of different scopes(kind, canonical_id) within the same keys, of one kind, that containment can't settle, as one of them isn't resolved."""
    on = [*keys, "kind"]
    rows = scopes.select(*on, "canonical_id").withColumn("nth", F.row_number().over(Window.partitionBy(*on).orderBy(F.asc_nulls_last("canonical_id"))))
    a, b = rows.withColumnsRenamed({"canonical_id": "a", "nth": "i"}), rows.filter("canonical_id is null").withColumnsRenamed({"canonical_id": "b", "nth": "j"})
    return a.join(b, on).filter("i < j").select(*on, "a", "b")


def needs_judgement(kind_a: Column, id_a: Column, kind_b: Column, id_b: Column) -> Column:
    """Whether two scopes are of one kind and one of them isn't resolved."""
    return (kind_a == kind_b) & (id_a.isNull() | id_b.isNull())


def scoped(clauses: DataFrame) -> DataFrame:
    """Clauses with scopes array<struct<canonical_id, ...>> as a row for each different resolved asset that they cover."""
    ids = F.array_distinct(F.filter(F.transform("scopes", lambda s: s["canonical_id"]), lambda i: i.isNotNull()))
    return clauses.withColumn("asset_id", F.explode(ids))


def covers(asset: Column, scopes: Column) -> Column:
    return F.exists(scopes, lambda s: s["canonical_id"] == asset)


def group_counts(links: DataFrame, key: str) -> DataFrame:
    """How many groups resolved keys make, in one row; unresolved ones make none."""
    return links.filter(F.col(key).isNotNull()).agg(F.count_distinct(key).alias("n_groups"))


def number_text(x: Column) -> Column:
    """A number without needless zeros, six digits at most."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(x, 6)), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def explain_overlap(asset: Column, said_a: Column, said_b: Column) -> Column:
    said = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unspecified"))
    return F.concat(F.lit("Asset "), asset, F.lit(" is granted twice in periods that meet ("), said(said_a), F.lit(" and "), said(said_b), F.lit(")."))


def explain_sum(total: Column, unit: Column, count: Column, ceiling: Column) -> Column:
    return F.concat(F.lit("Commitments of "), number_text(total), F.lit(" "), unit, F.lit(" in "), count.cast("string"), F.lit(" clauses exceed the ceiling of "), number_text(ceiling), F.lit("."))
