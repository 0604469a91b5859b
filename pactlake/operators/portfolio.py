"""Portfolio operators: calendar, benchmarks, retrieval, invoices, latest rows, writers, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions import labels, text
from pactlake.operators import entities


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order, which must be total."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def calendar_events(contracts: DataFrame) -> DataFrame:
    """One event for each contract with a known expiry.

    contracts(contract_id, expiry date, notice_days int, renewal_months int): the notice moves the day to act on
    before the expiry; with a parsed renewal it is an auto-renewal, assembled if there is a day to act on.
    """
    act = F.when(F.col("notice_days").isNotNull(), F.date_sub("expiry", F.col("notice_days")))
    renews = F.col("renewal_months").isNotNull()
    tier = F.when(renews & act.isNotNull(), "assembled").otherwise("normalised")
    return contracts.filter(F.col("expiry").isNotNull()).select("contract_id", F.when(renews, "auto_renewal").otherwise("expiry").alias("event_type"), F.col("expiry").alias("event_date"), act.alias("action_by"), tier.alias("tier"))


def calendar_window(events: DataFrame, as_of: str, days: int = 90, floor: str = "unverified", since: str | None = None, status: str = "active") -> DataFrame:
    """Events to act on until `days` after as_of, the overdue ones too unless since says from when, of at least a tier, in order of the day.

    status: active (open and acknowledged), all, or one of them, where events have one.
    """
    if "status" in events.columns and status != "all":
        events = events.filter(F.col("status").isin(*(("open", "acknowledged") if status == "active" else (status,))))
    if since is not None:
        events = events.filter(F.coalesce("action_by", "event_date") >= F.lit(since).cast("date"))
    effective = F.coalesce("action_by", "event_date")
    limit = labels.TIERS.index(floor)
    kept = events.withColumn("effective", effective).filter((F.col("effective") <= F.date_add(F.lit(as_of).cast("date"), days)) & (labels.rank(F.col("tier"), labels.TIERS) <= limit))
    return kept.withColumn("band", labels.date_band(F.col("effective"), F.lit(as_of).cast("date"))).orderBy("effective", "event_date", "contract_id")


def term_months(start: Column, end: Column) -> Column:
    """Whole months of 30.44 days, if over 0."""
    months = F.floor(F.date_diff(end, start) / 30.44 + 0.5)
    return F.when(months > 0, months)


def benchmarks(values: DataFrame, active: DataFrame, directions: dict[str, str]) -> DataFrame:
    """values(contract_id, category, value) against the mean of active contracts(contract_id)."""
    mean = values.join(active, "contract_id", "left_semi").groupBy("category").agg(F.avg("value").alias("average"))
    out = values.join(F.broadcast(mean), "category", "left")  # a row per category
    percent = F.lit(None).cast("bigint")
    for name, direction in directions.items():
        percent = F.when(F.col("category") == name, labels.worse_percent(F.col("value"), F.col("average"), direction)).otherwise(percent)
    return out.withColumn("percent_worse", percent).withColumn("risk", labels.traffic_light(F.col("percent_worse")))


def field_matches(predicate: dict, absent: Column, tier: Column, number: Column, day: Column) -> Column:
    """One condition on a field: {'state': 'absent' | 'present'} or {'op': 'lt|lte|gt|gte|eq', 'value': x} or {'from': d, 'to': d}.

    Absence comes first; unverified values match no number or date.
    """
    if "state" in predicate:
        return absent if predicate["state"] == "absent" else ~absent
    firm = ~absent & (tier != "unverified")
    if "op" in predicate:
        v = F.lit(predicate["value"])
        test = {"lt": number < v, "lte": number <= v, "gt": number > v, "gte": number >= v, "eq": number == v}[predicate["op"]]
    else:
        test = day.between(F.lit(predicate["from"]).cast("date"), F.lit(predicate["to"]).cast("date"))
    return F.coalesce(firm & test, F.lit(False))


def retrieve(contracts: DataFrame, condition: Column, name: str | None = None, scan: int = 200, show: int = 50) -> DataFrame:
    """Contracts (contract_id, name, ...) whose name has a part, the first `scan` by id, of them those that meet the condition, `show` at most."""
    some = contracts if name is None else contracts.filter(F.lower("name").contains(name.lower()))
    return some.orderBy("contract_id").limit(scan).filter(condition).orderBy("contract_id").limit(show)


def _grams(name: Column) -> Column:
    """The distinct runs of up to three characters of a name, those of three alone if it has any."""
    n = F.length(name)
    run = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1))), lambda i: F.substr(name, i, F.lit(k)))
    return F.array_distinct(F.when(n >= 3, run(3)).when(n == 2, run(2)).otherwise(run(1)))


def _all_grams(name: Column) -> Column:
    n = F.length(name)
    run = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1))), lambda i: F.substr(name, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(run(1), run(2), run(3)))


def matched_parties(names: DataFrame, known: DataFrame) -> DataFrame:
    """v, p and method for normalised names(name) and known(name): exact if equal, fuzzy if one is in the other, by letters or by words.

    Candidates are equal names, and for a name inside another one those with its rarest word or run of letters.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    pairs = names.join(known, "name").select(F.col("name").alias("v"), F.col("name").alias("p"))
    for small, big, order in ((names, known, ("s", "b")), (known, names, ("b", "s"))):
        found = entities.containing(small, big, words).unionByName(_by_letters(small, big))
        pairs = pairs.unionByName(found.select(F.col(order[0]).alias("v"), F.col(order[1]).alias("p")))
    return pairs.distinct().withColumn("method", text.match_method(F.col("v"), F.col("p"))).filter("method is not null")


def _by_letters(small: DataFrame, big: DataFrame) -> DataFrame:
    long, short = small.filter(F.length("name") >= 3), small.filter(F.length("name") < 3)
    some = entities.containing(long, big.filter(F.length("name") >= 3), _grams)
    return some.unionByName(entities.containing(short, big, lambda c: F.when(F.length(c) < 3, _grams(c)).otherwise(_all_grams(c))))


def reconcile_invoices(invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """Status, tier, contract, method and reason of each invoice.

    invoices(invoice_id, vendor, invoice_date), contracts(contract_id, party[, parties], start, end): a contract's
    party, and the names in its parties clause, are its names; an exact one beats a fuzzy one. Without a vendor or a
    contract of its name an invoice is rogue; with several contracts, or a date that isn't known to be inside, it is
    to be reviewed.
    """
    inv = invoices.withColumn("v", text.normalize_invoice_party(F.col("vendor")))
    names = inv.select(F.col("v").alias("name")).filter("name <> ''").distinct()
    said = F.array("party", "parties") if "parties" in contracts.columns else F.array("party")
    parties = contracts.select("contract_id", "start", "end", F.explode(F.array_compact(said)).alias("n")).select("contract_id", "start", "end", text.normalize_invoice_party(F.col("n")).alias("p"))
    near = matched_parties(names, parties.select(F.col("p").alias("name")).filter("name <> ''").distinct())
    matched = inv.join(near, "v").join(parties, "p").select("invoice_id", "contract_id", "method", "start", "end")
    best = matched.groupBy("invoice_id", "contract_id").agg(F.min("method").alias("method"), F.first("start").alias("start"), F.first("end").alias("end"))
    one = best.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("n"), F.min("contract_id").alias("contract_id"), F.min("method").alias("method"), F.min("start").alias("start"), F.min("end").alias("end"))
    out = invoices.join(one, "invoice_id", "left")
    inside = F.coalesce(F.col("invoice_date").between(F.col("start"), F.col("end")), F.lit(False))
    status = F.when(F.col("n").isNull(), "MISSING_CONTRACT_ROGUE").when(F.col("n") > 1, "MULTIPLE_CONTRACTS_REVIEW").when(inside, "HIGH_CONFIDENCE_MATCH").otherwise("DATE_MISMATCH_REVIEW")
    tier = F.when((status == "HIGH_CONFIDENCE_MATCH") & (F.col("method") == "exact"), "normalised").otherwise("inferred")
    reason = (
        F.when(F.coalesce("vendor", F.lit("")) == "", "no_vendor").when(F.col("n").isNull(), "no_contract_of_vendor").when(F.col("n") > 1, "several_contracts").when(F.col("invoice_date").isNull(), "no_invoice_date")
        .when(F.col("start").isNull() | F.col("end").isNull(), "no_contract_dates").when(inside, "inside_term").otherwise("outside_term")
    )
    single = F.col("n") == 1
    return out.select(*invoices.columns, status.alias("status"), tier.alias("tier"), F.when(single, F.col("contract_id")).alias("contract_id"), F.when(single, F.col("method")).alias("method"), reason.alias("reason"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and the old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """New rows with `duplicate`: their key is there already, or earlier among the new ones."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    have = old.select(*keys).distinct().withColumn("__old", F.lit(True))
    return new.withColumn("__n", nth).join(have, list(keys), "left").withColumn("duplicate", (F.col("__n") > 1) | F.coalesce("__old", F.lit(False))).drop("__n", "__old")


def replace_source(rows: DataFrame, source: str, new: DataFrame) -> DataFrame:
    """Rows of other sources, and the new ones of this one."""
    return rows.filter(~F.col("source").eqNullSafe(source)).unionByName(new.withColumn("source", F.lit(source)).select(*rows.columns))


def cascade_delete(parents: DataFrame, gone: DataFrame, children: dict[str, DataFrame], key: str, set_null: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Parents and children without those of gone(key); children named in set_null keep their rows and lose the key."""
    ids = gone.select(key).distinct()
    out = {"parents": parents.join(ids, key, "left_anti")}
    for name, child in children.items():
        if name in set_null:
            hit = child.join(ids.withColumn("__gone", F.lit(True)), key, "left")
            out[name] = hit.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(*child.columns)
        else:
            out[name] = child.join(ids, key, "left_anti")
    return out


def hydrate(rows: DataFrame, id: str, ids: str, dim: DataFrame, key: str, value: str) -> DataFrame:
    """The values that an array of ids stands for, in its order, dangling ones left out; rows without any have an empty array."""
    found = rows.select(id, F.posexplode(ids).alias("__pos", key)).join(dim.select(key, value), key)
    listed = found.groupBy(id).agg(F.transform(F.sort_array(F.collect_list(F.struct("__pos", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))
    return rows.select(id).join(listed, id, "left").withColumn("values", F.coalesce("values", F.array().cast(f"array<{dim.schema[value].dataType.simpleString()}>")))
