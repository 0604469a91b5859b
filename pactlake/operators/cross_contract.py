"""Contracts against each other: facts of a contract, registries, checks of pairs, and the report.

Tables: docs(contract_id, doc_ord, counterparties, family, amends), findings(contract_id,
category, answer, summary, evidence_status) and extractions(contract_id, category, ord,
vlm_text, supporting_text, page, clause, is_grounded). doc_ord orders the contracts: of a
pair the earlier one stands on the left, and checks aren't symmetric.

`contract_facts` folds all that checks ask of a contract into a row. A pair is looked at
if the contracts share a party that isn't common to the portfolio, or an asset. Names that
match are found by the rarest telling word of the shorter one; contracts then meet by
names and assets, each with all that checks ask of it, so that a pair is judged where it
meets, under the first of what it shares, and no row of a pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions import labels, text
from pactlake.operators import entities
from pactlake.session import saved

# Categories, words and patterns that decide results, in their order.
PRIORITY = (
    "exclusivity", "most_favored_nation", "non_compete", "no_solicit_of_customers",
    "no_solicit_of_employees", "rofr_rofo_rofn", "change_of_control", "anti_assignment",
    "ip_ownership_assignment", "joint_ip_ownership", "license_grant", "non_transferable_license",
    "termination_for_convenience", "minimum_commitment", "volume_restriction", "price_restrictions",
    "revenue_profit_sharing", "cap_on_liability", "uncapped_liability", "covenant_not_to_sue",
)
FINANCIAL = ("minimum_commitment", "volume_restriction", "price_restrictions", "revenue_profit_sharing")
RESTRICTIVE = ("non_compete", "no_solicit_of_customers", "no_solicit_of_employees")
CONTINGENT = ("termination_for_convenience", "change_of_control", "anti_assignment")
ASSETS = ("exclusivity", "license_grant", "ip_ownership_assignment", "non_transferable_license")
IP_ASSETS = ("ip_ownership_assignment", "license_grant", "joint_ip_ownership")
TERRITORIES = ("worldwide", "singapore", "malaysia", "united states", "u.s.", "europe", "asia", "global")
CONTINGENCY = r"(so long as|upon termination of|subject to|conditioned on|contingent (?:up)?on).{0,60}\bagreement\b"
NOT_EXCLUSIVE = "non-exclusive"
QUOTE = 400
NOBODY = "(shared subject matter)"

_TEXTS = ("exclusivity", "license_grant", *CONTINGENT, "effective_date", "agreement_date", "expiration_date", "governing_law")
_BLANK = " \t\n\x0b\f\r"


def _has(category: str) -> Column:
    return F.array_contains("present", category)


def _first_present(categories: tuple[str, ...]) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, categories)), lambda c: F.array_contains("present", c)), 0)


def _cite(*categories: str) -> Column:
    """The citation of the first of the categories that has an extraction, be its quote blank."""
    return F.coalesce(*(F.col("cites")[c] for c in categories))


@dataclass(frozen=True)
class Check:
    """left and right: whether a contract may stand there, and the citation; pair: a test of facts _a and _b; needs: assets, ents or both."""

    type: str
    severity: str
    left: tuple[Callable[[], Column], Callable[[], Column]]
    right: tuple[Callable[[], Column], Callable[[], Column]]
    says: str
    advice: str
    needs: tuple[str, ...] = ()
    pair: Callable[[], Column] | None = None
    inferred: bool = False
    subject: tuple[str, ...] = ("ents",)
    otherwise: str = ""


def _overlap() -> Column:
    """Windows meet; an unknown end is open."""
    return ~F.coalesce(F.col("end_a") < F.col("start_b"), F.lit(False)) & ~F.coalesce(F.col("end_b") < F.col("start_a"), F.lit(False))


def _any(*categories: str) -> Callable[[], Column]:
    def test() -> Column:
        out = _has(categories[0])
        for c in categories[1:]:
            out = out | _has(c)
        return out

    return test


_grant = (_any("license_grant", "exclusivity"), lambda: _cite("license_grant", "exclusivity"))
_where = (lambda: F.size("territories") > 0, lambda: _cite("exclusivity", "license_grant"))

# Types, severities and the words for what has no name, as reports have them.
CHECKS: tuple[Check, ...] = (
    Check("Exclusivity / Double-Grant Conflict", "Critical", (lambda: _has("exclusivity") & ~F.col("not_exclusive"), lambda: _cite("exclusivity")), (_any("exclusivity"), lambda: _cite("exclusivity")),
          "Each contract promises exclusivity while the other one's term runs.", "Have counsel decide which promise stands.", pair=_overlap, subject=("assets", "ents"), otherwise="the exclusive subject matter"),
    Check("MFN Conflict", "Significant", (_any("most_favored_nation"), lambda: _cite("most_favored_nation")), (_any("price_restrictions", "revenue_profit_sharing"), lambda: _cite("price_restrictions", "revenue_profit_sharing")),
          "Prices or shares agreed in one contract may be better than the other's best terms.", "Hold the two contracts' prices against each other.", otherwise="MFN subject matter"),
    Check("Territorial / Field-of-Use Overlap", "Critical", _where, _where,
          "The same asset is granted twice in one territory.", "Look for carve-outs that part the territories.", needs=("assets",), pair=lambda: F.arrays_overlap("territories_a", "territories_b"), subject=("assets",)),
    *(Check("Contingency / Dependency Conflict", "Significant", (lambda c=c: F.array_contains("contingent", c), lambda c=c: _cite(c)), (lambda: F.lit(True), lambda: _cite("expiration_date", "termination_for_convenience")),
            "A clause of the first contract hangs on an agreement that the second may end.", "See how long that agreement still runs.", inferred=True, otherwise="dependent obligation") for c in CONTINGENT),
    Check("IP Ownership / License-Stack Conflict", "Critical", (_any("ip_ownership_assignment"), lambda: _cite("ip_ownership_assignment")), (_any("license_grant", "joint_ip_ownership"), lambda: _cite("license_grant", "joint_ip_ownership")),
          "What one contract assigns the other licenses or owns jointly.", "Trace the title before using either right.", subject=("ip_assets", "ents"), otherwise="the intellectual property"),
    Check("Party Role Contradiction", "Critical", (lambda: _has("license_grant") & ~_has("non_transferable_license"), lambda: _cite("license_grant")), (_any("license_grant"), lambda: _cite("license_grant")),
          "A party takes and gives rights in one asset, and no sublicence joins the two.", "Ask for the right to sublicense.", needs=("ents", "assets"), inferred=True, subject=("assets",)),
    Check("Term / Renewal Conflict", "Significant", (lambda: _has("renewal_term") & F.col("end").isNotNull(), lambda: _cite("renewal_term")), (lambda: F.col("end").isNotNull(), lambda: _cite("expiration_date")),
          "The first contract renews beyond the day on which the second expires.", "Bring the two dates together.", needs=("ents",), pair=lambda: F.col("end_a") > F.col("end_b"), inferred=True),
    Check("Financial Commitment Conflict", "Significant", (_any(*FINANCIAL), lambda: F.col("cites")[_first_present(FINANCIAL)]), (_any(*FINANCIAL), lambda: F.col("cites")[_first_present(FINANCIAL)]),
          "Both contracts commit to amounts or prices that may draw on the same means.", "Check that both can be kept at once.", needs=("assets",)),
    Check("Liability / Indemnity Conflict", "Significant", (_any("cap_on_liability"), lambda: _cite("cap_on_liability")), (_any("uncapped_liability", "third_party_beneficiary"), lambda: _cite("uncapped_liability", "third_party_beneficiary")),
          "One contract caps a liability that the other leaves open or hands on.", "Check the cap against the indemnity.", needs=("assets",)),
    Check("Assignment / Change-of-Control Conflict", "Significant", (_any("anti_assignment"), lambda: _cite("anti_assignment")), (_any("change_of_control"), lambda: _cite("change_of_control")),
          "A transfer that one contract foresees may need the consent that the other reserves.", "Find out whose consent is needed.", needs=("assets",)),
    Check("Governing Law / Forum Conflict", "Administrative", (lambda: F.col("law").isNotNull(), lambda: _cite("governing_law")), (lambda: F.col("law").isNotNull(), lambda: _cite("governing_law")),
          "The two contracts are under different laws.", "Note it for disputes that touch both.", needs=("ents",), pair=lambda: F.col("law_a") != F.col("law_b")),
    Check("Non-Compete / Non-Solicit Overlap", "Significant", (_any(*RESTRICTIVE), lambda: F.col("cites")[_first_present(RESTRICTIVE)]), _grant,
          "One contract forbids what the other may need.", "Check the restraint against the grant.", needs=("assets",)),
)


#: Categories that checks cite.
CITED = tuple(dict.fromkeys((*PRIORITY, "renewal_term", "expiration_date", "third_party_beneficiary", "governing_law")))
#: Bits by which a contract's checks on the right stand beyond those on the left.
RIGHT = 31
#: Bytes of a generated method that Java doesn't compile: Spark is to run such a stage by operators, whose code is cut into small methods.
HUGE = 8000
_IP = next(k for k, c in enumerate(CHECKS) if c.subject[0] == "ip_assets")


def _answered(findings: DataFrame, extractions: DataFrame) -> DataFrame:
    """Findings with the parts of their extractions in order and c, the citation, firm if the evidence is direct; extractions of no finding too.

    Both are shuffled once, by contract: what is asked of a contract's rows next finds them together.
    """
    told = findings.select("contract_id", "category", F.struct("answer", "summary", "evidence_status").alias("f"))
    heard = extractions.select("contract_id", "category", F.struct("ord", "vlm_text", "supporting_text", "page", "clause", "is_grounded").alias("e"))
    both = told.unionByName(heard, allowMissingColumns=True).repartition("contract_id").select("contract_id", "category", "f", F.col("e").isNotNull().alias("extracted"), "e.*")
    firm = F.coalesce("is_grounded", F.lit(False))
    said = F.coalesce(F.nullif("supporting_text", F.lit("")), "vlm_text", F.lit(""))
    quote = F.substring(F.btrim(said, F.lit(_BLANK)), 1, QUOTE)
    cited = F.struct(F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("clause", F.lit("—")).alias("clause"), quote.alias("quote"), firm.alias("firm"))
    part = F.struct("ord", F.coalesce("vlm_text", F.lit("")).alias("v"), F.coalesce("supporting_text", F.lit("")).alias("s"), said.alias("said"))
    of = lambda c: F.when(F.col("extracted"), c)
    rows = both.groupBy("contract_id", "category").agg(F.collect_list("f").alias("f"), F.min_by(cited, of(F.struct(~firm, F.col("ord")))).alias("c"), F.array_sort(F.collect_list(of(part))).alias("parts"))
    rows = rows.select("contract_id", "category", F.explode_outer("f").alias("f"), "c", "parts").select("contract_id", "category", "f.*", "c", "parts")
    return rows.withColumn("c", F.when(F.col("c").isNotNull(), F.col("c").withField("firm", F.col("c.firm") & (F.coalesce("evidence_status", F.lit("unresolved")) == "direct"))))


def contract_facts(docs: DataFrame, findings: DataFrame, extractions: DataFrame) -> DataFrame:
    """A row for each contract: what is present and unresolved, citations, names, assets, dates, territories, law."""
    rows = _answered(findings, extractions)
    pieces = F.flatten(F.transform(F.coalesce("parts", F.array().cast("array<struct<ord:int,v:string,s:string,said:string>>")), lambda p: F.array(p["v"], p["s"])))
    rows = rows.withColumns({
        "text": F.when(F.col("category").isin(*_TEXTS), F.lower(F.array_join(F.concat(F.array(F.coalesce("summary", F.lit(""))), pieces), " "))),
        "said": F.when(F.col("category").isin("parties", *ASSETS, *IP_ASSETS), F.transform("parts", lambda p: p["said"])),
    })
    of_text = lambda c: F.coalesce(F.max(F.when(F.col("category") == c, F.col("text"))), F.lit(""))
    heard = lambda cs: F.flatten(F.collect_list(F.when(F.col("category").isin(*cs), F.col("said"))))
    folded = rows.groupBy("contract_id").agg(
        F.collect_set(F.when(F.col("answer") == "present", F.col("category"))).alias("present"),
        F.collect_set(F.when((F.col("answer") == "unresolved") | (F.col("evidence_status") == "unresolved"), F.col("category"))).alias("unresolved"),
        F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("category", "c")))).alias("cites"),
        heard(("parties",)).alias("parties"), heard(ASSETS).alias("a"), heard(IP_ASSETS).alias("i"), *(of_text(c).alias(f"t_{c}") for c in _TEXTS),
    )
    none = F.array().cast("array<string>")
    f = docs.select("contract_id", "doc_ord", F.coalesce("counterparties", none).alias("counterparties"), "family", "amends").join(folded, "contract_id", "left")
    of_assets = lambda c: F.array_distinct(F.flatten(F.transform(F.coalesce(c, none), text.asset_phrases)))
    raw = F.concat(F.flatten(F.transform(F.coalesce("parties", none), text.party_names)), "counterparties")
    both = F.concat(F.coalesce("t_exclusivity", F.lit("")), F.coalesce("t_license_grant", F.lit("")))
    day = lambda c: text.parse_date(F.col(f"t_{c}"), extended=False)
    return f.select(
        "contract_id", "doc_ord", "family", "amends", *(F.coalesce(c, none).alias(c) for c in ("present", "unresolved")), "cites", raw.alias("raw_names"),
        F.array_distinct(F.filter(F.transform(raw, text.normalize_entity), lambda n: n != "")).alias("names"), of_assets("a").alias("assets"), of_assets("i").alias("ip_assets"),
        F.coalesce(F.contains("t_exclusivity", F.lit(NOT_EXCLUSIVE)), F.lit(False)).alias("not_exclusive"), F.filter(F.array(*map(F.lit, TERRITORIES)), lambda t: F.contains(both, t)).alias("territories"),
        F.array_compact(F.array(*(F.when(F.col(f"t_{c}").rlike("(?d)" + CONTINGENCY), c) for c in CONTINGENT))).alias("contingent"),
        F.coalesce(day("effective_date"), day("agreement_date")).alias("start"), day("expiration_date").alias("end"), text.governing_law(F.col("t_governing_law")).alias("law"),
    )


def dated_facts(docs: DataFrame, findings: DataFrame, extractions: DataFrame) -> DataFrame:
    """Of `contract_facts` what registries and edges ask for, made from what is said of parties and dates alone."""
    told = F.col("category").isin("parties", "effective_date", "agreement_date", "expiration_date")
    return contract_facts(docs, findings.filter(told), extractions.filter(told)).select("contract_id", "doc_ord", "family", "amends", "raw_names", "names", "start", "end")


def mentions(facts: DataFrame) -> DataFrame:
    """contract_id, doc_ord, ord and raw: the names that contracts give their parties, in order."""
    return facts.select("contract_id", "doc_ord", F.posexplode("raw_names").alias("ord", "raw"))


def entity_registry(facts: DataFrame) -> DataFrame:
    """entity_id, aliases, contracts (both sorted) and n_contracts of each party."""
    return entities.entity_clusters(mentions(facts)).select(F.col("cluster").alias("entity_id"), "aliases", "contracts", "n_contracts")


def obligation_registry(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """contract_id, category, summary and the citation of each present finding of a priority category."""
    kept = findings.filter(F.col("category").isin(*PRIORITY) & (F.col("answer") == "present")).select("contract_id", "category", F.coalesce("summary", F.lit("")).alias("summary"))
    return kept.join(facts.select("contract_id", "cites"), "contract_id", "left").select("contract_id", "category", "summary", F.col("cites")[F.col("category")].alias("evidence"))


def cited_obligations(findings: DataFrame, extractions: DataFrame) -> DataFrame:
    """What `obligation_registry` gives, from findings and extractions of the priority categories, with no row of a whole contract."""
    told = F.col("category").isin(*PRIORITY)
    kept = _answered(findings.filter(told & (F.col("answer") == "present")), extractions.filter(told)).filter(F.col("answer") == "present")
    return kept.select("contract_id", "category", F.coalesce("summary", F.lit("")).alias("summary"), F.col("c").alias("evidence"))


def _named(facts: DataFrame) -> DataFrame:
    return facts.select("contract_id", "doc_ord", F.explode("names").alias("name"))


def _meetings(left: DataFrame, right: DataFrame, only: DataFrame | None) -> list[tuple[DataFrame, DataFrame]]:
    """What to join to find pairs of a in left and b in right: all, or those of which a or b is in only(contract_id), each once."""
    if only is None:
        return [(left, right)]
    a, b = only.select(F.col("contract_id").alias("a")), only.select(F.col("contract_id").alias("b"))
    return [(left.join(a, "a", "left_semi"), right), (left.join(a, "a", "left_anti"), right.join(b, "b", "left_semi"))]


def _matches(facts: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """met(x, y), names that match, facts with linked, those of a contract's names that match another one than themselves, and whether there are such names."""
    met = saved(entities.matching_names(_named(facts).select("name").distinct()), "met")
    none = F.array().cast("array<string>")
    if met.filter("x <> y").isEmpty():  # the usual case: facts needn't be shuffled to learn nothing
        return met, facts.withColumn("linked", none), False
    own = _named(facts).join(met.filter("x <> y").select(F.col("x").alias("name")).distinct(), "name", "left_semi").groupBy("contract_id").agg(F.collect_set("name").alias("linked"))
    return met, facts.join(own, "contract_id", "left").withColumn("linked", F.coalesce("linked", none)), True


def _matching(linked: bool = True) -> Column:
    """Names of contract a that match a name of b, in order; linked: whether names match that aren't equal."""
    if not linked:
        return F.sort_array(F.array_intersect("names_a", "names_b"))
    near = F.filter("linked_a", lambda x: F.exists("linked_b", lambda y: entities.names_match(x, y)))
    return F.array_sort(F.array_union(F.array_intersect("names_a", "names_b"), near))


def _least_match() -> Column:
    """The least name of b that matches x, a name of a."""
    near = F.filter("linked_b", lambda y: F.array_contains("linked_a", F.col("x")) & entities.names_match(F.col("x"), y))
    return F.array_min(F.concat(near, F.filter("names_b", lambda y: y == F.col("x"))))


def dependency_edges(facts: DataFrame) -> DataFrame:
    """source, target, kind and inferred: amendments of contracts that are there, families both ways, and pairs that share a party while their windows meet."""
    met, facts, _ = _matches(facts)
    ids = facts.select(F.col("contract_id").alias("target"))
    amends = facts.select(F.col("contract_id").alias("source"), F.col("amends").alias("target")).join(ids, "target", "left_semi").select("source", "target", F.lit("amends").alias("kind"), F.lit(False).alias("inferred"))
    kin = facts.select("family", F.col("contract_id").alias("target"))
    family = facts.select("family", F.col("contract_id").alias("source")).join(kin, "family").filter("source <> target").select("source", "target", F.lit("family").alias("kind"), F.lit(False).alias("inferred"))
    side = lambda s: facts.select(F.col("contract_id").alias(s), F.col("doc_ord").alias(f"ord_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("names", "linked", "start", "end")))
    by_name = side("a").withColumn("x", F.explode("names_a")).join(met, "x").join(side("b").withColumn("y", F.explode("names_b")), "y").filter("ord_a < ord_b").filter(_overlap())
    pairs = by_name.filter((F.get(_matching(), F.lit(0)) == F.col("x")) & (_least_match() == F.col("y")))
    return amends.unionByName(family).unionByName(pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("inferred").alias("kind"), F.lit(True).alias("inferred")))


def _side(side: str) -> list[Column]:
    """The place of the citation of each check that a contract may stand in on a side, null elsewhere."""
    rows = []
    for check in CHECKS:
        test, cite = (f() for f in getattr(check, side))
        rows.append(F.when(test & (F.coalesce(cite["quote"], F.lit("")) != ""), cite["at"]))
    return rows


def usual_names(facts: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """x: names that match a party which so many contracts name that it makes no pair."""
    met = entities.matching_names(_named(facts).select("name").distinct()) if met is None else met
    common = entities.common_entities(entity_registry(facts), facts.agg(F.count(F.lit(1)).alias("n"))).select(F.col("entity_id").alias("y"))
    return met.join(common, "y", "left_semi").select("x").distinct()


def _may(facts: DataFrame) -> DataFrame:
    """Contracts that may stand on a side: what checks ask of them, a bit for each check on the left and, RIGHT bits on, on the right, and citations with their places by side and check, 0 for none, and marks of their quotes.

    The columns are the same for both sides, so that contracts that meet are shuffled once and read from both.
    """
    cited = F.map_filter("cites", lambda c, _: c.isin(*CITED))
    rows = facts.withColumn("cites", cited).withColumn("told", F.map_values("cites"))
    rows = rows.withColumn("cites", F.map_from_arrays(F.map_keys("cites"), F.transform("told", lambda c, i: c.withField("at", i + 1))))
    rows = rows.withColumn("place", F.array(*(F.coalesce(c, F.lit(0)).cast("tinyint") for c in (*_side("left"), *_side("right")))))
    bit = lambda k: F.lit(1 << (k % len(CHECKS)) + (RIGHT if k >= len(CHECKS) else 0)).cast("bigint")
    bits = reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.get("place", F.lit(k)) > 0, bit(k)).otherwise(F.lit(0).cast("bigint")) for k in range(2 * len(CHECKS))))
    rows = rows.withColumns({"bits": bits, "open": F.array_contains("unresolved", "exclusivity")}).filter("bits <> 0").drop("cites").withColumnRenamed("told", "cites")
    rows = rows.withColumn("marks", F.transform("place", lambda i: F.when(i > 0, F.hash(F.get("cites", i - 1)["quote"]))))
    ip = F.lit((1 << _IP) | (1 << _IP + RIGHT)).cast("bigint")
    ip_assets = F.when(F.col("bits").bitwiseAND(ip) != 0, F.col("ip_assets"))
    own = ["file"] if "file" in facts.columns else []
    kept = {"ord": "doc_ord", **{c: c for c in ("bits", "names", "linked", "usual", "assets", "start", "end", "territories", "law", "open", "cites", "place", "marks", *own)}}
    return rows.select("contract_id", *(F.col(c).alias(n) for n, c in kept.items()), ip_assets.alias("ip_assets"))


def _as(may: DataFrame, s: str) -> DataFrame:
    """Contracts as side `s` of a pair; keys by which they meet keep their names."""
    return may.select(*(F.col(c) if c in ("kind", "key", "x") else F.col(c).alias(s if c == "contract_id" else f"{c}_{s}") for c in may.columns))


def _met_pairs(facts: DataFrame, only: DataFrame | None = None, usual: DataFrame | None = None) -> DataFrame:
    """A row for each name or asset by which contracts meet: all that is kept of both, ents, entities, assets and checks, the numbers of the conflicts.

    Of the rows of a pair one has checks, that whose name or asset comes first in what both share: there are no rows
    to bring together.
    """
    facts.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE)
    met, facts, linked = _matches(facts)
    usual = saved(usual_names(facts, met) if usual is None else usual, "usual")
    none = F.array().cast("array<string>")
    some_usual = not usual.isEmpty()
    if not some_usual:
        facts = facts.withColumn("usual", none)
    else:  # names that many share don't make a pair, but are named where a pair is made
        often = _named(facts).join(usual.withColumnRenamed("x", "name"), "name", "left_semi").groupBy("contract_id").agg(F.collect_set("name").alias("usual"))
        facts = facts.join(often, "contract_id", "left").withColumn("usual", F.coalesce("usual", none))
    may = _may(facts)

    # Contracts of one name or asset meet from one table, which is shuffled once; the few whose names only match, by what they match.
    name, asset = 0, 1
    of = lambda what: lambda k: F.struct(F.lit(what).cast("tinyint").alias("kind"), k.alias("key"))
    keys = F.concat(F.transform(F.array_except("names", "usual"), of(name)), F.transform("assets", of(asset)))
    keyed = may.withColumn("keys", keys).select(F.explode("keys").alias("k"), *may.columns).select("k.*", *may.columns)
    may_meet = (F.col("ord_a") < F.col("ord_b")) & (F.col("bits_a").bitwiseAND(F.shiftright("bits_b", RIGHT)) != 0)
    met_at = [x.join(y, ["kind", "key"]).filter(may_meet).withColumn("x", F.col("key")) for x, y in _meetings(_as(keyed, "a"), _as(keyed, "b"), only)]
    if linked:
        those = may.filter(F.size("linked") > 0)
        near = those.withColumn("x", F.explode(F.array_except("linked", "usual"))).join(met.filter("x <> y"), "x").select(F.lit(name).cast("tinyint").alias("kind"), F.col("y").alias("key"), "x", *may.columns)
        held = those.select(F.lit(name).cast("tinyint").alias("kind"), F.explode("linked").alias("key"), *may.columns)
        met_at += [x.join(y, ["kind", "key"]).filter(may_meet) for x, y in _meetings(_as(near, "a"), _as(held, "b"), only)]
    pairs = reduce(DataFrame.unionByName, met_at)

    # What a pair is asked for is told without functions over arrays that Spark doesn't compile, but for names that match and aren't equal.
    pairs = pairs.withColumns({"entities": _matching(linked), "assets": F.sort_array(F.array_intersect("assets_a", "assets_b")), "both": F.col("bits_a").bitwiseAND(F.shiftright("bits_b", RIGHT)).cast("int")})
    ents = F.array_except("entities", F.array_union("usual_a", "usual_b")) if some_usual else F.col("entities")
    pairs = pairs.withColumns({"ents": ents, "ip_assets": F.coalesce(F.sort_array(F.array_intersect("ip_assets_a", "ip_assets_b")), none)})
    by_name = F.get("ents", F.lit(0)) == F.col("x")
    if linked:
        by_name = by_name & (_least_match() == F.col("key"))
    first = F.when(F.col("kind") == name, by_name).otherwise((F.size("ents") == 0) & (F.get("assets", F.lit(0)) == F.col("key")))
    tests = []
    for k, check in enumerate(CHECKS):
        test = _in("both", k)
        for need in check.needs:
            test = test & (F.size(need) > 0)
        tests.append(F.when(test & check.pair() if check.pair else test, F.lit(1 << k)).otherwise(0))
    pairs = pairs.withColumn("held", F.when(first, reduce(lambda x, y: x.bitwiseOR(y), tests)).otherwise(0))
    checks = F.array_except(F.array(*(F.when(_in("held", k), F.lit(k)) for k in range(len(CHECKS)))), F.array(F.lit(None).cast("int")))
    return pairs.withColumn("checks", checks)  # no filter: it would be computed again below the join


def _in(bits: str, k: int) -> Column:
    return F.col(bits).bitwiseAND(F.lit(1 << k)) != 0


def _cited(k: Column, s: str) -> Column:
    return F.get(f"cites_{s}", F.get(f"place_{s}", k if s == "a" else k + len(CHECKS)) - 1)


def _confidence(k: Column) -> Column:
    """How sure conflict k of a pair is."""
    exclusive = k == 0
    guessed = F.get(F.array(*(F.lit(c.inferred) for c in CHECKS)), k) | (exclusive & (F.size("assets") == 0)) | ((k == _IP) & (F.size("ip_assets") == 0))
    open_ = exclusive & (F.col("open_a") | F.col("open_b"))
    return F.when(guessed | open_, "Low").when(_cited(k, "a")["firm"] & _cited(k, "b")["firm"], "High").otherwise("Medium")


def _nth(k: Column, attr: str) -> Column:
    return F.get(F.array(*(F.lit(getattr(c, attr)) for c in CHECKS)), k)


def _told() -> dict[str, Column]:
    """Subject, entities, citations and words of conflict check_ord of a pair."""
    k = F.col("check_ord")
    said = [(c, [n for n, check in enumerate(CHECKS) if c in check.subject], by) for c, by in (("assets", ", "), ("ip_assets", ", "), ("ents", "; "))]  # in the order of all checks' subjects
    subject = F.coalesce(*(F.when(k.isin(*those) & (F.size(c) > 0), F.nullif(F.array_join(c, by), F.lit(""))) for c, those, by in said), _nth(k, "otherwise"))
    named = F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.array(F.lit(NOBODY)))
    return {"subject": subject, "entities": named, "cite_a": _cited(k, "a"), "cite_b": _cited(k, "b"), "description": _nth(k, "says"), "recommended_action": _nth(k, "advice")}


def check_pairs(facts: DataFrame, only: DataFrame | None = None, usual: DataFrame | None = None) -> DataFrame:
    """A row for each conflict of two contracts: a, b, check_ord, type, severity, confidence, subject, entities and both citations.

    only(contract_id): conflicts that one of these has a part in; usual: the names of `usual_names`, if they are known.
    """
    k = F.col("check_ord")
    found = _met_pairs(facts, only, usual).withColumn("check_ord", F.explode_outer("checks")).filter("check_ord is not null")
    told = {"type": _nth(k, "type"), "severity": _nth(k, "severity"), "confidence": _confidence(k), **_told()}
    return found.select("a", "b", F.col("ord_a").alias("doc_ord_a"), F.col("ord_b").alias("doc_ord_b"), "check_ord", *(c.alias(n) for n, c in told.items()))


def merged_pairs(facts: DataFrame) -> DataFrame:
    """What `merge_conflicts` gives for `check_pairs`; the conflicts of a pair are in one row, so they are merged there.

    Facts with a column file give file_a and file_b too, and more fields of their citations stay.
    """
    k, clear = F.col("check_ord"), F.col("clear")
    sums = [F.when(_in("held", n), F.get("marks_a", F.lit(n)).cast("bigint") + F.get("marks_b", F.lit(n + len(CHECKS)))) for n in range(len(CHECKS))]
    told = F.bit_count("held") + F.when(F.col("held") == (1 << len(CHECKS)) - 1, 0).otherwise(1)  # nulls count as one
    pairs = _met_pairs(facts).withColumn("clear", F.size(F.array_distinct(F.array(*sums))) == told)  # then no two conflicts of the pair have the same quotes
    pairs = pairs.withColumn("check_ord", F.explode_outer("checks")).filter("check_ord is not null")
    quotes = lambda k: _quotes(_cited(k, "a"), _cited(k, "b"))
    pairs = pairs.withColumn("quotes", quotes(k)).withColumn("t", F.when(clear, None).otherwise(F.filter("checks", lambda n: quotes(n) == F.col("quotes")))).filter(clear | (F.get("t", F.lit(0)) == k))
    rank = {"sr": lambda k: F.get(F.array(*(F.lit(labels.SEVERITIES.index(c.severity)) for c in CHECKS)), k), "cr": lambda k: labels.rank(_confidence(k), labels.CONFIDENCES)}
    best = {c: F.when(clear, of(k)).otherwise(F.array_min(F.transform("t", of))) for c, of in rank.items()}
    pairs = pairs.withColumns({"type": F.when(clear, _nth(k, "type")).otherwise(_types(lambda n: _nth(n, "type"))), **best})
    told = {"severity": _named_rank(labels.SEVERITIES, "sr"), "confidence": _named_rank(labels.CONFIDENCES, "cr"), **_told()}
    files = [c for c in ("file_a", "file_b") if c in pairs.columns]
    return pairs.select("a", "b", F.col("ord_a").alias("doc_ord_a"), F.col("ord_b").alias("doc_ord_b"), "check_ord", "quotes", "type", *(c.alias(n) for n, c in told.items()), "sr", "cr", *files)


def _stamps(facts: DataFrame, name: str) -> DataFrame:
    """contract_id and a digest of all that checks read of a contract, whatever the order of its sets."""
    sets = {c: F.array_sort(c) for c in ("present", "unresolved")} | {"cites": F.array_sort(F.map_entries("cites"))}
    told = facts.withColumns(sets).select("contract_id", F.to_json(F.struct(*facts.columns)).alias("told"))
    return told.select("contract_id", F.sha2("told", 256).alias(name))


def touched_contracts(before: DataFrame, after: DataFrame, usual_before: DataFrame, usual_after: DataFrame) -> DataFrame:
    """contract_id: those that came, went or say something else, and those with a name that became usual or is so no longer.

    A name's being usual hangs on all contracts; nothing else in a pair's conflicts hangs on a third one.
    """
    edited = _stamps(before, "old").join(_stamps(after, "new"), "contract_id", "full").filter(~F.col("old").eqNullSafe(F.col("new"))).select("contract_id")
    turned = usual_before.join(usual_after, "x", "left_anti").unionByName(usual_after.join(usual_before, "x", "left_anti")).withColumnRenamed("x", "name")
    return edited.unionByName(_named(after).join(turned, "name", "left_semi").select("contract_id")).distinct()


def recheck_pairs(conflicts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What `check_pairs` gives for the contracts after, from its rows for those before: only pairs with a touched side are checked anew.

    before and after: facts; both are read several times, so they should be tables that were written.
    """
    old, new = saved(usual_names(before), "usual"), saved(usual_names(after), "usual")
    touched = saved(touched_contracts(before, after, old, new), "touched")
    a, b = touched.select(F.col("contract_id").alias("a")), touched.select(F.col("contract_id").alias("b"))
    return conflicts.join(a, "a", "left_anti").join(b, "b", "left_anti").select(conflicts.columns).unionByName(check_pairs(after, touched, new))


def _quotes(a: Column, b: Column) -> Column:
    x, y = a["quote"], b["quote"]
    return F.when(x == y, F.array(x)).when(x < y, F.array(x, y)).otherwise(F.array(y, x))


def _types(of: Callable[[Column], Column] = lambda x: x["type"]) -> Column:
    """Types of t in order, none that is said already."""
    return F.aggregate("t", F.lit(""), lambda s, x: F.when(s == "", of(x)).when(s.contains(of(x)), s).otherwise(F.concat(s, F.lit("; "), of(x))))


def _named_rank(names: tuple[str, ...], r: str) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col(r) + 1)


def merge_conflicts(conflicts: DataFrame) -> DataFrame:
    """One row for each pair and set of quotes: types in order joined by '; ', the gravest severity, the best confidence, the rest from the first."""
    first = F.min_by(F.struct("subject", "entities", "cite_a", "cite_b", "description", "recommended_action"), "check_ord")
    grouped = conflicts.withColumn("quotes", _quotes(F.col("cite_a"), F.col("cite_b"))).groupBy("a", "b", "doc_ord_a", "doc_ord_b", "quotes").agg(
        F.array_sort(F.collect_list(F.struct("check_ord", "type"))).alias("t"), F.min(labels.rank(F.col("severity"), labels.SEVERITIES)).alias("sr"),
        F.min(labels.rank(F.col("confidence"), labels.CONFIDENCES)).alias("cr"), F.min("check_ord").alias("check_ord"), first.alias("f"))
    return grouped.select("a", "b", "doc_ord_a", "doc_ord_b", "check_ord", "quotes", _types().alias("type"), _named_rank(labels.SEVERITIES, "sr").alias("severity"), _named_rank(labels.CONFIDENCES, "cr").alias("confidence"), "f.*", "sr", "cr")


def report(merged: DataFrame, a_bucket: int = 1000) -> DataFrame:
    """All conflicts, numbered C-001 on from the gravest and surest, then by contracts and checks.

    Numbers within a bucket of the left contracts' order come after those of the buckets before, which are counted.
    merged is written once; of the columns that only tell what a conflict is, those that it has are kept.
    """
    rows = saved(merged, "merged").withColumn("bucket", F.floor(F.col("doc_ord_a") / a_bucket))
    keys = ["sr", "cr", "bucket"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each bucket
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_ord_a", "doc_ord_b", "check_ord"))
    nth = (F.col("before") + inside).cast("string")
    numbered = rows.join(counts.withColumn("before", before).drop("n"), keys).withColumn("conflict_id", F.concat(F.lit("C-"), F.when(F.length(nth) < 3, F.lpad(nth, 3, "0")).otherwise(nth)))
    told = [c for c in ("subject", "entities", "quotes", "cite_a", "cite_b", "description", "recommended_action") if c in merged.columns]
    return numbered.select("conflict_id", "a", "b", "type", "severity", "confidence", *told, "sr", "cr", "doc_ord_a", "doc_ord_b", "check_ord")


def analyze(docs: DataFrame, findings: DataFrame, extractions: DataFrame) -> dict[str, DataFrame]:
    """The report of a portfolio: contracts, entity_registry, dependency_edges, obligations and conflicts."""
    facts = saved(contract_facts(docs, findings, extractions), "facts")
    return {
        "contracts": facts.select("contract_id", "doc_ord"), "entity_registry": entity_registry(facts), "dependency_edges": dependency_edges(facts),
        "obligations": obligation_registry(findings, facts), "conflicts": report(merged_pairs(facts)),
    }
