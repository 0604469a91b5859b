"""From a contract's extractions to one finding and one field for each category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.functions import text

# The forty-one categories in order.
CATEGORIES = (
    "document_name", "parties", "agreement_date", "effective_date", "expiration_date", "renewal_term", "notice_period_to_terminate_renewal", "governing_law", "most_favored_nation", "non_compete",
    "exclusivity", "no_solicit_of_customers", "competitive_restriction_exception", "no_solicit_of_employees", "non_disparagement", "termination_for_convenience", "rofr_rofo_rofn", "change_of_control",
    "anti_assignment", "revenue_profit_sharing", "price_restrictions", "minimum_commitment", "volume_restriction", "ip_ownership_assignment", "joint_ip_ownership", "license_grant",
    "non_transferable_license", "affiliate_license_licensor", "affiliate_license_licensee", "unlimited_all_you_can_eat_license", "irrevocable_or_perpetual_license", "source_code_escrow",
    "post_termination_services", "audit_rights", "uncapped_liability", "cap_on_liability", "liquidated_damages", "warranty_duration", "insurance", "covenant_not_to_sue", "third_party_beneficiary",
)
CLIP, QUOTE, BLANK = 600, 400, " \t\n\x0b\f\r"


def dimension(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "category_ord int, category string")


def findings(contracts: DataFrame, extractions: DataFrame, dim: DataFrame) -> DataFrame:
    """A row for each contract and category.

    extractions(contract_id, category, ord, vlm_text, is_grounded): with a grounded one the finding is present and
    direct, and says the first of them; with others only it is present and unresolved; with none it is unresolved.
    """
    first = F.min_by("vlm_text", F.when(F.col("is_grounded"), F.col("ord")))
    agg = extractions.groupBy("contract_id", "category").agg(F.count(F.lit(1)).alias("n"), F.max("is_grounded").alias("grounded"), first.alias("said"), F.min_by("vlm_text", "ord").alias("any_said"))
    every = contracts.select("contract_id").crossJoin(F.broadcast(dim)).join(agg, ["contract_id", "category"], "left")  # forty-one rows
    grounded = F.coalesce("grounded", F.lit(False))
    return every.select("contract_id", "category", "category_ord", F.when(F.col("n") > 0, "present").otherwise("unresolved").alias("answer"),
        F.when(grounded, "direct").otherwise("unresolved").alias("evidence_status"), F.coalesce(F.when(grounded, F.col("said")).otherwise(F.col("any_said")), F.lit("")).alias("summary"), (~grounded).alias("needs_review"))


def citations(extractions: DataFrame) -> DataFrame:
    """The extraction to quote for each contract and category: a grounded one first, then by order; quotes are clipped."""
    best = F.min_by(F.struct("page", "clause", "supporting_text", "vlm_text"), F.struct(~F.col("is_grounded"), F.col("ord")))
    said = F.coalesce(F.nullif("c.supporting_text", F.lit("")), "c.vlm_text", F.lit(""))
    quote = F.substring(F.btrim(said, F.lit(BLANK)), 1, QUOTE)
    return extractions.groupBy("contract_id", "category").agg(best.alias("c")).select("contract_id", "category", F.coalesce("c.page", F.lit(0)).alias("page"), F.coalesce("c.clause", F.lit("—")).alias("clause"), quote.alias("quote"))


def fields(found: DataFrame, extractions: DataFrame) -> DataFrame:
    """A field row for each finding: without a value it is inferred and says why; else its tier tells how it was read.

    The value is the best extraction's quote, or what the model said if nothing was located, and is read as its
    category is; of extractions grounded ones, then the best score, then the first.
    """
    best = F.max_by(F.struct("vlm_text", "supporting_text", "is_grounded", "score", "clause", "page"), F.struct("is_grounded", "score", -F.col("ord")))
    top = extractions.groupBy("contract_id", "category").agg(best.alias("b"))
    none = (F.col("answer") != "present") | F.col("b").isNull()
    said = F.coalesce(F.nullif("b.supporting_text", F.lit("")), "b.vlm_text", F.lit(""))
    value = F.substring(F.btrim(said, F.lit(BLANK)), 1, CLIP)
    read = text.normalize_value(F.col("category"), value, F.col("b.vlm_text"))
    tier = F.when(none, "inferred").when(~F.col("b.is_grounded"), "unverified").when(read.isNotNull(), "normalised").otherwise("verbatim")
    return found.join(top, ["contract_id", "category"], "left").select(
        "contract_id", "category", F.when(~none, F.nullif(value, F.lit(""))).alias("value_verbatim"), F.when(~none, read).alias("value_normalized"), tier.alias("confidence_tier"), F.lit("contract_text").alias("claim_type"),
        F.when(none, "not_found").alias("absence_reason"), F.when(~none, F.nullif("b.clause", F.lit(""))).alias("clause_label"), F.when(~none, F.bround(F.col("b.score") / 100, 3)).alias("consistency_score"), F.when(~none, F.col("b.page")).alias("anchor_page"))


def assembled(answers: DataFrame, matches: DataFrame) -> DataFrame:
    """Extractions of answers(contract_id, category, ord, page, text, clause) with what was located of them.

    matches(contract_id, category, ord, found, score, recall, mass, verified, bbox): without one, as on a page that has
    no words, everything is zero, the found text empty and nothing grounded.
    """
    a = answers.join(matches, ["contract_id", "category", "ord"], "left")
    zero = F.array(*(F.lit(0.0) for _ in range(4)))
    number = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return a.select(
        "contract_id", "category", "ord", F.col("text").alias("vlm_text"), "page", F.coalesce(F.nullif("clause", F.lit("")), F.lit("Unlabeled")).alias("clause"), F.coalesce("found", F.lit("")).alias("supporting_text"),
        number("score"), number("recall"), number("mass"), F.coalesce("bbox", zero).alias("bbox"), F.coalesce("verified", F.lit(False)).alias("is_grounded"))


def present_counts(found: DataFrame) -> DataFrame:
    """How many categories are present in each contract, and whether parties are."""
    return found.groupBy("contract_id").agg(F.count_if(F.col("answer") == "present").alias("n_present"), F.bool_or((F.col("category") == "parties") & (F.col("answer") == "present")).alias("has_parties"))
