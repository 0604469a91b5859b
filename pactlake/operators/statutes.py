"""Statute chunks: their status, review and audit trail, and which of them apply to a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions import labels, text
from pactlake.operators.portfolio import upsert

# What a contract's type is in the statutes' terms, and what an action makes of a review.
STATUTE_TYPES = {
    "nda": ("nda",), "lease": ("lease", "goods_hire"), "msa": ("services", "other_commercial"), "distribution": ("distribution", "other_commercial"),
    "employment": ("employment",), "other": ("other_commercial", "ip_agreement"),
}
REVIEWS = {"agree": "human_verified", "disagree": "overridden", "manual_review": "manual_review"}


def clauses(chunks: DataFrame) -> DataFrame:
    """Chunks(id, source, provision, exact_wording, summary, authority_basis, engine_status, statuses, target_fields, applicable_contract_types) with an id, as clauses."""
    ai = labels.ai_status(F.col("engine_status"), F.col("authority_basis"), F.coalesce("statuses", F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    return chunks.filter("id is not null and id <> ''").select(
        F.col("id").alias("clause_key"), "source", F.coalesce("provision", F.lit("—")).alias("provision"), F.coalesce("exact_wording", F.lit("")).alias("exact_wording"), "summary", ai.alias("ai_status"),
        "authority_basis", F.when(ai == "NA", "dependency_unavailable").alias("na_reason"), F.coalesce("target_fields", none).alias("target_fields"), F.coalesce("applicable_contract_types", none).alias("types"))


def refresh(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The new clauses with the review status that people gave the old ones, open without one, and old ones that didn't come again."""
    have = existing.select("clause_key", "review_status")
    taken = new.join(have, "clause_key", "left").withColumn("review_status", F.coalesce("review_status", F.lit("open")))
    return upsert(existing, taken.select(*existing.columns), ["clause_key"])


def listing(found: DataFrame, annotations: DataFrame) -> DataFrame:
    """Clauses with the number of their annotations, by source and provision."""
    n = annotations.groupBy("clause_key").agg(F.count(F.lit(1)).alias("n_annotations"))
    return found.join(n, "clause_key", "left").withColumn("n_annotations", F.coalesce("n_annotations", F.lit(0).cast("bigint"))).orderBy("source", "provision", "clause_key")


def trail(annotations: DataFrame, *keys: str) -> DataFrame:
    """The annotations of each key in order of time."""
    return annotations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("created_at", "kind", "author", "body"))).alias("annotations"))


def status_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("ai_status").agg(F.count(F.lit(1)).alias("n"))


def verify(found: DataFrame, annotations: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clauses and annotations after actions(clause_key, action, author, note, created_at) on clauses that are there: each is appended, the last sets the review."""
    known = actions.filter(F.col("action").isin(*REVIEWS)).join(found.select("clause_key"), "clause_key", "left_semi")
    last = known.groupBy("clause_key").agg(F.max_by("action", F.struct("created_at", "action")).alias("action"))
    after = found.join(last, "clause_key", "left").withColumn("review_status", F.coalesce(labels.mapped(F.col("action"), REVIEWS, "open"), "review_status") if "review_status" not in found.columns else F.when(F.col("action").isNull(), F.col("review_status")).otherwise(labels.mapped(F.col("action"), REVIEWS, "open")))
    added = known.select("clause_key", F.col("action").alias("kind"), "author", F.col("note").alias("body"), "created_at")
    return after.select(*dict.fromkeys([*found.columns, "review_status"])), annotations.unionByName(added.select(*annotations.columns))


def statute_types(doc_type: Column) -> Column:
    """The statutes' terms for a document's type; null for one that has none."""
    return F.create_map(*(x for k, v in STATUTE_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[doc_type]


def applicable(documents: DataFrame, found: DataFrame, reviews: DataFrame, annotations: DataFrame) -> DataFrame:
    """documents(id, doc_type, governing_law) with each clause made for their type: its status there and why it doesn't apply, its review and notes.

    A clause without what it depends on, or a law other than Singapore's, is NA; else the clause's own status stands.
    reviews(document_id, clause_key, review_status); annotations(document_id, clause_key, created_at, kind, author, body).
    """
    gate = text.jurisdiction(F.col("governing_law"))
    d = documents.select(F.col("id").alias("document_id"), F.explode(statute_types(F.col("doc_type"))).alias("type"), gate.alias("jurisdiction"))
    c = F.broadcast(found.select("clause_key", "source", "provision", "ai_status", F.explode("types").alias("type")))  # a store of chunks written by hand
    met = d.join(c, "type").drop("type").distinct()
    reason = F.when(F.col("ai_status") == "NA", "dependency_unavailable").when(F.col("jurisdiction") == "excluded", "governing_law_excluded")
    out = met.withColumns({"reason": reason, "status": F.when(reason.isNotNull(), "NA").otherwise(F.col("ai_status"))})
    out = out.join(reviews, ["document_id", "clause_key"], "left").join(trail(annotations, "document_id", "clause_key"), ["document_id", "clause_key"], "left")
    return out.withColumn("review_status", F.coalesce("review_status", F.lit("open"))).drop("ai_status")
