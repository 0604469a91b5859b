"""Column functions that name things: bands, labels, reasons, tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers from best to worst, and bands of days.
TIERS = ("verbatim", "normalised", "assembled", "inferred", "unverified")
LINK_TIERS = ("high", "medium", "low")
SEVERITIES = ("Critical", "Significant", "Administrative")
CONFIDENCES = ("High", "Medium", "Low")
DATE_BANDS = ((0, "overdue"), (8, "this_week"), (31, "next_30"), (61, "next_60"), (91, "in_90"))
REASONS = {
    "governing_law_excluded": "Governing law excludes this statute",
    "dependency_unavailable": "Depends on a statute not in the knowledge store",
    "contract_type_excluded": "Out of scope for this contract type",
}
EDIT_TIERS = {"quoted": "verbatim", "inferred": "inferred", "evaluation_required": "unverified", "na": "inferred"}
EVIDENCE = {"verbatim": "direct", "normalised": "direct", "unverified": "unresolved"}


def rank(value: Column, names: tuple[str, ...]) -> Column:
    """The place of a name, from 0; null if it isn't one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), value).cast("int"), F.lit(0)) - 1


def worst(a: Column, b: Column, names: tuple[str, ...] = LINK_TIERS) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.greatest(rank(a, names), rank(b, names)) + 1)


def date_band(day: Column, as_of: Column) -> Column:
    """overdue, this_week, next_30, next_60, in_90 or later, by days from as_of, bands' ends included."""
    left = F.date_diff(day, as_of)
    return F.when(left.isNotNull(), reduce(lambda rest, b: F.when(left < b[0], b[1]).otherwise(rest), reversed(DATE_BANDS), F.lit("later")))


def relative_days(day: Column, as_of: Column) -> Column:
    """today, tomorrow, in N days, or overdue by N days."""
    n = F.date_diff(day, as_of)
    late = F.when(n == -1, "overdue by 1 day").otherwise(F.format_string("overdue by %d days", -n))
    return F.when(n == 0, "today").when(n == 1, "tomorrow").when(n < 0, late).when(n > 1, F.format_string("in %d days", n))


def display_date(day: Column) -> Column:
    """01 Nov 2026; what isn't an ISO date as it stands, null as a dash."""
    at = F.try_to_date(F.substring(day.cast("string"), 1, 10), "yyyy-MM-dd")
    return F.when(day.isNull() | (day.cast("string") == ""), "—").otherwise(F.coalesce(F.date_format(at, "dd MMM yyyy"), day.cast("string")))


def reason_label(reason: Column) -> Column:
    """What a reason's code says; of an unknown one the words."""
    out = F.replace(reason, F.lit("_"), F.lit(" "))
    for code, said in REASONS.items():
        out = F.when(reason == code, said).otherwise(out)
    return F.nullif(out, F.lit(""))


def initials(author: Column) -> Column:
    """The capital first letters of an author's first two names, without what follows an @; ? if there are none."""
    parts = F.split(F.regexp_replace(author, "@.*", ""), r"[.\-_ ]")
    return F.coalesce(F.nullif(F.array_join(F.slice(F.transform(parts, lambda p: F.upper(F.substring(p, 1, 1))), 1, 2), ""), F.lit("")), F.lit("?"))


def mapped(code: Column, names: dict[str, str], otherwise: str) -> Column:
    """The name of a code, or the name of all others."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[code], F.lit(otherwise))


def benchmark_sentence(claim: Column, assessment: Column, reference: Column) -> Column:
    """A sentence for a benchmark claim; null for any other."""
    where = F.when(assessment == "below", "Below").when(assessment == "above", "Above").otherwise("Within")
    return F.when(claim == "benchmark", F.concat(where, F.lit(" our reference range of "), F.coalesce(reference, F.lit("our reference range")), F.lit(".")))


def ocr_band(mean: Column) -> Column:
    return F.when(mean >= 0.85, "high").when(mean >= 0.7, "moderate").when(mean.isNotNull(), "low")


def coarse_label(value: Column, tier: Column) -> Column:
    """na without a value, evaluation_required if it is unverified, quoted if it stands there, else inferred."""
    return F.when(value.isNull(), "na").when(tier == "unverified", "evaluation_required").when(tier.isin("verbatim", "normalised"), "quoted").otherwise("inferred")


def review_reasons(tier: Column, edited: Column, absence: Column, clause: Column, score: Column, agreement: Column, competing: Column, claim: Column, anchors: Column, value: Column) -> Column:
    """Codes of the reasons to look at a field again, in order. competing: an array of readings; anchors: how many lines."""
    rules = (
        ((tier == "unverified") & ~F.coalesce(edited, F.lit(False)), "quote_not_found"), (absence == "illegible", "illegible"), ((tier == "assembled") & (clause != ""), "assembled"), (score < 0.7, "passes_disagree"),
        (agreement < 0.7, "image_disagrees"), (F.size(competing) >= 2, "competing_readings"), (claim == "benchmark", "own_range"), ((tier == "inferred") & (anchors == 0) & value.isNotNull(), "no_verbatim_text"),
    )
    return F.array_compact(F.array(*(F.when(c, n) for c, n in rules)))


def page_role(page: Column, last: Column) -> Column:
    return F.when(page == 1, "cover").when(page == last, "signature").otherwise("operative")


def ai_status(engine: Column, basis: Column, statuses: Column) -> Column:
    """The status of a statute chunk, NA before Inferred before Quoted before Evaluation Required."""
    has = lambda s: F.coalesce(F.array_contains(statuses, s), F.lit(False))
    return F.when(engine == "dependency_unavailable", "NA").when((basis == "case_law_gloss") | has("cuad_partial_proxy"), "Inferred").when(has("cuad_native") & (basis == "statute_text"), "Quoted").otherwise("Evaluation Required")


def worse_percent(value: Column, average: Column, direction: str) -> Column:
    """How much worse than average, in whole per cent, at least 0; 0 for neutral and for averages not over 0."""
    if direction == "neutral":
        return F.when(value.isNotNull(), F.lit(0).cast("bigint"))
    gap = average - value if direction == "higher_better" else value - average
    return F.when(average <= 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), F.floor(gap / average * 100 + 0.5)))


def traffic_light(percent: Column) -> Column:
    return F.when(percent <= 0, "green").when(percent <= 15, "yellow").when(percent > 15, "red")
