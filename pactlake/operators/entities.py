"""Clusters of party names: what going through the mentions in order gives, computed in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions import text
from pactlake.functions.text import ROLE_WORDS
from pactlake.session import dropped, saved


def _worded(names: DataFrame) -> DataFrame:
    return names.select("name", F.array_distinct(F.split("name", " ")).alias("words"))


def name_pairs(names: DataFrame) -> DataFrame:
    """names(name), normalised and distinct: pairs a < b that match.

    The shorter of two names that match has all its words in the other, so it meets it by the rarest of its telling ones.
    """
    told = _worded(names).withColumn("telling", F.array_except("words", F.array(*map(F.lit, ROLE_WORDS))))
    telling = told.select("name", "words", F.explode("telling").alias("w"))
    often = telling.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rarest = telling.join(often, "w").groupBy("name").agg(F.min_by("w", F.struct("n", "w")).alias("w"), F.first("words").alias("words"))
    small = rarest.select("w", F.col("name").alias("x"), F.col("words").alias("x_words"))
    big = telling.select("w", F.col("name").alias("y"), F.col("words").alias("y_words"))
    met = small.join(big, "w").filter((F.col("x") != F.col("y")) & (F.size(F.array_except("x_words", "y_words")) == 0))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def names_match(x: Column, y: Column) -> Column:
    """Whether two normalised names are equal or match as in `name_pairs`, told from the two alone."""
    words = lambda n: F.split(n, " ")
    within = lambda s, b: (F.size(F.array_except(words(s), words(b))) == 0) & (F.size(F.array_except(words(s), F.array(*map(F.lit, ROLE_WORDS)))) > 0)
    return (x == y) | within(x, y) | within(y, x)


def containing(small: DataFrame, big: DataFrame, pieces: Callable[[Column], Column]) -> DataFrame:
    """s and b: names of small(name) and of big(name) that may hold them, all pieces of s being in b.

    They meet by that piece of s which the fewest of big have; a name one of whose pieces none has meets nothing.
    """
    b = big.select(F.col("name").alias("b"), F.explode(pieces(F.col("name"))).alias("w"))
    often = b.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    s = small.select(F.col("name").alias("s"), F.explode(pieces(F.col("name"))).alias("w")).join(often, "w", "left")
    rarest = s.groupBy("s").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0").drop("n")
    return rarest.join(b, "w").select("s", "b")


def matching_names(names: DataFrame) -> DataFrame:
    """x and y: each name with itself and with all that it matches."""
    pairs = name_pairs(names)
    same = names.select(F.col("name").alias("x"), F.col("name").alias("y"))
    return same.unionByName(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))


def _stairs(rows: DataFrame) -> DataFrame:
    """Of rows(name, piece, t, label, fresh) those whose label is less than all labels that their name had before.

    Rows of one piece of a name are sorted together, pieces only by their least labels.
    """
    one = rows.groupBy("name", "piece", "t").agg(F.min(F.struct("label", "fresh")).alias("x")).select("name", "piece", "t", "x.*")
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    pieces = one.groupBy("name", "piece").agg(F.min("label").alias("least"))
    pieces = pieces.withColumn("earlier", F.min("least").over(before("name").orderBy("piece"))).drop("least")
    told = one.withColumn("here", F.min("label").over(before("name", "piece").orderBy("t"))).join(pieces, ["name", "piece"])
    return told.filter("(here is null or label < here) and (earlier is null or label < earlier)").drop("here", "earlier")


def _next_mentions(asked: DataFrame, mentions: DataFrame, held: DataFrame) -> DataFrame:
    """name, piece, t and label of asked(name, label, since): t is the name's first mention after since; none, no row.

    held: the first and the last mention, lo and hi, of each piece of a name. Pieces that begin after since answer
    by lo; in others rows asked and mentions are sorted together, a piece at a time.
    """
    at = asked.join(held, "name").filter("hi > since").groupBy("name", "label", "since").agg(F.min(F.struct("piece", "lo")).alias("p")).select("name", "label", "since", "p.*")
    ready = at.filter("lo > since").select("name", "piece", F.col("lo").alias("t"), "label")
    inside = at.filter("lo <= since").select("name", "piece", F.col("since").alias("t"), "label")
    touched = mentions.join(inside.select("name", "piece").distinct(), ["name", "piece"], "left_semi")
    rows = inside.unionByName(touched.withColumn("mention", F.col("t")), allowMissingColumns=True)
    later = Window.partitionBy("name", "piece").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("next", F.min("mention").over(later)).filter("mention is null")
    return ready.unionByName(found.select("name", "piece", F.col("next").alias("t"), "label"))


def _openers(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """name, t and label, a row each time the name comes into an earlier cluster: from mention t on in that which mention label opened.

    mentions(name, t): t orders them and is of one mention alone; pairs(a, b): names that match. A mention is in the
    earliest cluster that a mention of it or of a matching name before it is in, so its label is the least mention that
    matches reach going back in time. In a round labels go to the next mention of each matching name, and each
    label gives way to that of the mention which it names, so chains halve. Mentions lie in pieces by name and time, and
    no task holds more of a name than a piece.
    """
    spark = mentions.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mentions = saved(mentions.repartitionByRange(parts, "name", "t").withColumn("piece", F.spark_partition_id()), "mentions")
    held = saved(mentions.groupBy("name", "piece").agg(F.min("t").alias("lo"), F.max("t").alias("hi")), "pieces")
    both = saved(pairs.select(F.col("a").alias("name"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("name"), F.col("a").alias("other"))), "both")
    opened = held.groupBy("name").agg(F.min(F.struct("piece", "lo")).alias("p"))
    state = saved(opened.select("name", "p.piece", F.col("p.lo").alias("t"), F.col("p.lo").alias("label"), F.lit(True).alias("fresh")), "steps")
    while True:
        first = state.groupBy("name").agg(F.min_by("label", "t").alias("own"))
        told = state.filter("fresh").join(both, "name").groupBy(F.col("other").alias("name"), "label").agg(F.min("t").alias("since"))
        asked = told.join(first, "name").filter("label < own").select("name", "label", "since")
        of = state.select(F.col("t").alias("label"), F.col("label").alias("less")).filter("less < label")
        jumped = state.join(of, "label").select("name", "piece", "t", F.col("less").alias("label"))
        found = _next_mentions(asked, mentions, held).unionByName(jumped).withColumn("fresh", F.lit(True))
        after = saved(_stairs(state.withColumn("fresh", F.lit(False)).unionByName(found)), "steps")
        dropped(state)
        state = after
        if state.filter("fresh").isEmpty():
            dropped(mentions, held, both)
            return state.select("name", "t", "label")


def entity_clusters(mentions: DataFrame) -> DataFrame:
    """mentions(contract_id, ord, raw[, doc_ord]) to cluster, aliases, contracts (both sorted), n_aliases and n_contracts.

    In order of (doc_ord or contract_id, ord) each mention joins the first cluster that has a matching alias, or opens
    one under its name; a name that is mentioned again may so stand in an earlier cluster too. Names that match no other
    are clusters by themselves; see `_openers` for the rest. Nulls and names of which nothing is left are no mentions.
    """
    norm = mentions.withColumn("name", text.normalize_entity(F.col("raw"))).filter("name <> ''")
    when = F.struct(F.col("doc_ord" if "doc_ord" in mentions.columns else "contract_id").alias("c"), F.col("ord").alias("o"), "name")
    norm = saved(norm.select("contract_id", "name", F.trim("raw").alias("alias"), when.alias("t")), "named")
    pairs = saved(name_pairs(norm.select("name").distinct()), "pairs")
    linked = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    alone = norm.join(linked, "name", "left_anti").select(F.col("name").alias("cluster"), "alias", "contract_id")
    if not pairs.isEmpty():
        steps = saved(_openers(norm.join(linked, "name", "left_semi").select("name", "t").distinct(), pairs), "openers")
        until = F.lead("t").over(Window.partitionBy("name").orderBy("t"))
        spans = steps.select("name", F.col("t").alias("since"), F.col("label.name").alias("cluster"), until.alias("until"))
        placed = norm.join(spans, "name").filter("t >= since and (until is null or t < until)")
        alone = alone.unionByName(placed.select("cluster", "alias", "contract_id"))
    every = alone.groupBy("cluster").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("contract_id")).alias("contracts"))
    return every.withColumns({"n_aliases": F.size("aliases").cast("bigint"), "n_contracts": F.size("contracts").cast("bigint")})


def common_entities(clusters: DataFrame, contracts: int | DataFrame) -> DataFrame:
    """Clusters in at least max(3, 40 %) of the contracts; contracts: their number, or a table of one row that has it as n."""
    if isinstance(contracts, int):
        return clusters.filter(F.col("n_contracts") >= F.greatest(F.lit(3), F.bround(F.lit(0.4 * contracts))))
    return clusters.crossJoin(F.broadcast(contracts)).filter(F.col("n_contracts") >= F.greatest(F.lit(3), F.bround(0.4 * F.col("n")))).drop("n")
