"""Clusters of parties against going through the mentions one by one."""

import random

import pytest
from pyspark.sql import functions as F

from pactlake.functions.text import ROLE_WORDS
from pactlake.operators import entities

MENTIONS = "contract_id int, ord int, raw string"


def alike(a: str, b: str) -> bool:
    x, y = set(a.split()), set(b.split())
    return a == b or (bool(x & y - set(ROLE_WORDS)) and len(x & y) == min(len(x), len(y)))


def one_by_one(mentions):
    clusters = []
    for contract, _, raw in sorted(mentions, key=lambda m: (m[0], m[1], m[2].strip().lower())):
        name = raw.strip().lower()
        for _, names, aliases, contracts in clusters:
            if any(alike(name, x) for x in names):
                break
        else:
            names, aliases, contracts = set(), set(), set()
            clusters.append((name, names, aliases, contracts))
        names.add(name)
        aliases.add(raw.strip())
        contracts.add(contract)
    return {name: (sorted(aliases), sorted(contracts)) for name, _, aliases, contracts in clusters}


@pytest.fixture
def clusters(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))

    def of(rows, schema=MENTIONS):
        return {r.cluster: (r.aliases, r.contracts) for r in entities.entity_clusters(spark.createDataFrame(rows, schema)).collect()}

    return of


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_order(clusters, seed):
    """Random names of few words, mentioned again and again: names change clusters when others join these."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(rng.choice((6, 12, 25)))] + list(ROLE_WORDS[1:3])  # role words that no suffix is
    names = [" ".join(rng.sample(words, rng.choice((1, 2, 2, 3)))) for _ in range(40)]
    rows = [(k // 2, k % 2, rng.choice((str, str.upper, lambda n: f" {n} "))(rng.choice(names))) for k in range(160)]
    assert clusters(rows) == one_by_one(rows)


def test_named_again(clusters):
    """`bee` opens a cluster; `ant bee` joins that of `ant`, so `bee` is in this one from its next mention on."""
    rows = [(1, 0, "Ant"), (2, 0, "Bee"), (3, 0, "Ant Bee"), (4, 0, "Bee"), (5, 0, "Bee Cat"), (6, 0, "Cat"), (7, 0, "Cat")]
    assert clusters(rows) == one_by_one(rows) == {"ant": (["Ant", "Ant Bee", "Bee", "Bee Cat", "Cat"], [1, 3, 4, 5, 6, 7]), "bee": (["Bee"], [2])}


def test_chain(clusters, monkeypatch):
    """Names each of which matches the next one only: one cluster, in rounds by the logarithm of its length."""
    rounds = []
    whole = entities._stairs
    monkeypatch.setattr(entities, "_stairs", lambda rows: rounds.append(1) or whole(rows))
    rows = [(k, 0, f"n{k // 2}" if k % 2 else f"n{k // 2} n{k // 2 - 1}") for k in range(2, 122)]
    got = clusters(rows)
    assert got == one_by_one(rows) and len(got) == 1 and len(rounds) <= 9


def test_one_name_everywhere(spark, clusters):
    """A name in a third of all mentions lies in several pieces, and none of a round's rows are pairs of mentions."""
    rows = [(k, 0, "hub") for k in range(0, 3000, 3)] + [(k, 0, f"hub spoke{k % 700}") for k in range(1, 3000, 3)] + [(k, 0, f"spoke{k % 700}") for k in range(2, 3000, 3)]
    got = clusters(rows)
    assert got == one_by_one(rows)
    norm = spark.createDataFrame(rows, MENTIONS).select(F.col("raw").alias("name"), F.struct(F.col("contract_id").alias("c"), F.col("ord").alias("o"), F.col("raw").alias("name")).alias("t"))
    steps = entities._openers(norm, entities.name_pairs(norm.select("name").distinct()))
    assert steps.count() < len(rows)


def test_odd_rows(clusters):
    assert clusters([]) == {}
    assert clusters([(1, 0, None), (2, 0, "  "), (3, 0, "Solo"), (3, 0, "Solo"), (None, None, "Duo")]) == {"solo": (["Solo"], [3]), "duo": (["Duo"], [])}
    by_order = clusters([("z", 1, 0, "Ant Hill"), ("a", 2, 0, "Ant"), ("b", 3, 0, "Ant Farm")], "contract_id string, doc_ord int, ord int, raw string")
    assert by_order == {"ant hill": (["Ant", "Ant Farm", "Ant Hill"], ["a", "b", "z"])}
