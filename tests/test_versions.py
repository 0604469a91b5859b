"""Tables that change together: whole versions, failures in the middle, writers at the same time, batches handed over twice."""

import threading

import pytest
from pyspark.sql import functions as F

from pactlake.versions import Change, Lost, Store

FIELDS, AUDIT = "document_id string, k string, v long", "document_id string, what string"


def docs(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "document_id string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", buckets=4)
    first = Change(docs(spark, "a", "b", "c"), {"fields": spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("c", "x", 4)], FIELDS)}, {"audit": spark.createDataFrame([("a", "made")], AUDIT)})
    s.update(lambda now: first)
    return s


def test_documents_change_together(spark, store):
    new = Change(docs(spark, "a", "d", None), {"fields": spark.createDataFrame([("a", "z", 9), ("d", "x", 5), (None, "x", 6), ("b", "not listed", 0)], FIELDS)}, {"audit": spark.createDataFrame([("a", "edited"), (None, "made")], AUDIT)})
    then = store.update(lambda now: new)
    assert then.version == 2 and then.tables() == ["audit", "fields"]
    assert rows(then.read("fields")) == sorted([("a", "z", 9), ("b", "x", 3), ("c", "x", 4), ("d", "x", 5), (None, "x", 6)], key=repr)
    assert rows(then.read("audit")) == sorted([("a", "made"), ("a", "edited"), (None, "made")], key=repr)
    assert rows(store.at(1).read("fields")) == [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("c", "x", 4)]
    assert rows(then.of("fields", docs(spark, "a", "c", "none"))) == [("a", "z", 9), ("c", "x", 4)]
    left = store.update(lambda now: Change(docs(spark, "a", "b", "c", "d", None), {"fields": now.read("fields").limit(0)}))
    assert rows(left.read("fields")) == [] and rows(left.read_or("none", FIELDS)) == []
    assert store.update(lambda now: None).version == 3


def test_failure_in_the_middle_leaves_the_version(spark, store):
    broken = spark.createDataFrame([("a", "x")], AUDIT).withColumn("what", F.raise_error(F.lit("half way")).cast("string"))
    with pytest.raises(Exception, match="half way"):
        store.update(lambda now: Change(docs(spark, "a"), {"fields": spark.createDataFrame([("a", "z", 9)], FIELDS)}, {"audit": broken}))
    now = store.current()
    assert now.version == 1 and rows(now.read("fields").filter("document_id = 'a'")) == [("a", "x", 1), ("a", "y", 2)]
    gone = store.vacuum(keep=1, age_seconds=-60)
    assert any(f.startswith("fields/") for f in gone) and rows(store.current().read("fields")) == rows(now.read("fields"))
    assert store.vacuum(keep=1, age_seconds=-60) == []


def test_writers_lose_no_update(spark, store):
    """Four writers add one to the same number and a document of their own, all from the same version first."""
    start, tries, wrong = threading.Barrier(4), [], []

    def write(n):
        first = True

        def make(now):
            nonlocal first
            tries.append(n)
            more = now.read("fields").filter("document_id = 'b'").withColumn("v", F.col("v") + 1)
            if first:
                first = False
                start.wait(60)
            return Change(docs(spark, "b", f"w{n}"), {"fields": more.unionByName(spark.createDataFrame([(f"w{n}", "x", n)], FIELDS))})

        try:
            store.update(make)
        except Exception as e:  # shown by the assertion below
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(240)
    now = store.current()
    assert not wrong and now.version == 5 and len(tries) > 4
    assert rows(now.read("fields").filter("document_id like 'w%' or document_id = 'b'")) == [("b", "x", 7), ("w0", "x", 0), ("w1", "x", 1), ("w2", "x", 2), ("w3", "x", 3)]


def test_a_batch_counts_once_and_a_race_ends(spark, store):
    more = lambda now: Change(docs(spark, "b"), {"fields": now.read("fields").filter("document_id = 'b'").withColumn("v", F.col("v") + 1)})
    for number in (0, 0, 1, 0, 1):
        store.update(more, batch=("jobs", number))
    assert rows(store.current().read("fields").filter("document_id = 'b'")) == [("b", "x", 5)] and store.current().version == 3
    assert store.update(lambda now: None, batch=("jobs", 2)).manifest["applied"] == {"jobs": 2}
    assert store._put({"version": 4}) is False

    def always_late(now):
        store.update(more)
        return more(now)

    with pytest.raises(Lost):
        store.update(always_late, tries=2)
