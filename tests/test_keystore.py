"""The bucketed key store: exact answers, a filter that spares work, stored keys that are never shuffled."""

import re

import pytest

from vacantia.operators import keystore, load

KEYS = {"source": "string", "external_id": "string"}
ROWS = "source string, external_id string, n int"


def rows(spark, ids, source="a"):
    return spark.createDataFrame([(source, None if i is None else str(i), 1) for i in ids], ROWS)


@pytest.mark.parametrize("expected", [1, 10_000])
def test_additions_and_answers(spark, tmp_path, expected):
    store = keystore.KeyStore(spark, str(tmp_path / "s"), KEYS, buckets=4, expected=expected)
    assert sorted(r.external_id for r in store.absent(rows(spark, [1, 2])).collect()) == ["1", "2"]
    store.add(rows(spark, range(0, 1000)))
    store.add(rows(spark, [*range(900, 1500), None]))
    assert store.stored().distinct().count() == 1500
    # opened anew, as by a later job; repeats and keys without an id pass as they are
    again = keystore.KeyStore(spark, str(tmp_path / "s"), KEYS, buckets=4, expected=expected)
    asked = rows(spark, [*range(1400, 1600), None, 1599])
    assert sorted(str(r.external_id) for r in again.absent(asked).collect()) == sorted([*map(str, range(1500, 1600)), "1599", "None"])
    assert again.absent(rows(spark, range(50), source="b")).count() == 50
    assert again.absent(asked.limit(0)).count() == 0


def test_the_filter_stops_new_keys(spark, tmp_path):
    store = keystore.KeyStore(spark, str(tmp_path / "s"), KEYS, buckets=4, expected=5000)
    store.add(rows(spark, range(5000)))
    passed = store.asked(rows(spark, range(5000, 15000))).filter("maybe").count()
    assert passed < 300
    assert store.asked(rows(spark, range(5000))).filter("maybe").count() == 5000


def test_stored_keys_are_not_shuffled(spark, tmp_path):
    store = keystore.KeyStore(spark, str(tmp_path / "s"), KEYS, buckets=4, expected=5000)
    store.add(rows(spark, range(5000)))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.absent(rows(spark, range(4000, 6000)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if store.table in line)
    indent = len(re.match(r"[\s:|+-]*", lines[scan])[0])
    above = []
    for line in reversed(lines[:scan]):
        depth = len(re.match(r"[\s:|+-]*", line)[0])
        if depth < indent:
            above.append(line)
            indent = depth
    assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)


def test_insert_through_a_store_equals_insert_through_a_table(spark, tmp_path):
    stored, new = rows(spark, range(30)), rows(spark, [*range(20, 40), 39, None])
    store = keystore.KeyStore(spark, str(tmp_path / "s"), KEYS, buckets=2, expected=100)
    store.add(stored)
    got, want = (sorted(map(repr, load.insert_if_absent(new, s, ["n"]).collect())) for s in (store, stored))
    assert got == want


def test_a_full_filter_is_not_asked(spark, tmp_path, monkeypatch):
    """A store with far more keys than expected decides by its keys alone, and still never shuffles them."""
    from pyspark.sql import functions as F

    small = keystore.KeyStore(spark, str(tmp_path / "small"), KEYS, buckets=4, expected=1_000)
    many = spark.range(60_000).select(F.expr("if(id % 2 = 0, 'e', 'o')").alias("source"), F.col("id").cast("string").alias("external_id"))
    small.add(many.limit(10))
    assert small.passing() < 0.01
    small.add(many)
    assert small.passing() > 0.9
    monkeypatch.setattr(keystore.KeyStore, "asked", None)
    asked = [("o", "5"), ("e", "60000"), ("e", "5"), (None, "5"), ("e", None), ("e", "8")]
    fresh = small.absent(spark.createDataFrame(asked, "source string, external_id string"))
    assert sorted(map(tuple, fresh.collect()), key=str) == sorted(asked[1:5], key=str)
    plan = small.absent(many.groupBy("source", "external_id").count())._jdf.queryExecution().executedPlan().toString()
    # the arrivals come to the buckets
    join = plan[plan.index("SortMergeJoin"):]
    assert "Exchange" not in join[join.rindex("Sort ["):] and "Broadcast" not in plan and small.table in join[join.rindex("Sort ["):]
