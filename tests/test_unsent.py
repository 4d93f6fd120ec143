"""What grows with the input is not broadcast, however small its files are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from civicmill.operators.resolve import resolved_beneficiaries
from civicmill.plans import registry
from tests.test_beneficiaries import brute

#: All tables count as small, and none may be broadcast.
SMALL = {"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.maxBroadcastTableSize": "1b"}


@pytest.fixture
def nothing_sent(spark):
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_broadcasts_are_seen(spark, nothing_sent):
    rows = spark.range(100)
    with pytest.raises(Exception, match="(?i)broadcast"):
        rows.join(rows.groupBy("id").count(), "id").collect()


def test_beneficiaries_are_not_broadcast(spark, nothing_sent):
    folder = "/root/testdata/sf0.001"
    orders, part = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("orders", "part"))
    got = registry.QUERIES["R04_beneficiaries"](spark, folder).collect()
    assert len(got) == orders.join(part.hint("merge"), F.col("o_custkey") == F.col("p_partkey")).count() > 0


def test_resolver_with_long_names_broadcasts_nothing(spark, nothing_sent):
    rng = random.Random(11)
    words = [f"mot{i}" for i in range(12)]
    name = lambda most: " ".join(rng.sample(words, rng.randint(1, most)))
    entities = [(i, name(11), rng.choice(["association", "business", "person"])) for i in range(1, 30)]
    mentions = [(100 + i, f"{name(10)} {rng.choice(['', 'x' + str(i % 7), 'nouveau club x' + str(i % 5) + ' de y' + str(i % 3)])}") for i in range(150)] + [(300, "club"), (301, "club neuf"), (302, "neuf"), (303, None)]
    paid = {3, 5, 8, 13}
    frames = spark.createDataFrame(mentions, "mention_id long, name string"), spark.createDataFrame(entities, "id long, name string, type string")
    got = resolved_beneficiaries(*frames, spark.createDataFrame([(i,) for i in paid], "id long"), {})
    want = brute(mentions, entities, paid)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {"known", "registered", "new", "subsidised"} <= {row[3] for row in want}
