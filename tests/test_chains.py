"""Chains and components: the walk in one task against the joins, on random networks with rings and branches."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright.operators import chains as ch
from spanwright.operators.components import components


def network(seed):
    rng, rows, at = random.Random(seed), [], 0
    for _ in range(12):  # paths over fresh vertices, some closed, some hung onto others
        n = rng.randrange(2, 9)
        path = [at + k for k in range(n)]
        at += n
        if rng.random() < 0.4:
            path.append(path[0])
        elif rows and rng.random() < 0.7:
            path.append(rng.choice(rows)[0])
        rows += [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(path, path[1:], strict=False)]
    rng.shuffle(rows)
    return [(i, a, b) for i, (a, b) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1])
def test_walk_and_joins_agree(spark, seed):
    segs = spark.createDataFrame(network(seed), "seg_id long, a long, b long").withColumn("alive", F.col("seg_id") % 11 != 5)
    columns = ["seg_id", "chain_id", "pos", "reversed", "from_node", "to_node"]
    one = sorted(map(tuple, ch.chains(segs).select(*columns).collect()))
    assert one == sorted(map(tuple, ch.chains(segs, task_segments=0).select(*columns).collect())) and len(one) == segs.filter("alive").count()


def test_components_by_task_and_by_joins(spark):
    rng = random.Random(4)
    pairs = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(260))] + [(1000 + i, 1001 + i) for i in range(60)]
    least = {}
    for a, b in pairs:
        if a != b:
            least.setdefault(a, a)
            least.setdefault(b, b)
    for _ in range(len(pairs)):
        moved = False
        for a, b in pairs:
            if a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
        if not moved:
            break
    links = spark.createDataFrame(pairs, "a long, b long")
    for bound in (None, 40):
        assert dict(map(tuple, components(links, bound).collect())) == least
    assert components(links.limit(0)).count() == 0


def test_totals_of_a_chain_longer_than_a_run(spark, monkeypatch):
    monkeypatch.setattr(ch, "RUN", 7)
    rows = spark.range(40).select(F.lit(3).cast("long").alias("chain_id"), F.lit(0).cast("long").alias("from_node"), F.lit(9).cast("long").alias("to_node"), F.col("id").alias("pos"), F.lit(2.0).alias("cost_along"), F.lit(float("inf")).alias("cost_against"), F.lit(0.5).alias("length"))
    assert [tuple(r) for r in ch.chain_totals(rows).collect()] == [(3, 0, 9, 40, 80.0, float("inf"), 20.0)]


def test_cells_leave_little_to_joins(spark, monkeypatch):
    """Over the bound, chains and components inside of a cell take no joins, and those across cells are the same."""
    pairs = [(i, i + 1) for i in range(150) if i % 10 < 8] + [(i, i + 10) for i in range(0, 140, 20)]
    segs = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "seg_id long, a long, b long").withColumn("alive", F.lit(True))
    columns = ["seg_id", "chain_id", "pos", "reversed", "from_node", "to_node"]
    links = segs.select("a", "b")
    one, joined = sorted(map(tuple, ch.chains(segs).select(*columns).collect())), sorted(map(tuple, components(links).collect()))

    def fail(*_):
        raise AssertionError("joined with itself")

    monkeypatch.setattr(ch, "_walked", fail)
    monkeypatch.setattr("spanwright.operators.components._rooted", fail)
    assert sorted(map(tuple, ch.chains(segs, task_segments=100).select(*columns).collect())) == one
    assert sorted(map(tuple, components(links, 100).collect())) == joined


def test_merges_take_no_call_a_cluster(spark, monkeypatch):
    from pyspark.sql import GroupedData

    from spanwright.functions.geometry import Metric
    from spanwright.operators import topology as tp
    from tests.test_network import features

    def fail(*_):
        raise AssertionError("a call for each cluster")

    monkeypatch.setattr(GroupedData, "applyInPandas", fail)
    lines = [[(0, 0), (10, 0)], [(10.2, 0), (20, 0)], [(10.1, -0.1), (10, 5)], [(19.9, 0.1), (30, 0)]]
    placed, log = tp.merged_vertices(tp.coordinates(features(spark, lines)), Metric(), 0.5)
    assert {(r["feature_idx"], r["idx"], r["vx"], r["vy"]) for r in placed.collect()} == {(0, 0, 0.0, 0.0), (0, 1, 10.0, 0.0), (1, 0, 10.0, 0.0), (1, 1, 20.0, 0.0), (2, 0, 10.0, 0.0), (2, 1, 10.0, 5.0), (3, 0, 20.0, 0.0), (3, 1, 30.0, 0.0)}
    assert log.count() == 3
