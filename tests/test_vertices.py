"""Vertices named by their places: the same segments as with numbers, and no rank over the whole table."""

import math

import pytest
from pyspark.sql import functions as F

from spanwright.functions.geometry import Metric
from spanwright.operators import diagnostics, repair, topology
from spanwright.plans import materialise
from spanwright.plans import queries as q
from tests.test_network import features
from tests.test_whole import trips  # noqa: F401

#: Lines that meet, turn back, stand still, break off twice and begin or end with an invalid position.
LINES = [[(0, 0), (1, 0), (1, 0), (2, 0)], [(1, 0), (1, 1), (1, 0)], [(2, 0), (math.nan, 0), (3, 0), (4, 0), (math.inf, 1), (math.nan, 1), (5, 0), (6, 0)], [(math.nan, 0), (-0.0, 0), (0, 5)], [(7, 7), (8, 8), (8, math.nan)]]


def named(segs):
    """The segments' own columns, and which of their ends are one vertex."""
    rows = segs.orderBy("feature_idx", "part", "seg_idx").collect()
    seen = {}
    return [tuple(r[c] for c in ("feature_idx", "part", "seg_idx", "run", "ax", "ay", "bx", "by", "a_grp", "b_grp", "length")) + tuple(seen.setdefault(r[c], len(seen)) for c in "ab") for r in rows]


@pytest.mark.parametrize("groups", [{}, {"group": "feature_idx % 2"}, {"group": "'0'", "end_group": "if(feature_idx < 2, '1', '0')"}])
def test_keyed_vertices_make_the_same_segments(spark, groups):
    coords = topology.coordinates(features(spark, LINES), **{k: F.expr(e) for k, e in groups.items()})
    known, found = (named(topology.segments(f(coords), Metric())) for f in (topology.exact_vertices, topology.keyed_vertices))
    assert found == known
    assert [k[:4] for k in known] == [(0, 0, 0, 0), (0, 0, 2, 0), (1, 0, 0, 0), (1, 0, 1, 0), (2, 0, 2, 1), (2, 0, 6, 3), (3, 0, 1, 1), (4, 0, 0, 0)]


@pytest.mark.parametrize(("name", "shuffles"), [("part_runs", 1), ("measures_running", 1), ("dangles", 2)])
def test_trips_stay_in_their_lines(spark, trips, monkeypatch, name, shuffles):  # noqa: F811
    monkeypatch.setattr(topology, "with_rank", None)
    out = q.QUERIES[name](spark, trips)
    assert out.count() and out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == shuffles


def test_loose_ends_tell_their_own_columns(spark):
    segs = topology.segments(topology.exact_vertices(topology.coordinates(features(spark, [[(0, 0, 3), (1, 0)], [(1, 0), (2, 0, 4)], [(5, 5), (6, 5), (6, 6), (5, 5)]]))), Metric())
    ends = repair.loose_ends(segs)
    told = {(r["x"], r["y"], r["z"], r["grp"], r["feature_idx"]) for r in ends.collect()}
    assert told == {(0.0, 0.0, 3.0, "", 0), (2.0, 0.0, 4.0, "", 1)} and {r["other"] for r in ends.collect()} == {1}
    # one look at the segments, and partial sums kept in place
    plan = ends.select("x", "y", "feature_idx")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "SortAggregate" not in plan


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame([(p, 1 + p * 7 % 11) for p in range(120)], "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    return path


def test_the_log_cuts_nothing(spark, parts, monkeypatch):
    _, known = repair.split_intersections(q._brace_segments(spark, parts, topology.exact_vertices), Metric())
    log = {tuple(r) for r in known.collect()}
    for module, name in ((repair, "_applied"), (repair, "settled"), (topology, "with_rank")):
        monkeypatch.setattr(module, name, None)
    assert q.repairs_log(spark, parts).first()["repairs"] == known.count() == len(log) > 50
    assert {tuple(r) for r in repair.split_log(q._brace_segments(spark, parts)).collect()} == log


def test_pairs_are_looked_at_in_one_cell(spark):
    """Long lines among short ones share many cells; the join's condition holds no fractions, which come after it."""
    lines = [[(0, 0), (40, 40)], [(0, 40), (40, 0)], [(1, 0), (41, 38)]] + [[(i, 20), (i, 21)] for i in range(40)]
    found = repair.intersections(topology.segments(topology.exact_vertices(topology.coordinates(features(spark, lines))), Metric()))
    pairs = [(r["feature_idx1"], r["feature_idx2"]) for r in found.collect()]
    assert sorted(pairs) == [(0, 1), (0, 23), (0, 24), (1, 2), (1, 22), (1, 23), (2, 26)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and all(" / " not in line for line in plan.splitlines() if "Join" in line)


@pytest.mark.parametrize("find", [repair.intersections, diagnostics.overlaps])
def test_rows_of_cells_are_not_broadcast(spark, parts, find):
    plan = find(q._brace_segments(spark, parts))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pieces_without_ranks_or_joins_back(spark, parts, monkeypatch):
    """Vertices keep their places' names, and cuts are laid in a row with the segments."""
    known = sorted(map(tuple, q._pieces(q._brace_segments(spark, parts, topology.exact_vertices)).collect()))
    for module in (materialise, topology):
        monkeypatch.setattr(module, "with_rank", None)
    out = q.split_segments(spark, parts)
    assert sorted(map(tuple, out.collect())) == known and len({r[1] for r in known}) > 1
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


#: Lines that cross at a new place (three of them), at the end of a fourth, at a place where another group's line ends,
#: touch inside, all but touch an end, meet end to end a little apart, turn back over a crossing, and have a gap.
MEETING = [[(0, 0), (4, 4)], [(0, 4), (4, 0)], [(0, 2), (4, 2)], [(1, 1), (1, -1), (3, -1), (1, 1)], [(2, 0), (2, 0.5)], [(2, -2), (2, -0.95)], [(6, 0), (8, 0.05), (8, 3)], [(8.05, 0), (10, 2)], [(8, 1), (12, 1), (8, 1)], [(9, 0), (9, 2), (math.nan, 0), (9.5, 2), (9.5, 0)], [(20, 0), (30, 7)], [(20, 7), (30, 0)], [(50, -0.05), (50, 4)], [(46, -2), (46, -2), (47, -2)], [(46, 0), (50.05, 0)]]


@pytest.mark.parametrize(("group", "tolerance"), [(None, 0.0), ("feature_idx % 2", 0.1), ("'0'", 0.1)])
def test_named_vertices_split_alike(spark, group, tolerance):
    told = {"group": F.expr(group)} if group else {}
    if group == "'0'":  # with a connector, whose inner position stands alone
        told["end_group"] = F.expr("if(feature_idx = 3, '1', '0')")
    coords = topology.coordinates(features(spark, MEETING), **told)
    known, found = (repair.split_intersections(topology.segments(f(coords), Metric()), Metric(), tolerance) for f in (topology.exact_vertices, topology.keyed_vertices))
    rows = named(found[0])
    assert rows == named(known[0]) and len(rows) > len(MEETING) + 6
    # the least of two ends that all but meet takes both
    assert [r[6:8] for r in rows if r[0] == 14] == ([(50, -0.05)] if tolerance else [(50, 0), (50.05, 0)])
    assert sorted(map(tuple, found[1].collect())) == sorted(map(tuple, known[1].collect()))


def test_cuts_on_both_sides_of_a_place(spark):
    """Three lines through one place make one vertex; of a segment cut three times each piece begins where the last one ended."""
    lines = [[(0, 0), (9, 0)], [(2, -1), (4, 1)], [(4, -1), (2, 1)], [(6, -2), (6, 0)], [(7, 1), (8, -1)], [(3, 5), (4, 5)]]
    for vertices in (topology.exact_vertices, topology.keyed_vertices):
        out, _ = repair.split_intersections(topology.segments(vertices(topology.coordinates(features(spark, lines))), Metric()), Metric())
        rows = out.orderBy("feature_idx", "seg_idx").collect()
        line = [r for r in rows if r["feature_idx"] == 0]
        assert [(r["seg_idx"], r["ax"], r["bx"], r["length"]) for r in line] == [(0, 0, 3, 3), (1, 3, 6, 3), (2, 6, 7.5, 1.5), (3, 7.5, 9, 1.5)]
        assert all(r["b"] == s["a"] for r, s in zip(line, line[1:], strict=False))
        assert len({r["b"] for r in rows if (r["bx"], r["by"]) == (3, 0)}) == 1
        assert [sum(r["feature_idx"] == f for r in rows) for f in range(6)] == [4, 2, 2, 1, 2, 1]
        assert {r["b"] for r in rows if r["feature_idx"] == 3} == {line[1]["b"]}
