"""Near duplicates: what the bands lose, the exact join behind them, rows of one doc_id, and awkward tables."""

import random

import numpy as np

from spanwright.llm import near_dedup
from spanwright.llm.common import Scratch
from spanwright.llm.near_dedup import PERMUTATIONS, ROWS, signature

SCHEMA = "doc_id long, text string"


def test_bands_lose_few_pairs():
    """Pairs of known similarity: 0.80 to 0.82 on sets of 45, 90 and 450."""
    rng, met, tried = np.random.default_rng(4), 0, 0
    for size in (45, 90, 450):
        for _ in range(150):
            both = round(2 * size * 0.81 / 1.81)
            pool = rng.integers(0, 1 << 63, 2 * size - both, np.uint64)
            a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:both], pool[size:]]))
            met += bool((signature(a) == signature(b)).any())
            tried += 1
    assert (1 - 0.8**ROWS) ** (2 * PERMUTATIONS // ROWS) < 1e-5 and met >= 0.99 * tried


def test_the_join_behind_the_leaders_misses_no_pair(spark):
    """All rows open, each its own component: the candidates hold every similar pair, and few others."""
    rng, rows = random.Random(6), []
    for i in range(120):
        own = rng.sample(range(400), 12) if i % 3 else [i]
        rows.append((i, sorted({*range(i % 4 * 1000, i % 4 * 1000 + 40 + i % 7)} | {5000 + x for x in own})))
    sets = spark.createDataFrame([(i, i, len(s), s) for i, s in rows], "doc_id long, set_a long, n_shingles long, shingles array<long>")
    open_docs = spark.createDataFrame([(i, i) for i, _ in rows], "doc_id long, component long")
    known = {(i, j) for i, a in rows for j, b in rows if i > j and 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b})}
    hold = Scratch(spark)
    try:
        pairs = near_dedup._candidates(open_docs, sets, 80, hold)
        found = {tuple(r) for r in pairs.collect()}
        linked = {tuple(r) for r in near_dedup._linked(pairs, sets, 80).collect()}
    finally:
        hold.close()
    assert known and linked == known and found >= known and len(found) < 120 * 119 // 4


def test_rows_of_one_document_are_linked_by_any_text(spark):
    words = {k: " ".join(f"{k}w{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, words["a"]), (5, words["a"]), (5, words["b"]), (7, words["b"]), (7, words["c"]), (9, words["c"] + " x"), (9, words["c"] + " x"), (11, words["d"]), (None, words["d"]), (12, None)]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4, 80).collect()]
    known = [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (7, 1, False), (9, 1, False), (9, 1, False), (11, 11, True), (None, None, True), (12, 12, True)]
    assert sorted(got, key=str) == sorted(known, key=str)
