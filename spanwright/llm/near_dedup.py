"""Near-duplicate groups by min-max hashing.

Every permutation of a document's shingle set gives two signature values, its minimum and its maximum, so 256
hash evaluations a shingle make 512 values. They are banded into 64 keys of 8: a pair at similarity 0.8 shares no
key with probability (1 - 0.8**8)**64, below 1e-5, one at 0.85 with 2e-9, while pairs below 0.4 rarely share one.
Documents that share a key are candidates, and full shingle sets decide; there is no estimate in between.

First each key's members are compared with one of them, the one that shares most keys with others, which in a group
of copies is the least edited. A key is finished if its other members then lie in one component; groups of true
copies are, without expanding them into pairs. The members of all other keys meet in an exact join: their shingles
are put in one order, rare ones first; two sets of similarity 0.8 must share one of the first fifth of both, at places
that leave room for the overlap that the similarity asks for. So a loosely linked group of copies, edited too much to be
linked, gives few pairs, since its members' own edits fill the start of their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import Scratch, hashed_words, mix, pieces, settled, utf8, windows
from spanwright.operators.components import components

#: Permutations; signature values to a band.
PERMUTATIONS, ROWS = 256, 8

_random = np.random.default_rng(77003)
_FLIP = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_ODD = _random.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _random.integers(0, 1 << 63, (2 * PERMUTATIONS // ROWS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, without words none."""
    data, offsets = utf8(batch.column("text"))
    words, first, _, _ = hashed_words(data, offsets, lower=True)
    runs = windows(words, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(mix(windows(words[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The band keys of a set that is not empty."""
    low, high = np.full(PERMUTATIONS, np.uint32(2**32 - 1)), np.zeros(PERMUTATIONS, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        values = (short[at : at + 1024][None, :] ^ _FLIP[:, None]) * _ODD[:, None]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    both = mix(np.stack([low, high], 1).ravel().astype(np.uint64) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), PERMUTATIONS))
    return mix((both.reshape(-1, ROWS) * _BAND).sum(1, dtype=np.uint64) + np.arange(len(_BAND), dtype=np.uint64)).view(np.int64)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit digests of each set."""
    return np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _sign(width: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            sets = shingle_sets(batch, width)
            digest = _digests(sets)
            bands = pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands], schema=kind)

    return run


_SETS = "doc_id long, set_a long, n_shingles long, shingles array<long>"


def _sets(width: int):
    """Each text's set of hashes."""
    kind = pa.schema([("doc_id", pa.int64()), ("set_a", pa.int64()), ("n_shingles", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            sets = shingle_sets(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_digests(sets)[:, 0]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=kind)

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(doc_id, leader) of which the sets are similar enough."""
    own = sets.select("doc_id", "shingles")
    both = pairs.join(own, "doc_id").join(own.toDF("leader", "led"), "leader").withColumn("common", F.size(F.array_intersect("shingles", "led")))
    return both.filter(100 * F.col("common") >= percent * (F.size("shingles") + F.size("led") - F.col("common"))).select("doc_id", "leader")


def _candidates(open_docs: DataFrame, sets: DataFrame, percent: int, hold: Scratch) -> DataFrame:
    """Pairs(doc_id, leader) of different components among open_docs(doc_id, component) that can be similar enough; misses none."""
    key = ["doc_id", "set_a"]
    hashes = sets.join(open_docs, "doc_id").select(*key, "n_shingles", "component", F.explode("shingles").alias("hash"))
    # a hash of one document alone comes first in the order and needs no row
    common = hold.keep(hashes.groupBy("hash").agg(F.count("*").alias("held"), (F.min("component") < F.max("component")).alias("apart")).filter("held > 1"), "common")
    listed = hashes.join(common, "hash").groupBy(*key, "n_shingles", "component").agg(F.array_sort(F.collect_list(F.struct("held", "hash", "apart"))).alias("known"))
    fit = F.expr(f"n_shingles - (n_shingles * {percent} + 99) div 100 + 1")  # similar sets share one of so many
    listed = listed.withColumn("alone", F.col("n_shingles") - F.size("known"))
    prefixed = listed.select(*key, "n_shingles", "component", "alone", F.posexplode(F.slice("known", F.lit(1), F.greatest(F.lit(0), fit - F.col("alone")).cast("int"))).alias("at", "k"))
    prefix = hold.keep(prefixed.filter("k.apart").select("doc_id", "n_shingles", "component", (F.col("n_shingles") - F.col("alone") - F.col("at")).alias("rest"), F.col("k.hash").alias("hash")), "prefix")
    one, two = (prefix.select("hash", *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "n_shingles", "component", "rest"))) for k in "ab")
    met = one.join(two, "hash").filter("doc_id_a > doc_id_b and component_a <> component_b")
    met = met.filter((100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b")))
    return met.select(F.col("doc_id_a").alias("doc_id"), F.col("doc_id_b").alias("leader")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text).

    Words are runs of non-space bytes after lower-casing A-Z; a document's set is its distinct ``width``-word
    shingles. Documents whose sets have a Jaccard similarity of at least ``percent`` hundredths are linked, and
    component_id is the least doc_id reachable, kept whether that is the document itself. A document without
    words, or without text, has an empty set and stands alone. One of fewer words has its whole sequence as the
    only shingle. doc_id is the key: rows of one doc_id are one document, linked by any of their texts; each row
    tells its own n_shingles. Rows without doc_id get no component and are kept. Other columns are ignored; an empty
    table gives an empty result.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is between 1 and 100")
    spark = docs.sparkSession
    hold = Scratch(spark)
    try:
        return _near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), width, percent, hold)
    finally:
        hold.close()


def _near_duplicates(texts: DataFrame, width: int, percent: int, hold: Scratch) -> DataFrame:
    equal = ["set_a", "set_b"]
    signed = hold.keep(texts.mapInArrow(_sign(width), _SIGNED), "signed")
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    # tables of keys are written before they are joined with the rows, so that Spark can deal out a key with many rows
    groups = hold.keep(known.groupBy(*equal).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "groups")
    copies = hold.keep(known.select("doc_id", *equal).join(groups, equal).filter("doc_id <> first").distinct(), "copies")
    heads = known.join(copies, ["doc_id", *equal], "left_anti")

    banded = heads.select(F.explode("bands").alias("band"), "doc_id", "n_shingles")
    keys = hold.keep(banded.groupBy("band").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("held")).filter("least < most").select("band", "held"), "keys")
    members = hold.keep(banded.join(keys, "band"), "members")
    spread = hold.keep(members.groupBy("doc_id").agg(F.sum("held").alias("spread"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")), "spread")
    sets = hold.keep(texts.join(spread.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets(width), _SETS).filter("n_shingles > 0").dropDuplicates(["doc_id", "set_a"]), "sets")

    widest = F.max(F.struct("spread", (-F.col("doc_id")).alias("down"), "low", "high"))
    leaders = members.join(spread, "doc_id").groupBy("band").agg(widest.alias("m")).select("band", (-F.col("m.down")).alias("leader"), "m.low", "m.high")
    led = hold.keep(members.join(hold.keep(leaders, "leaders"), "band").filter("doc_id <> leader").drop("held"), "led")
    alike = f"{percent} * n_shingles <= 100 * high and {percent} * low <= 100 * n_shingles"
    near = _linked(led.filter(alike).select("doc_id", "leader").distinct(), sets, percent)
    links = hold.keep(near.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).unionByName(_variants(known, copies, equal)), "links")
    labels = components(links).withColumnRenamed("node", "doc_id")

    now = led.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    unfinished = hold.keep(now.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("band"), "unfinished")
    open_docs = now.join(unfinished, "band", "left_semi").select("doc_id", "component").distinct()
    more = _linked(_candidates(open_docs, sets, percent, hold), sets, percent)
    labels = components(links.unionByName(more.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")))).withColumnRenamed("node", "doc_id")

    firsts = groups.join(labels.withColumnRenamed("doc_id", "first"), "first", "left").select(*equal, F.coalesce("component", "first").alias("of_copies"))
    out = signed.select("doc_id", "n_shingles", *equal).join(firsts, equal, "left").join(labels, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("of_copies")), "component", "doc_id")).alias("component_id"))
    return settled(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _variants(known: DataFrame, copies: DataFrame, equal: list[str]) -> DataFrame:
    """Links(a, b) of each document that has rows with different sets with the first documents of those sets."""
    several = known.groupBy("doc_id").agg(F.min(F.struct(*equal)).alias("one"), F.max(F.struct(*equal)).alias("other")).filter("one <> other").select("doc_id")
    return copies.join(several, "doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
