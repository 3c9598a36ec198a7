"""Packing of documents into training sequences by conflict-constrained best fit.

Documents are dealt by a hash of doc_id, length and cluster into groups of about GROUP, each packed on its own in decreasing length.
A group's open bins are ordered by residual space and carry two bitmaps, of the sources and of the duplicate
clusters that they hold. The search starts at the tightest bin that has room and goes on to its successors until
one holds neither the document's source nor its cluster; else a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a sequence; documents of a packing group on average.
CAPACITY, GROUP = 8192, 2048
_OUT = "doc_id long, piece int, piece_start long, n_tokens long, bin_id long, bin_offset long"


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, given in packing order; sources and clusters are bit numbers, -1 conflicts with nothing."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[list[int]] = []  # bitmaps of sources and of clusters
    least = min(lengths, default=0)
    out = []
    for n, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(open_bins, (n, -1))
        while at < len(open_bins) and (held[open_bins[at][1]][0] & s or held[open_bins[at][1]][1] & c):
            at += 1
        if at < len(open_bins):
            residual, k = open_bins.pop(at)
        else:
            residual, k = capacity, len(held)
            held.append([0, 0])
        held[k][0] |= s
        held[k][1] |= c
        out.append((k, capacity - residual))
        if residual - n >= least:
            insort(open_bins, (residual - n, k))
    return out


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        source_bits: dict = {None: -1}
        cluster_bits: dict = {None: -1}
        tails, out = [], []
        bins = 0
        group = rows["group"][0] << 24
        for i, n in enumerate(rows["n_tokens"]):
            full, rest = divmod(n, capacity)
            for p in range(full):
                out.append((rows["doc_id"][i], p, p * capacity, capacity, group + bins, 0))
                bins += 1
            if rest:
                s = source_bits.setdefault(rows["source"][i], len(source_bits) - 1)
                c = cluster_bits.setdefault(rows["cluster"][i], len(cluster_bits) - 1)
                tails.append((-rest, rows["doc_id"][i] is None, rows["doc_id"][i] or 0, s, c, full))
            elif not full:
                out.append((rows["doc_id"][i], 0, 0, 0, None, None))
        tails.sort()
        placed = best_fit([-t[0] for t in tails], [t[3] for t in tails], [t[4] for t in tails], capacity)
        for (rest, missing, doc, _, _, full), (k, offset) in zip(tails, placed, strict=True):
            out.append((None if missing else doc, full, full * capacity, -rest, group + bins + k, offset))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "piece_start", "n_tokens", "bin_id", "bin_offset"]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def packed(docs: DataFrame, n_tokens: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, piece_start, n_tokens, bin_id, bin_offset: every document's pieces and their places.

    n_tokens is by default that of a byte tokenizer, the UTF-8 bytes of text and an end mark; cluster is by default
    a hash of the text, so that exact copies conflict. No bin holds two pieces of one source, or of one cluster, or
    more than ``capacity`` tokens. A longer document is split: full pieces fill bins of their own and the rest is
    packed like any other. Null source or cluster conflicts with nothing. Null or empty text has no tokens: one row
    with null bin_id. Equal lengths go in doc_id's order, null first; repeated rows are packed as separate
    documents. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    if n_tokens is None:
        n_tokens = F.when(F.coalesce(F.octet_length(text), F.lit(0)) > 0, F.octet_length(text) + 1).otherwise(0)
    if cluster is None:
        cluster = F.when(text.isNotNull(), F.xxhash64(text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_tokens.cast("long").alias("n_tokens"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"))
    groups = max(1, -(-docs.select("doc_id").count() // group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "n_tokens", "cluster"), F.lit(groups)))
    return rows.groupBy("group").applyInArrow(_pack(capacity), _OUT)
