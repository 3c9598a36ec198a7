"""Removal of word passages that an earlier document already holds, by level-wise doubling.

Windows double in length from level to level, up to the one that is asked for. At each level a window of the next
length is represented by the least hash among the windows of this length inside it, which is the same choice wherever
the longer window occurs, so a fraction of all positions is compared and no repeat is lost. Representatives that two
documents hold are extended; the others are given up, and documents without one leave the loop, which ends early when
none is left. Windows of the last length that survive all levels decide the removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import Scratch, hashed_words, pieces, settled, sliding_min, utf8, windows


def levels(length: int, least: int) -> list[int]:
    """Window lengths from about ``least`` words to ``length``, each half of the next; at least two."""
    out = [length]
    while len(out) < 2 or (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _places(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the text of each window of a length."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return first[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts), text


def _anchors(words: np.ndarray, first: np.ndarray, short: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each long window of a text: its first word, its text and the least hash of a short window in it."""
    runs = windows(words, short)
    least = sliding_min(runs, long - short + 1) if len(runs) > long - short else words[:0]
    at, text = _places(first, long)
    return at, text, least[at]


def _held(text: np.ndarray, values: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Whether each value, in order of text, is in its text's set."""
    out = np.zeros(len(values), bool)
    bounds = np.searchsorted(text, np.arange(len(sets) + 1))
    for i, found in enumerate(sets):
        out[bounds[i] : bounds[i + 1]] = np.isin(values[bounds[i] : bounds[i + 1]], found)
    return out


def _lists(text: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    """Each text's values, a repeat beside its like left out."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    counts = np.bincount(text[fresh], minlength=rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values[fresh].view(np.int64)))


def _joined(data: bytes) -> str:
    return hashlib.sha256(b" ".join(data.split())).hexdigest()


#: Words of the first level's windows.
LEAST = 13
_FIRST = "doc_id long, text_key long, n_words long, words_sha256 string, anchors array<long>"


def _first_level(short: int, long: int):
    kind = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("words_sha256", pa.string()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            data, offsets = utf8(batch.column("text"))
            words, first, _, _ = hashed_words(data, offsets)
            _, text, anchor = _anchors(words, first, short, long)
            raw = data.tobytes()
            shas = [_joined(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(first)), pa.array(shas, pa.string()), _lists(text, anchor, batch.num_rows)], schema=kind)

    return run


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [found.values.to_numpy().view(np.uint64) for found in batch.column("anchors")]


def _next_level(short: int, middle: int, long: int):
    """From the repeated representatives of middle windows to those of long ones, over middle windows that survive."""
    kind = pa.schema([("doc_id", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            words, first, _, _ = hashed_words(*utf8(batch.column("text")))
            at, text, anchor = _anchors(words, first, short, middle)
            alive = _held(text, anchor, _sets(batch))
            own, text = windows(words, middle)[at[alive]] if len(at) else words[:0], text[alive]
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            _, text, anchor = _anchors(words, first, middle, long)
            hit = _held(text, anchor, [own[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(text[hit], anchor[hit], batch.num_rows)], schema=kind)

    return run


def _last_level(short: int, long: int):
    """A row for each different long window that survives in a text, with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            words, first, _, _ = hashed_words(*utf8(batch.column("text")))
            at, text, anchor = _anchors(words, first, short, long)
            full = windows(words, long, 0xA0761D6478BD642F)[at] if len(at) else words[:0]
            hit = _held(text, anchor, _sets(batch))
            at, text, anchor, full = (x[hit] for x in (at, text, anchor, full))
            order = np.lexsort((at, full, anchor, text))
            at, text, anchor, full = (x[order] for x in (at, text, anchor, full))
            fresh = np.ones(len(at), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (full[1:] != full[:-1])
            begins = np.flatnonzero(fresh)
            starts = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)).astype(np.int32)), pa.array((at - first[text]).astype(np.int32)))
            rows = pa.array(text[begins])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[begins].view(np.int64)), pa.array(full[begins].view(np.int64)), batch.column("doc_id").take(rows), batch.column("text_key").take(rows), starts], ["anchor", "passage", "doc_id", "text_key", "starts"])

    return run


def _cut(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            data, offsets = utf8(batch.column("text"))
            raw = data.tobytes()
            removed, shas, texts = [], [], []
            for a, b, starts in zip(offsets[:-1], offsets[1:], batch.column("starts"), strict=True):
                words = raw[a:b].split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts.values.to_numpy())
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                covered = np.cumsum(edge)[:-1] > 0
                left = b" ".join([w for w, gone in zip(words, covered.tolist(), strict=True) if not gone])
                removed.append(int(covered.sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "text_key", "cut", "cut_sha256", "cut_text"])

    return run


def without_repeats(docs: DataFrame, length: int = 50, keep_text: bool = True, least: int = LEAST) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept_sha256, kept_text for each row of docs(doc_id, text).

    Words are runs of non-space bytes, unchanged; a window is ``length`` successive words of one document. A word
    goes if a window over it has a word sequence that also starts in a document with a smaller doc_id; windows are
    judged on the input. kept_sha256 is of the words left, joined by one space. kept_text holds these where words
    went, else null: the text stands as it is (always null without ``keep_text``). text_key, a hash of the text,
    tells rows of one doc_id apart. Null text has no words. Rows without doc_id are neither searched nor sources.
    Repeated rows give repeated results and do not remove each other's words. The first level's windows have about
    ``least`` words. Other columns are ignored; an empty table gives an empty result.
    """
    if length < 2:
        raise ValueError("a window has at least two words")
    hold = Scratch(docs.sparkSession)
    try:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        return _without_repeats(texts.withColumn("text_key", F.xxhash64("text")), length, keep_text, levels(length, least), hold)
    finally:
        hold.close()


def _repeated(anchors: DataFrame, hold: Scratch, name: str) -> DataFrame:
    """doc_id, anchors: each document's representatives that another one holds as well."""
    rows = anchors.select("doc_id", F.explode("anchors").alias("anchor"))
    # written before the join, so that Spark can deal out an anchor with many rows
    shared = hold.keep(rows.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("anchor"), f"{name}_shared")
    return settled(rows.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))


def _without_repeats(texts: DataFrame, length: int, keep_text: bool, sizes: list[int], hold: Scratch) -> DataFrame:
    key = ["doc_id", "text_key"]
    level = hold.keep(texts.select("doc_id", "text_key", "text").mapInArrow(_first_level(*sizes[:2]), _FIRST), "level")
    # equal word sequences: all windows of a later copy start in the first one, so only the first is searched
    long = level.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= length))
    first = hold.keep(long.groupBy("words_sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "first")
    copies = settled(long.select(*key, "words_sha256").join(first, "words_sha256").filter("doc_id > first").select(*key).distinct())
    found = _repeated(long.join(copies, key, "left_anti"), hold, "level")
    candidates = hold.keep(texts.join(found, "doc_id"), "candidates0")
    hold.drop("level_shared")
    for k in range(1, len(sizes) - 1):
        if candidates.isEmpty():
            break
        extended = hold.keep(candidates.mapInArrow(_next_level(*sizes[k - 1 : k + 2]), "doc_id long, anchors array<long>"), f"level{k}")
        hold.drop(f"candidates{k - 1}")
        candidates = hold.keep(texts.join(_repeated(extended, hold, f"level{k}"), "doc_id"), f"candidates{k}")
        hold.drop(f"level{k}", f"level{k}_shared")

    passages = hold.keep(candidates.mapInArrow(_last_level(*sizes[-2:]), "anchor long, passage long, doc_id long, text_key long, starts array<int>"), "passages")
    sources = passages.groupBy("anchor", "passage").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("anchor", "passage", "least")
    starts = passages.join(hold.keep(sources, "sources"), ["anchor", "passage"]).filter("doc_id > least").groupBy(*key).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = settled(candidates.select(*key, "text").join(settled(starts), key).dropDuplicates(key).mapInArrow(_cut(length, keep_text), "doc_id long, text_key long, cut long, cut_sha256 string, cut_text string"))

    out = level.select(*key, "n_words", "words_sha256").join(cut, key, "left").join(copies.withColumn("copy", F.lit(True)), key, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return settled(
        out.select(
            *key,
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "words_sha256")).alias("kept_sha256"),
            F.when(F.col("copy"), F.lit("") if keep_text else F.lit(None).cast("string")).otherwise(F.col("cut_text")).alias("kept_text"),
        )
    )
