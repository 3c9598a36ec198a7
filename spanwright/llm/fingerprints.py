"""Fingerprints that follow edit distance: order min-hash.

Every k-mer of characters is numbered by its occurrence, so repeats differ. Each of SKETCHES hash functions picks
the TUPLE k-mers of least value; their hashes, in the order in which they stand in the text, make one value of the
fingerprint. Two texts agree in a value if they share these k-mers in the same order, so moved passages cost
agreement as inserted ones do. The share of equal values is the likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import mix, settled

#: Characters of a k-mer, a power of two; k-mers of a tuple; values of a fingerprint; k-mers hashed in one step.
K, TUPLE, SKETCHES, STEP = 8, 2, 32, 4096

_random = np.random.default_rng(40409)
_FLIP = _random.integers(0, 1 << 32, (SKETCHES, 1), np.uint32)
_ODD = _random.integers(0, 1 << 31, (SKETCHES, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_ROW = np.arange(SKETCHES)
_PLACE_BITS = 24


def kmers(codes: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers of a text's code points, in text order; a shorter text is one k-mer."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    block, size = codes.astype(np.uint64) + np.uint64(1), 1
    while size < K and len(block) > size:
        block = block[:-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + block[size:]
        size *= 2
    if size < K:  # fewer characters than K: all of them
        whole = np.uint64(len(codes))
        for c in codes.astype(np.uint64):
            whole = (whole ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        block = np.array([whole], np.uint64)
    block = mix(block)
    n = len(block)
    if n < 1 << _PLACE_BITS:  # sorting hash and place as one number is several times faster than a stable argsort
        packed = np.sort((block >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64))
        order, key = (packed & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64), packed >> np.uint64(_PLACE_BITS)
    else:
        order = np.argsort(block >> np.uint64(_PLACE_BITS), kind="stable")
        key = (block >> np.uint64(_PLACE_BITS))[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    again = np.flatnonzero(~fresh)
    if len(again):
        begins = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        block = block.copy()
        block[order[again]] += (again - begins[again]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        block = mix(block)
    else:
        block = mix(block)
    return block


def fingerprint(codes: np.ndarray) -> np.ndarray:
    """SKETCHES values of 32 bits; a text without characters has all zeros."""
    block = kmers(codes)
    if not len(block):
        return np.zeros(SKETCHES, np.uint32)
    short = (block >> np.uint64(32)).astype(np.uint32)
    best = np.zeros((SKETCHES, 0), np.uint32)
    spots = np.zeros((SKETCHES, 0), np.int64)
    for at in range(0, len(short), STEP):
        values = (short[None, at : at + STEP] ^ _FLIP) * _ODD
        found, where = [best], [spots]
        for _ in range(min(TUPLE, values.shape[1])):
            least = values.argmin(1)
            found.append(values[_ROW, least][:, None].copy())
            where.append(least[:, None] + at)
            values[_ROW, least] = np.uint32(2**32 - 1)
        best, spots = np.concatenate(found, 1), np.concatenate(where, 1)
        order = np.lexsort((spots, best), axis=1)[:, :TUPLE]
        best, spots = np.take_along_axis(best, order, 1), np.take_along_axis(spots, order, 1)
    spots = np.sort(spots, 1)
    out = np.full(SKETCHES, spots.shape[1], np.uint64)
    for k in range(spots.shape[1]):
        out = mix(out * np.uint64(0x94D049BB133111EB) + block[spots[:, k]])
    return np.maximum(out >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out: list[tuple] = []
    held = None  # the row before, with its bucket, halo mark, code points and fingerprint
    for batch in batches:
        for bucket, halo, doc, text in zip(*(batch.column(k) for k in ("bucket", "halo", "doc_id", "text")), strict=True):
            codes = _codes(text.as_py())
            row = (bucket.as_py(), halo.as_py(), doc.as_py(), codes, fingerprint(codes))
            if held is not None and held[0] == row[0] and not held[1]:
                tail = len(held[3]) // 4
                edited = np.concatenate([held[3][: len(held[3]) - tail], codes[:tail]])
                mark = fingerprint(edited)
                out.append((held[2], len(held[3]), hashlib.sha256(_text(edited).encode("utf-8", "surrogatepass")).hexdigest(), held[4].tobytes().hex(), mark.tobytes().hex(), likeness(held[4], mark), likeness(held[4], row[4])))
            held = row
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs(doc_id, text).

    A text (null counts as empty) is compared with its edited form, whose last floor(n_chars / 4) code points are
    replaced by the first as many of the next document's (all of them if it has fewer), and with the next document.
    Next is the next row by (doc_id, text), null doc_id first; after the last comes the first, so a single row is
    its own next. Fingerprints are hexadecimal; equal texts have equal ones, and two empty texts a likeness of 1.
    Repeated rows are rows of their own. Other columns are ignored; an empty table gives an empty result.

    Texts move once: rows go to ranges of doc_id between sampled bounds, and the first row of each range goes to
    the range before it as well. The bounds are a few for each shuffle partition, whatever the number of rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first()["c"] or []))
    placed = rows.withColumn("bucket", _bucket(F.col("doc_id"), cuts))
    head = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))
    firsts = placed.groupBy("bucket").agg(head.alias("first")).orderBy("bucket").collect()  # a row a bucket
    if not firsts:
        return spark.createDataFrame([], _OUT)
    heads = spark.createDataFrame([(f["first"]["doc_id"], f["bucket"], firsts[i - 1]["bucket"]) for i, f in enumerate(firsts)], "head long, bucket int, target int")
    own, lent = (F.struct(F.col(k).alias("bucket"), F.lit(halo).alias("halo")) for k, halo in (("bucket", False), ("target", True)))
    marked = placed.join(F.broadcast(heads), "bucket")
    places = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, lent)).otherwise(F.array(own))
    dealt = marked.select("doc_id", "text", F.explode(places).alias("at")).select("at.bucket", "at.halo", "doc_id", "text")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text").mapInArrow(_compare, _OUT)


def _bucket(doc_id: F.Column, cuts: list[int]) -> F.Column:
    """The number of cuts below doc_id, 0 for null: first among every so-manieth cut, then among those between two of them."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    coarse = cuts[width - 1 :: width]
    fine = [cuts[i : i + width - 1] for i in range(0, len(cuts), width)] + [[]]

    def longs(values: list[int]) -> F.Column:
        return F.array(*(F.lit(v).cast("long") for v in values)).cast("array<long>")

    at = F.size(F.filter(longs(coarse), lambda c: c < doc_id))
    inner = F.size(F.filter(F.get(F.array(*map(longs, fine)), at), lambda c: c < doc_id))
    return F.when(doc_id.isNull(), 0).otherwise(at * width + inner).cast("int")
