"""Sampled subword segmentation over the lattice of a SentencePiece vocabulary, and its decoding.

Forward filtering sums the weights of all segmentations up to each character, backward sampling then draws pieces
from the end with the probabilities these sums imply, so every segmentation comes up in proportion to its weight.
Draws are seeded by the row's key and the place in its text: the same row gives the same pieces wherever and
whenever it is computed. No piece crosses a word's beginning or a line feed, so lattices are built once for each
distinct word of a batch and drawn from for each occurrence, all in numpy.

Spaces become the vocabulary's space mark; characters outside the vocabulary, and the mark itself in a text, become
UTF-8 byte pieces. Nothing is normalised, so decoding returns the text bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import mix, pieces

#: Model file (a path on the driver) and the greatest number of its pieces: they are sent to all executors.
MODEL, PIECES_BOUND = "/opt/tokenizers/piece_bpe_32k.model", 1 << 20
MARK = 0x2581
#: Log weight of a character that falls back to bytes; added to code points that must fall back.
FALLBACK, APART = -30.0, 0x110000
_STEP = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    pieces: list[str]
    weights: np.ndarray  # log weights by id
    byte_ids: np.ndarray  # the ids of the 256 byte pieces

    def tables(self) -> None:
        """Lookup tables by length, and bytes for decoding; built once in each worker."""
        if hasattr(self, "slot_id"):
            return
        plain = [i for i in range(len(self.pieces)) if np.isfinite(self.weights[i])]
        self.longest = max(len(self.pieces[i]) for i in plain)
        slots = 1 << max(10, len(plain).bit_length() + 4)
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.slot_hash, self.slot_id = np.zeros(slots + 64, np.uint64), np.full(slots + 64, -1, np.int64)
        for i in plain:
            h = np.zeros(1, np.uint64)
            for c in self.pieces[i]:
                h = h * _BASE + mix(np.array([ord(c) + 1], np.uint64))
            k = int(h[0] >> self.shift)
            while self.slot_id[k] >= 0:
                k += 1
            self.slot_hash[k], self.slot_id[k] = h[0], i
        data = [p.replace(chr(MARK), " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            data[i] = bytes([b])
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The id of the piece of each hash, -1 where there is none; by linear probing."""
        spot = (hashes >> self.shift).astype(np.int64)
        out = self.slot_id[spot]
        open_ = np.flatnonzero((out >= 0) & (self.slot_hash[spot] != hashes))
        while len(open_):
            spot[open_] += 1
            out[open_] = self.slot_id[spot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.slot_hash[spot[open_]] != hashes[open_])]
        return out


def vocabulary(model: str = MODEL, sharpness: float = 1.0, ranked: bool = True) -> Vocabulary:
    """The pieces of a model file. Scores are log probabilities, or with ``ranked`` merge ranks, whose probabilities are taken as 1 / (rank + 1); ``sharpness`` multiplies their logarithms."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=model)
    count = read.vocab_size()
    if count > PIECES_BOUND:
        raise ValueError(f"{model} has more than {PIECES_BOUND} pieces")
    names = [read.id_to_piece(i) for i in range(count)]
    byte_ids = np.array([read.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    if not all(read.is_byte(int(i)) for i in byte_ids):
        raise ValueError(f"{model} has no byte pieces, which lossless decoding needs")
    if crossing := [n for n in names if chr(MARK) in n.lstrip(chr(MARK)) or "\n" in n]:
        raise ValueError(f"{model} has pieces that cross words, such as {crossing[0]!r}")
    scores = np.array([read.get_score(i) for i in range(count)])
    weights = sharpness * (-np.log1p(np.maximum(-scores, 0)) if ranked else scores)
    special = [i for i in range(count) if read.is_control(i) or read.is_unknown(i) or read.is_byte(i) or read.is_unused(i)]
    weights[special] = -np.inf
    return Vocabulary(names, weights, byte_ids)


def _lattice(vocab: Vocabulary, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the words' lattices sorted by end node: their start nodes, pieces and cumulated probabilities plus end node; each node's first edge.

    codes holds the words one after the other; word k's node before its j-th character is starts[k] + k + j.
    """
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes))
    left = np.repeat(starts + sizes, sizes) - place  # characters up to the word's end
    marked = mix(codes.astype(np.uint64) + np.uint64(1))
    found: list[tuple[np.ndarray, np.ndarray]] = []  # characters where a piece of this length begins, and the piece
    node = place + word
    counts = np.zeros(len(codes) + len(sizes) + 1, np.int64)
    rolling, at = np.zeros(len(codes), np.uint64), place
    for length in range(1, vocab.longest + 1):
        ok = left[at] >= length
        at, rolling = at[ok], rolling[ok]
        if not len(at):
            break
        rolling = rolling * _BASE + marked[at + length - 1]
        ids = vocab.find(rolling)
        if length == 1:  # a character without a piece of its own
            ids = np.where(ids < 0, -1 - codes, ids)
            hit = at
        else:
            hit, ids = at[ids >= 0], ids[ids >= 0]
        found.append((hit, ids))
        counts[node[hit] + length] += 1
    # an edge's row: after those of earlier end nodes and of shorter pieces; end nodes of one length are distinct
    next_row = np.concatenate([[0], np.cumsum(counts)[:-1]])
    firsts = next_row.copy()
    rows = int(counts.sum())
    begin, piece, end, depth = np.empty(rows, np.int64), np.empty(rows, np.int64), np.empty(rows, np.int64), np.empty(rows, np.int64)
    for length, (hit, ids) in enumerate(found, 1):
        to = node[hit] + length
        row = next_row[to]
        begin[row], piece[row], end[row], depth[row] = node[hit], ids, to, hit - starts[word[hit]] + length
        next_row[to] += 1
    weight = np.where(piece >= 0, vocab.weights[np.maximum(piece, 0)], FALLBACK)
    total = np.full(len(codes) + len(sizes), 0.0)  # log sums by node; 0 where a word begins
    by_depth = np.argsort(depth.astype(np.uint16) if depth.max() < 1 << 16 else depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max()) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = by_depth[a:b]
        value, node = total[begin[rows]] + weight[rows], end[rows]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        most = np.maximum.reduceat(value, first)
        spread = np.repeat(most, np.diff(np.concatenate([first, [len(rows)]])))
        total[node[first]] = most + np.log(np.add.reduceat(np.exp(value - spread), first))
    share = np.exp(total[begin] + weight - total[end])
    fresh = np.concatenate([[True], end[1:] != end[:-1]])
    run = np.cumsum(share)
    first = np.flatnonzero(fresh)
    run -= np.repeat((run - share)[first], np.diff(np.concatenate([first, [len(run)]])))
    run[np.concatenate([fresh[1:], [True]])] = 1.5  # never passed over
    return begin, piece, end + run, firsts


def encode(vocab: Vocabulary, texts: list[str | None], keys: list[int | None], seed: int = 0) -> list[np.ndarray]:
    """Sampled piece ids of each text, drawn by its key; null and empty texts have none."""
    vocab.tables()
    lines = [np.frombuffer(f" {t}".encode("utf-32-le"), np.uint32).astype(np.int64) if t else np.zeros(0, np.int64) for t in texts]
    sizes = np.array([len(x) for x in lines])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if not offsets[-1]:
        return [np.zeros(0, np.int32) for _ in texts]
    codes = np.concatenate(lines)
    codes[codes == MARK] += APART
    codes[codes == 32] = MARK
    mark, feed = codes == MARK, codes == 10
    cut = mark.copy()
    cut[1:] &= ~mark[:-1]
    cut |= feed
    cut[1:] |= feed[:-1]
    cut[offsets[:-1][sizes > 0]] = True
    begins = np.flatnonzero(cut)
    lengths = np.diff(np.concatenate([begins, [len(codes)]]))
    # distinct words, by a hash of their characters
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) - 1, _BASE)]))
    inside = np.arange(len(codes)) - np.repeat(begins, lengths)
    word_hash = mix(np.add.reduceat(mix(codes.astype(np.uint64)) * powers[inside], begins) + lengths.astype(np.uint64))
    _, sample, which = np.unique(word_hash, return_index=True, return_inverse=True)
    size = lengths[sample]
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    spots = np.repeat(begins[sample] - starts, size) + np.arange(int(size.sum()))
    begin, piece, bound, firsts = _lattice(vocab, codes[spots], starts, size)
    # backward draws for all words at once
    base = (starts + np.arange(len(starts)))[which]
    node = base + lengths
    text = np.searchsorted(offsets, begins, "right") - 1
    key = mix(np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64) + np.uint64(seed) * _BASE)
    state = mix(key[text] + begins.astype(np.uint64) - offsets[text].astype(np.uint64))
    active, taken, step = np.arange(len(begins)), [], 0
    counts = np.zeros(len(begins), np.int64)
    while len(active):
        state = mix(state + np.uint64(0xD1B54A32D192ED03))
        draw = (state >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        edge, sought = firsts[node], node + draw
        later = np.flatnonzero(bound[edge] <= sought)
        while len(later):
            edge[later] += 1
            later = later[bound[edge[later]] <= sought[later]]
        taken.append((active, piece[edge]))
        counts[active] += 1
        node = begin[edge]
        more = node > base
        active, node, state, base = active[more], node[more], state[more], base[more]
        step += 1
    after = np.cumsum(counts)
    ids = np.empty(int(after[-1]), np.int64)
    for k, (who, drawn) in enumerate(taken):
        ids[after[who] - 1 - k] = drawn
    # characters outside the vocabulary become their UTF-8 bytes
    code = np.where(ids < 0, -1 - ids, 0)
    code = np.where(code >= APART, code - APART, code)
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    spread = np.cumsum(width)
    out = np.repeat(ids, width)
    lone = np.flatnonzero(ids < 0)
    for n in (1, 2, 3, 4):
        rows = lone[width[lone] == n]
        for k in range(n):
            low = (code[rows] >> (6 * (n - 1 - k))) & (0x3F if k else 0xFF)
            byte = low if n == 1 else (low | 0x80 if k else low | (0xC0, 0xE0, 0xF0)[n - 2])
            out[spread[rows] - n + k] = vocab.byte_ids[byte]
    per_text = np.add.reduceat(np.concatenate([width, [0]]), np.concatenate([[0], after[:-1]]))  # pieces of each word
    ends = np.cumsum(np.bincount(text, per_text, len(texts)).astype(np.int64))
    return np.split(out.astype(np.int32), ends[:-1])


def decode(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The text that these pieces were drawn from, as UTF-8."""
    vocab.tables()
    size = vocab.sizes[ids]
    ends = np.cumsum(size)
    spots = np.repeat(vocab.starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return vocab.data[spots].tobytes()[1:]


def _encode(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in (p for b in batches for p in pieces(b, limit=_STEP)):
            texts = batch.column("text").to_pylist()
            drawn = encode(vocab, texts, batch.column("doc_id").to_pylist(), seed)
            whole = [decode(vocab, d) == (t or "").encode() for t, d in zip(texts, drawn, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(d) for d in drawn])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(drawn)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), ids, pa.array(whole, pa.bool_())], ["doc_id", "n_pieces", "pieces", "lossless"])

    return run


def sampled(docs: DataFrame, vocab: Vocabulary | None = None, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, pieces, lossless for each row of docs(doc_id, text).

    pieces are the sampled ids, seeded by doc_id (null: as 0); lossless says that decoding them gave the text back.
    Null or empty text has no pieces and is lossless. Repeated rows have equal pieces. Other columns are ignored; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(shared, seed), "doc_id long, n_pieces long, pieces array<int>, lossless boolean")


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids.as_py() is None else decode(shared.value, ids.values.to_numpy(zero_copy_only=False)).decode() for ids in batch.column("pieces")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decoded(encoded: DataFrame, vocab: Vocabulary | None = None) -> DataFrame:
    """doc_id, text for each row of encoded(doc_id, pieces); no pieces give an empty text, null gives null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    return encoded.select("doc_id", F.col("pieces").cast("array<int>").alias("pieces")).mapInArrow(_decode(shared), "doc_id long, text string")
