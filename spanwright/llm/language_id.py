"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's bytes are cut into windows of fixed length that overlap by the widest filter less one byte, so every byte
sequence that a filter can match lies in a window and no text is cut short. Filters of several widths slide over
embedded bytes; each keeps its maximum over the window, and a softmax layer turns these into language
probabilities. A text's probabilities are the means over its windows, weighted by their bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import pieces, utf8

#: Bytes of a window; filter widths; filters of each width; size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4, 5), 12, 8
#: Bound of the training sample: windows of each language (the documents of least hash, one window of each), and languages.
SAMPLE, LANGUAGES = 600, 256
EPOCHS, BATCH, RATE = 12, 64, 0.004
WIDEST = max(WIDTHS)
STRIDE = WINDOW - WIDEST + 1


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 257 x EMBED; 256 stands for padding
    filters: np.ndarray  # WIDEST * EMBED x len(WIDTHS) * FILTERS, zero beyond a filter's width
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def hidden(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over the positions of each window, and where they were found. codes: windows x (WINDOW + WIDEST - 1)."""
        n, length = codes.shape
        flat = self.embedding[codes.ravel()]
        views = np.lib.stride_tricks.as_strided(flat, (n, length - WIDEST + 1, WIDEST * EMBED), (length * EMBED * 4, EMBED * 4, 4))
        scores = views.reshape(-1, WIDEST * EMBED) @ self.filters
        return np.maximum(scores.reshape(n, length - WIDEST + 1, -1).max(1) + self.bias, 0), scores

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return _softmax(self.hidden(codes)[0] @ self.weight + self.offset)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _padded(windows: list[bytes]) -> np.ndarray:
    codes = np.full((len(windows), WINDOW + WIDEST - 1), 256, np.int64)
    for i, w in enumerate(windows):
        codes[i, : len(w)] = np.frombuffer(w, np.uint8)
    return codes


def trained(windows: list[bytes], labels: list[str], seed: int = 11) -> Network:
    """A network from byte windows of at most WINDOW bytes and their languages, by Adam on the cross entropy; the same for the same rows in the same order."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    count = len(WIDTHS) * FILTERS
    mask = np.repeat(np.concatenate([np.repeat(np.arange(WIDEST) < w, EMBED)[:, None] * np.ones(FILTERS) for w in WIDTHS], 1), 1, 0).astype(np.float32)
    net = Network(languages, rng.normal(0, 0.5, (257, EMBED)).astype(np.float32), (rng.normal(0, 0.25, (WIDEST * EMBED, count)) * mask).astype(np.float32), np.zeros(count, np.float32), rng.normal(0, 0.2, (count, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.embedding[256] = 0
    codes, targets = _padded(windows), np.searchsorted(languages, labels)
    params = ("embedding", "filters", "bias", "weight", "offset")
    first = {k: np.zeros_like(getattr(net, k)) for k in params}
    second = {k: np.zeros_like(getattr(net, k)) for k in params}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, y = codes[rows], targets[rows]
            top, scores = net.hidden(x)
            p = _softmax(top @ net.weight + net.offset)
            p[np.arange(len(y)), y] -= 1
            p = (p / len(y)).astype(np.float32)
            back = (p @ net.weight.T) * (top > 0)
            where = scores.reshape(len(y), -1, count).argmax(1)  # windows x filters
            spots = where[..., None] + np.arange(WIDEST)  # the bytes under each filter's maximum
            under = x[np.arange(len(y))[:, None, None], spots]
            inputs = net.embedding[under].reshape(len(y), count, WIDEST * EMBED)
            grads = {"weight": top.T @ p, "offset": p.sum(0), "bias": back.sum(0), "filters": np.einsum("nf,nfe->ef", back, inputs) * mask}
            spread = (back[..., None] * net.filters.T[None]).reshape(len(y), count, WIDEST, EMBED)
            grads["embedding"] = np.zeros_like(net.embedding)
            np.add.at(grads["embedding"], under.ravel(), spread.reshape(-1, EMBED))
            grads["embedding"][256] = 0
            step += 1
            for k in params:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.01 * (grads[k] ** 2 - second[k])
                move = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    return net


def sampled(docs: DataFrame, train: F.Column | str = "true") -> tuple[list[bytes], list[str]]:
    """One window of up to WINDOW bytes from a hashed place of each of about SAMPLE documents of a language.

    docs(text, lang) are filtered by ``train`` and lang, which may not be null. The bound does not grow with docs:
    a hash of the text picks rows with a chance that the language's count sets, so that no more than a few more
    than SAMPLE are expected, and the least hashes stay. More than LANGUAGES values of lang raise ValueError.
    """
    known = docs.filter(train).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select("text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang")
    if not counts:
        return [], []
    lot = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000_007)) / 1_000_000_007.0
    chance = F.element_at(F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*(F.lit(min(1.0, 1.5 * SAMPLE / n)) for n in counts.values()))), F.col("lang"))
    place = F.pmod(F.xxhash64("text", F.lit(9)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    picked = known.filter(F.col("lang").isin(*counts)).withColumn("lot", lot).filter(F.col("lot") < chance)
    rows = picked.select("lang", "lot", F.substring("text", place, F.lit(WINDOW)).alias("part")).distinct().collect()
    rows.sort(key=lambda r: (r["lot"], r["lang"], r["part"]))
    windows, labels, held = [], [], dict.fromkeys(counts, 0)
    for r in rows:
        if held[r["lang"]] < SAMPLE:
            held[r["lang"]] += 1
            part = r["part"].encode()[:WINDOW]
            windows.append(part)
            labels.append(r["lang"])
    return windows, labels


def _classify(net: Network):
    packed = pickle.dumps(net)
    letter = np.zeros(256, bool)  # an ASCII letter shows at once; the rest is asked of Python
    letter[65:91] = letter[97:123] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(packed)
        spot = np.arange(WINDOW + WIDEST - 1)
        for batch in (p for b in batches for p in pieces(b)):
            data, offsets = utf8(batch.column("text"))
            sizes = np.diff(offsets)
            count = np.maximum(1, -(-(sizes - WIDEST + 1) // STRIDE)) * (sizes > 0)
            text = np.repeat(np.arange(len(sizes)), count)
            begin = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
            held = np.minimum(sizes[text] - begin, WINDOW)
            total = np.zeros((len(sizes), max(1, len(net.languages))))
            for at in range(0, len(text) if net.languages else 0, 512):
                t, b, h = text[at : at + 512], begin[at : at + 512], held[at : at + 512]
                codes = data[np.minimum((offsets[t] + b)[:, None] + spot, len(data) - 1)].astype(np.int64)
                codes[spot >= h[:, None]] = 256
                np.add.at(total, t, net.probabilities(codes) * h[:, None])
            best = total.argmax(1)
            score = total[np.arange(len(best)), best] / np.maximum(total.sum(1), 1e-300)
            ascii_letters = np.concatenate([[0], np.cumsum(letter[data])])
            lettered = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            for i in np.flatnonzero(~lettered & (sizes > 0)):
                lettered[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace")))
            known = lettered & bool(net.languages)
            langs = [net.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            columns = {k: c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k != "text"}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(langs, pa.string()), pa.array(np.where(known, np.minimum(score, 1.0), 0.0))], [*columns, "lang_pred", "score"])

    return run


def identified(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text), repeated rows included.

    lang_pred is one of the network's languages, ``und`` with score 0 where the text is null or has no letter (or
    where nothing was learned). score is the mean probability of lang_pred. Only the text decides; other columns,
    such as one named lang, are ignored. An empty table gives an empty result.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_classify(net), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def recognised(docs: DataFrame, net: Network, least_score: float) -> DataFrame:
    """The rows of docs whose text has a language of the network with at least that score; a row's columns stay as they are."""
    boxed = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    scored = boxed.mapInArrow(_classify(net), f"row {boxed.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")


def learned(docs: DataFrame, train: F.Column | str = "true") -> Network:
    """A network trained on the bounded sample of docs; without labelled rows one that knows no language."""
    windows, labels = sampled(docs, train)
    return trained(windows, labels)
