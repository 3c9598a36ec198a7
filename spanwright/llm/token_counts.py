"""Exact token totals for every context limit, from a histogram of encoded lengths.

A text's length is its number of byte-level BPE tokens. Documents are counted by length; suffix sums over the
lengths then answer how many documents and tokens lie beyond any limit and how many tokens truncation leaves.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import pieces, settled

#: Vocabulary file of merge ranks (a path on the driver), and its greatest size in bytes: it is sent to all executors.
RANKS, RANKS_BOUND = "/opt/tokenizers/byte_bpe_50k.tiktoken", 16 << 20
#: The pre-tokenizer's pattern that belongs to these ranks (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern knows it (fixed values), in runs on which its lookahead would exhaust the matcher.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 512
#: Lengths of one bucket of the two-level suffix sum.
BUCKET = 4096

_encoders: dict = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of these ranks, built once in each Python worker."""
    import tiktoken

    if (key := (hash(ranks), pattern)) not in _encoders:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as file:
        ranks = file.read(RANKS_BOUND + 1)
    if len(ranks) > RANKS_BOUND:
        raise ValueError(f"{path} is larger than {RANKS_BOUND} bytes")
    return ranks


def encoded(tokens, text: str, long_run: int = LONG_RUN) -> list[int]:
    """The token ids of a text, which is cut where a long run of white space makes pre-tokens that are known beforehand.

    The pattern takes such a run but for its last character as one pre-token, at the text's end all of it, and goes on
    from there as at a beginning, so that the pieces' tokens are the text's.
    """
    out, at = [], 0
    for run in re.finditer(f"[{SPACES}]{{{long_run},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += tokens.encode_ordinary(text[at : run.start()])
        out += tokens._encode_single_piece(text[run.start() : end])
        at = end
    return out + tokens.encode_ordinary(text[at:]) if at else tokens.encode_ordinary(text)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(shared.value)
        for batch in (p for b in batches for p in pieces(b)):
            counts = [len(encoded(tokens, t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return run


def with_token_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens for each row of docs(doc_id, text); null or empty text has no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_count(shared), "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens, docs, total, docs_over, tokens_over, tokens_truncated, docs_share for each length that occurs.

    docs and total are the documents of that length and their tokens, docs_over and tokens_over those that are
    longer, tokens_truncated the corpus's tokens if every document is cut to this length, and docs_share the share
    of documents that are at most so long (its least length with docs_share >= q is the q-quantile). Between two
    lengths a and b that occur, a limit c leaves tokens_truncated(a) + (c - a) * docs_over(a). Suffix sums run in
    two levels, over buckets of lengths and inside them, so no task sees more than one bucket's lengths or one row
    a bucket. An empty table gives an empty result.
    """
    lengths = settled(counted.groupBy("n_tokens").agg(F.count("*").alias("docs")).withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("total", F.col("docs") * F.col("n_tokens")))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = lengths.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum("total").alias("t"))
    # a row a bucket: the longest text's length over BUCKET, whatever the number of documents
    beyond = buckets.select("bucket", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"))
    whole = buckets.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("docs"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens")).first()
    inner = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = lengths.withColumns({"docs_over": F.coalesce(F.sum("docs").over(inner), F.lit(0)), "tokens_over": F.coalesce(F.sum("total").over(inner), F.lit(0))})
    out = out.join(beyond, "bucket").withColumns({"docs_over": F.col("docs_over") + F.col("d"), "tokens_over": F.col("tokens_over") + F.col("t")})
    truncated = F.lit(whole["tokens"]) - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return out.select("n_tokens", "docs", "total", "docs_over", "tokens_over", truncated.alias("tokens_truncated"), ((F.lit(whole["docs"]) - F.col("docs_over")) / F.lit(max(whole["docs"], 1))).alias("docs_share"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, tokens_truncated for any limits, from a histogram."""
    asked = hist.select("n_tokens", "docs", "total", F.explode(F.array(*(F.lit(int(c)).cast("long") for c in limits))).alias("context_limit"))
    longer = F.col("n_tokens") > F.col("context_limit")
    kept = F.when(longer, F.col("docs") * F.col("context_limit")).otherwise(F.col("total"))
    return asked.groupBy("context_limit").agg(F.sum(F.when(longer, F.col("docs")).otherwise(0)).alias("docs_over"), F.sum(kept).alias("tokens_truncated"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents do not exceed."""
    return hist.filter(F.col("docs_share") >= q).agg(F.min("n_tokens").alias("n_tokens"))
