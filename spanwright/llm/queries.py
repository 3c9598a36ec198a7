"""The driver's queries over the operators of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import fingerprints, language_id, near_dedup, packing, quality_rules, sentencepiece, sharding, substring_dedup, token_counts, warc
from spanwright.llm.common import Scratch, settled


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out() -> F.Column:
    """A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.with_token_counts(_read(spark, sf_dir)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    net = language_id.learned(docs, ~held_out())
    return language_id.identified(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.sampled(_read(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(_read(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(_read(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_read(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_read(spark, sf_dir), 50, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives of both versions, converted to WARC and read back."""
    pages = _read(spark, sf_dir, "pages")
    hold = Scratch(spark)
    try:
        even = F.coalesce(F.col("page_id") % 2, F.lit(0)) == 0
        for version, part in ((1, pages.filter(even)), (2, pages.filter(~even))):
            warc.write_arc(part, f"{hold.root}/arc{version}", version)
        records = warc.read_arc(spark, f"{hold.root}/arc1").unionByName(warc.read_arc(spark, f"{hold.root}/arc2"))
        warc.write_warc(records, f"{hold.root}/warc")
        return settled(warc.read_warc(spark, f"{hold.root}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"))
    finally:
        hold.close()


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir), 4, 80)


NEAR_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) >= 4 then list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as both_have from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join n a on a.doc_id = x join n b on b.doc_id = y where 100 * both_have >= 80 * (a.n + b.n - both_have)),
edges as (select x, y from links union all select y, x from links),
reach(doc_id, component_id) as (select x, x from edges union select e.y, r.component_id from reach r join edges e on e.x = r.doc_id),
least as (select doc_id, min(component_id) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(l.component_id, d.doc_id) as component_id, coalesce(l.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join least l on l.doc_id = d.doc_id
"""

REPEATS_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
windows as (select doc_id, i, array_to_string(words[i:i+49], ' ') as passage from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w)),
sources as (select md5(passage) as p, min(doc_id) as least from windows group by 1 having min(doc_id) < max(doc_id)),
starts as (select doc_id, i from windows join sources on md5(passage) = p where doc_id > least),
gone as (select distinct doc_id, i + k as spot from starts, range(50) as r(k)),
gone_lists as (select doc_id, count(*) as n, list(spot) as spots from gone group by doc_id),
kept as (select w.doc_id, len(words) as n_words, coalesce(n, 0) as n_removed, case when n is null then words else list_transform(list_filter(range(1, len(words) + 1), lambda i: not list_contains(spots, i)), lambda i: words[i]) end as left_words from w left join gone_lists g on g.doc_id = w.doc_id)
select doc_id, n_words, n_removed, sha256(array_to_string(left_words, ' ')) as kept_sha256 from kept
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_sharding": op5_sharding,
    "op6_order_minhash": op6_order_minhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc": op9_warc,
    "op10_near_dedup": op10_near_dedup,
}

ORACLES: dict[str, str] = {
    "op7_quality_rules": quality_rules.oracle_sql(),
    "op8_substring_dedup": REPEATS_SQL,
    "op10_near_dedup": NEAR_SQL,
}
