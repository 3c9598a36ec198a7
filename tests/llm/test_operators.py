"""Every corpus operator on awkward rows, and against brute force, a round trip or held-out accuracy."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.llm import fingerprints, language_id, near_dedup, packing, quality_rules, sentencepiece, sharding, substring_dedup, token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, component string, bucket string, score string"


def table(spark, rows):
    """documents with extra columns of clashing names; rows are (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or ""), 7, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed, pool=4000):
    rng = random.Random(seed)
    return ["w" + "".join("abcdefghij"[int(d)] for d in str(rng.randrange(pool))) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    a, b = words(120, 1), words(150, 2)
    rows = [
        (5, " ".join(a)), (1, " ".join(a)), (9, " ".join(a[:-3] + ["x", "y", "z"])), (2, " ".join(b)), (3, " ".join(b[:70] + words(80, 3))),
        (4, None), (6, ""), (7, " \n\t "), (8, "one two"), (10, "one two"), (11, "!!! 123 ???"), (None, " ".join(b)), (12, " ".join(words(6000, 4))),
        (13, "é\U0001F600▁  x\x00y"), (2, " ".join(b)), (14, "ab " * 400),
    ]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [(1, "x")]).limit(0)


OPERATORS = {
    "packing": packing.packed,
    "counts": token_counts.with_token_counts,
    "sentencepiece": sentencepiece.sampled,
    "sharding": sharding.sharded,
    "fingerprints": fingerprints.fingerprinted,
    "quality": quality_rules.judged,
    "substring": substring_dedup.without_repeats,
    "near": near_dedup.near_duplicates,
    "language": lambda docs: language_id.identified(docs, language_id.learned(docs)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(awkward, empty, name):
    out = OPERATORS[name](awkward)
    found = Counter(r["doc_id"] for r in out.collect())
    assert set(found) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, None} and found[2] >= 2
    assert OPERATORS[name](empty).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [words(rng.randrange(30, 90), k, 900) for k in range(12)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
        rows.append((i, " ".join(w).title() if i % 5 == 0 else " ".join(w)))
    sets = {i: {tuple(t.lower().split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    label = dict.fromkeys(sets)
    for i in sets:
        label[i] = i
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table(spark, rows), 4, 80).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_one_group_of_loosely_linked_copies(spark):
    """Copies of one text with up to a third of it edited: many keys stay unfinished after their leader."""
    rng, base, rows = random.Random(8), words(150, 1, 900), []
    for i in range(220):
        w = list(base)
        for k in range(rng.randrange(1, 16)):
            w[rng.randrange(len(w))] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in range(i + 1, len(rows)):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    assert 20 < len(set(label.values())) < 200
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, rows), 4, 80).collect()}
    assert got == label


def test_repeats_against_brute_force(spark):
    rng = random.Random(8)
    passages = [words(rng.randrange(40, 90), 100 + k) for k in range(5)]
    rows = [(i, " ".join(sum((words(rng.randrange(0, 30), 1000 * i + j) + rng.choice(passages) for j in range(3)), []))) for i in range(25)]
    split = {i: t.split() for i, t in rows}
    first = {}
    for i, w in sorted(split.items()):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in substring_dedup.without_repeats(table(spark, rows)).collect()}
    for i, w in split.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left if gone else None)


def test_packing_keeps_every_token_and_no_conflict(spark):
    rng = random.Random(1)
    rows = [(i, f"{i % 40} " + "x" * rng.randrange(0, 900), "en", "hot" if i % 3 == 0 else f"s{rng.randrange(9)}") for i in range(300)] + [(300, "y" * 5000, "en", "hot"), (301, None, "en", None)]
    docs = table(spark, rows)
    out = packing.packed(docs, capacity=1000, group=100).collect()
    by_doc, by_bin = Counter(), {}
    info = {r[0]: (r[1], r[3]) for r in rows}
    for r in out:
        by_doc[r["doc_id"]] += r["n_tokens"]
        if r["bin_id"] is not None:
            by_bin.setdefault(r["bin_id"], []).append(r)
    assert by_doc == {i: len(t) + 1 if t else 0 for i, (t, _) in info.items()}
    for group in by_bin.values():
        spans = sorted((r["bin_offset"], r["n_tokens"]) for r in group)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0 and sum(n for _, n in spans) <= 1000
        sources, texts = [info[r["doc_id"]][1] for r in group], [info[r["doc_id"]][0] for r in group]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)


def test_best_fit_takes_the_tightest_compatible_bin():
    placed = packing.best_fit([6, 5, 3, 2], [0, 1, 1, 2], [-1, -1, -1, -1], 10)
    assert placed == [(0, 0), (1, 0), (0, 6), (1, 5)]  # 3 fits both; the tighter bin 0 has room and another source


def test_token_counts(spark, awkward):
    counted = token_counts.with_token_counts(awkward)
    lengths = [r["n_tokens"] for r in counted.collect()]
    hist = token_counts.histogram(counted)
    for r in hist.collect():
        n = r["n_tokens"]
        assert r["docs"] == lengths.count(n) and r["docs_over"] == sum(x > n for x in lengths) and r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["tokens_truncated"] == sum(min(x, n) for x in lengths) and r["docs_share"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for r in token_counts.at_limits(hist, [0, 3, 500, 10**6]).collect():
        assert r["tokens_truncated"] == sum(min(x, r["context_limit"]) for x in lengths)
    assert token_counts.quantile(hist, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]


def test_shards_are_contiguous_and_balanced(spark):
    rows = [(i * 3, "é" * (i % 50)) for i in range(500)] + [(7, None)]
    out = sorted(sharding.sharded(table(spark, rows)).collect(), key=lambda r: r["doc_id"])
    text = dict(rows)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in out)
    assert [r["shard"] for r in out] == sorted(r["shard"] for r in out)
    total = sum(r["size"] for r in out)
    for s in range(8):
        own = [r for r in out if r["shard"] == s]
        assert [r["slot"] for r in own] == list(range(len(own))) and abs(sum(r["size"] for r in own) - total / 8) <= 101


def test_fingerprints_against_plain_python(spark):
    rows = [(i, " ".join(words(n, i))) for i, n in enumerate([50, 3, 200, 1, 90, 400])] + [(6, "é"), (7, None), (8, "same text here"), (9, "same text here")]
    out = {r["doc_id"]: r for r in fingerprints.fingerprinted(table(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i]["near_next"] <= 1
    assert out[8]["fingerprint"] == out[9]["fingerprint"] and out[8]["near_next"] == 1
    assert np.mean([out[i]["near_edited"] for i in (0, 2, 4, 5)]) > 0.2 > out[2]["near_next"]


def test_occurrences_are_numbered_and_order_counts():
    def mark(t):
        return fingerprints.fingerprint(np.frombuffer(t.encode("utf-32-le"), np.uint32))

    codes = np.frombuffer(("abcdefgh" * 3).encode("utf-32-le"), np.uint32)
    assert len(set(fingerprints.kmers(codes).tolist())) == len(codes) - 7
    a, b = " ".join(words(60, 1)), " ".join(words(60, 2))
    assert fingerprints.likeness(mark(a + b), mark(b + a)) < 0.75 and fingerprints.likeness(mark(a), mark(a)) == 1


def test_sampling_follows_the_lattice_and_decodes():
    vocab = sentencepiece.vocabulary()
    odd = ["", None, " ", "  a▁b \n\n xé\U0001F600中", "a" * 3000, "\x00\t", "▁"]
    drawn = sentencepiece.encode(vocab, odd, list(range(len(odd))))
    assert [sentencepiece.decode(vocab, d).decode() for d in drawn] == [t or "" for t in odd]
    again = sentencepiece.encode(vocab, odd[::-1], list(range(len(odd)))[::-1])[::-1]
    assert all((a == b).all() for a, b in zip(drawn, again, strict=True))
    ids = {p: i for i, p in enumerate(vocab.pieces) if np.isfinite(vocab.weights[i])}

    def all_of(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in ids:
                yield from ((ids[s[:n]], *rest) for rest in all_of(s[n:]))

    ways = list(all_of("▁hello"))
    share = np.exp([sum(vocab.weights[i] for i in w) for w in ways])
    share /= share.sum()
    seen = Counter(tuple(x.tolist()) for x in sentencepiece.encode(vocab, ["hello"] * 4000, list(range(4000))))
    assert all(abs(seen[w] / 4000 - p) < 0.03 for w, p in zip(ways, share, strict=True))


def test_language_is_learned(spark):
    rng = random.Random(2)
    kinds = {"aa": ["tion", "the", "ing"], "bb": ["eux", "que", "oi"], "cc": ["ung", "sch", "ei"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=2)) for _ in range(40)), k, "s") for i, k in enumerate(rng.choices(list(kinds), k=300))]
    docs = table(spark, rows)
    net = language_id.learned(docs, F.col("doc_id") < 200)
    held = docs.filter("doc_id >= 200")
    found = {r["doc_id"]: r for r in language_id.identified(held, net).collect()}
    assert sum(found[i]["lang_pred"] == k for i, _, k, _ in rows[200:]) >= 97
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identified(table(spark, [(1, None), (2, "123 !!"), (3, "")]), net).collect()}
    assert odd == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0)}
    assert language_id.recognised(held, net, 0.0).columns == docs.columns


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ bé", "x\r\n\r\ny"), (2, None, None), (3, "http://c", "x\r\n\r\ny"), (4, "http://d", ""), (5, "http://e", "WARC/1.1\r\n"), (None, "http://f", "x\r\n\r\ny")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for version in (1, 2):
        arc, out = f"{tmp_path}/arc{version}", f"{tmp_path}/warc{version}"
        warc.write_arc(df, arc, version)
        warc.write_warc(warc.read_arc(spark, arc), out)
        got = {r["page_id"]: r for r in warc.read_warc(spark, out).collect()}
        assert len(got) == 6 and all(r["intact"] for r in got.values())
        for page, _, html in pages:
            body = (html or "").encode()
            assert got[page]["payload_bytes"] == len(body) and got[page]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("revisit", 2), 5: ("response", None), None: ("response", None)}
    with pytest.raises(ValueError):
        list(warc.arc_records(b"filedesc://x 0 0 text/plain 9999\nshort"))


def test_quality_counts_and_verdicts(spark):
    clean = [(i, ". ".join(" ".join(words(12, 20 * i + k)).capitalize() for k in range(9)) + ".") for i in range(40)]
    shout = [(100 + i, " ".join(f"{w.upper()}!!" for w in words(100, 900 + i))) for i in range(6)]
    got = {r["doc_id"]: r for r in quality_rules.judged(table(spark, [*clean, *shout, (200, "a b c a b c x\nz\nz")])).collect()}
    assert all(got[i]["kept"] for i, _ in clean) and not any(got[i]["kept"] for i, _ in shout)
    assert (got[200]["n_words"], got[200]["n_repeat_words"], got[200]["n_dup_lines"], got[200]["base_failed"]) == (9, 6, 1, True)


def test_archives_of_awkward_pages(spark, tmp_path):
    """Repeated rows, clashing columns, a long payload, an empty table, and malformed records, which are set aside."""
    long = "é" * 700_000
    rows = [(4, "http://a", "same", "x"), (4, "http://a", "same", "y"), (2, "http://b", "same", "z"), (7, "", long, None), (9, "http://c", None, "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    warc.write_arc(df, f"{tmp_path}/arc", 1)
    warc.write_warc(warc.read_arc(spark, f"{tmp_path}/arc"), f"{tmp_path}/warc")
    got = warc.read_warc(spark, f"{tmp_path}/warc").collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["refers_to"]) == [(4, "revisit", 2, 4)] * 2
    assert len({r["record_id"] for r in got}) == 5 and all(r["intact"] for r in got) and {r["payload_bytes"] for r in got} == {4, 0, 1_400_000}
    warc.write_arc(df.limit(0), f"{tmp_path}/none", 2)
    warc.write_warc(warc.read_arc(spark, f"{tmp_path}/none"), f"{tmp_path}/none_warc")
    assert warc.read_warc(spark, f"{tmp_path}/none_warc").count() == 0

    block = f"1 0 x\n{warc.FIELDS[1]}\n"
    good = "http://g 0.0.0.0 202401 text/plain 5\nhello\n"
    data = f"filedesc://x 0.0.0.0 20240102030405 text/plain {len(block)}\n{block}\nhttp://bad 0 0\nnoise\n{good}http://cut 0.0.0.0 20240102030405 text/plain 99999\nrest\n{good}"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0.arc").write_bytes(data.encode())
    found = warc.read_arc(spark, f"{tmp_path}/bad")
    assert [bytes(r["payload"]) for r in found.collect()] == [b"hello"] * 2 and warc.arc_faults(spark, f"{tmp_path}/bad").count() == 2
    warc.write_warc(found, f"{tmp_path}/bad_warc")
    assert {r["date"] for r in warc.read_warc(spark, f"{tmp_path}/bad_warc").collect()} == {"2024-01-01T00:00:00Z"}


def test_packing_against_brute_force():
    """Items in order go to the tightest open bin with room and neither their source nor their cluster, else to a new one."""
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randrange(1, 60)
        lengths = sorted((rng.randrange(1, 50) for _ in range(n)), reverse=True)
        sources, clusters = [rng.choice([-1, 0, 0, 1, 2]) for _ in range(n)], [rng.choice([-1, rng.randrange(9)]) for _ in range(n)]
        bins, known = [], []
        for size, s, c in zip(lengths, sources, clusters, strict=True):
            fits = [(50 - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + size <= 50 and all((x[1] != s or s < 0) and (x[2] != c or c < 0) for x in b)]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([])
            known.append((k, sum(x[0] for x in bins[k])))
            bins[k].append((size, s, c))
        assert packing.best_fit(lengths, sources, clusters, 50) == known


def test_packing_of_rows_without_ids_is_spread(spark):
    docs = table(spark, [(None, f"text {i}", "en", f"s{i % 7}") for i in range(400)])
    out = packing.packed(docs, capacity=100, group=50).collect()
    assert len(out) == 400 and len({r["bin_id"] >> 24 for r in out}) > 4


def test_long_white_space_is_counted_exactly(spark):
    tokens = token_counts.encoder(token_counts.read_ranks())
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b1", " ", "  ", "\n", "　", "\x85", "\x1c", "é", "'s", "!"]) for _ in range(rng.randrange(40)))
        assert token_counts.encoded(tokens, t, 2) == tokens.encode_ordinary(t)
    docs = table(spark, [(1, " " * 1_000_000), (2, "x" + "\n" * 700_000 + "y")])
    assert {r["doc_id"]: r["n_tokens"] > 1000 for r in token_counts.with_token_counts(docs).collect()} == {1: True, 2: True}


def test_shards_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(200), "é" * rng.randrange(60)) for _ in range(300)] + [(None, "x"), (None, None), (5, None)]
    sized = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows))
    total, at, known, slots = sum(r[3] for r in sized), 0, Counter(), Counter()
    for some, i, crc, size in sized:
        shard = at * 8 // total
        known[i if some else None, size, crc, shard, slots[shard]] += 1
        slots[shard] += 1
        at += size
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.sharded(table(spark, rows)).collect())
    assert got == known


def test_fingerprint_values_against_plain_python(spark):
    """Each value recomputed: occurrence-numbered 8-mers, the two least under a hash, their hashes mixed in text order."""
    m = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        return x ^ (x >> 31)

    def mark(text):
        if len(text) < 9:
            return None
        seen, marks = Counter(), []
        for k in range(len(text) - 7):
            gram = text[k : k + 8]
            value = 0
            for ch in gram:  # the doubling of blocks is a polynomial in the base
                value = (value * 0x9E3779B97F4A7C15 + ord(ch) + 1) & m
            n, value = seen[gram], mix(value)
            seen[gram] += 1
            marks.append(mix((value + n * 0xD6E8FEB86659FD93) & m))
        out = []
        for f, o in zip(fingerprints._FLIP.ravel().tolist(), fingerprints._ODD.ravel().tolist(), strict=True):
            least = sorted(range(len(marks)), key=lambda k: ((((marks[k] >> 32) ^ f) * o) & 0xFFFFFFFF, k))[: fingerprints.TUPLE]
            value = len(least)
            for k in sorted(least):
                value = mix((value * 0x94D049BB133111EB + marks[k]) & m)
            out.append(max(value >> 32, 1))
        return out

    texts = [" ".join(words(n, n)) for n in (12, 40, 90)] + ["abcdefgh" * 5]
    got = {r["doc_id"]: r for r in fingerprints.fingerprinted(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, other, onward = mark(t), mark(edited), mark(after)
        assert got[i]["fingerprint"] == np.array(own, "<u4").tobytes().hex() and got[i]["edited_fingerprint"] == np.array(other, "<u4").tobytes().hex()
        assert got[i]["near_edited"] == sum(a == b for a, b in zip(own, other, strict=True)) / 32 and got[i]["near_next"] == sum(a == b for a, b in zip(own, onward, strict=True)) / 32


def test_a_rule_that_contradicts_the_others_loses_its_say(spark):
    """Bad votes of one rule alone, on documents that all others find good, are kept; those that several find bad go."""
    rng = random.Random(7)

    def prose(seed):
        return [" ".join(words(12, 50 * seed + k)).capitalize() + "." for k in range(10)]

    clean = [(i, "\n".join(prose(i))) for i in range(150)]
    lines = [(1000 + i, "\n".join([p for p in prose(300 + i)] + ["- - -"] * 9)) for i in range(12)]
    junk = [(2000 + i, " ".join(f"{w} | {rng.choice('#$%')}{rng.randrange(9999999)}" for w in words(80, 900 + i))) for i in range(15)]
    docs = table(spark, [*clean, *lines, *junk])
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    assert all(got[i]["kept"] for i, _ in clean) and not any(got[i]["kept"] for i, _ in junk)
    assert all(100 * got[i]["n_dup_lines"] > 30 * got[i]["n_lines"] and got[i]["kept"] for i, _ in lines)
    assert {r["doc_id"] for r in quality_rules.passing(docs).collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.passing(docs.limit(0)).count() == 0
