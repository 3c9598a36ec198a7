"""The pipeline's stages one after the other, on documents with planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    parts = {"en": ["tion", "the", "ing", "re"], "fr": ["eux", "que", "oi", "la"]}

    def prose(lang, n, seed):
        r = random.Random(seed)
        return ". ".join(" ".join("".join(r.choices(parts[lang], k=3)) + str(r.randrange(50)) * 0 for _ in range(11)) for _ in range(n)) + "."

    rows = [(i, prose(lang, 12, i), lang, f"s{i % 4}") for i, lang in enumerate(rng.choices(["en", "fr"], k=60))]
    rows += [(100, rows[3][1], "en", "s1"), (101, None, "en", "s1"), (102, "!!! 123", "en", "s1"), (103, rows[5][1] + " " + prose("en", 14, 777), "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "sf").mkdir()
    docs.coalesce(1).write.parquet(f"{tmp_path}/sf/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"{tmp_path}/sf")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert name != "language" or ids == set(range(60)) | {100, 103}
            assert name != "near_duplicates" or 100 not in ids
    assert set(range(60)) <= {r["doc_id"] for r in out.collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == out.count()


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, text_key string, row string, kept boolean, component_id long, vote_marks int, group int"


def _prose(n, seed):
    rng = random.Random(seed)
    return ". ".join(" ".join("".join(rng.choices(["tion", "the", "ing", "re", "al"], k=3)) for _ in range(11)) for _ in range(n)) + "."


def _awkward(spark):
    long = _prose(900, 1)
    rows = [
        (1, _prose(12, 2)), (1, _prose(12, 2)), (1, _prose(12, 3)), (2, _prose(12, 2)), (3, None), (4, ""), (5, " \n "), (6, long), (7, _prose(9, 4) + " " + long[:9000]),
        (None, _prose(12, 5)), (None, None), (8, "one"), (9, _prose(12, 6)), (10, _prose(12, 7)), (11, _prose(12, 8)),
    ]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", "key", "r", True, 5, 3, 4) for i, t in rows], CLASHING)


def test_stages_on_awkward_rows(spark):
    docs = _awkward(spark)
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0, name
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        assert {(r["kept_text"], r["text_key"], r["row"], r["kept"], r["component_id"], r["vote_marks"], r["group"]) for r in rows} == {("own", "key", "r", True, 5, 3, 4)}, name
        if name != "passages":
            assert {(r["doc_id"], r["text"]) for r in rows} <= texts
        if name == "language":
            assert len(rows) == 11 and not {3, 4, 5} & set(ids)
        if name == "quality":
            assert sorted(i for i in ids if i) == [1, 1, 1, 2, 6, 7, 9, 10, 11] and ids.count(None) == 1
        if name == "near_duplicates":
            # 2 copies one of 1's texts; 1 keeps both of its texts, once each
            assert ids.count(1) == 2 and 2 not in ids and ids.count(None) == 2
        if name == "passages":
            assert len(rows) == docs.count() and all(r["n_chars"] == len(r["text"] or "") for r in rows)
            cut = {r["doc_id"]: r["text"] for r in rows}
            assert cut[2] == "" and len(cut[7]) < 2000 and len(cut[6]) > 9000
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in texts} and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_no_labelled_row_leaves_all(spark):
    docs = _awkward(spark).selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    assert corpus_pipeline.language(spark, docs, "").count() == docs.count()
