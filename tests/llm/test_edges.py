"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000)) + " " + "a" * 40_000 + " " + "7" * 30_000 + " " + "1 " * 5_000
ROWS = [
    (0, "The quick brown fox jumps over the lazy dog near the old river bank today and again tomorrow", "en"), (0, "The quick brown fox jumps over the lazy dog near the old river bank today and again tomorrow", "en"),
    (1, None, "en"), (2, "", None), (3, " \n\t ", "de"), (4, "one", "en"), (5, "!!! ...", "en"), (6, LONG, "en"), (7, LONG, "en"), (8, "one", None),
    (None, "no id at all, but mail me@here.example.org", "en"), (9, "mail me@here.example.org or +1 (234) 555-7777, 10.0.0.1, 4111-1111-1111-1111", "en"),
]


@pytest.fixture
def docs(spark):
    rows = [(*r, "s", 1, 0.5, [1], 0, "x") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, starts array<int>, fp long, bucket string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old river"), (2, None), (3, ""), (4, "one"), (4, "one")], "item_id long, text string")


def both(docs, run, expected=len(ROWS)):
    got = run(docs).collect()
    assert len(got) == expected
    assert run(docs.limit(0)).collect() == []
    return got


def test_pages(spark):
    from skyweave.llm.pages import extract_main_text

    pages = spark.createDataFrame([(1, None, None, 0), (2, "http://a.b/c", "", 0), (3, "x", "<p>a<p>b", 0), (3, "x", "<p>a<p>b", 0), (None, "http://a.b", "<article>" + "<b>x " * 20000, 0)], "page_id long, url string, html string, text long")
    got = both(pages, extract_main_text, 5)
    assert sorted(r.text[:5] for r in got) == ["", "", "a b", "a b", "x x x"] and all(r.n_chars == len(r.text) for r in got)


def test_substring(docs):
    from skyweave.llm.substring import substring_dedup

    got = {r.doc_id: r for r in both(docs, substring_dedup)}
    assert got[7].n_removed == got[7].n_words > 0 and got[6].n_removed == got[0].n_removed == got[1].n_words == 0
    assert got[None].n_removed == 0 and got[7].kept_text == ""


def test_leaks(docs, items, spark):
    from skyweave.llm.decontaminate import clean_documents, leaks

    got = leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (4, 4), (8, 4)}
    assert leaks(docs.limit(0), items).collect() == leaks(docs, items.limit(0)).collect() == []
    clean = clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 4


def test_private_data(docs):
    from skyweave.llm.privacy import privacy_report, sanitised

    got = {r.doc_id: r for r in both(docs, privacy_report)}
    assert (got[9].n_email, got[9].n_ip, got[9].n_card, got[9].n_phone) == (1, 1, 1, 1) and got[1].spans == got[6].spans == ""
    clean = sanitised(docs)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and texts[9] == "mail [email] or [phone], [ip], [card]" and texts[1] is None and texts[6] == LONG


def test_packing(docs):
    from skyweave.llm.packing import pack_documents

    got = pack_documents(docs).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS} and pack_documents(docs.limit(0)).collect() == []
    assert sum(r.length for r in got if r.doc_id == 1) == 1


def test_quality(docs, labels):
    from skyweave.llm.quality import passing_documents, quality_rules

    got = {r.doc_id: r for r in both(docs, lambda d: quality_rules(d, labels))}
    assert got[1].n_words == got[3].n_words == 0 and got[3].base_failed and got[6].n_words > 60_000
    assert passing_documents(docs, labels).columns == docs.columns
    assert quality_rules(docs, labels.limit(0)).count() == len(ROWS)


def test_toxicity(docs, labels):
    from skyweave.llm.toxicity import score_toxicity

    got = both(docs, lambda d: score_toxicity(d, labels))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.score == 0 for r in score_toxicity(docs, labels.limit(0)).collect())


def test_language(docs):
    from skyweave.llm.language import identify_languages

    got = {r.doc_id: r for r in both(docs, identify_languages)}
    assert all(got[k].lang_pred == "und" for k in (1, 2, 3, 5)) and got[0].lang_pred == "en"


def test_language_model(docs):
    from skyweave.llm.ctw import score_documents

    got = {r.doc_id: r for r in both(docs, score_documents)}
    assert got[1].n_tokens == 1 and got[1].score < 0 and got[6].n_tokens > 60_000


def test_simhash(docs, spark):
    from skyweave.llm.simhash import near_duplicates, simhash_components, without_copies

    got = {r.doc_id: r for r in both(docs, simhash_components)}
    assert got[1].component_id == got[2].component_id == got[3].component_id == 1 and got[1].fp == 0 and got[7].component_id == 6
    assert {r.doc_id: r.component_id for r in both(docs, near_duplicates)}[8] == 4
    left = without_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [0, 0, 1, 4, 5, 6, 9]


def test_resampling(docs, items):
    from skyweave.llm.resample import importance_resample, resampled

    rows = both(docs, lambda d: importance_resample(d, items, min_words=1, share=50))
    got = sorted((r for r in rows if r.rank), key=lambda r: r.rank)
    long = [r for r in rows if r.n_features >= 1]
    assert [r.rank for r in got] == list(range(1, len(long) // 2 + 1)) and all(r.weight == 0 for r in rows if not r.n_features)
    assert [r.score for r in got] == sorted((r.score for r in long), reverse=True)[: len(got)]
    assert importance_resample(docs, items.limit(0)).count() == len(ROWS) and resampled(docs, items, min_words=1).columns == docs.columns


def test_hard_negatives(spark):
    from skyweave.llm.negatives import hard_negatives

    nan = float("nan")
    rows = [(0, [0.5, 0.25], 1), (1, [0.5, 0.2], 1), (2, [0.4, 0.3], 2), (2, [0.4, 0.3], 2), (3, None, 1), (4, [0.5, None], 1), (5, [0.5, nan], 2), (6, [0.5, float("inf")], 2), (None, [0.5, 0.5], 2), (8, [0.5, 0.5], None), (9, [], 2), (10, [0.5], 2)]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, label int, score long, rid string")
    got = sorted(tuple(r) for r in hard_negatives(frame, every=100, shift_every=0).collect())
    # 128 * 128 + 64 * 51 = 19648 for the positive; rows 2: 128 * 102 + 64 * 76 = 17920, row 10: 16384
    assert got == [(0, 1, 1, 2, 19648, 17920), (0, 1, 2, 2, 19648, 17920), (0, 1, 3, 10, 19648, 16384)]
    assert hard_negatives(frame.limit(0)).collect() == [] and hard_negatives(frame.where("vec_id > 100")).columns == hard_negatives(frame).columns


def test_jaccard_join(docs):
    from skyweave.llm.jaccard import jaccard_components

    got = {r.doc_id: r for r in both(docs, jaccard_components)}
    assert (got[1].n_shingles, got[1].component_id, got[2].component_id, got[3].component_id) == (0, 1, 2, 3)
    assert got[8].component_id == 4 and got[8].n_shingles == 1 and got[7].component_id == 6 and got[None].n_shingles == 3


@pytest.mark.parametrize("text", ["a" + " " * 30_000 + "b c", "\n" * 25_000, "x" + "　 \t" * 9_000 + "'s", " " * 10_001 + "1", "z" * 30_000 + " " * 20_000, "end " + " " * 9_999 + "\x1c" * 20_000 + "."])
def test_long_space_gives_the_ids_of_tokenizers(text):
    import public_tokenizers
    import tokenizers

    from skyweave.llm.packing import document_encoder

    assert document_encoder()(text) == tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_packing_of_millions_of_one_character(spark):
    from skyweave.llm.packing import document_encoder, pack_documents

    texts = [" " * 2_000_000, "a" + " " * 3_000_000 + "b", "\n" * 2_000_000, "q" * 2_000_000, " " * 10_000_000, "\r\n" * 1_000_000, "-" * 2_000_000, "9" * 1_000_000]
    got = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    totals = {r.doc_id: (r.n, r.total) for r in got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "n", "total").collect()}
    assert all(n == total > 1000 for n, total in totals.values()) and len(totals) == len(texts)
    assert totals[0][1] == len(document_encoder()(texts[0])) + 1
