"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, further columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldtrace.llm import decontaminate, html_wrapper, line_quality, near_dedup, pseudo_likelihood, sentence_pieces, substring_dedup, token_files, url_rules, warc_zip

CLASHING = "block data n kept key label row salt host regs family lines hash size component_id n_words text_ part step item_id verdict".split()
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
DOCS = [(1, "a b c d e f g h i j k l m", "en", "s", 25), (2, None, "en", "s", 0), (3, "", None, "s", None), (4, " \n\t ", "en", None, 4), (5, LONG, "en", "s", len(LONG)),
        (1, "a b c d e f g h i j k l m", "en", "s", 25), (None, "null id has a text of some ten words or more here", "en", "s", 1), (None, None, None, None, None), (6, LONG, "en", "s", len(LONG))]


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    return clash(spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.com/en/", "<p>x</p>"), (2, None, None), (None, "http://a.com/", ""), (3, "", "<p>" + LONG), (1, "http://a.com/en/", "<p>x</p>")]
    return clash(spark.createDataFrame(rows, "page_id long, url string, html string"))


def benchmark(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j k l m"), (2, None), (None, "x"), (3, "")], "item_id long, text string")


def lm(docs):
    rows = pseudo_likelihood.tokenised(docs, pseudo_likelihood.vocabulary(docs))
    return pseudo_likelihood.score(rows, pseudo_likelihood.train(rows, rounds=1))


ON_DOCS = {"quality": line_quality.judge, "near": near_dedup.near_duplicates, "substring": substring_dedup.removed_words, "pieces": sentence_pieces.round_trip,
           "tokens": lambda d: token_files.read(token_files.write(d)), "lm": lm}
ON_PAGES = {"html": html_wrapper.extract, "warc": lambda p: warc_zip.read(warc_zip.write(p)), "urls": lambda p: url_rules.judge(p, url_rules.rule_table(p.sparkSession))}


@pytest.mark.parametrize("name", ON_DOCS)
def test_a_row_for_each_document(docs, name):
    got = [r["doc_id"] for r in ON_DOCS[name](docs).collect()]
    assert sorted(got, key=str) == sorted((r[0] for r in DOCS), key=str)


@pytest.mark.parametrize("name", ON_DOCS)
def test_no_documents(docs, name):
    assert ON_DOCS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ON_PAGES)
def test_pages(pages, name):
    assert sorted((r["page_id"] for r in ON_PAGES[name](pages).collect()), key=str) == [1, 1, 2, 3, None]
    assert ON_PAGES[name](pages.limit(0)).count() == 0


def test_leaks(spark, docs):
    assert [tuple(r)[:4] for r in decontaminate.leaks(docs, benchmark(spark)).collect()] == [(1, 1, 0, 13)] * 2
    assert decontaminate.leaks(docs, benchmark(spark).limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), benchmark(spark)).count() == 0


def test_defined_results(docs):
    near = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert near[6]["component_id"] == 5 and not near[6]["kept"] and near[2]["n_shingles"] == 0 and near[2]["kept"] and near[None]["component_id"] is None
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.removed_words(docs).collect()}
    assert removed[6] == removed[6] > 59_000 and removed[5] == 0 and removed[2] == 0
    quality = {r["doc_id"]: r for r in line_quality.judge(docs).collect()}
    assert quality[1]["kept"] and not quality[2]["kept"] and not quality[5]["kept"] and quality[3]["n_words"] == 0


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stage_cases(spark, sf_dir, docs, name):
    got = STAGES[name](spark, docs, sf_dir)
    if name != "sentence_pieces":
        assert got.columns == docs.columns
    assert STAGES[name](spark, docs.limit(0), sf_dir).count() == 0
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    want = {"quality": [1, 1, None, None], "near_dedup": [1, 1, 2, 3, 4, 5, None, None]}.get(name, [1, 1, 2, 3, 4, 5, 6, None, None])
    assert ids == want


def test_pipeline_keeps_what_is_clean(spark, tmp_path):
    import random

    rng = random.Random(41)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage, item = text(70), text(30)
    rows = [(i, text(200), "en", "s", 0) for i in range(20)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, rows[4][1] + " more", "en", "s", 0), (102, text(80) + " " + passage, "en", "s", 0), (103, passage + " " + text(80), "en", "s", 0),
             (104, text(50) + " " + item + " " + text(50), "en", "s", 0), (105, "too short", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [*range(20), 102, 103] and all(r["exact"] for r in out.values())
    assert len(out[103]["ids"]) < len(out[102]["ids"])
