"""Clashing names, empty tables and the one rule of the rejection."""

from __future__ import annotations

import random

import pytest

CLASH = "doc_id long, text string, _m string, _g string, _l string, _s string, _row string, _gone string, _block long, _pii_text string, pii string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "m", "g", "l", "s", "r", "gone", 5, "t", "p") for i, t in rows], CLASH)


def test_pii_keeps_columns_of_any_name(spark):
    from termgrid.llm.pii import find_pii

    docs = clashing(spark, [(1, "mail to a.b@example.org now"), (2, None)])
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1].pii] == [("email", 8, 23)] and got[2].pii == []
    assert all((r._m, r._g, r._l, r._s, r._row, r._pii_text) == ("m", "g", "l", "s", "r", "t") for r in got.values())
    assert find_pii(docs.limit(0)).count() == 0


def test_decontamination_keeps_columns_of_any_name(spark):
    from termgrid.llm.decontam import without_contaminated

    item = " ".join(f"w{i}" for i in range(30))
    docs = clashing(spark, [(1, f"before {item} after"), (2, "clean words only here and there"), (None, "no id"), (3, None)])
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None, 3}
    assert without_contaminated(docs.limit(0), items).count() == 0 and without_contaminated(docs, items.limit(0)).count() == 4


@pytest.mark.parametrize("max_grams", [10, 2_000_000])
def test_languages_keep_columns_of_any_name(spark, max_grams):
    from termgrid.llm.langid import fit_languages, identify

    learn = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 8, "text string, lang string")
    model = fit_languages(learn, max_grams)
    docs = clashing(spark, [(1, "the dog"), (2, None)])
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "und" and {r._block for r in got.values()} == {5}
    assert identify(docs.limit(0), model).count() == 0
    none = fit_languages(learn.limit(0), max_grams)
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"}


@pytest.mark.parametrize("rows", [100, 1000])
def test_rejection_is_by_one_rule_at_every_size(spark, rows):
    from termgrid.llm.langid import fit_languages, identify

    rng = random.Random(rows)
    syllables = {"a": ["ba", "lo", "mi", "tan", "ru"], "b": ["sch", "ock", "end", "ung", "ei"]}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    learn = [(text("a", 30), "a") for _ in range(rows)] + [(text("b", 30), "b") for _ in range(300)]
    model = fit_languages(spark.createDataFrame(learn, "text string, lang string"))
    assert all(abs(m) < 50 for m in model.pass_mark)
    new = [(i, text("a", 30)) for i in range(300)] + [(1000 + i, "".join(rng.choice("xqzjvwyk") for _ in range(120))) for i in range(50)]
    got = identify(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    assert sum(r.lang_rejected for r in got if r.doc_id < 1000) <= 0.06 * 300
    assert all(r.lang_rejected for r in got if r.doc_id >= 1000)


def test_pipeline_stages_take_no_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, sf).count() == 0, name
