"""Language ID, quality, packing, tokens, nearest neighbours, the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_language_of_held_out_texts(spark):
    from termgrid.llm.langid import op2_language_id

    truth = {r.doc_id: (r.lang, r.text) for r in table(spark, "documents").collect()}
    got = op2_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id][0] == r.lang_pred for r in held) >= 0.97 * len(held) > 20


def test_language_edges(spark):
    from termgrid.llm.langid import fit_languages, identify

    train = spark.createDataFrame([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), (None, "en"), ("text", None)], "text string, lang string")
    asked = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "the dog", "x"), (5, "und der hund", "x"), (6, "Ω≈ç" * 20000, "x"), (7, "z", "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in identify(asked, fit_languages(train)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert got[6].lang_rejected and got[1].lang_score == 0 and got[7].lang_pred in ("en", "de")


def test_kneser_ney_is_that_of_dictionaries():
    from collections import Counter

    from termgrid.llm.langid import keys_of, kneser_ney

    texts = ["abracadabra alakazam", "banana  bandana!", "ab", "3 cab 7 a", "42", "", " ana cada "]

    def grams(text):
        t = re.sub(r"[^a-z]+", " ", text).lstrip(" ")
        s = "   " + t + ("" if t.endswith(" ") else " ")
        return [s[i - 3 : i + 1] for i in range(3, len(s))] if re.search("[a-z]", t) else []

    tables = {4: Counter(g for t in texts for g in grams(t))}
    letters = {g[-1] for g in tables[4]}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def p(g):
        if not g:
            return 1 / (len(letters) + 1)
        table = tables[len(g)]
        one, two = (sum(c == k for c in table.values()) for k in (1, 2))
        d = min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5
        mine = {x: c for x, c in table.items() if x[:-1] == g[:-1]}
        if not mine:
            return p(g[1:])
        return max(mine.get(g, 0) - d, 0) / sum(mine.values()) + d * len(mine) / sum(mine.values()) * p(g[1:])

    got, n = keys_of(texts)
    assert [int(x) for x in n] == [len(grams(t)) for t in texts]
    keys, counts = np.unique(got, return_counts=True)
    model = kneser_ney(["x"], [keys], [counts.astype(float)])
    asked = [a + b + c + d for a in "ab z" for b in "na q" for c in "an z" for d in "abnz "]
    code = lambda g: sum(ord(ch) << 16 * (3 - i) for i, ch in enumerate(g))
    share = model.share(np.array([code(g) for g in asked], dtype=np.uint64), 4)[:, 0]
    assert share == pytest.approx([p(g) for g in asked], abs=1e-6)
    total = model.share(np.array([code("aba" + c) for c in sorted(letters)], dtype=np.uint64), 4).sum()
    assert total + p("aba#") == pytest.approx(1, abs=1e-6)


def test_few_texts_of_a_known_language_are_rejected(spark):
    from termgrid.llm.common import held_out
    from termgrid.llm.langid import PASS, fit_languages, identify

    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    found = identify(docs.filter(held_out()), fit_languages(docs.filter(~held_out())))
    r = found.filter("lang_pred = lang").selectExpr("count(*) as n", "avg(cast(lang_rejected as double)) as share").first()
    assert r.n > 1000 and r.share <= 3 * (1 - PASS)


def test_quality_of_held_out_texts(spark):
    from termgrid.llm.quality import op9_quality

    sf = SF.replace("0.001", "0.01")  # the smallest tables hold 64 labels to learn from
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op9_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 50


def test_quality_scores_are_those_of_dictionaries(spark):
    """Features by name, ratios, dual descent and the curve in plain Python, on a few hundred rows."""
    from termgrid.llm.quality import _COST, _EPOCHS, fit_quality, platt, score_quality

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").filter("length(text) < 1500").collect()]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()}

    def named(text):
        w = [x.encode() for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        shape, coarse, out = [], [], set()
        for i, x in enumerate(w):
            up, low, digit, wide = (sum(a <= c <= b for c in x) for a, b in ((65, 90), (97, 122), (48, 57), (128, 255)))
            last = x[-1] if x[-1] < 128 and not chr(x[-1]).isalnum() else 0
            again = (i > 0 and w[i - 1] == x, i > 1 and w[i - 2] == x)
            flags = (up > 0, up > 1 and not low, digit > 0, digit == len(x), up + low + digit + wide == 0, again, last)
            shape.append((*flags, min(len(x), 12)))
            coarse.append(flags)
        for name, units, longest in (("w", w, 2), ("s", shape, 1), ("c", coarse, 3)):
            for k in range(1, longest + 1):
                out |= {(name, k, *units[i : i + k]) for i in range(len(units) - k + 1)}
        return out

    texts = dict(docs)
    known = sorted(i for i in label if i in texts and zlib.crc32(str(i).encode()) % 4 != 2)
    feats, y = [sorted(named(texts[i]), key=str) for i in known], [1 if label[i] else -1 for i in known]
    vocabulary = {f for x in feats for f in x}

    def fit(chosen):
        count = {c: dict.fromkeys(vocabulary, 1.0) for c in (1, -1)}
        for i in chosen:
            for f in feats[i]:
                count[y[i]][f] += 1
        size = {c: sum(v.values()) + (1 << 22) - len(vocabulary) for c, v in count.items()}
        ratio = {f: math.log(count[1][f] / size[1]) - math.log(count[-1][f] / size[-1]) for f in vocabulary}
        rng, w, bias, a = np.random.default_rng(0), dict.fromkeys(vocabulary, 0.0), 0.0, [0.0] * len(chosen)
        x = []
        for i in chosen:
            norm = max(math.sqrt(sum(ratio[f] ** 2 for f in feats[i])), 1e-12)
            x.append([(f, ratio[f] / norm) for f in feats[i]])
        for _ in range(_EPOCHS):
            for j in rng.permutation(len(chosen)):
                g = y[chosen[j]] * (sum(w[f] * v for f, v in x[j]) + bias) - 1
                new = min(max(a[j] - g / (sum(v * v for _, v in x[j]) + 1), 0.0), _COST)
                for f, v in x[j]:
                    w[f] += (new - a[j]) * y[chosen[j]] * v
                bias += (new - a[j]) * y[chosen[j]]
                a[j] = new
        return ratio, w, bias

    def margin(model, names):
        ratio, w, bias = model
        names = [f for f in names if f in vocabulary]
        return sum(ratio[f] * w[f] for f in names) / max(math.sqrt(sum(ratio[f] ** 2 for f in names)), 1e-6) + bias

    part, tried = [i for i in range(len(y)) if i % 5], list(range(0, len(y), 5))
    first = fit(part)
    slope, shift = platt(np.array([margin(first, feats[i]) for i in tried]), np.array([y[i] for i in tried]))
    final = fit(list(range(len(y))))
    asked = spark.createDataFrame(docs[:200] + [(-1, None)], "doc_id long, text string")
    model = fit_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(label.items()), "doc_id long, quality int"), bits=22)
    got = {r.doc_id: r.quality_score for r in score_quality(asked, model).collect()}
    # unseen features weigh nothing in the margin but do have a ratio, that of the classes' sizes
    want = {i: 1 / (1 + math.exp(-(slope * margin(final, named(t)) + shift))) for i, t in docs[:200] if named(t) <= vocabulary}
    assert len(want) > 50 and max(abs(got[i] - want[i]) for i in want) < 0.03


def test_bytes_of_the_quality_fit_are_bounded(spark):
    from termgrid.llm import quality

    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(200))) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    seen = []
    learn = quality.learn
    quality.learn = lambda rows, y, bits: seen.append(sum(map(len, rows))) or learn(rows, y, bits)
    try:
        quality.fit_quality(docs, labels, fit_features=5000)
    finally:
        quality.learn = learn
    assert 2000 < seen[0] <= 5000


def test_hinge_loss_optimum():
    from termgrid.llm.quality import dual_coordinate_descent

    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(10, 4, replace=False)) for _ in range(40)]
    y = np.array([1.0 if 0 in r or 3 in r else -1.0 for r in rows])
    w = dual_coordinate_descent(rows, np.ones(10), y, 1.0, 200, 10)

    def loss(v):
        return v @ v / 2 + sum(max(0.0, 1 - t * (v[r].sum() / 2 + v[-1])) for r, t in zip(rows, y))

    assert all(loss(w) <= loss(w + rng.normal(size=11) * s) + 1e-3 for s in (0.01, 0.1, 1) for _ in range(50))


def test_tokens_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    from termgrid.llm.packing import tokenizer_path
    from termgrid.llm.tokens import words_for

    rng, letters = random.Random(2), list("ab's'tre ll vd mé1٣Σ😀!\n.İ")
    texts = ["", " ", "It's they're I'LL 's ''s don''t", "é ﬁ Σας", "<|endoftext|> hi", "x\x85y", "'"] + ["".join(rng.choice(letters) for _ in range(60)) for _ in range(200)]
    whole = Tokenizer.from_file(tokenizer_path())
    assert [x.tolist() for x in words_for(tokenizer_path()).ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizer_files_are_used_as_they_are():
    from tokenizers import Tokenizer

    from termgrid.llm.packing import tokenizer_path
    from termgrid.llm.tokens import Words

    path = tokenizer_path("byte_bpe_50k.json")
    texts, whole = ["It's 42 ways,\n  Σ é!", "", "plain words"], Tokenizer.from_file(path)
    words = Words(path)
    assert not words.by_words and [x.tolist() for x in words.ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_genetic_search_saves_sequences():
    """Lengths where best fit alone misses the bound: triples of a third each, made by cutting full sequences."""
    from termgrid.llm.packing import best_fit, evolve

    rng, length = random.Random(5), []
    for _ in range(120):
        a = rng.randrange(260, 480)
        b = rng.randrange(260, 1000 - a - 230)
        length += [a, b, 1000 - a - b]
    plain: list[list[int]] = []
    best_fit(list(range(len(length))), length, plain, 1000)
    found = evolve(length, 1000, [], 60, 6, random.Random(1))
    assert sorted(i for b in found for i in b) == list(range(len(length)))
    assert 120 <= len(found) < len(plain)


def test_lengths_that_fill_no_sequence_well(spark):
    from termgrid.llm import packing

    rows = [(k, 1800 if k % 2 else 2200) for k in range(9000)]
    got = packing.pack(spark.createDataFrame(rows, "pid long, length long"), 4096).toPandas()
    assert len(got) == got.pid.nunique() == 9000 and got.sequence_id.nunique() <= 4500 + 3


def test_packing_holds_every_piece_once(spark):
    from termgrid.llm.packing import pack_documents, token_pieces, tokenizer_path

    rng = random.Random(4)
    rows = [(k, " ".join("abc" for _ in range(rng.randrange(1, 90)))) for k in range(300)] + [(900, "abc " * 1000), (901, None), (902, ""), (5, "abc"), (5, "abc"), (None, "abc")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pid long, length long")
    got = pack_documents(docs, capacity=128).toPandas()
    parts = token_pieces(docs, tokenizer_path(), 128, with_ids=True).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, got[key].fillna(-1).values.tolist())) == sorted(map(str, parts[key].fillna(-1).values.tolist()))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 128
    assert got.sequence_id.nunique() <= 1.02 * math.ceil(got.length.sum() / 128) + 1
    long = parts[parts.doc_id == 900]
    assert (long.sort_values("piece").length[:-1] == 128).all() and long.length.sum() == 1001
    assert all(zlib.crc32(np.array(i, dtype="<u4")) == c for i, c in zip(parts.ids, parts.ids_crc32))


def test_crossover_keeps_all_items():
    from termgrid.llm.packing import best_fit, crossover, evolve

    rng = random.Random(0)
    length = [rng.randrange(1, 60) for _ in range(300)]
    people = []
    for _ in range(2):
        bins: list[list[int]] = []
        order = list(range(300))
        rng.shuffle(order)
        best_fit(order[:150], length, bins, 100)
        best_fit(order[150:], length, bins, 100)
        people.append(bins)
    child = crossover(*people, length, 100, rng)
    assert sorted(i for b in child for i in b) == list(range(300)) and all(sum(length[i] for i in b) <= 100 for b in child)
    assert len(evolve(length, 100, people, 6, 4, rng)) <= min(map(len, people))


def test_neighbours_against_brute_force(spark):
    from termgrid.llm.ann import op1_multi_index_hashing

    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in table(spark, "embeddings").collect()}
    got: dict = {}
    for r in op1_multi_index_hashing(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    assert set(got) == {k for k in v if k % 20 == 0}
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and all(s == pytest.approx(float(v[q] @ v[i])) for _, i, s in rows)
        assert [r[1:] for r in rows] == sorted((r[1:] for r in rows), key=lambda x: (-x[1], x[0]))
        best = sorted((k for k in v if k != q), key=lambda k: (-float(v[q] @ v[k]), k))[:20]
        hit += len(set(best) & {r[1] for r in rows})
    assert hit >= 0.9 * 20 * len(got)


def test_probing_finds_every_code_in_the_radius():
    from termgrid.llm.ann import indexed, probe

    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (400, 8), dtype=np.uint16)
    codes[1] = codes[0]
    codes[2, 3] = codes[0, 3] ^ 5
    for k in range(20):  # some near ones, differing in 3 * k bits
        flip = np.zeros(128, dtype=np.uint8)
        flip[rng.choice(128, 3 * k, replace=False)] = 1
        codes[10 + k] = codes[0] ^ np.packbits(flip).view(np.uint16)
    for radius in (0, 2, 13, 20, 50, 127, 128):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[0]).sum(axis=1, dtype=int) <= radius)
        assert (probe(codes, codes[0], indexed(codes), radius) == want).all() and len(want) > 1


def test_probes_touch_few_rows_where_vectors_have_neighbours():
    """Vectors in groups: the index reads a small share of the rows and finds nine tenths of the true neighbours."""
    from termgrid.llm.ann import indexed, learn_codes, probe, probed

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(400, 64))
    x = centres[rng.integers(0, 400, 20000)] + rng.normal(size=(20000, 64)) * 0.35
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = learn_codes(x[:4000], neighbours=4)  # a fifth of the rows, so a fifth of 20
    codes = model.encode(x)
    index, touched, hit = indexed(codes), 0, 0
    for q in range(0, 20000, 400):
        touched += len(probed(codes[q], index, len(codes), model.radius))
        rows = probe(codes, codes[q], index, model.radius)
        best = np.argsort(-(x @ x[q]))[1:21]
        hit += len(set(best) & set(rows[np.argsort(-(x[rows] @ x[q]))][:21]))
    assert touched <= 0.2 * 50 * len(x) and hit >= 0.9 * 20 * 50


def test_several_shards_and_wider_radii(spark, monkeypatch):
    from termgrid.llm import ann

    monkeypatch.setattr(ann, "SHARD", 90)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = -v[:300].mean(axis=0) * 50  # far from all: nothing lies in its radius
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(df, df.filter("vec_id % 7 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 300, 7)) and all(sorted(x)[-1][0] == 5 and len(x) == 5 for x in got.values())


def test_neighbours_edges(spark):
    from termgrid.llm.ann import search

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, id string, score string")
    got = sorted(tuple(r) for r in search(df, df, k=20).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.5), (2, 1, 1, 1.0), (2, 2, 3, 0.5), (3, 1, 1, 0.5), (3, 2, 2, 0.5)]
    assert search(df.filter("vec_id = 4"), df).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from termgrid.llm.common import materialize
    from termgrid.llm.decontam import contaminated

    docs, before = table(spark, "documents"), None
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SF), "test")
        assert docs.dtypes == before.dtypes, name
        ids, old = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= old and len(ids) > 0.7 * len(old), name
        if name == "decontamination":
            gone = {r.doc_id for r in contaminated(before, table(spark, "benchmark")).collect()}
            assert old - ids == gone
        if name == "near duplicates":
            from termgrid.llm.ngram_join import near_duplicates

            found = near_duplicates(before).collect()
            assert ids == {r.class_id for r in found}
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_entry_registers_one_query_for_each_operator():
    import __spark_entry__ as e

    names = e.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_language_models_keep_every_n_gram(spark):
    from termgrid.llm.langid import TableModel, fit_languages, identify

    rng = random.Random(8)
    big = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(40)]
    rows = [(t, "big") for t in big] + [("qrst uvwx yzqr", "few"), ("12 34", "none"), (None, "big"), ("text", None)]
    train = spark.createDataFrame(rows, "text string, lang string")
    asked = spark.createDataFrame([(k, t) for k, t in enumerate([*big, "qrst uvwx", "uvwx yzqr", "zzz kkk", "", "42", None, "Ω≈ç" * 2000])] + [(1, big[1])], "doc_id long, text string")
    small, tables = fit_languages(train), fit_languages(train, max_grams=100)
    assert isinstance(tables, TableModel) and tables.languages == small.languages == ["big", "few"]
    assert tables.mean == pytest.approx(small.mean, abs=1e-6) and tables.pass_mark == pytest.approx(small.pass_mark, abs=1e-5)
    key = lambda r: (r.doc_id, r.lang_pred)
    want, got = (sorted(identify(asked, m).collect(), key=key) for m in (small, tables))
    assert len(got) == len(want) == 48
    for a, b in zip(got, want):
        assert (a.doc_id, a.text, a.lang_pred, a.lang_rejected) == (b.doc_id, b.text, b.lang_pred, b.lang_rejected)
        assert (a.lang_score, a.lang_entropy) == (pytest.approx(b.lang_score, abs=1e-4), pytest.approx(b.lang_entropy, abs=1e-5))
    assert {r.lang_pred for r in got if r.doc_id in (40, 41)} == {"few"}


def test_rejection_is_calibrated_on_every_training_row(spark):
    """5,000 rows, of which a sample of 4,000 would see other means and marks: each row tried on the other half's model."""
    from termgrid.llm.langid import PASS, fit_languages, keys_of, kneser_ney

    rng = random.Random(4)
    rows = [("".join(rng.choice(letters) for _ in range(rng.randint(3, 60))), lang) for lang, letters in (("one", "abcde "), ("two", "cdefgh ")) for _ in range(2500)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = fit_languages(df)
    half = [(r.text, r.lang, r.half) for r in df.select("text", "lang", F.pmod(F.xxhash64("text", "lang"), F.lit(2)).alias("half")).collect()]
    models = []
    for k in (0, 1):
        counted = [np.unique(keys_of([t for t, name, h in half if name == lang and h == k])[0], return_counts=True) for lang in got.languages]
        models.append(kneser_ney(got.languages, [a for a, _ in counted], [n.astype(float) for _, n in counted]))
        models[k].base = got.base
    for i, lang in enumerate(got.languages):
        tried = [models[1 - k].entropies([t for t, name, h in half if name == lang and h == k]) for k in (0, 1)]
        h, n = np.concatenate([h[:, i] for h, _ in tried]), np.concatenate([n for _, n in tried])
        h, n = h[n > 0], n[n > 0]
        mean = np.average(h, weights=n)
        assert got.mean[i] == pytest.approx(mean, abs=1e-9)
        assert got.pass_mark[i] == pytest.approx(np.quantile((h - mean) * np.sqrt(n), PASS), abs=1e-9)
