"""Collocations, fill-in-middle and exact dedup against brute force, with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

SCHEMA = "doc_id long, text string, lang string, digest string, batch string, row long, phrase string, f long, n long, doc string, k long, kept string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with working names; rows of (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "d", "b", 1, "p", 2, 3, "d", 4, "k") for r in rows], SCHEMA)


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, max_words, least, share, top):
    count, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for g in range(1, max_words + 1):
                for i in range(len(w) - g + 1):
                    count[lang, tuple(w[i : i + g])] += 1
    many = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    made = {}
    for (lang, p), a in many.items():
        cuts = [(10**6 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= share * a for (l2, q), b in many.items())
        if not inside:
            made.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]], k))
    out = set()
    for lang, found in made.items():
        for rank, (s, a, p, l, r, k) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.add((lang, rank, p.decode(), -a, k, l, r, total[lang], -s))
    return out


def phrase_rows(rng):
    sets = ["new york city", "New York", "york city hall", "a b c d", "é ü", "the same the same"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 30)):
            words += rng.choice(sets).split() if rng.random() < 0.4 else [rng.choice("the of x y Z zz".split())]
            words[-1] += rng.choice(["", "", "", ".", "\n", "\t", ",", "\x0b", "\r\n"])
        rows.append((i, " ".join(words), rng.choice(["en", "de", None, "und"])))
    return [*rows, (None, None, "en"), (1, "", None), (2, " \t\n", "en"), rows[3], rows[3], (9, "x" * 30000 + " " + "the of " * 4000, "en")]


@pytest.mark.parametrize(("max_words", "share", "top"), [(3, 50, 2000), (4, 30, 2000), (2, 50, 7)])
def test_collocations_equal_brute_force(spark, max_words, share, top):
    from termgrid.llm.collocations import collocations

    rows = phrase_rows(random.Random(max_words))
    got = collocations(frame(spark, rows), max_words, 5, share, top)
    assert {tuple(r) for r in got.collect()} == plain_collocations(rows, max_words, 5, share, top)


def test_scores_are_exact_beyond_64_bits(spark):
    from termgrid.llm.collocations import scored_phrases

    a, first, rest = 10**13 - 7, 10**13, 10**13 - 1
    frequent = spark.createDataFrame([("en", "a", first), ("en", "b", rest), ("en", "a b", a)], "lang string, phrase string, f long")
    assert [r.score for r in scored_phrases(frequent).collect()] == [10**6 * a * a // (first * rest)]


def test_collocations_of_no_rows(spark):
    from termgrid.llm.collocations import collocations

    assert collocations(frame(spark, [(1, "a b", "en")])).count() == 0
    assert collocations(frame(spark, []).limit(0)).count() == 0


def test_lookup_is_the_join_with_hot_and_rare_keys(spark):
    from termgrid.llm.common import lookup

    rows = spark.createDataFrame([(k, i) for i in range(3000) for k in ([0] if i % 3 else [i])], "k long, v long")
    keyed = spark.createDataFrame([(k, -k) for k in range(0, 3000, 2)], "k long, x long")
    for heads in (1, 3, 1000):
        got = Counter(tuple(r) for r in lookup(rows, keyed, ["k"], heads).select("k", "v", "x").collect())
        assert got == Counter(tuple(r) for r in rows.join(keyed, "k").select("k", "v", "x").collect())


# ---------------------------------------------------------------- fill in middle


def plain_fim(doc, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:i], text[i:j], text[j:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}"


FIM = [(i, "é<P" * (i % 5) + "a😀\n" * (i % 50) + "<M" + "ü" * (i % 3)) for i in range(300)]
FIM += [(None, "no id"), (None, None), (7, None), (8, ""), (9, "has <P> in it"), (10, "<<S>>"), (11, "<M>"), (12, "x" * 100_000 + "é" * 50_000), (12, "again"), (12, "again"), (13, "a\u0000b")]


def test_fill_in_middle_equals_plain_slicing(spark):
    from pyspark.sql import functions as F

    from termgrid.llm.fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(frame(spark, FIM)).withColumn("back", restored(F.col("form"), F.col("output")))
    rows = made.collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(plain_fim(i, t) for i, t in FIM)
    assert Counter((r.doc_id, r.back) for r in rows) == Counter((i, t or "") for i, t in FIM)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_are_restored_and_cut_at_their_edges(spark, unit):
    from pyspark.sql import functions as F

    from termgrid.llm.fill_in_middle import fill_in_middle, restored, unit_starts

    assert [i for i in range(9) if unit_starts(b"ab c\n\nd e", unit) >> i & 1] == ([0, 3, 6, 8] if unit == "word" else [0, 5, 6])
    made = fill_in_middle(frame(spark, FIM), rate=100, unit=unit).withColumn("back", restored(F.col("form"), F.col("output")))
    assert Counter((r.doc_id, r.back) for r in made.collect()) == Counter((i, t or "") for i, t in FIM)


def test_bits_are_selected_by_rank():
    from termgrid.llm.fill_in_middle import holds, select_bit

    rng = random.Random(2)
    for size in (1, 63, 64, 65, 1000, 20_000):
        at = sorted(rng.sample(range(size), max(1, size // 3)))
        bits = sum(1 << i for i in at)
        assert [select_bit(bits, k) for k in range(0, len(at), max(1, len(at) // 50))] == at[:: max(1, len(at) // 50)]
    assert holds(b"xx<P>", b"<P>") and holds(b"<P>", b"<P>") and not holds(b"<P <M >", b"<P>") and not holds(b"", b"<P>") and not holds(b"P><", b"<P>")


def test_overlapping_sentinels_and_unknown_units_are_refused(spark):
    from termgrid.llm.fill_in_middle import fill_in_middle

    for marks in (("<P>", "<P>x", "<M>"), ("<P>", "><S", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError, match="overlap"):
            fill_in_middle(frame(spark, FIM), marks=marks)
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle(frame(spark, FIM), unit="page")


# ---------------------------------------------------------------- exact dedup


def dedup_rows():
    rng = random.Random(4)
    out = []
    for i in range(150):
        t = " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 4)))
        out.append((i * 7 % 150, rng.choice([t, t.replace(" ", ""), t + "\n", " " + t, t.replace(" ", "\t\x0b")])))
    out += [(None, "a b"), (None, "a b"), (None, None), (500, None), (500, ""), (501, "\r\n"), (502, "é😀"), (503, "é 😀"), (503, "é 😀"), (504, " "), (505, "q" * 50_000)]
    return out


def plain_groups(rows):
    """keep_id and size of each group and the number of its rows that stay, by normalised text."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[ \t-\r]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return {k: (None if min(g)[1] else min(g)[2], len(g), min(g)) for k, g in groups.items()}


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_exact_groups_equal_brute_force(spark, tmp_path, parts):
    from termgrid.llm.exact_dedup import DigestIndex, exact_groups

    rows = dedup_rows()
    index = DigestIndex(spark, f"{tmp_path}/index", 4)
    got = exact_groups(frame(spark, rows), index, "load", parts).collect()
    index.close()
    want = plain_groups(rows)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, hashlib.sha256(re.sub("[ \t-\r]", "", t or "").encode()).hexdigest()) for i, t in rows)
    assert all((r.keep_id, r.group_size) == sha[r.text_sha256][:2] for r in got)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(sha) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_index_outlives_the_session_and_takes_a_delivery_once(spark, tmp_path):
    from termgrid.llm.exact_dedup import DigestIndex, digested, new_documents

    path, rows = f"{tmp_path}/index", dedup_rows()
    first, second = rows[:90], rows[60:]
    index = DigestIndex(spark, path, 4)
    new = new_documents(frame(spark, first), index, "monday")
    assert new.columns == frame(spark, first).columns
    text = lambda t: re.sub("[ \t-\r]", "", t or "")
    assert Counter(text(r.text) for r in new.collect()) == Counter({text(t) for _, t in first})
    index.close()
    again = DigestIndex(spark, path, 99)
    assert again.buckets == 4
    later = new_documents(frame(spark, second), again, "tuesday")
    assert Counter(text(r.text) for r in later.collect()) == Counter({text(t) for _, t in second} - {text(t) for _, t in first})
    sizes = lambda: Counter(r.group_size for r in again.groups().collect())
    before = sizes()
    assert sum(k * v for k, v in before.items()) == len(first) + len(second)
    again.add(digested(frame(spark, second), "tuesday"))  # a load that is run once more
    assert sizes() == before
    plan = again.groups()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" in plan
    again.close()


def test_exact_groups_of_no_rows(spark, tmp_path):
    from termgrid.llm.exact_dedup import DigestIndex, exact_groups

    index = DigestIndex(spark, f"{tmp_path}/index", 2)
    assert exact_groups(frame(spark, []).limit(0), index, "none").count() == 0
    index.close()


def test_large_groups_are_met_by_broadcast_and_small_ones_by_bucket(spark, tmp_path, monkeypatch):
    from termgrid.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "HEADS", 5)
    rows = [(i, "hot") for i in range(100)] + [(1000 + i, f"cold {i % 40}") for i in range(100)]
    index = exact_dedup.DigestIndex(spark, f"{tmp_path}/index", 4)
    got = exact_dedup.exact_groups(frame(spark, rows), index, "load").collect()
    assert Counter(r.group_size for r in got) == Counter({100: 100, 3: 60, 2: 40})
    index.close()
