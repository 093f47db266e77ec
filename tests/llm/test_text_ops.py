"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, h string, n string, w string, pii string, gone string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with working names."""
    return spark.createDataFrame([(i, t, "h", "n", "w", "p", "g", "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, junk; ids out of order, one null id, one repeated row."""
    rng = random.Random(5)
    passage, out = words(rng, 30, 900), []
    for i in range(40):
        text = words(rng, rng.randrange(1, 80), 900)
        if i % 7 == 0:
            text += " " + passage + "\n" + words(rng, 5, 900)
        out.append((i, text.replace(" w1", "\nw1")))
    out += [(100, out[3][1]), (101, out[3][1] + " tail"), (50, out[5][1]), (51, None), (52, ""), (53, "   \n\t "), (54, "one"), (55, "é ü 😀  x"), (None, out[3][1]), (100, out[3][1])]
    out += [(60, "a b c\n" * 12), (61, "a b c\n" * 5 + "end"), (62, "x" * 30000), (63, words(rng, 20000, 900))]
    rng.shuffle(out)
    return out


def first_holders(rows, units, n):
    first = {}
    for i, t in rows:
        u = units(t)
        for s in range(len(u) - n + 1):
            key, at = tuple(u[s : s + n]), (float("inf") if i is None else i)
            first[key] = min(first.get(key, at), at)
    return first


def test_substring_dedup_is_exact(spark, rows):
    from termgrid.llm.substring_dedup import remove_repeated_words

    units = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first, want = first_holders(rows, units, 13), Counter()
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for s in range(len(u) - 12):
            if first[tuple(u[s : s + 13])] < (float("inf") if i is None else i):
                gone[s : s + 13] = [True] * 13
        want[i, len(u), sum(gone), " ".join(x for x, g in zip(u, gone) if not g)] += 1
    got = Counter(tuple(r) for r in remove_repeated_words(frame(spark, rows), bits=16).collect())
    assert got == want and sum(k[2] > 0 for k in want) > 3


def test_stretches_lose_windows_held_elsewhere(spark):
    """Passages cut at random between other words, so windows stand in several stretches; the ids' order is not the texts'."""
    from termgrid.llm.substring_dedup import remove_repeated_words

    rng = random.Random(31)
    passages = [words(rng, 60, 5000).split() for _ in range(4)]
    texts = []
    for _ in range(80):
        u = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(0, 45)
            u += words(rng, rng.randrange(0, 12), 5000).split() + rng.choice(passages)[a : a + rng.randrange(10, 40)]
        texts.append(" ".join(u))
    texts += ["again " * 3000, "again " * 40, "again " * 12]
    ids = rng.sample(range(1000), len(texts))
    rows, want = list(zip(ids, texts)), {}
    first = first_holders(rows, str.split, 13)
    for i, t in rows:
        u = t.split()
        gone = [False] * len(u)
        for k in range(len(u) - 12):
            if first[tuple(u[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[i] = (len(u), sum(gone), " ".join(x for x, g in zip(u, gone) if not g))
    for bits in (8, 16):  # full sets, then nearly empty ones
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeated_words(frame(spark, rows), bits=bits).collect()}
        assert got == want
    assert sum(0 < n < m for m, n, _ in want.values()) > 20


def test_line_dedup_keeps_the_first_run(spark, rows):
    from termgrid.llm.line_dedup import remove_repeated_lines

    units = lambda t: [x for x in (t or "").split("\n") if x]
    rng = random.Random(6)
    long, short = words(rng, 60, 900), words(rng, 30, 900)
    rows = rows + [(70, "a\n" + long), (71, long), (72, "b\n" + long + "\nc"), (73, short + "\n" + short), (74, short), (75, short + "\n" + short + "\nd"), (None, long), (None, "e\n" + long), (76, long + "\n" + long)]
    runs = lambda u: ((s, g) for g in (1, 2, 3) for s in range(len(u) - g + 1) if g == 3 or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in u[s : s + g]) >= 50)
    at = lambda i, s: (float("inf") if i is None else i, s)
    first = {}
    for i, t in rows:
        u = units(t)
        for s, g in runs(u):
            first[tuple(u[s : s + g])] = min(first.get(tuple(u[s : s + g]), at(i, s)), at(i, s))
    want = Counter()
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for s, g in runs(u):
            if first[tuple(u[s : s + g])] < at(i, s):
                gone[s : s + g] = [True] * g
        want[i, len(u), sum(gone), "\n".join(x for x, g in zip(u, gone) if not g) if any(gone) else t] += 1
    got = Counter(tuple(r) for r in remove_repeated_lines(frame(spark, rows), bits=16).collect())
    assert got == want and sum(k[2] > 0 for k in want) > 6


def shingle_set(t, n=5):
    w = (t or "").lower().encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_near_duplicates_match_all_pairs(spark, rows, monkeypatch):
    from termgrid.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 4)  # so that groups are cut into blocks
    rng = random.Random(9)
    base = words(rng, 120, 900).split()
    more = []
    for k in range(14):  # a group of different texts
        w = list(base)
        w[rng.randrange(120)] = f"z{k}"
        more.append((200 + k, " ".join(w)))
    all_rows = rows + more
    sets = [shingle_set(t) for _, t in all_rows]
    root, links = list(range(len(all_rows))), [0] * len(all_rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(all_rows):
        least.setdefault(find(k), []).append(i)
    want = Counter((i, min((x for x in least[find(k)] if x is not None), default=None), links[k]) for k, (i, _) in enumerate(all_rows))
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(frame(spark, all_rows)).collect())
    assert got == want and max(links) > 5
    docs, stay = frame(spark, all_rows), {}
    for k, (i, text) in enumerate(all_rows):  # one row of each class, whatever its id
        row = (i is None, i, text) if sets[k] else (k,)
        stay[find(k)] = min(stay.get(find(k), row), row)
    kept = [(r.doc_id, r.text) for r in ngram_join.without_near_duplicates(docs).collect()]
    assert Counter(kept) == Counter((v[1], v[2]) if len(v) > 1 else all_rows[v[0]] for v in stay.values())


def test_rows_of_equal_or_no_id_are_kept_apart(spark):
    from termgrid.llm.ngram_join import without_near_duplicates

    rng = random.Random(14)
    a, b, c = (words(rng, 60, 900) for _ in range(3))
    docs = frame(spark, [(1, a), (2, a + " x"), (2, b), (1, c), (None, b + " y"), (None, words(rng, 50, 900)), (None, ""), (2, None)])
    got = sorted(((r.doc_id, (r.text or "")[-9:]) for r in without_near_duplicates(docs).collect()), key=str)
    assert len(got) == 6 and Counter(i for i, _ in got) == {1: 2, 2: 2, None: 2}


def test_bands_reach_the_recall():
    from termgrid.llm.ngram_join import bands_for

    for s, recall, r in ((0.8, 0.999, 6), (0.5, 0.9, 3)):
        b = bands_for(s, recall, r)
        assert 1 - (1 - s**r) ** b >= recall > 1 - (1 - s**r) ** (b - 1)


def test_components(spark):
    from termgrid.llm.components import components

    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (301, 302), (302, 301)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x != 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pii_base_spans(spark):
    from termgrid.llm.pii import BASE, find_pii

    texts = [None, "", "mail a.b@c.de_x@y.z, ü😀 +49 (170) 555-0123 and 1.2.3.4.5.6.7.8 999.1.1.1 0000001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 49927398716", "+1 2 3 4 5 6 7 8 9 0) .. +12", "a" * 50000 + "@" + "b.c" * 9000, "1 " * 30000, "IBAN DE89 3704 0044 0532 0130 00 bank", "a@b.c " * 1500]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(int(c) for c in reversed(d))) % 10 == 0

    def base(t):
        out = []
        for k, kind in enumerate(BASE):
            for m in re.finditer(patterns[kind], t or ""):
                d = re.sub(r"[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                    out.append((m.start(), k, kind, m.end(), m[0]))
        return sorted(out)

    got = find_pii(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [[tuple(x)[:5] for x in r.pii if x.kind in BASE] for r in got] == [base(t) for t in texts]
    assert [x.kind for x in got[7].pii] == ["iban"] and got[7].pii[0].score == pytest.approx(1.0) and got[7].n == "n"


def test_secret_spans_and_random_tokens(spark):
    from termgrid.llm.secrets import find_secrets

    rng = random.Random(3)
    sign = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choice(sign) for _ in range(40)) for _ in range(60)]
    tokens = [t for t in tokens if any(c.isdigit() for c in t)]
    plain = ["https1/the/words/and/the/words/and/the/words", "aaaaaaaaaaaaaaaaaaaaaaaa1aaaaaaaaaaaa", "chapter1chapter2chapter3chapter4chapter5"]
    texts = [None, "", "API_Key: 'abcdefghijkl' token=short AKIAABCDEFGHIJKLMN0 deadbeefdeadbeef0 😀 secret=\"0123456789ab\"", *[f"see {t} end" for t in tokens + plain]]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)

    def base(t):
        t = t or ""
        return sorted([(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])

    got = find_secrets(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [[tuple(x)[:4] for x in r.secrets if x.kind != "random"] for r in got] == [base(t) for t in texts]
    found = [any(x.kind == "random" for x in r.secrets) for r in got[3:]]
    assert sum(found[: len(tokens)]) >= 0.85 * len(tokens) and not any(found[len(tokens) :])


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_contamination_matches_all_windows(spark, broadcast_rows):
    from termgrid.llm.decontam import contaminated, without_contaminated

    rng = random.Random(11)
    items = [(k, words(rng, rng.randrange(12, 40), 900)) for k in range(8)] + [(90, "two words"), (91, None), (92, " ")]
    docs = [(k, words(rng, 60, 900) + " " + items[k % 8][1].upper() + " " + words(rng, 20, 900)) for k in range(12)]
    edited = items[0][1].split()
    edited[-1] = "changed"
    docs += [(20, words(rng, 9, 900) + " " + " ".join(edited)), (21, " ".join(items[1][1].split()[: len(items[1][1].split()) // 2])), (22, None), (23, ""), (24, "two  words"), (25, items[2][1]), (25, items[2][1]), (None, items[3][1]), (26, words(rng, 20000, 900))]

    def grams(t):
        w = (t or "").lower().split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])

    want = {}
    for i, t in docs:
        s = grams(t)
        for j, u in items:
            g = grams(u)
            if not set(s) & set(g):
                continue
            for a in range(max(0, len(s) - len(g)) + 1):
                w = s[a : a + len(g)]
                c = sum((Counter(w) & Counter(g)).values())
                sim = c / (len(w) + len(g) - c)
                if sim >= 0.8 and sim >= want.get((i, j), (0, -1))[1] - 1e-12:
                    want[i, j] = (a, sim, len(w) + 4)
    d, b = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity, r.n_words) for r in contaminated(d, b, broadcast_rows=broadcast_rows).collect()}
    assert got.keys() == want.keys() and len(want) >= 14
    assert all(got[k] == (pytest.approx(want[k][0]), pytest.approx(want[k][1]), want[k][2]) for k in want)
    kept = {r.doc_id for r in without_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_contamination_finds_reordered_items(spark):
    from termgrid.llm.decontam import contaminated

    rng = random.Random(12)
    items = [(k, words(rng, n, 900)) for k, n in enumerate((60, 60, 90, 61))]
    part = [t.split() for _, t in items]
    around = lambda x: words(rng, 25, 900) + " " + " ".join(x) + " " + words(rng, 30, 900)
    docs = [(0, around(part[0][30:] + part[0][:30])), (1, around(part[1][12:] + part[1][:12])), (2, around(part[2])), (3, " ".join(part[3][20:] + part[3][:20]))]
    docs += [(4, around(part[2][45:] + part[2][:45]) + " " + " ".join(part[0][5:])), (5, around(part[0][:30])), (None, around(part[1][50:] + part[1][:50])), (None, around(part[0]))]

    def grams(t):
        w = t.split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for i, t in docs:
        s = grams(t)
        for j, u in items:
            g = grams(u)
            for a in range(max(0, len(s) - len(g)) + 1):  # every window
                w = s[a : a + len(g)]
                c = sum((Counter(w) & Counter(g)).values())
                if c / (len(w) + len(g) - c) >= 0.8:
                    want[i, j] = max(want.get((i, j), 0), c / (len(w) + len(g) - c))
    rows = contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    assert got == pytest.approx(want) and {(0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (4, 0), (None, 0), (None, 1)} == want.keys()


def test_empty_tables(spark):
    from termgrid.llm.decontam import contaminated
    from termgrid.llm.langid import fit_languages, identify
    from termgrid.llm.line_dedup import remove_repeated_lines
    from termgrid.llm.ngram_join import near_duplicates
    from termgrid.llm.packing import pack_documents
    from termgrid.llm.pii import find_pii
    from termgrid.llm.quality import fit_quality, score_quality
    from termgrid.llm.secrets import find_secrets
    from termgrid.llm.substring_dedup import remove_repeated_words

    d, one = frame(spark, []), frame(spark, [(1, "hello there"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (remove_repeated_words, remove_repeated_lines, near_duplicates, find_pii, find_secrets, pack_documents, lambda x: contaminated(x, x.selectExpr("doc_id as item_id", "text"))):
        assert f(d).count() == 0
    assert [round(r.quality_score, 6) for r in score_quality(one, fit_quality(one, labels)).collect()] == [0.5, 0.5]
    assert [r.lang_pred for r in identify(one, fit_languages(d)).collect()] == ["und", "und"]
    assert contaminated(one, frame(spark, []).selectExpr("doc_id as item_id", "text")).count() == 0


def test_digest_of_no_spans(spark):
    from termgrid.llm.pii import find_pii, span_text

    one = find_pii(frame(spark, [(1, "nothing here")])).select(span_text(F.col("pii")).alias("x")).first()
    assert one.x == ""


def _random_strings(rng, signs, n, times):
    return ["".join(rng.choice(signs) for _ in range(n)) for _ in range(times)]


def test_random_tokens_have_uniform_p_by_encoding_and_length(spark):
    from termgrid.llm.secrets import ALPHABETS, battery

    rng, times = random.Random(21), 400
    rows = [(name, n, t) for name in ("hex", "base32", "lower26", "base62", "base64url") for n in (20, 40, 200) for t in _random_strings(rng, ALPHABETS[name], n, times)]
    df = spark.createDataFrame(rows, "name string, n int, t string").withColumn("b", battery(F.col("t")))
    for r in df.groupBy("name", "n").agg(*[F.avg((F.col("b.p") >= c).cast("double")).alias(f"p{k}") for k, c in enumerate((0.1, 0.5, 0.9))]).collect():
        assert 0.84 <= r.p0 <= 0.96 and 0.4 <= r.p1 <= 0.64 and r.p2 <= 0.2, r


def test_few_of_the_found_tokens_are_not_random(spark):
    from termgrid.llm.secrets import ALPHABETS, RATE, find_secrets

    rng = random.Random(22)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(200)]
    real = _random_strings(rng, ALPHABETS["lower36"], 40, 150) + _random_strings(rng, ALPHABETS["lower26"], 40, 40)
    fake = []
    while len(fake) < 600:
        t = "".join(rng.choice(vocabulary) + rng.choice(("", "", "1", "2019")) for _ in range(9))[:40]
        fake.append(t)
    for scale in (1, 12):  # the same rule for many and for few
        some = [(k, f"x {t} y") for k, t in enumerate(real[::scale] + fake[::scale])]
        got = {r.doc_id for r in find_secrets(frame(spark, some)).collect() if any(x.kind == "random" for x in r.secrets)}
        n = len(real[::scale])
        false = sum(k >= n for k in got)
        assert sum(k < n for k in got) >= 0.75 * n and false <= 2 * RATE * len(got) + 2, (scale, len(got), false)


def test_secrets_of_a_very_long_token(spark):
    from termgrid.llm.secrets import ALPHABETS, find_secrets

    token = "".join(random.Random(23).choices(ALPHABETS["base62"], k=1 << 20))
    r = find_secrets(frame(spark, [(1, "key " + token + " end"), (2, "a" * (1 << 20))])).orderBy("doc_id").collect()
    assert [(x.start, x.end) for x in r[0].secrets if x.kind == "random"] == [(4, 4 + len(token))]
    assert not [x for x in r[1].secrets if x.kind == "random"]
