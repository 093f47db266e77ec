"""Texts that polynomial hashes modulo a power of two take for equal: the Thue-Morse sequence and its complement."""

from __future__ import annotations

import numpy as np
import pytest

TOKENIZER = "word_bpe_49k.json"


def thue_morse(n: int, zero: str, one: str) -> tuple[list[str], list[str]]:
    bits = [i.bit_count() % 2 for i in range(n)]
    return [one if b else zero for b in bits], [zero if b else one for b in bits]


@pytest.mark.parametrize("n", [64, 128, 256, 1024, 4096, 8192])
def test_span_hashes_tell_blocks_apart(n):
    from termgrid.llm.common import KEY, OTHER_KEY, span_hashes

    w, v = ("".join(x).encode() for x in thue_morse(n, "a", "b"))
    data = np.frombuffer(b"xx" + w + b" " + v + b"." + w, dtype=np.uint8)
    starts = np.array([2, 3 + n, 4 + 2 * n])
    for key in (KEY, OTHER_KEY):
        h = span_hashes(data, starts, starts + n, key)
        assert h[0] != h[1] and h[0] == h[2]
    assert span_hashes(data, starts, starts + n, KEY)[0] != span_hashes(data, starts, starts + n, OTHER_KEY)[0]


def test_span_hashes_depend_on_content_alone():
    from termgrid.llm.common import span_hashes

    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 3, k, dtype=np.uint8) for k in [*range(40), 127, 128, 129, 400] for _ in range(6)]
    data = np.concatenate([*parts, *reversed(parts)])
    size = np.array([len(p) for p in parts] + [len(p) for p in reversed(parts)])
    starts = np.cumsum(size) - size
    h, known = span_hashes(data, starts, starts + size), {}
    for k, p in zip(h, [*parts, *reversed(parts)], strict=True):
        assert known.setdefault(p.tobytes(), k) == k
    assert len(set(known.values())) == len(known)
    assert len(span_hashes(np.empty(0, dtype=np.uint8), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))) == 0


def test_token_ids_of_such_words_are_the_librarys():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from termgrid.llm.tokens import Words

    path = str(public_tokenizers.path(TOKENIZER))
    w, v = ("".join(x) for x in thue_morse(4096, "a", "b"))
    texts = [f"{w} {v}", v, f"one {v}{w} two", "", w]
    full, words = Tokenizer.from_file(path), Words(path)
    assert [x.tolist() for x in words.ids(texts)] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_such_windows_are_not_repeats(spark):
    from termgrid.llm.substring_dedup import remove_repeated_words

    w, v = ("".join(x) for x in thue_morse(2048, "a", "b"))
    tail = " one two three four five six seven eight nine ten eleven twelve"
    got = remove_repeated_words(spark.createDataFrame([(1, w + tail), (2, v + tail)], "doc_id long, text string"), bits=16)
    assert {(r.doc_id, r.n_removed) for r in got.collect()} == {(1, 0), (2, 0)}


def test_such_lines_are_not_repeats(spark):
    from termgrid.llm.line_dedup import remove_repeated_lines

    w, v = (" ".join(x) for x in thue_morse(2048, "no", "or"))
    got = remove_repeated_lines(spark.createDataFrame([(1, w), (2, v)], "doc_id long, text string"), bits=16)
    assert {(r.doc_id, r.n_removed) for r in got.collect()} == {(1, 0), (2, 0)}


def test_such_texts_are_not_near_copies(spark):
    from termgrid.llm.ngram_join import near_duplicates

    w, v = ("".join(x) for x in thue_morse(4096, "a", "b"))
    rows = [(1, f"{w} two three four"), (2, f"{v} two three four"), (3, f"{v} two three four")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bits=16)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 0), (2, 2, 1), (3, 2, 1)}
