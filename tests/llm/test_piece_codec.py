"""Exact round trips; N-best lists against all segmentations."""

import random
import time
from pathlib import Path

import numpy as np
import pytest

from sphaera.llm import piece_codec as m

PIECES = m.Pieces(Path(m.MODEL).read_bytes())


def every(word: bytes, pieces=PIECES):
    """Scores and ids of all segmentations."""
    lattice = pieces.edges(word)
    paths = {0: [(0.0, [])]}
    for end in range(1, len(word) + 1):
        paths[end] = [
            (s + (pieces.score_of[word[a:end]] if k >= 0 else pieces.unknown), p + pieces.expand(word, [(a, end, k)]))
            for a, k in lattice[end] for s, p in paths.get(a, [])
        ]
    return sorted(paths[len(word)], key=lambda x: -x[0])


@pytest.mark.parametrize("word", [b" hello", b" the", b"x", b"\n", "  é日本".encode(), " ▁a".encode(), "😀ab".encode(), b" internation"])
def test_astar_gives_the_best(word):
    full = every(word)
    for n in (1, 2, 5, 50):
        found = PIECES.nbest(word, n)
        assert [s for s, _ in found] == [s for s, _ in full[:n]]
        assert all((s, p) in full for s, p in found)
        assert len({tuple(p) for _, p in found}) == len(found)


@pytest.mark.parametrize("word", [b" " + b"a" * 100_000, b"=" * 100_000, b"ab" * 50_000, "日本".encode() * 17_000, b"abcab" * 20_000])
def test_long_runs_take_time_in_proportion(word):
    began = time.process_time()
    found = PIECES.nbest(word, 4)
    assert time.process_time() - began < 30
    scores = [s for s, _ in found]
    assert scores == sorted(scores, reverse=True) and len({tuple(p) for _, p in found}) == len(found)
    for _, ids in found:
        assert b"".join(PIECES.text[i] for i in ids) == word


@pytest.mark.parametrize("word", [b"aaaaaaaaaaaa", b" aabbaabbaa", b"=-=-=-=-=", "日日日日日".encode()])
def test_ties_against_all_segmentations(word):
    full = every(word)
    for n in (2, 7, 40):
        found = PIECES.nbest(word, n)
        assert [s for s, _ in found] == [s for s, _ in full[:n]]
        assert len({tuple(p) for _, p in found}) == len(found)


def encoded(spark, texts, n_best=4):
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id bigint, text string, score string")
    return {r.doc_id: r for r in m.decode(m.encode(docs, n_best=n_best)).collect()}


def test_whole_texts_against_all_segmentations(spark):
    r = random.Random(1)
    texts = ["".join(r.choices(["a", "b", "th", "e ", " in", "\n", "é"], k=r.randint(1, 4))) for _ in range(40)]
    for i, row in encoded(spark, texts, 6).items():
        full = every(b" " + texts[i].encode())
        assert [x.score for x in row.nbest] == [s for s, _ in full[:6]] and row.score == full[0][0]
        for x in row.nbest:
            ids = m.apply_edits(list(row.ids), [e.asDict() for e in x.edits])
            assert any(s == x.score and p == ids for s, p in full)


def test_round_trip(spark):
    r = random.Random(2)
    alphabet = "abcdefg   \n\t\r\0éß日本語😀▁ |&$%'\""
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 300))) for _ in range(60)]
    texts += ["", " ", "  ", "\n\n", "▁", " lead", "trail ", "x" * 3000, "a" * 100_000, "long word " * 20_000, "a b" * 10]
    found = encoded(spark, texts)
    assert {i: row.decoded for i, row in found.items()} == dict(enumerate(texts))
    assert found[60].ids == [] and found[60].score == 0


def test_long_words_take_the_same_path(spark, monkeypatch):
    words = [w.encode() for w in (" internationalisation", " the", "nothing", " éa")]
    found = []
    for most in (48, 0):
        monkeypatch.setattr(m, "MAX_WORD", most)
        own = m.Words(PIECES)
        own.lookup(words)
        found.append((own.score.tolist(), own.gap.tolist(), own.ids.tolist()))
    assert found[0] == found[1]


def test_nulls_and_empty_table(spark):
    row = encoded(spark, [None])[0]
    assert row.ids == [] and row.decoded == "" and row.text is None and np.isclose(row.score, 0)
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert m.decode(m.encode(docs)).collect() == []
