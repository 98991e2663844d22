"""Repeated byte strings against brute force; the loser tree against sorting."""

import random

import pytest

from sphaera.llm import suffix_dedup as m

SCHEMA = "doc_id bigint, text string, row string, place string, first string"


def brute(rows, width):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), []
    for d, t, *_ in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def result(spark, rows, width, gram):
    found = m.deduplicate(spark.createDataFrame(rows, SCHEMA), width=width, gram=gram).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    pool = ["".join(r.choices("abcé ", k=r.randint(10, 90))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [r.choice(pool) if r.random() < 0.5 else "".join(r.choices("abcdefgh é\0", k=r.randint(0, 60))) for _ in range(r.randint(0, 6))]
        out.append("".join(parts))
    out += ["a" * 150, "ab" * 80, "a" * 19, "a" * 20, "a" * 21, out[0], out[1]]
    return [(i, t, "x", "y", "z") for i, t in enumerate(out)]


@pytest.mark.parametrize(("width", "gram"), [(20, 16), (24, 17), (40, 16)])
def test_against_brute_force(spark, width, gram):
    rows = corpus(width) + [(500, None, "", "", ""), (501, "", "", "", "")]
    assert result(spark, rows, width, gram) == brute(rows, width)


def test_many_runs(spark, monkeypatch):
    monkeypatch.setattr(m, "RUN_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    rows = corpus(5, 120)
    assert result(spark, rows, 20, 16) == brute(rows, 20)


@pytest.mark.parametrize(("cut", "single"), [(9, 32), (3, 32), (9, 0)])
def test_frequent_grams_are_cut(spark, monkeypatch, cut, single):
    monkeypatch.setattr(m, "CUT", cut)
    monkeypatch.setattr(m, "SINGLE", single)
    r = random.Random(3)
    shared = "".join(r.choices("abcdefgh", k=70))
    rows = [(i, "".join(r.choices("xyz", k=r.randint(0, 30))) + shared + "".join(r.choices("xyz", k=r.randint(0, 30))), "", "", "") for i in range(1500)]
    assert result(spark, rows, 20, 16) == brute(rows, 20)


def test_a_passage_in_many_documents_gives_ranges(spark):
    """About a range for each document and anchor at the passage's edges, not one for each window."""
    r = random.Random(8)
    passage = "".join(r.choices("abcdefgh ", k=300))
    rows = [(i, "".join(r.choices("uvwxyz", k=40)) + passage + "".join(r.choices("uvwxyz", k=40)), "", "", "") for i in range(2000)]
    texts = spark.createDataFrame([(i, t) for i, t, *_ in rows], "row bigint, text string").repartition(20)
    assert m.repeated_windows(texts).count() < 4 * len(rows)
    assert result(spark, rows[::10], 100, 32) == brute(rows[::10], 100)


def test_texts_longer_than_a_block_are_chunked(spark, monkeypatch):
    r = random.Random(6)
    long = "".join(r.choices("abcdefgh ", k=2_500_000))
    rows = [(1, long, "", "", ""), (2, long[1_040_000:1_060_000] + "x" * 90 + long[2_090_000:2_100_000], "", "", "")]
    assert result(spark, rows, 100, 32) == brute(rows, 100)


def test_ranges_that_touch_are_joined():
    a = [m.np.array(x) for x in ([2, 1, 1, 2, 1, 2], [5, 0, 3, 9, 9, 7], [6, 9, 4, 9, 9, 7])]
    assert [x.tolist() for x in m.joined(*a)] == [[1, 2, 2], [0, 5, 9], [9, 7, 9]]


def test_long_text_repeated_and_null_ids(spark):
    r = random.Random(4)
    long = "".join(r.choices("abcdefgh ", k=200_000))
    rows = [(1, long, "", "", ""), (2, long[50_000:150_000] + "end", "", "", ""), (3, "q" * 120, "", "", ""), (3, "q" * 120, "", "", ""), (None, "r" * 110, "", "", ""), (0, "r" * 130, "", "", "")]
    assert result(spark, rows, 100, 32) == brute(rows, 100)


def test_empty_table(spark):
    assert result(spark, [], 100, 32) == []


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_loser_tree(k):
    r = random.Random(k)
    runs = []
    for _ in range(k):
        own = sorted(bytes(r.choices(b"ab", k=r.randint(1, 12))) for _ in range(r.randint(0, 40)))
        runs.append((own, m.front_code(own, 12).tolist() if own else []))
    out = [(runs[a][0][i], c) for a, i, c in m.merge_runs(runs)]
    assert [s for s, _ in out] == sorted(s for own, _ in runs for s in own)
    for (a, _), (b, c) in zip(out, out[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert c == n
