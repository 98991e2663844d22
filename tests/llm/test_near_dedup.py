"""Near-duplicate components against brute force."""

import random
import re

import pytest

from sphaera.llm import near_dedup as m

SCHEMA = "doc_id bigint, text string, row string, sig string, n string"


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    sets = [shingles(r[1], size) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        ids = [x for x in (best.get(root(i)), r[0]) if x is not None]
        best[root(i)] = min(ids) if ids else None
    return sorted(((r[0], len(sets[i]), best[root(i)], r[0] == best[root(i)]) for i, r in enumerate(rows)), key=str)


def result(spark, rows, size, percent):
    found = m.annotate(spark.createDataFrame(rows, SCHEMA), shingle=size, percent=percent).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str)


def corpus(seed, n=150, vocabulary=400, passage=0):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(vocabulary)]
    shared = r.choices(words, k=passage)
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = out[r.randrange(len(out))].split()
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
        else:
            w = r.choices(words, k=r.randint(1, 60)) + shared
        out.append(" ".join(w))
    return [(i, t, "x", "y", "z") for i, t in enumerate(out)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, size, percent):
    rows = corpus(1) + [(900, None, "", "", ""), (901, "", "", "", ""), (902, " \t\n", "", "", ""), (903, "one two", "", "", ""), (904, "ONE\vtwo", "", "", ""), (905, "long " * 40_000, "", "", "")]
    assert result(spark, rows, size, percent) == brute(rows, size, percent)


@pytest.mark.parametrize(("passage", "most", "items"), [(0, 1 << 20, 1 << 15), (40, 1 << 20, 300), (20, -1, 1 << 15)])
def test_long_lists_go_the_exact_way(spark, monkeypatch, passage, most, items):
    monkeypatch.setattr(m, "PIVOT_ROWS", 5)
    monkeypatch.setattr(m, "BLOCK_ITEMS", items)
    monkeypatch.setattr(m, "MAX_BROADCAST_IDS", most)
    monkeypatch.setattr(m, "LIST", 4)
    monkeypatch.setattr(m, "BLOCK", 8)
    r = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = corpus(2, 60, passage=passage)
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5, 5, 6, 7, 9, 14])):
            w[r.randrange(150)] = f"e{r.randrange(500)}"
        rows.append((1000 + i, " ".join(w), "", "", ""))
    assert result(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_repeated_and_null_ids(spark):
    rows = corpus(3, 30) + [(3, "a b c d e f", "", "", ""), (None, "a b c d e f", "", "", ""), (None, "quite alone here", "", "", ""), (3, None, "", "", "")]
    assert result(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_empty_table(spark):
    assert result(spark, [], 3, 85) == []


def test_recall_at_the_threshold(spark):
    """300 pairs of different texts at 85 to 87 %: every one is found, and no text of two pairs is linked."""
    r, rows, pairs = random.Random(12), [], 0
    while pairs < 300:
        one = [f"p{pairs}w{r.randrange(150)}" for _ in range(r.randint(120, 260))]
        two = list(one)
        for _ in range(r.randint(3, 7)):
            two[r.randrange(len(two))] = f"other{r.randrange(10**6)}"
        a, b = (shingles(" ".join(x), 3) for x in (one, two))
        if 85 <= 100 * len(a & b) / len(a | b) <= 87:
            rows += [(2 * pairs, " ".join(one), "", "", ""), (2 * pairs + 1, " ".join(two), "", "", "")]
            pairs += 1
    assert [c for _, _, c, _ in sorted(result(spark, rows, 3, 85), key=lambda x: x[0])] == [i // 2 * 2 for i in range(600)]


def test_hubs_are_spread(spark, monkeypatch):
    """Stars, chains and a hub with a third of all links: components by hand; no join brings a hub's links to one task."""
    from sphaera.llm import graph

    r = random.Random(3)
    links = [(0, i) for i in range(1, 700)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, 5001 + i) for i in range(300)] + [(650, 1040)] + [(r.randrange(7000, 9000), r.randrange(7000, 9000)) for _ in range(500)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            one, two = sorted((root(a), root(b)))
            up[two] = one
    found = {x.node: x.label for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: root(x) for x in up}
    edges = spark.createDataFrame([(0, i) for i in range(1, 5000)], "a long, b long").repartition(4)
    groups = spark.createDataFrame([(0, 7, 4999)], "a long, new_a long, n long")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        sizes = graph._join(edges, "a", groups, "new_a", "n", 4999, graph.F.col("b")).groupBy(graph.F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(x["count"] for x in sizes) == 4999 and max(x["count"] for x in sizes) < 2000
