"""Decontamination against brute force, with and without a broadcast."""

import random
import re

import pytest

from sphaera.llm import decontaminate as m

SCHEMA = "doc_id bigint, text string, row string, items string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))


def brute(docs, items):
    own = {}
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            own.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for d, t, *_ in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(g) for g in own}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in own:
                    hit |= set(range(i, i + n))
                    names |= {str(k) for k in own[tuple(w[i : i + n])] if k is not None}
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    v = ["a", "B", "Été", "d1", "e"]
    items = [(k, " ".join(r.choices(v, k=r.choice([1, 4, 9, 10, 11, 15])))) for k in range(12)] + [(20, None), (21, ""), (22, "--"), (None, "e e e e"), (3, "d1 d1 d1 d1 d1")]
    docs = []
    for i in range(80):
        parts = [r.choice(items)[1] or "" if r.random() < 0.3 else ", ".join(r.choices(v + ["x", "y"], k=r.randint(0, 20))) for _ in range(r.randint(0, 5))]
        docs.append((i, "; ".join(parts).upper() if i % 2 else "\n".join(parts), "p", "q"))
    return docs + [(90, None, "", ""), (90, "", "", ""), (None, items[0][1], "", ""), (91, "long " * 50_000 + items[3][1], "", "")], items


@pytest.mark.parametrize("most", [None, -1])
def test_against_brute_force(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(m, "MAX_BROADCAST_BYTES", most)
    docs, items = corpus(1)
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    found = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in m.scan(d, b).collect()), key=str)
    assert found == brute(docs, items)


@pytest.mark.parametrize("most", [None, -1])
def test_cleaning(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(m, "MAX_BROADCAST_BYTES", most)
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"before, {item.upper()}. after", "r", "i"), (2, "clean text", "r", "i"), (None, None, "r", "i"), (2, item, "r", "i")]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    cut = sorted(map(tuple, m.decontaminate(d, b).collect()), key=str)
    assert cut == sorted([(1, "before, . after", "r", "i"), docs[1], docs[2], (2, "", "r", "i")], key=str)
    left = sorted(map(tuple, m.decontaminate(d, b, drop_documents=True).collect()), key=str)
    assert left == sorted(docs[1:3], key=str)


def test_empty_tables(spark):
    docs, items = corpus(2)
    none_d, none_b = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    assert m.scan(none_d, none_b).collect() == []
    d = spark.createDataFrame(docs, SCHEMA)
    assert {(r.n_hit, len(r["items"])) for r in m.scan(d, none_b).collect()} == {(0, 0)}


@pytest.mark.parametrize("most", [None, -1])
def test_windows_formed_by_a_cut(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(m, "MAX_BROADCAST_BYTES", most)
    item = [f"w{i}" for i in range(10)]
    one, two = " ".join(item[:5] + item + item[5:]), " ".join(item[:3] + item[:5] + item + item[5:] + item[3:])
    docs = [(1, f"before {one} after", "r", "i"), (2, f"before {two} after", "r", "i"), (3, "clean", "r", "i"), (None, None, "r", "i")]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    left = {r.doc_id: r.text for r in m.decontaminate(d, b).collect()}
    assert [words(left[k]) for k in (1, 2)] == [["before", "after"]] * 2 and left[3] == "clean" and left[None] is None
    scanned = {r.doc_id: (r.cleaned, r.n_hit) for r in m.scan(d, b, clean=True).collect()}
    assert {k: v[0] for k, v in scanned.items()} == left and [scanned[k][1] for k in (1, 2, 3)] == [10, 10, 0]


@pytest.mark.parametrize("most", [None, -1])
def test_nested_windows_at_random(spark, monkeypatch, most):
    """Cutting ends with the same text on both ways, and that of cutting whole texts again and again."""
    if most is not None:
        monkeypatch.setattr(m, "MAX_BROADCAST_BYTES", most)
    r = random.Random(5)
    items = [(k, " ".join(r.choices("abc", k=r.choice([3, 5, 10, 12])))) for k in range(6)]
    index = m.WindowIndex(items)

    def again_and_again(t):
        while True:
            raw = m.np.frombuffer(t.encode(), m.np.uint8)
            found = m.scan_block(index, raw, m.np.array([0, len(raw)]))[1]
            if not found:
                return t
            spans = [x.span() for x in re.finditer(r"[a-z]+", t)]
            mask, out, at, k = found[0][0], "", 0, 0
            while k < len(spans):
                if not mask[k]:
                    k += 1
                    continue
                out += t[at : spans[k][0]]
                while k < len(spans) and mask[k]:
                    at = spans[k][1]
                    k += 1
            t = out + t[at:]

    docs = []
    for i in range(60):
        t = r.choice(items)[1].split(" ")
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(t))
            t = t[:k] + r.choice(items)[1].split(" ") + t[k:]
        docs.append((i, r.choice([", ", " ", ". "]).join(["x", *t, "y"]), "r", "i"))
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    assert {r.doc_id: r.text for r in m.decontaminate(d, b).collect()} == {i: again_and_again(t) for i, t, *_ in docs}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(m.tx, "gram_hash", lambda words, n: m.np.full(max(0, len(words) - n + 1), 7 << 40, m.np.uint64))
    index = m.WindowIndex([("a", "one two"), ("b", "three four"), ("c", "one two"), ("d", "one two five")])
    raw = m.np.frombuffer(b"x three four y", m.np.uint8)
    found = m.scan_block(index, raw, m.np.array([0, len(raw)]))[1]
    assert {index.names[i] for i in found[0][1]} == {"b"} and found[0][0].tolist() == [False, True, True, False]


def test_size_of_the_index():
    text = " ".join(f"word{i}" for i in range(20_000))
    assert m.WindowIndex([("a", text)]).nbytes() < 16 * len(text)
