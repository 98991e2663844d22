"""SimHash components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from sphaera.llm import simhash as m

SCHEMA = "doc_id bigint, text string, row string, fp string, key string"


def fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def brute(rows, size):
    prints = [fingerprint(r[1], size) for r in rows]
    best, of = {}, roots(prints)
    for r, o in zip(rows, of, strict=True):
        ids = [x for x in (best.get(o), r[0]) if x is not None]
        best[o] = min(ids) if ids else None
    return sorted(((r[0], f"{p:016x}", best[o], r[0] == best[o]) for r, p, o in zip(rows, prints, of, strict=True)), key=str)


def result(spark, rows, size):
    return sorted((tuple(r) for r in m.annotate(spark.createDataFrame(rows, SCHEMA), shingle=size).collect()), key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = re.split(r"\s+", out[r.randrange(len(out))])
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = r.choices(words, k=r.randint(1, 400))
        out.append(r.choice([" ", "\n", " \t"]).join(w))
    return [(i, t, "x", "y", "z") for i, t in enumerate(out)]


EDGES = [
    (900, None, "", "", ""), (901, "", "", "", ""), (902, " \t\n", "", "", ""), (903, "one two", "", "", ""), (904, "\vONE\v\ttwo ", "", "", ""),
    (905, "long " * 40_000, "", "", ""), (906, "x" * 700_000 + " y", "", "", ""), (None, "one two", "", "", ""), (None, "lone text here", "", "", ""),
    (3, "one two", "", "", ""), (3, None, "", "", ""), (907, "Ünïcode wörds ÄÖ and more", "", "", ""), (908, "a", "", "", ""),
]


@pytest.mark.parametrize("size", [1, 3, 5])
def test_against_brute_force(spark, size):
    rows = corpus(size) + EDGES
    assert result(spark, rows, size) == brute(rows, size)


@pytest.mark.parametrize(("seed", "size"), [(1, 1), (2, 3), (3, 5)])
def test_pieces_of_long_texts(monkeypatch, seed, size):
    """Long texts are hashed in pieces; words and shingles across their ends count once."""
    monkeypatch.setattr(m, "PIECE", 64)
    monkeypatch.setattr(m, "CHUNK", 16)
    for _, text, *_ in corpus(seed, 60) + EDGES:
        if len(text or "") < 100_000:
            data = np.frombuffer((text or "").encode(), np.uint8)
            assert int(m.block_prints(data, np.array([0, len(data)]), size)[0]) == fingerprint(text, size)


def test_golay_code_is_perfect():
    """Every word of 23 bits is at most three bits from the codeword it decodes to."""
    words = np.arange(1 << 23)
    index = m.decode(words)
    code = np.zeros(4096, np.int64)
    zero = words[np.isin(words, np.flatnonzero(m.golay_tables()[1] == 0))]
    assert len(zero)
    of_byte, error = m.golay_tables()
    s = of_byte[0][words & 255] ^ of_byte[1][words >> 8 & 255] ^ of_byte[2][words >> 16]
    code[index] = words ^ error[s]
    assert np.bincount(index, minlength=4096).tolist() == [2048] * 4096
    assert np.bitwise_count(words ^ code[index]).max() == 3
    assert min(int(a).bit_count() for a in code if a) == 7


def test_two_bits_share_a_key():
    """All fingerprints within two bits of some, whatever bits differ, meet in a key; each has 18 at most."""
    r = random.Random(5)
    for base in [0, (1 << 64) - 1, *(r.getrandbits(64) for _ in range(6))]:
        near = [base] + [base ^ (1 << a) for a in range(64)] + [base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
        key, row = m.keys(np.array(near, np.uint64))
        own = {}
        for k, i in zip(key.tolist(), row.tolist(), strict=True):
            own.setdefault(i, set()).add(k)
        assert all(own[0] & own[i] for i in range(len(near)))
        assert max(map(len, own.values())) <= 18


def test_crowded_keys_go_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(m, "LIST", 3)
    r = random.Random(9)
    base = r.getrandbits(64)
    prints = {base}
    for _ in range(300):
        p = r.choice(sorted(prints))
        for _ in range(r.choice([1, 2, 2, 3])):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    prints = sorted(prints | {r.getrandbits(64) for _ in range(50)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {row.node: row.label for row in m.components(m.links(nodes)).collect()}
    of = roots(prints)
    got = {}
    for p, o in zip(signed, of, strict=True):
        got.setdefault(o, set()).add(p)
    for group in got.values():
        if len(group) > 1:
            assert {found[p] for p in group} == {min(group)}
        else:
            assert not group & set(found)


def test_deduplicate_keeps_columns(spark):
    rows = [(1, "a b c d e f", "p", "q", "r"), (2, "a b c d e f", "s", "t", "u"), (2, "of another kind", "v", "w", "x"), (None, "A b c d e F", "y", "z", "0")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, m.deduplicate(docs).collect())) == [rows[0], rows[2]]


def test_empty_table(spark):
    assert result(spark, [], 3) == []
