"""Line deduplication against brute force, with insertion and deletion."""

import random
import re

import numpy as np
import pytest

from sphaera.llm import line_dedup as m

LINES = ["The same long line here", "  the SAME long line here\t", "short", "another repeated line", "ünïcödé line with ÀÉ", "", "unique %d of many lines"]
SCHEMA = "doc_id bigint, text string, row string, key string, owner string"


def documents(n, seed, start=0):
    r = random.Random(seed)
    out = []
    for i in range(start, start + n):
        out.append((i, "\n".join((x % i if "%d" in x else x) for x in r.choices(LINES, k=r.randint(0, 7))), "a", "b", "c"))
    return out


def brute(rows):
    def key(x):
        x = x.strip("\x20\x09\x0a\x0b\x0c\x0d")
        return re.sub("[A-Z]", lambda c: c[0].lower(), x)

    owners = {}
    ident = lambda d: -1 << 63 if d is None else d
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owners.setdefault(key(x), set()).add(ident(d))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == ident(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def test_nulls_empty_and_clashing_columns(spark):
    rows = documents(30, 1) + [(100, None, "", "", ""), (101, "", "", "", ""), (None, LINES[0], "", "", ""), (102, "x" * 200_000 + "\n" + LINES[3], "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(m.LineIndex.build(docs).deduplicate(docs)) == brute(rows)


def test_repeated_ids(spark):
    rows = documents(6, 3) + documents(6, 4) + [(None, LINES[0], "", "", "")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(m.LineIndex.build(docs, keys_per_shard=1).deduplicate(docs)) == brute(rows)


def test_without_broadcast_filters(spark, monkeypatch):
    monkeypatch.setattr(m, "MAX_FILTER_BYTES", -1)
    docs = spark.createDataFrame(documents(30, 8), SCHEMA)
    assert result(m.LineIndex.build(docs).deduplicate(docs)) == brute(documents(30, 8))


def test_lines_dealt_to_many_filters(spark, monkeypatch):
    monkeypatch.setattr(m, "MAX_FILTER_BYTES", -1)
    rows = documents(60, 9) + [(1000 + i, f"text number {i % 40} of several", "", "", "") for i in range(80)] + [(None, LINES[3], "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    index = m.LineIndex.build(docs, keys_per_shard=2)
    assert index.n_shards >= 16
    assert result(index.deduplicate(docs)) == brute(rows)
    # filters decide what passes: few lines that only one document holds do
    passed = {bytes(r.key) for r in index.candidates(m.identify(docs)).collect()}
    known = {bytes(r.key) for r in index.contested.collect()}
    assert known <= passed and len(passed - known) <= 2


def test_full_filters_are_built_anew(spark):
    few, many = documents(5, 2), [(100 + i, "\n".join(f"line number {j} of a long list" for j in range(600)), "", "", "") for i in range(2)]
    index = m.LineIndex.build(spark.createDataFrame(few, SCHEMA))
    assert index.n_shards == 1
    grown = index.insert(spark.createDataFrame(many, SCHEMA))
    assert [(r.full, len(r.stash)) for r in grown.filters.collect()] == [(False, 0)]
    assert result(grown.deduplicate(spark.createDataFrame(few + many, SCHEMA))) == brute(few + many)
    wide = m.LineIndex.build(spark.createDataFrame(few, SCHEMA), keys_per_shard=50).insert(spark.createDataFrame(many, SCHEMA))
    assert wide.n_shards == 16
    assert result(wide.deduplicate(spark.createDataFrame(few + many, SCHEMA))) == brute(few + many)


def test_rewrite_keeps_columns(spark):
    rows = [(1, "one long line here\nb", "p", "q", "r"), (2, "One long line here ", "s", "t", "u"), (2, None, "v", "w", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sorted(map(tuple, m.LineIndex.build(docs).rewrite(docs).collect()), key=str)
    assert out == sorted([rows[0], (2, "", "s", "t", "u"), (2, "", "v", "w", "x")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert result(m.LineIndex.build(docs).deduplicate(docs)) == []


def test_insert_and_delete_are_reversible(spark):
    a, b = documents(20, 5), documents(20, 6, 20)
    one, both = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(a + b, SCHEMA)
    index = m.LineIndex.build(one, keys_per_shard=2)
    grown = index.insert(spark.createDataFrame(b, SCHEMA))
    assert result(grown.deduplicate(both)) == brute(a + b)
    shrunk = grown.delete(spark.createDataFrame([(i,) for i in range(20, 40)], "id bigint"))
    assert result(shrunk.deduplicate(one)) == brute(a)
    assert sorted(map(tuple, shrunk.refs.collect())) == sorted(map(tuple, index.refs.collect()))
    assert sorted(map(tuple, shrunk.contested.collect())) == sorted(map(tuple, index.contested.collect()))


@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_cuckoo_filter(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 1 << 63, n * 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    own = m.CuckooFilter(n)
    own.insert(keys[:n])
    assert own.contains(keys[:n]).all() and own.contains(keys[n:]).sum() <= max(2, n // 100)
    own.delete(keys[: n // 2])
    assert own.contains(keys[n // 2 : n]).all() and own.contains(keys[: n // 2]).sum() <= max(2, n // 100)
    again = m.CuckooFilter(table=own.row(0)[1], stash=own.row(0)[2])
    assert again.contains(keys[n // 2 : n]).all()


def test_overfull_filter_keeps_all_keys():
    own = m.CuckooFilter(1)
    keys = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own.insert(keys)
    assert own.stash and own.contains(keys).all()
