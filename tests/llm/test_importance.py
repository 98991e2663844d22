"""Importance resampling against brute force and held-out labels."""

import random
import re

import numpy as np
import pytest

from sphaera.llm import importance as m
from sphaera.llm import textops as tx

SCHEMA = "doc_id bigint, text string, key string, kept string"


def corpus(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = int(r.random() < 0.7)
        words = ["river", "stone", "house", "by", "the", "old"] if good else ["win$$$", "click!!", "the", "free&&&", "old"]
        docs.append((i, " ".join(r.choices(words, k=r.randint(5, 60))), "x", "y"))
        labels.append((i, good))
    return docs, labels


def bucket_of(text, n):
    raw = np.frombuffer(text.encode(), np.uint8)
    return m.block_grams(raw, np.array([0, len(raw)]), n)[1].tolist()


@pytest.mark.parametrize("most", [1 << 20, -1])
def test_counts_and_weights(spark, monkeypatch, most):
    monkeypatch.setattr(m, "MAX_BROADCAST_LABELS", most)
    docs, labels = corpus(60, 1)
    docs += [(100, None, "", ""), (101, "", "", ""), (None, "river", "", "")]
    d, la = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int")
    target, raw = m.count_grams(d, la)
    one, two = np.zeros(m.BUCKETS), np.zeros(m.BUCKETS)
    good = {i for i, q in labels if q}
    for i, t, *_ in docs:
        assert len(bucket_of(t or "", 7)) == max(0, 2 * len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) - 1)
        for b in bucket_of(t or "", m.BUCKETS):
            two[b] += 1
            one[b] += i in good
    assert (one == target).all() and (two == raw).all()
    ratio = m.log_ratio(target, raw)
    found = sorted((str(r.doc_id), r.log_weight) for r in m.weigh(d, ratio).collect())
    want = sorted((str(i), sum(ratio[b] for b in bucket_of(t or "", m.BUCKETS))) for i, t, *_ in docs)
    assert [a for a, _ in found] == [a for a, _ in want] and np.allclose([b for _, b in found], [b for _, b in want])


def test_packed_counts_are_summed_in_a_tree(spark, monkeypatch):
    """Many tasks, several ranges of buckets: the counts of one task over all texts; no record is a bucket's."""
    docs, labels = corpus(200, 7)
    la = spark.createDataFrame(labels, "doc_id bigint, quality int")
    one = m.count_grams(spark.createDataFrame(docs, SCHEMA).coalesce(1), la)
    monkeypatch.setattr(m, "RANGE", 1000)
    monkeypatch.setattr(m, "MERGED", 3)
    many = m.count_grams(spark.createDataFrame(docs, SCHEMA).repartition(11), la)
    assert all((a == b).all() for a, b in zip(one, many, strict=True))
    parts = spark.createDataFrame([(p, r, np.full(4, p).tobytes(), np.ones(4, np.int64).tobytes()) for p in range(20) for r in range(2)], m._PACKED)
    found = m.summed(parts, 20).collect()
    assert len(found) == 2 and all(np.frombuffer(f.target, np.int64).tolist() == [190] * 4 and np.frombuffer(f.raw, np.int64).tolist() == [20] * 4 for f in found)


def test_selection_at_the_bound(spark):
    """The most buckets that there can be prefer the good texts as the least do."""
    docs, labels = corpus(300, 8)
    d, la = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels[:150], "doc_id bigint, quality int")
    good = {i for i, q in labels if q}
    hits = []
    for n in (m.BUCKETS, m.MAX_BUCKETS):
        rows = m.weigh(d, m.log_ratio(*m.count_grams(d, la, buckets=n))).collect()
        best = sorted(rows, key=lambda r: -r.log_weight)[: len(good)]
        hits.append(sum(r.doc_id in good for r in best) / len(good))
    assert min(hits) > 0.9 and hits[1] > hits[0] - 0.05


def test_draws_k_and_prefers_the_good(spark):
    docs, labels = corpus(500, 2)
    d = spark.createDataFrame(docs, SCHEMA)
    la = spark.createDataFrame(labels[:250], "doc_id bigint, quality int")
    rows = m.resample(d, la, k=200).collect()
    assert sum(r.kept for r in rows) == 200
    keys = sorted((r.key for r in rows), reverse=True)
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in rows if r.key >= keys[199]}
    held = dict(labels[250:])
    auto = [r for r in m.resample(d, la).collect() if r.doc_id in held]
    assert np.mean([r.kept == held[r.doc_id] for r in auto]) > 0.9


@pytest.mark.parametrize("k", [0, 1, 7, 999, 5000, 9000])
def test_kth_largest(spark, monkeypatch, k):
    monkeypatch.setattr(m, "_BINS", 16)
    r = random.Random(k)
    values = [r.choice([1.0, 2.5, -1e9, r.random(), r.random() * 1e-9]) for _ in range(5000)]
    found = m.kth_largest(spark.createDataFrame([(v,) for v in values], "key double"), "key", k)
    assert found == (None if k == 0 else min(values) if k >= 5000 else sorted(values, reverse=True)[k - 1])


def test_empty_and_unlabelled(spark):
    d, la = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int")
    assert m.resample(d, la).collect() == []
    some = spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (None, None, "", "")], SCHEMA)
    assert [(r.log_weight, r.kept) for r in m.resample(some, la).collect()] == [(0.0, True)] * 3
    assert tx.BLOCK_BYTES > 0


def test_models_grow_with_the_text(spark):
    sizes = [m.buckets_for(n) for n in (0, 1 << 26, (1 << 28) - 1, 1 << 28, 30 << 30, 100 << 40)]
    assert sizes == [m.BUCKETS, m.BUCKETS, m.BUCKETS, 2 * m.BUCKETS, 16 * m.BUCKETS, m.MAX_BUCKETS]


def test_long_texts_and_text_ids(spark):
    docs = [("a", "river stone " * 100_000, "", ""), ("b", "win click", "", ""), (None, "river", "", "")]
    d = spark.createDataFrame(docs, SCHEMA.replace("bigint", "string"))
    la = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int")
    target, raw = m.count_grams(d, la)
    assert raw.sum() == 399_999 + 3 + 1 and target.sum() == 399_999
    assert {r.doc_id: r.kept for r in m.resample(d, la, k=2).collect()}["a"]
