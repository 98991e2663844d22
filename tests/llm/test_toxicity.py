"""Held-out accuracy, counterfactual regularisation, defined cases."""

import random
import re
import zlib

import numpy as np

from sphaera.llm import toxicity as m

SCHEMA = "doc_id bigint, text string, score string, toxic string, lang string"
PLAIN = "the house by the river was built of stone and wood many years ago near a small town".split()
BAD = ["vileword", "vilething", "nastyness", "nastier"]


def corpus(n, seed, biased=False):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.3)
        words = r.choices(PLAIN, k=r.randint(4, 30)) + (r.sample(BAD, 2) if toxic and r.random() < 0.8 + 0.2 * (not biased) else [])
        if biased:
            words.append("muslims" if r.random() < (0.85 if toxic else 0.1) else "christians")
        r.shuffle(words)
        docs.append((i, " ".join(words), "x", "y", "z"))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_ids(spark):
    docs, labels = corpus(600, 1)
    d, la = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = m.score(d, m.train(d, la)).select("doc_id", "score", m.held_out().alias("h")).collect()
    truth = dict(labels)
    assert {r.doc_id: r.h for r in found} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in truth}
    out = [((r.score >= m.THRESHOLD) == truth[r.doc_id]) for r in found if r.h]
    assert len(out) > 100 and np.mean(out) > 0.98


def test_held_out_labels_are_never_learned(spark):
    docs, labels = corpus(300, 2)
    d = spark.createDataFrame(docs, SCHEMA)
    flip = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = (m.train(d, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (labels, flip))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_counterfactual_penalty_closes_the_gap(spark):
    docs, labels = corpus(600, 3, biased=True)
    d, la = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    gaps = []
    for strength in (0.0, 1.0):
        model = m.train(d, la, counterfactual=strength)
        s = []
        for who in ("muslims", "christians"):
            raw = f"the {who} near the river".encode()
            p = model.score_block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
            s.append(np.log(p / (1 - p)))
        gaps.append(s[0] - s[1])
    assert gaps[0] > 1 and abs(gaps[1]) < 0.3 * gaps[0]


def test_defined_cases(spark):
    docs, labels = corpus(200, 4)
    odd = [(None, "vileword nastier", "", "", ""), (900, None, "", "", ""), (900, "", "", "", ""), (901, "house " * 50_000 + "vileword vilething", "", "", "")]
    d = spark.createDataFrame(docs + odd, SCHEMA)
    la = spark.createDataFrame(labels + [(0, None), (None, 1), (3, 1), (3, 0)], "doc_id bigint, toxic int")
    found = [r for r in m.score(d, m.train(d, la)).collect() if r.doc_id is None or r.doc_id >= 900]
    assert len(found) == 4 and all(0 <= r.score <= 1 for r in found)
    empty = [r.score for r in found if r.doc_id == 900]
    assert empty[0] == empty[1] < 0.5
    assert all(r.score > 0.7 for r in found if r.doc_id in (None, 901))
    none = d.limit(0)
    assert m.score(none, m.train(none, la.limit(0))).collect() == []


def test_every_term_has_its_twin(spark):
    kinds = (m.IDENTITY[5], m.IDENTITY[6])
    text = f"a {kinds[0][0]} and a {kinds[1][0]} by the river"
    rows = spark.createDataFrame([(1, text, 7), (0, "the " * 9 + kinds[0][1], 8)], "toxic int, text string, key bigint")
    found = m._training_rows(rows, m.IDENTITY, True).collect()
    assert sum(r.key == 7 for r in found) == 11 and sum(r.key == 8 for r in found) == 6
    for kind in kinds:
        for w in kind:
            assert any(int(np.int64(m.features_of(w)[0].view(np.int64))) in r.features for r in found if r.key == 7)


def pure_hash(word: bytes, kind: int) -> int:
    """The feature hash in plain integers."""
    top, h = (1 << 64) - 1, 0
    for i, b in enumerate(word):
        h += (b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64)
    h = h + kind & top
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & top
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & top
    return h ^ h >> 32


def test_scores_against_brute_force(spark):
    docs, labels = corpus(300, 7)
    docs += [(900, "Ünïcödé VILEWORD, nasty-ness! 12 \x00 x", "", "", ""), (901, "", "", "", ""), (902, None, "", "", "")]
    d = spark.createDataFrame(docs, SCHEMA)
    model = m.train(d, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    weight = dict(zip(model.known.tolist(), model.weights.tolist()))
    want = {}
    for i, t, *_ in docs:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)
        found = {pure_hash(w, 1) for w in words} | {pure_hash(w[:n], 1 + n) for w in words for n in m.PREFIXES}
        want[i] = 1 / (1 + np.exp(-(model.bias + sum(weight.get(h, 0.0) for h in found))))
    got = {r.doc_id: r.score for r in m.score(d, model).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[i], want[i], atol=1e-9) for i in want)
    assert len({round(v, 9) for v in want.values()}) >= 3


def test_neutral_mentions_are_not_rejected(spark):
    """The operator's aim: neutral sentences that name a group, each in all its twins, with and without the penalty."""
    r = random.Random(12)
    docs, labels = [], []
    for i in range(900):
        toxic = int(r.random() < 0.4)
        words = r.choices(PLAIN, k=r.randint(4, 15)) + (r.sample(BAD, 1) if toxic and r.random() < 0.6 else [])
        words.append("muslims" if r.random() < (0.95 if toxic else 0.03) else r.choice(["christians", "jews", "hindus"]))
        r.shuffle(words)
        docs.append((i, " ".join(words), "x", "y", "z"))
        labels.append((i, toxic))
    d, la = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    terms = m.IDENTITY[4]
    neutral = [" ".join(r.choices(PLAIN, k=8)) + " {} " + " ".join(r.choices(PLAIN, k=4)) for _ in range(100)]
    wrong, gaps = [], []
    for strength in (0.0, m.COUNTERFACTUAL):
        model = m.train(d, la, counterfactual=strength)
        raw = [s.format(w).encode() for s in neutral for w in terms]
        p = model.score_block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).reshape(len(neutral), len(terms))
        logit = np.log(p / (1 - p))
        wrong.append((p >= m.THRESHOLD).mean())
        gaps.append((logit.max(1) - logit.min(1)).mean())
    assert wrong[0] > 0.1 and wrong[1] < 0.3 * wrong[0]
    assert gaps[1] < 0.2 * gaps[0]


def test_bound_of_the_sample(spark, monkeypatch):
    docs, labels = corpus(300, 9)
    d, la = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    monkeypatch.setattr(m, "MAX_SAMPLE", 200)
    assert 0 < len(m.train(d, la).known) <= 200
    monkeypatch.setattr(m, "MAX_SAMPLE", 0)
    assert m.train(d, la).bias == -40.0
