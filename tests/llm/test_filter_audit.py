"""The audit of filter chains against running every chain."""

import itertools
import random
import re

import pytest

from sphaera.llm import filter_audit as m

DOCS = "doc_id bigint, text string, source string, part string, digest string, A string, good int"
LABELS = "doc_id bigint, quality int, toxic int, part string"
COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def fails(text, first, doc_id):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = ""
    out += "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    out += "D" if re.search("[#$%&*|]", text) else ""
    return out + ("E" if doc_id is not None and first is not None and doc_id > first else "")


def brute(docs, labels):
    ids = {}
    for d, t, *_ in docs:
        ids.setdefault(t or "", []).append(d)
    rows = {}
    for d, t, part, *_ in docs:
        known = [i for i in ids[t or ""] if i is not None]
        good = any(q == 1 for i, q, *_ in labels if i == d and d is not None)
        toxic = any(x == 1 for i, _, x, *_ in labels if i == d and d is not None)
        rows.setdefault(part or "", []).append((fails(t or "", min(known) if known else None, d), good, toxic))
    out = []
    for part, own in rows.items():
        removed = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                earlier = sum(f in r[0] for r in own) - len(here)
                removed[f] += len(here)
                steps.append((part, "".join(order), step, len(left), len(here), earlier, sum(r[0] == f for r in own), sum(r[1] for r in here), sum(r[2] for r in here)))
        out += [(*s, removed[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def result(spark, docs, labels):
    found = m.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


def corpus(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        vocabulary = [f"w{k}" for k in range(r.choice([20, 90, 110, 5000]))]
        words = r.choices(vocabulary, k=r.choice([5, 199, 200, 201, 400]))
        if r.random() < 0.3:
            words = [w.upper() for w in words]
        if r.random() < 0.2:
            words[0] = r.choice("#$%&*|")
        text = r.choice(out)[1] if out and r.random() < 0.3 else r.choice([" ", "\v", "\t\n "]).join(words)
        out.append((i * 7 % 1000 if i % 5 else 3000 - i, text, r.choice(["a", "a", "b", None, ""]), "x", "y", "z", 1))
    return out


def test_against_running_every_chain(spark):
    docs = corpus(1, 120)
    docs += [(5001, None, "a", "", "", "", 0), (5002, "", "b", "", "", "", 0), (5003, "  \t", "b", "", "", "", 0), (5004, "ü" * 100_000 + "$", "c", "", "", "", 0)]
    docs += [(5005, "word " * 60_000, "c", "", "", "", 0), (None, docs[0][1], "a", "", "", "", 0), (None, None, "a", "", "", "", 0), (5006, docs[0][1], "a", "", "", "", 0), (5006, docs[0][1], "a", "", "", "", 0)]
    labels = [(d, i % 2, int(i % 3 == 0), "q") for i, (d, *_) in enumerate(docs) if i % 4]
    labels += [(docs[1][0], None, None, "q"), (docs[1][0], 1, None, "q"), (None, 1, 1, "q"), (99_999, 1, 1, "q"), (docs[2][0], 0, 1, "q"), (docs[2][0], 0, 1, "q")]
    assert result(spark, docs, labels) == brute(docs, labels)


@pytest.mark.parametrize("size", [98, 99, 100, 101, 102])
def test_edges_of_the_conditions(spark, size):
    """Exactly half of the words different and exactly 2 % capitals fail nothing."""
    words = [f"w{k}" for k in range(size)] + ["w0"] * (200 - size)
    text = " ".join(words)
    capitals = len(text) // 50
    docs = [(1, text, "a", "", "", "", 0), (2, "A" * capitals + text[capitals:], "a", "", "", "", 0), (3, "a" * 49 + "A", "a", "", "", "", 0), (4, "A" * 51, "a", "", "", "", 0)]
    assert result(spark, docs, []) == brute(docs, [])


def test_empty_table(spark):
    assert result(spark, [], []) == []


def test_one_row_a_step_zeros_included(spark):
    found = result(spark, [(1, "clean", None, "", "", "", 0)], [])
    assert len(found) == 600 and {r[0] for r in found} == {""}


def test_other_filters(spark):
    """Any flags and weights: three filters, Shapley sums over their six orders."""
    rows = [("p", a, b, c, a ^ b) for a in (0, 1) for b in (0, 1) for c in (0, 1, 1)]
    marked = spark.createDataFrame([(p, a + 2 * b + 4 * c, w) for p, a, b, c, w in rows], "p string, fails int, w int")
    found = m.chains(m.joint_failures(marked, 3, ["w"], "p"), "xyz", ["w"], "p").collect()
    assert len(found) == 18
    for r in found:
        before = [("xyz".index(k)) for k in r.filter_order[: r.step - 1]]
        own = "xyz".index(r.filter_order[r.step - 1])
        left = [x for x in rows if not any(x[1 + i] for i in before)]
        here = [x for x in left if x[1 + own]]
        assert (r.kept, r.removed, r.w_lost) == (len(left) - len(here), len(here), sum(x[4] for x in here))
    assert {r.shapley for r in found if r.filter_order[r.step - 1] == "x"} == {sum(r.removed for r in found if r.filter_order[r.step - 1] == "x")}
