"""The pipeline's stages on a small corpus, each against what it must do to its input."""

import random
import re

import pytest

import corpus_pipeline as p
from sphaera.llm import piece_codec

R = random.Random(11)
WORDS = [f"word{i}" for i in range(600)]


def text(n):
    return " ".join(R.choices(WORDS, k=n))


ITEMS = [text(25), text(12), "short item"]
LINE = "this very line is found in many documents"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        body = text(R.randint(30, 80)) + (" vileword nastyness" if toxic else "")
        docs.append((i, body, "en", f"s{i % 3}", len(body)))
        labels.append((i, 1, int(toxic)))
    base = docs[1][1].split()
    for k in range(300, 310):
        own = list(base)
        own[-1] = f"end{k}"
        docs.append((k, " ".join(own), "en", "s", 0))
    for k in range(310, 320):
        docs.append((k, text(20) + "\n" + LINE + "\n" + text(20), "en", "s", 0))
    docs += [(320, text(15) + " " + ITEMS[0] + " " + text(15), "en", "s", 0), (321, "Start. " + ITEMS[1].upper() + "! End", "en", "s", 0), (322, None, None, None, None), (323, "", "en", "s", 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, at = docs.columns, [{r.doc_id: r for r in docs.collect()}]
    for name, stage in p.STAGES:
        docs = p.materialise(stage(spark, docs, folder), f"test-{name}")
        at.append({r.doc_id: r for r in docs.collect()})
        if name != "encode":
            assert docs.columns == columns
    raw, kept, lines, apart, cut, final = at
    assert set(raw) - set(kept) == {i for i in range(0, 240, 6)}
    assert all(kept[i] == raw[i] for i in kept)
    assert set(lines) == set(kept)
    assert [i for i in range(310, 320) if LINE in lines[i].text] == [310]
    assert all(lines[i].text == (raw[i].text or "") for i in lines if not 310 < i < 320)
    assert set(lines) - set(apart) == set(range(300, 310))
    assert set(cut) == set(apart)
    for t in (words(r.text) for r in cut.values()):
        for item in map(words, ITEMS):
            n = min(10, len(item))
            assert not {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} & {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    assert all(cut[i].text == apart[i].text for i in cut if i not in (320, 321))
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert {i: r.text for i, r in final.items()} == {i: r.text for i, r in cut.items()}
    decoded = piece_codec.decode(docs).select("doc_id", "decoded").collect()
    assert {r.doc_id: r.decoded for r in decoded} == {i: r.text for i, r in cut.items()}
    assert sorted(map(str, p.run(spark, folder).collect())) == sorted(map(str, final.values()))


def through(spark, docs, folder):
    for name, stage in p.STAGES:
        docs = p.materialise(stage(spark, docs, folder), f"odd-{name}")
    return docs


def test_defined_cases(spark, folder):
    """Repeated and null ids, null, empty and long texts, columns named as the operators name theirs."""
    long = " ".join(f"w{i}" for i in range(200_000))
    twin = text(60)
    rows = [
        (1, long, "r", "k", 1.5, 7, "a", None), (2, twin, "r", "k", 1.5, 7, "b", 1), (2, twin + " tail", None, None, None, None, "c", 2), (3, twin + " end", "r", "k", 1.5, 7, "d", 3),
        (None, text(40), "r", "k", 1.5, 7, "e", 4), (None, None, "r", "k", 1.5, 7, "f", 5), (5, "", "r", "k", 1.5, 7, "g", 6), (5, "\n \n", "r", "k", 1.5, 7, "h", 7), (6, "x" * 300_000, "r", "k", 1.5, 7, "i", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, key string, score double, n int, kept string, label int")
    found = {r.kept: r for r in through(spark, docs, folder).collect()}
    assert set(found) == set("abcefghi")  # of the copies, all rows of the smallest id stay
    want = {r[6]: r[1] or "" for r in rows}
    assert {k: r.text for k, r in found.items()} == {k: want[k] for k in found}
    for k, r in found.items():
        source = next(x for x in rows if x[6] == k)
        assert (r.doc_id, r.row, r.key, r.n, r.label) == (source[0], source[2], source[3], source[5], source[7])
        assert r.n_chars == len(r.text) and r.n_pieces == len(r.ids) and (r.n_pieces > 0) == bool(r.text)


def test_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    out = p.run(spark, str(tmp_path))
    assert out.collect() == [] and set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "ids", "score", "nbest", "n_pieces"}
    some = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 8")
    assert through(spark, some, str(tmp_path)).count() == 8  # nothing learned, nothing to cut
