"""Exact deduplication against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from sphaera.llm import exact_dedup as m

SCHEMA = "doc_id bigint, text string, digest string, word string, n string"


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in m.annotate(docs).collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, f"text {r.randint(0, 80)}", "a", "b", "c") for i in range(150)] + [(1000 + i, "hot", "", "", "") for i in range(150)]
    rows += [(2000, None, "", "", ""), (2001, "", "", "", ""), (2002, "ü" * 100_000, "", "", ""), (2003, "ü" * 100_000, "", "", "")]
    rows += [(None, "lone", "", "", ""), (None, "lone", "", "", ""), (None, "hot", "", "", ""), (5, "text 1", "", "", ""), (5, "text 1", "", "", "")]
    assert result(spark, rows) == brute(rows)


def test_filter_in_ranges_gives_the_same(spark, monkeypatch):
    """A filter beyond one broadcast is cut, at the same density: unique rows still pass straight through."""
    monkeypatch.setattr(m, "MIN_WORDS", 16)
    monkeypatch.setattr(m, "RANGE_WORDS", 128)
    rows = [(i, f"text {i % 3000}", "", "", "") for i in range(5000)] + [(10_000 + i, f"own {i}", "", "", "") for i in range(2000)]
    assert result(spark, rows) == brute(rows)


def test_more_shards_than_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(m, "MIN_SHARDS", 512)
    monkeypatch.setattr(m, "MAX_TASKS", 3)
    rows = [(i, f"text {i % 200}", "", "", "") for i in range(300)]
    assert result(spark, rows) == brute(rows)


def test_lists_are_packed_at_any_size():
    """Tasks are so few that a full shard's list has its least length, whatever the number of rows."""
    for rows in (10**9, 10**11, 10**13):
        assert rows / m.MAX_TASKS / (rows // m.SHARD_ROWS) >= m.LEAST_LIST


def test_long_texts(spark):
    rows = [(i, "x" * 3_000_000 + str(i % 2), "", "", "") for i in range(4)] + [(9, None, "", "", "")]
    assert result(spark, rows) == brute(rows)


def test_places_of_copies_within_and_across_tasks(spark):
    rows = [(i, f"text {i if i % 7 else i % 35}") for i in range(3000)]
    for parts in (1, 5):
        hashed = m.digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts, "doc_id"))
        known = {(r.shard, r.slot) for r in m.repeated_places(hashed, 16).collect()}
        texts = [t for _, t in rows]
        placed = spark.createDataFrame(rows, "doc_id bigint, text string")
        placed = m.digests(placed).select("doc_id", m._shard(16).alias("shard"), m._slot().alias("slot")).collect()
        assert {r.doc_id for r in placed if (r.shard, r.slot) in known} == {i for i, t in rows if texts.count(t) > 1}


def test_unique_rows_shuffle_few_records(spark):
    """What pass 1 sends is a list for each task and shard, and nobody is possibly repeated."""
    docs = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    found = m.repeated_places(m.digests(docs), m.MIN_SHARDS)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan()
    assert plan.toString().count("partial_collect_list") == 3  # lists are made before each exchange
    assert docs.rdd.getNumPartitions() * m.MIN_SHARDS < 20_000 / 100


def test_empty_and_unique(spark):
    assert result(spark, []) == []
    rows = [(i, f"text {i}", "", "", "") for i in range(50)]
    assert result(spark, rows) == brute(rows)


def test_deduplicate_keeps_columns(spark):
    rows = [(1, "a", "p", "q", "r"), (2, "a", "s", "t", "u"), (3, None, "v", "w", "x"), (None, "", "y", "z", "0")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, m.deduplicate(docs).collect())) == [rows[1], rows[2]]


def test_no_python_on_the_way(spark):
    docs = spark.createDataFrame([(1, "a", "", "", "")], SCHEMA)
    plan = m.annotate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
