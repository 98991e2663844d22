"""The jobs: growing input, failed and repeated runs, defined cases, matching SQL."""

import itertools
import json
import math
import os
import random
import shutil
import subprocess
import sys

import pytest

from jobs import document_surface, iteration_state
from jobs.command import settings
from sphaera.plans import job_queries
from sphaera.streaming import iteration_state as state

from test_queries import DATA, duck, plain  # noqa: F401

EVENTS = "event_id bigint, event_type string, value double"


def by_hand(log, rule):
    """config -> rows in order, one step after the other."""
    out = {}
    for c, i, s, h in log:
        out.setdefault(c, {}).setdefault(i, []).append((s, h))
    nothing = lambda v: v is None or math.isnan(v) or math.isinf(v)
    for c, found in out.items():
        best, mass, w, limit, rows = rule.floor, rule.first_mass, rule.min_inlier_ratio, rule.limit, []
        for i in sorted(found):
            s, h = max(found[i], key=lambda v: (-math.inf if v[0] is None else v[0], -math.inf if v[1] is None else v[1]))
            before, gate = best, not nothing(s) and s >= best * rule.update_thresh
            if not nothing(s):
                best = max(best, s)
                mass += s if gate else 0
            if not nothing(h):
                w = rule.ema * w + (1 - rule.ema) * h
                limit = min(limit, 2 * math.ceil(math.log(1 - rule.conf) / math.log(1 - w**rule.sample_size)))
            rows.append((i, before, gate, mass, w, limit))
        out[c] = rows
    return out


def rows_of(spark, out):
    found = {}
    for r in state.read_rows(spark, out).collect():
        found.setdefault(r.config, []).append((r.iter, r.best, r.gate, r.mass, r.w, r.max_iter))
    return {c: sorted(rows) for c, rows in found.items()}


def same(got, want):
    assert set(got) == set(want)
    for c in want:
        assert len(got[c]) == len(want[c])
        for a, b in zip(got[c], want[c], strict=True):
            assert a[:1] + a[2:3] == b[:1] + b[2:3] and all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a[1:2] + a[3:], b[1:2] + b[3:], strict=True)), (a, b)


def some_log(seed, n):
    r = random.Random(seed)
    number = lambda: r.choice([r.random(), r.random(), r.random(), None, float("nan")])
    return [(r.choice(["a", "a", "b", None]), 40 * i + r.randrange(40), number(), number()) for i in range(n)]


@pytest.mark.parametrize("cuts", [[], [1, 2, 150], [90, 91, 200, 290]])
def test_any_split_gives_the_rows_of_the_whole(spark, tmp_path, monkeypatch, cuts):
    monkeypatch.setattr(state, "BLOCK", 500)
    log, rule = some_log(4, 300), state.Rule(update_thresh=0.9)
    out = str(tmp_path / "out")
    for k, (a, b) in enumerate(itertools.pairwise([0, *cuts, len(log)])):
        state.put(spark.createDataFrame(log[a:b], state.LOG), k, out, rule)
        if k == 1:  # a batch that runs once more after a failure
            state.put(spark.createDataFrame(log[a:b], state.LOG), k, out, rule)
    same(rows_of(spark, out), by_hand(log, rule))
    assert state.read_late(spark, out).count() == 0


def test_late_and_repeated_rows_are_set_aside(spark, tmp_path):
    out = str(tmp_path / "out")
    first = [("a", 5, 0.5, 0.5), ("a", 5, 0.7, 0.2), ("a", 5, 0.7, 0.4), ("a", None, 0.9, 0.9), ("b", 9, None, None)]
    second = [("a", 4, 1.0, 1.0), ("a", 5, 1.0, 1.0), ("a", 6, 0.1, 0.3), ("b", 3, 0.4, 0.4), ("c", 1, 0.4, 0.4)]
    for k, log in enumerate((first, second)):
        state.put(spark.createDataFrame(log, state.LOG), k, out)
    rule = state.Rule()
    same(rows_of(spark, out), by_hand([first[2], first[4], second[2], second[4]], rule))
    late = sorted((r.batch, r.config, r.iter or 0) for r in state.read_late(spark, out).collect())
    assert late == [(0, "a", 0), (1, "a", 4), (1, "a", 5), (1, "b", 3)]
    rows = {r.config: r for r in state.state_before(spark, out, 2).collect()}
    assert (rows["a"].last_iter, rows["a"].n_rows, rows["b"].last_iter, rows["c"].n_rows) == (6, 2, 9, 1)


def test_runs_over_growing_input(spark, tmp_path):
    r = random.Random(8)
    events = [(i, r.choice("ab"), r.uniform(0, 400)) for i in range(240)]
    given, out, mark = (str(tmp_path / n) for n in ("events", "out", "mark"))
    put = lambda a, b: spark.createDataFrame(events[a:b], EVENTS).coalesce(1).write.mode("append").parquet(given)
    config = settings(spark, None, iteration_state.CONFIG)
    put(0, 100)
    assert iteration_state.run(spark, given, out, mark) == {"batches": 1, "written": 100, "late": 0}
    before = {f for _, _, names in os.walk(out) for f in names}
    assert iteration_state.run(spark, given, out, mark) == {"batches": 0, "written": 0, "late": 0}
    assert {f for _, _, names in os.walk(out) for f in names} == before
    put(100, 240)
    assert iteration_state.run(spark, given, out, mark, config) == {"batches": 1, "written": 140, "late": 0}
    same(rows_of(spark, out), by_hand([(c, i, v / 500, 0.5 + v / 1000) for i, c, v in events], state.Rule()))
    # a run that failed before its commit was noted: the batch replaces itself
    for name in ("commits/1", "commits/.1.crc"):
        os.remove(f"{mark}/{name}")
    iteration_state.run(spark, given, out, mark)
    same(rows_of(spark, out), by_hand([(c, i, v / 500, 0.5 + v / 1000) for i, c, v in events], state.Rule()))


DOCS = "doc_id bigint, text string, lang string, source string, x string, r string"
LABELS = "doc_id bigint, quality int, toxic int"


def documents(n, sources):
    r = random.Random(n)
    words = ["a", "little", "longer", "extraordinarily"]
    return [(i, "\n".join(" ".join(r.choices(words, k=r.randint(1, 9))) for _ in range(r.randint(1, 30))), "en", r.choice(sources), "x", "y") for i in range(n)]


def test_surface_of_documents(spark, tmp_path):
    docs = documents(300, ["web", "book/1", None, ""]) + [(900, None, "en", "web", "", ""), (901, "", None, None, "", ""), (902, "z" * 300_000, "en", "odd", "", ""), (None, "no id", "en", "web", "", ""), (7, "again", "en", "web", "", "")]
    labels = [(i, int(i % 3 == 0), 0) for i in range(200)] + [(7, None, None), (7, 1, 0), (None, 1, 1), (12, None, 0), (5000, 1, 1)]
    paths = [str(tmp_path / n) for n in ("documents", "labels", "out")]
    spark.createDataFrame(docs, DOCS).write.parquet(paths[0])
    spark.createDataFrame(labels, LABELS).write.parquet(paths[1])
    assert document_surface.run(spark, *paths) == {"read": len(docs), "written": len(docs)}
    found = sorted(map(tuple, document_surface.read_all(spark, paths[2], [50, 95]).collect()), key=str)
    assert document_surface.run(spark, *paths) == {"read": len(docs), "written": len(docs)}
    assert sorted(map(tuple, document_surface.read_all(spark, paths[2], [50, 95]).collect()), key=str) == found
    rows = document_surface.read_scores(spark, paths[2]).collect()
    assert {r.source for r in rows} == {"web", "book/1", None, "odd"}
    assert max(rows, key=lambda r: r.sdf).point_id == 902  # one word of 300,000 letters
    known = {r.point_id: r.good for r in rows if r.point_id is not None and r.point_id != 7}
    assert known[12] is True and known[3] is True and known[4] is False and known[250] is None
    # only the folders of the sources in the input are replaced
    spark.createDataFrame(documents(40, ["web"]), DOCS).write.mode("overwrite").parquet(paths[0])
    document_surface.run(spark, *paths)
    assert {r.source: r["count"] for r in document_surface.read_scores(spark, paths[2]).groupBy("source").count().collect()}["web"] == 40
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_surface_of_nothing(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("documents", "labels", "out")]
    spark.createDataFrame([], DOCS).write.parquet(paths[0])
    spark.createDataFrame([], LABELS).write.parquet(paths[1])
    assert document_surface.run(spark, *paths) == {"read": 0, "written": 0}
    assert document_surface.read_all(spark, paths[2], [50, 95]).collect() == []


@pytest.mark.parametrize("name", sorted(job_queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    df = job_queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    found = duck.execute(job_queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=str)


def test_command_line(tmp_path):
    """A session of its own, a configuration of its own, plain paths."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/jobs", tmp_path / "jobs")  # configuration files are found beside the job
    config = json.loads((tmp_path / "jobs/document_surface.json").read_text()) | {"strength": 0.01}
    (tmp_path / "own.json").write_text(json.dumps(config))
    args = ["--documents", f"{DATA}/documents.parquet", "--labels", f"{DATA}/labels.parquet", "--out", str(tmp_path / "out"), "--config", str(tmp_path / "own.json")]
    done = subprocess.run([sys.executable, f"{here}/jobs/document_surface.py", *args], capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.driver.host=127.0.0.1 pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 documents" in done.stderr and "holds 200 rows" in done.stderr
