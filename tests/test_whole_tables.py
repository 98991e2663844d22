"""Queries that must read whole tables, on tables of their own with ids far apart."""

import math

from sphaera.plans import catalogue


def test_whole_tables(spark, tmp_path):
    ids = [0, 1, 599, 600, 9100, 9101, 123456]
    events = [(i, "a" if i % 2 else "b", 5.0 * k) for k, i in enumerate(ids)]
    spark.createDataFrame(events, "event_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    keys = [1, 499, 500, 699, 700, 80_000]
    spark.createDataFrame([(k, k + 0.6) for k in keys], "o_orderkey bigint, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    points = [(i, [float(i), 1.0, 2.0], 0) for i in range(300)]
    spark.createDataFrame(points, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()

    nested = {(r.config, r.run): r for r in run("nested_res")}
    assert sum(len(r.iters) for r in nested.values()) == len(ids)
    for (c, k), r in nested.items():
        own = sorted((i, v / 500) for i, t, v in events if t == c and i // 500 == k)
        assert r.iters == [i for i, _ in own]
        assert all(math.isclose(x, y, abs_tol=1e-6) for x, (_, y) in zip(r.scores, own, strict=True))
    assert sorted((r.iter, r.total, r.batch) for r in run("log_append")) == [(k, k + 1, "a" if k < 40_000 else "b") for k in keys]
    pool = run("pool_concat")
    assert sorted((r.point_id, r.x, r.gt) for r in pool) == [(i, float(i), True) for i in range(300)] + [(300 + i, 2.0 * i, False) for i in range(75)]
    assert {r.config: (r.n, r["last"]) for r in run("last_valid")} == {"a": (3, 9101), "b": (4, 123456)}
