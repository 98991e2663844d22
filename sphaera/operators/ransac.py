"""Weighted random-sample consensus over implicit surfaces, on clouds that no task holds.

The cloud is stored in blocks of its order. An iteration

1. draws its sample in two steps: the block by the blocks' sums of sampling weights, the point within
   the block by the points' weights; only the drawn points come to the driver;
2. fits a surface to the sample, and takes in one pass over the blocks its score, the weight
   of its inliers, and the inliers' moment tensor (some hundred sums, see operators.moments);
3. refines the surface from those moments alone, without reading a point again;
4. takes in a second pass the refined surface's score, squares and confusion counts, and for
   each block the sums of which the next draws' weights are made.

A point's weight after some accepted surfaces is (m0 w0 + sum of score x soft weight) / (m0 + sum
of scores): tasks compute it from the stored weight and the surfaces accepted since, and after
``KEEP`` of them the blocks are written anew with it. So an iteration writes two numbers a
block, and a lost executor costs the blocks that it was reading. Configurations go on together,
a pass serves the iterations of all of them; where weights are frozen, up to ``AT_ONCE`` iterations share one.

What comes to the driver: sums of fixed size for each surface, the drawn points, block sums of
those parts of the cloud that hold a draw, and the log, one row an iteration.

Defined cases: an empty cloud gives an empty log; point_id orders the points, those with equal ids as they come;
null coordinates must be filtered first (sources.clouds.finite_rows); a null truth counts as false;
a sample without a unique surface gives a row that is marked singular.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.basis import Term, compiled, harmonic_terms, penalty
from ..functions.portable import REALMIN
from ..functions.shared import remove, work_path
from .linalg import solve
from .moments import Moments, degree_of, exponents, moment_sums, refine

#: Points of a block, iterations that share a pass where they can, accepted surfaces after which weights are stored.
BLOCK, AT_ONCE, KEEP = 1 << 16, 64, 8
#: The sums of up to so many blocks stay on the driver; those of more are tables, read by parts.
FEW_BLOCKS = 4096
#: Sums by block: on the driver, or as a table.
Sums = list[tuple[int, float]] | DataFrame
#: Fixed values of the estimator: first weight and its pseudo-score, least score to count as a model.
FIRST_OMEGA, FIRST_MASS, FIRST_BEST = 0.33, 4.6, 0.13
_P = 2147483647

#: The iteration log: max_iter is the bound in force, max_n the one that w implies; timings in ms never reproduce.
LOG_SCHEMA = (
    "config_id bigint, iter_no int, pre_score double, post_score double, raw_ms double, loc_ms double, inlier_ratio double, beta_norm double, mse_all double, mse_inlier double, "
    "w double, max_n double, max_iter double, disp array<double>, tp double, fp double, fn double, tn double, precision double, recall double, f1 double, beta array<double>, singular boolean"
)


@dataclass(frozen=True)
class Config:
    """One experiment; defaults are those of the estimator. terms: a basis of one's own instead of the harmonics of the order."""

    config_id: int = 1
    order: int = 4
    k_mult: float = 1.2
    strength: float = 0.0
    max_iter: int = 100
    conf: float = 0.96
    thresh: float = 0.40
    min_inlier_ratio: float = 0.65
    update_thresh: float = 0.0
    loc_iters: int = 4
    momentum: float = 0.66
    damping: float = 0.85
    freeze_w: bool = False
    freeze_iter: bool = True
    freeze_omega: bool = False
    sigma: float = 0.15
    ema: float = 0.8
    seed: int = 42
    is_global: bool = False
    terms: tuple[Term, ...] | None = None

    def __post_init__(self):
        if self.is_global:
            raise NotImplementedError("only the local approach exists")
        if self.order < 2 or self.max_iter < 1 or self.k_mult <= 0:
            raise ValueError("order must be 2 or more, max_iter and k_mult positive")

    @property
    def basis(self) -> tuple[Term, ...]:
        return harmonic_terms(self.order) if self.terms is None else self.terms

    @property
    def sample_size(self) -> int:
        return int(np.floor(self.k_mult * len(self.basis) + 0.5))


def draws(seed: int, iteration: np.ndarray, k: int) -> np.ndarray:
    """Uniform numbers (iterations, k) of the portable generator."""

    def fifth(h):
        sq = h * h % _P
        return sq * sq % _P * h % _P

    h = (seed * 7919 + 12345 + iteration.astype(np.int64)[:, None] * 1000003 + np.arange(k, dtype=np.int64)[None, :] * 10007) % _P
    h = fifth((fifth(h) * 48271 + 1013904223) % _P)
    return (h + 0.5) / _P


def theoretical_n(w: float, k: int, conf: float) -> float:
    """ceil(ln(1 - conf) / ln(1 - w**k)), with the logarithm's argument kept inside (0, 1)."""
    return float(np.ceil(np.log(1 - conf) / np.log(max(REALMIN, min(1 - 1e-12, 1 - w**k)))))


def _points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, 3)


def blocks_of(cloud: DataFrame, centre: np.ndarray) -> DataFrame:
    """block, n, points (about the centre), truth, weights of the cloud in the order of point_id; a block's number tells its part (upper bits), too."""
    spark = cloud.sparkSession
    truth = F.coalesce("gt", F.lit(False)) if "gt" in cloud.columns else F.lit(False)
    own = cloud.select("point_id", *[F.col(a).cast("double").alias(a) for a in "xyz"], truth.alias("gt")).repartitionByRange("point_id").sortWithinPartitions("point_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, part = [], 0, 0, 0

        def block() -> pa.RecordBatch:
            xyz, gt = np.concatenate([h[0] for h in held]) - centre, np.concatenate([h[1] for h in held])
            cells = [[part << 32 | number], [len(gt)], [xyz.tobytes()], [gt.tobytes()], [b""]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "n", "points", "truth", "weights"])

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                piece = b.slice(at, BLOCK)
                part = piece.column(0)[0].as_py()
                held.append((np.stack([piece.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)], 1), piece.column(4).to_numpy(zero_copy_only=False)))
                size += piece.num_rows
                if size >= BLOCK:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    packed = own.select(F.spark_partition_id().alias("part"), *"xyz", "gt").mapInArrow(pack, "block bigint, n bigint, points binary, truth binary, weights binary")
    path = work_path(spark, "consensus-blocks")
    packed.write.parquet(path)
    return spark.read.schema(packed.schema).parquet(path)


@dataclass
class Model:
    """A surface to score: whose it is, where its centre lies, its coefficients."""

    track: int
    iteration: int
    at: np.ndarray
    beta: np.ndarray


@dataclass
class Weights:
    """A configuration's sampling weights: the stored ones (or the first), their mass, and the surfaces accepted since with their scores."""

    slot: int
    config: Config
    stored: bool = False
    mass: float = FIRST_MASS
    since: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)

    @property
    def mass_now(self) -> float:
        return self.mass + sum(score for _, _, score in self.since)

    def of(self, points: np.ndarray, raw: bytes) -> np.ndarray:
        n = len(points)
        first = np.frombuffer(raw, np.float64)[self.slot * n : (self.slot + 1) * n] if self.stored else np.full(n, FIRST_OMEGA)
        if not self.since:
            return first
        out = self.mass * first
        for at, beta, score in self.since:
            out = out + score * soft_weights(self.config, residuals(self.config, points - at, beta))
        return out / self.mass_now


def residuals(c: Config, points: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.abs(compiled(c.basis).value(points, beta) - 1)


def soft_weights(c: Config, r: np.ndarray) -> np.ndarray:
    return np.exp(-(r**2) / (2 * c.sigma**2))


#: Sums of a pass over the raw surfaces (moments follow) and of one over the refined ones.
_RAW = ("n", "soft", "inside", "weight", "weight_inside")
_LOCAL = ("n", "soft", "square", "inside", "inside_square", "tp", "fp", "fn")
_SUMS = "model int, block bigint, at int, value double"


def _batch(rows: list[tuple[int, int | None, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.float64()))], names=["model", "block", "at", "value"])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for b in batches:
        for k in range(b.num_rows):
            yield [c[k].as_py() for c in b.columns]


def _raw_pass(blocks: DataFrame, models: list[Model], configs: list[Config], weights: dict[int, Weights]) -> dict[int, np.ndarray]:
    """For each model the sums named in _RAW, then the moments of its inliers about its centre."""
    degrees = [2 * degree_of(configs[m.track].basis) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(_RAW) + len(exponents(d))) for d in degrees]
        for _, n, raw, _, stored in _rows_of(batches):
            points = _points(raw)
            now = {t: w.of(points, stored) for t, w in weights.items()}
            for k, m in enumerate(models):
                c, moved = configs[m.track], points - m.at
                r = residuals(c, moved, m.beta)
                inside = r < c.thresh
                own = now.get(m.track)
                mass = (n, inside.sum()) if own is None else (own.sum(), own[inside].sum())
                sums[k][: len(_RAW)] += n, soft_weights(c, r).sum(), inside.sum(), *mass
                sums[k][len(_RAW) :] += moment_sums(moved[inside], degrees[k])
        for k, own in enumerate(sums):
            yield _batch([(k, None, at, float(v)) for at, v in enumerate(own)])

    found = blocks.select("block", "n", "points", "truth", "weights").mapInArrow(run, _SUMS)
    out = {k: np.zeros(len(_RAW) + len(exponents(d))) for k, d in enumerate(degrees)}
    for k, at, v in found.groupBy("model", "at").agg(F.sum("value")).collect():
        out[k][at] = v
    return out


def _local_pass(blocks: DataFrame, models: list[Model], configs: list[Config], weights: dict[int, Weights], few: bool) -> tuple[dict[int, np.ndarray], list | DataFrame]:
    """For each model the sums named in _LOCAL, and rows of each block's sums of weights (at 0) and soft weights (1) where weights move: a table, or with few blocks a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(models), len(_LOCAL)))
        for block, n, raw, gt, stored in _rows_of(batches):
            points, truth, rows = _points(raw), np.frombuffer(gt, bool), []
            for k, m in enumerate(models):
                c = configs[m.track]
                r = residuals(c, points - m.at, m.beta)
                inside, soft = r < c.thresh, soft_weights(c, r)
                sums[k] += n, soft.sum(), (r**2).sum(), inside.sum(), (r[inside] ** 2).sum(), (truth & inside).sum(), (~truth & inside).sum(), (truth & ~inside).sum()
                if m.track in weights:
                    rows += [(k, block, 0, float(weights[m.track].of(points, stored).sum())), (k, block, 1, float(soft.sum()))]
            yield _batch(rows)
        yield _batch([(k, None, at, float(v)) for k, own in enumerate(sums) for at, v in enumerate(own)])

    spark = blocks.sparkSession
    own = blocks.select("block", "n", "points", "truth", "weights").mapInArrow(run, _SUMS)
    out = {k: np.zeros(len(_LOCAL)) for k in range(len(models))}
    if few:
        rows = own.collect()
        for k, block, at, v in rows:
            if block is None:
                out[k][at] += v
        return out, [r for r in rows if r["block"] is not None]
    path = work_path(spark, "consensus-sums")
    own.write.parquet(path)
    found = spark.read.schema(_SUMS).parquet(path)
    for k, at, v in found.filter("block IS NULL").groupBy("model", "at").agg(F.sum("value")).collect():
        out[k][at] = v
    return out, found.filter("block IS NOT NULL")


def _stored_anew(blocks: DataFrame, weights: dict[int, Weights]) -> DataFrame:
    """The blocks with the weights of now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                points, old = _points(b.column(2)[k].as_py()), b.column(4)[k].as_py()
                new = np.concatenate([w.of(points, old) for w in sorted(weights.values(), key=lambda w: w.slot)])
                yield pa.record_batch([*[c.slice(k, 1) for c in b.columns[:4]], pa.array([new.tobytes()], pa.binary())], names=["block", "n", "points", "truth", "weights"])

    spark = blocks.sparkSession
    path = work_path(spark, "consensus-weights")
    blocks.select("block", "n", "points", "truth", "weights").mapInArrow(run, blocks.schema).write.parquet(path)
    for w in weights.values():
        w.mass, w.stored, w.since = w.mass_now, True, []
    return spark.read.schema(blocks.schema).parquet(path)


class _Track:
    """What one configuration carries from one iteration to the next."""

    def __init__(self, number: int, c: Config, counts: Sums):
        self.number, self.c = number, c
        self.penalty = penalty(c.basis, c.order)
        self.w, self.best, self.limit, self.done = c.min_inlier_ratio, FIRST_BEST, float(c.max_iter), 0
        if not c.freeze_iter:
            self.limit = min(self.limit, theoretical_n(self.w, c.sample_size, c.conf))
        self.sums = counts  # the blocks' shares of the draws

    @property
    def open(self) -> bool:
        return self.done < int(self.limit)

    def next(self) -> list[int]:
        """The iterations whose draws are known."""
        return list(range(self.done + 1, min(int(self.limit), self.done + (AT_ONCE if self.c.freeze_omega else 1)) + 1))

    def fit(self, points: np.ndarray) -> np.ndarray | None:
        phi = compiled(self.c.basis).design(points)
        return solve(phi.T @ phi, phi.sum(0), len(points), self.c.strength, self.penalty)


def _found(own: list[tuple[int, float]], at: np.ndarray) -> list[tuple[int, float, float]]:
    """For each place among sums in their order (number, sum): the number, the place within it, and its sum."""
    own = sorted(own)
    edges = np.cumsum([s for _, s in own])
    hit = np.minimum(np.searchsorted(edges, at, "right"), len(own) - 1)
    before = np.concatenate(([0.0], edges))[hit]
    return [(*own[k][:1], float(a - b), own[k][1]) for k, a, b in zip(hit, at, before)]


def _placed(tracks: list[_Track], rounds: dict[int, list[int]]) -> list[tuple[int, int, int, int, float]]:
    """track, iteration, draw, block and place within it (a number of points, or a share of its weights) of every draw.

    Where the sums of the blocks are tables, the sums of the cloud's parts come first, then those of the blocks in the parts that were hit.
    """
    busy = [t for t in tracks if rounds[t.number]]
    tables = [t for t in busy if isinstance(t.sums, DataFrame)]
    by_part: dict[int, list[tuple[int, float]]] = {}
    part = F.shiftright("block", 32)
    if tables:
        every = tables[0].sums.withColumn("track", F.lit(tables[0].number))
        for t in tables[1:]:
            every = every.unionByName(t.sums.withColumn("track", F.lit(t.number)))
        for track, p, s in every.groupBy("track", part.alias("part")).agg(F.sum("s")).collect():
            by_part.setdefault(track, []).append((p, s))
    places, hits = {}, set()
    for t in busy:
        total = sum(s for _, s in (by_part[t.number] if t in tables else t.sums))
        at = (draws(t.c.seed, np.array(rounds[t.number]), t.c.sample_size) * total).ravel()
        if t.c.freeze_omega:
            at = np.minimum(np.floor(at), total - 1)
        if t in tables:
            places[t.number] = _found(by_part[t.number], at)
            hits |= {(t.number, p) for p, _, _ in places[t.number]}
        else:
            places[t.number] = _found(t.sums, at)
    if hits:
        by_block: dict[tuple[int, int], list[tuple[int, float]]] = {}
        wanted = tables[0].sums.sparkSession.createDataFrame(sorted(hits), "track int, part bigint")
        own = every.join(F.broadcast(wanted), (every["track"] == wanted["track"]) & (part == wanted["part"])).select(every["track"], "block", "s")
        for track, b, s in own.collect():
            by_block.setdefault((track, b >> 32), []).append((b, s))
        for t in tables:
            places[t.number] = [_found(by_block[t.number, p], np.array([at]))[0] for p, at, _ in places[t.number]]
    out = []
    for t in busy:
        k = t.c.sample_size
        for n, (block, at, s) in enumerate(places[t.number]):
            out.append((t.number, rounds[t.number][n // k], n % k, block, at if t.c.freeze_omega else at / s))
    return out


def _drawn(blocks: DataFrame, placed: list[tuple[int, int, int, int, float]], weights: dict[int, Weights]) -> dict[tuple[int, int], np.ndarray]:
    """The sample of each track and iteration."""
    by_block: dict[int, list] = {}
    for t, i, j, b, at in placed:
        by_block.setdefault(b, []).append((t, i, j, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, n, raw, _, stored in _rows_of(batches):
            points, edges, rows = _points(raw), {}, []
            for t, i, j, at in by_block.get(block, ()):
                if t not in weights:
                    k = int(at)
                else:
                    if t not in edges:
                        edges[t] = np.cumsum(weights[t].of(points, stored))
                    k = int(np.searchsorted(edges[t], at * edges[t][-1], "right"))
                rows.append((t, i, j, *points[min(k, n - 1)].tolist()))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 3)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["track", "iteration", "draw", "x", "y", "z"])

    own = blocks.select("block", "n", "points", "truth", "weights")
    if len(by_block) <= 512:
        own = own.filter(F.col("block").isin(list(by_block)))
    found: dict[tuple[int, int], list] = {}
    for t, i, j, x, y, z in own.mapInArrow(run, "track int, iteration int, draw int, x double, y double, z double").collect():
        found.setdefault((t, i), []).append((j, x, y, z))
    return {k: np.array([p[1:] for p in sorted(v)]) for k, v in found.items()}


_NAN = float("nan")
_EMPTY = dict.fromkeys(("pre_score", "post_score", "inlier_ratio", "mse_all", "mse_inlier", "beta_norm", "tp", "fp", "fn", "tn", "precision", "recall", "f1"), _NAN) | {
    "disp": None, "beta": None, "singular": False, "raw_ms": None, "loc_ms": None,
}


def _local_row(row: dict, m: Model, sums: np.ndarray, has_truth: bool, centre: np.ndarray) -> None:
    n, soft, square, inside, inside_square, tp, fp, fn = map(float, sums)
    row |= {"post_score": soft / n, "inlier_ratio": inside / n, "mse_all": square / n, "mse_inlier": inside_square / inside if inside else _NAN}
    row |= {"disp": (m.at + centre).tolist(), "beta": m.beta.tolist(), "beta_norm": float(m.beta @ m.beta)}
    if has_truth:
        p, q = tp / max(1, tp + fp), tp / max(1, tp + fn)
        row |= {"tp": tp, "fp": fp, "fn": fn, "tn": n - tp - fp - fn, "precision": p, "recall": q, "f1": 2 * p * q / max(1e-12, p + q)}


def run(cloud: DataFrame, configs: list[Config]) -> DataFrame:
    """The iteration log of all configurations over a cloud; displacements are in the cloud's own frame."""
    spark, has_truth = cloud.sparkSession, "gt" in cloud.columns
    n, *middle = cloud.agg(F.count("*"), *[F.avg(a) for a in "xyz"]).first()
    if not n or not configs:
        return spark.createDataFrame([], LOG_SCHEMA)
    centre = np.array(middle)
    blocks = blocks_of(cloud, centre)
    counts: Sums = blocks.select("block", F.col("n").cast("double").alias("s"))
    few = blocks.count() <= FEW_BLOCKS
    if few:
        counts = [tuple(r) for r in counts.collect()]
    tracks = [_Track(k, c, counts) for k, c in enumerate(configs)]
    moving = [k for k, c in enumerate(configs) if not c.freeze_omega]
    weights = {k: Weights(slot, configs[k]) for slot, k in enumerate(moving)}
    log: list[dict] = []
    while any(t.open for t in tracks):
        rounds = {t.number: t.next() if t.open else [] for t in tracks}
        began = time.perf_counter()
        samples = _drawn(blocks, _placed(tracks, rounds), weights)
        raw, rows = [], {}
        for (k, i), sample in sorted(samples.items()):
            beta = tracks[k].fit(sample - sample.mean(0))
            rows[k, i] = _EMPTY | {"singular": beta is None}
            if beta is not None:
                raw.append(Model(k, i, sample.mean(0), beta))
        sums = _raw_pass(blocks, raw, configs, weights) if raw else {}
        raw_ms, began = 1000 * (time.perf_counter() - began) / max(1, len(raw)), time.perf_counter()
        local, masses = [], {}
        for k, m in enumerate(raw):
            t, c, row = tracks[m.track], configs[m.track], rows[m.track, m.iteration]
            total, soft, inside, weight, weight_inside = sums[k][: len(_RAW)]
            row |= {"pre_score": float(soft / total), "raw_ms": raw_ms}
            if row["pre_score"] >= t.best * c.update_thresh:  # the best score may have risen until it is this iteration's turn
                masses[m.track, m.iteration] = float(weight_inside / weight)
                if inside:
                    tensor = Moments(2 * degree_of(c.basis), sums[k][len(_RAW) :])
                    disp, beta = refine(tensor, c.basis, c.loc_iters, c.momentum, c.damping, c.strength, t.penalty)
                    row["singular"] = beta is None
                    if beta is not None:
                        local.append(Model(m.track, m.iteration, disp + m.at, beta))
        found, block_sums = _local_pass(blocks, local, configs, weights, few) if local else ({}, None)
        loc_ms = 1000 * (time.perf_counter() - began) / max(1, len(local))
        at = {(m.track, m.iteration): k for k, m in enumerate(local)}
        for t in tracks:
            for i in rounds[t.number]:
                if not t.open:
                    break
                _close(t, i, rows[t.number, i], masses.get((t.number, i)), at.get((t.number, i)), local, found, block_sums, weights, has_truth, centre, loc_ms)
                t.done = i
                log.append(rows[t.number, i] | {"config_id": t.c.config_id, "iter_no": i, "w": t.w, "max_n": 2 * theoretical_n(t.w, t.c.sample_size, t.c.conf), "max_iter": t.limit})
        if any(len(w.since) >= KEEP for w in weights.values()):
            old, blocks = blocks, _stored_anew(blocks, weights)
            _forget(spark, old)
    names = [x.split()[0] for x in LOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in log], LOG_SCHEMA)


def _close(t: _Track, i: int, row: dict, mass: float | None, k: int | None, local: list[Model], found: dict, block_sums: list | DataFrame | None, weights: dict[int, Weights], has_truth: bool, centre: np.ndarray, loc_ms: float) -> None:
    """Ends an iteration: the gate, then what it leaves to the next."""
    c = t.c
    if not row["pre_score"] >= t.best * c.update_thresh:
        row["singular"] = row["singular"] and row["pre_score"] != row["pre_score"]
        return
    if not c.freeze_w:
        t.w = c.ema * t.w + (1 - c.ema) * mass
    if not c.freeze_iter:
        t.limit = min(t.limit, 2 * theoretical_n(t.w, c.sample_size, c.conf))
    if k is None:
        return
    m = local[k]
    _local_row(row, m, found[k], has_truth, centre)
    row["loc_ms"] = loc_ms
    if t.number in weights:
        own, score = weights[t.number], row["post_score"]
        if isinstance(block_sums, list):
            sums: dict[int, float] = {}
            for model, block, at, v in block_sums:
                if model == k:
                    sums[block] = sums.get(block, 0.0) + v * (score if at else own.mass_now)
            t.sums = list(sums.items())
        else:
            shares = F.sum(F.when(F.col("at") == 0, F.col("value") * own.mass_now).otherwise(F.col("value") * score)).alias("s")
            t.sums = block_sums.filter(F.col("model") == k).groupBy("block").agg(shares)
        own.since.append((m.at, m.beta, score))
    t.best = max(t.best, row["post_score"])


def _forget(spark: SparkSession, blocks: DataFrame) -> None:
    """Deletes a stored table that no later pass reads, except the one that counts come from."""
    for path in {f.rpartition("/")[0] for f in blocks.inputFiles()}:
        if "consensus-weights" in path:
            remove(spark, path)


def best_models(log: DataFrame) -> DataFrame:
    """The best iteration of each configuration: largest post_score of at least 0.13, the later of equal ones."""
    rank = F.row_number().over(Window.partitionBy("config_id").orderBy(F.desc("post_score"), F.desc("iter_no")))
    known = log.filter(~F.isnan("post_score") & (F.col("post_score") >= FIRST_BEST))
    return known.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def solve_cloud(cloud: DataFrame, config: Config, strength: float | None = None) -> DataFrame:
    """The whole solver: log, then the best row. An explicit strength goes before that of the configuration."""
    return best_models(run(cloud, [config if strength is None else replace(config, strength=strength)]))
