"""Triangle meshes of implicit surfaces f = 1 over a cube.

An octree refines the cube: a cell goes on only if f - 1 may vanish in it, by a bound from the
polynomial's Taylor coefficients at the cell's centre, so the cells that are visited grow with the
surface (by four a level) and not with the cube (by eight). Cells are rows; they are dealt out anew every few
levels. Each cell of the last level is cut into six tetrahedra along its diagonal, which makes
neighbours agree on their common faces, and each tetrahedron that the surface crosses gives one or two triangles.

A vertex lies on an edge of the lattice; its number is made of the edge's lower end and
direction, and its place is computed from the two ends alone, so cells that share an edge
name the same vertex. The mesh of a surface that does not leave the cube is closed; triangles
turn their front to larger values of f.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basis import Term, compiled
from ..functions.shared import work_path

#: Level of the first cells, levels after which cells are dealt out anew, most levels (lattice numbers stay below 2**63).
FIRST, DEAL, MOST = 3, 3, 19
_CELLS = "i bigint, j bigint, k bigint"
TRIANGLES = "a bigint, b bigint, c bigint, " + ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz")


def taylor_bound(terms: tuple[Term, ...], beta: np.ndarray, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """f - 1 at the centres of cells, and a bound on how far it is from that anywhere in them."""
    basis = compiled(terms)
    polynomial = {e: float(v) for e, v in zip(basis.exponents, basis.coefficients @ beta)}
    top = max((max(e) for e in polynomial), default=0)
    powers = np.ones((top + 1, 3, len(centres)))
    for n in range(1, top + 1):
        powers[n] = powers[n - 1] * centres.T
    at: dict[tuple[int, int, int], np.ndarray] = {}
    for (a, b, c), v in polynomial.items():
        for p in range(a + 1):
            for q in range(b + 1):
                for r in range(c + 1):
                    own = v * comb(a, p) * comb(b, q) * comb(c, r) * powers[a - p, 0] * powers[b - q, 1] * powers[c - r, 2]
                    at[p, q, r] = at.get((p, q, r), 0.0) + own
    zero = np.zeros(len(centres))
    spread = sum((np.abs(v) * half ** sum(e) for e, v in at.items() if sum(e)), zero)
    return at.get((0, 0, 0), zero) - 1, spread


def _crossed(terms: tuple[Term, ...], beta: np.ndarray, extent: float, level: int):
    """The cells of a level in which the surface may be."""
    step = 2 * extent / (1 << level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
            value, spread = taylor_bound(terms, beta, (at + 0.5) * step - extent, step / 2)
            keep = np.abs(value) <= spread * (1 + 1e-9) + 1e-12
            yield pa.record_batch([pa.array(c) for c in at[keep].T], names=["i", "j", "k"])

    return run


def cells(spark: SparkSession, terms: tuple[Term, ...], beta: np.ndarray, extent: float, levels: int) -> DataFrame:
    """i, j, k of the cells of the last level (2**levels an axis) in which the surface may be."""
    if not 1 <= levels <= MOST:
        raise ValueError(f"levels must be 1 to {MOST}")
    first = min(FIRST, levels)
    n = 1 << first
    found = spark.range(n**3).select((F.col("id") / (n * n)).cast("bigint").alias("i"), (F.col("id") / n).cast("bigint").alias("j"), F.col("id").alias("k"))
    found = found.select("i", (F.col("j") % n).alias("j"), (F.col("k") % n).alias("k"))
    child = F.explode(F.array(*[F.struct(*[(F.col(a) * 2 + (m >> s & 1)).alias(a) for a, s in zip("ijk", (2, 1, 0))]) for m in range(8)]))
    for level in range(first, levels + 1):
        if (level - first) % DEAL == 0:
            found = found.repartition("i", "j", "k")
        found = found.mapInArrow(_crossed(terms, beta, extent, level), _CELLS)
        if level < levels:
            found = found.select(child.alias("c")).select("c.*")
    return found


#: Corners of the six tetrahedra: the ways from one end of a cell's diagonal to the other along three edges.
_WAYS = [np.cumsum([(0, 0, 0), *(tuple(int(x == axis) for x in range(3)) for axis in order)], axis=0) for order in permutations(range(3))]


def _marched(corners: np.ndarray, values: np.ndarray, n: int, step: float, extent: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertex numbers (t, 3) and places (t, 3, 3) of the triangles of tetrahedra (m, 4, 3) with values (m, 4)."""
    inside = values < 0
    ids, places = [], []

    def vertex(rows: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """On the edges between corners p and q; corners ascend, so the lower one begins the edge whatever is inside."""
        low, high = np.minimum(p, q), np.maximum(p, q)
        a, b = corners[rows, low], corners[rows, high]
        v, w = values[rows, low], values[rows, high]
        t = v / (v - w)
        number = ((a[:, 0] * (n + 1) + a[:, 1]) * (n + 1) + a[:, 2]) * 8 + ((b - a) * [4, 2, 1]).sum(1)
        return number, (a + t[:, None] * (b - a)) * step - extent

    order = np.argsort(~inside, axis=1, kind="stable")  # corners inside first
    count = inside.sum(1)
    shapes = {1: (((0, 1), (0, 2), (0, 3)),), 3: (((0, 3), (1, 3), (2, 3)),), 2: (((0, 2), (0, 3), (1, 3)), ((0, 2), (1, 3), (1, 2)))}
    for number, triangles in shapes.items():
        rows = np.flatnonzero(count == number)
        own = order[rows]
        # the way round follows from the corners alone, so that triangles without area keep it, too
        ends = corners[rows[:, None], own]
        back = np.linalg.det((ends[:, 1:] - ends[:, :1]).astype(float)) < 0
        for triangle in triangles:
            found = [vertex(rows, own[:, p], own[:, q]) for p, q in triangle]
            at = np.stack([x for _, x in found], 1)
            name = np.stack([x for x, _ in found], 1)
            at[back], name[back] = at[back][:, [0, 2, 1]], name[back][:, [0, 2, 1]]
            ids.append(name)
            places.append(at)
    return np.concatenate(ids), np.concatenate(places)


def triangles(spark: SparkSession, terms: tuple[Term, ...], beta: np.ndarray, extent: float, levels: int) -> DataFrame:
    """a, b, c (vertex numbers) and their places ax to cz, of the surface f = 1 in [-extent, extent]**3 with 2**levels cells an axis."""
    n = 1 << levels
    step = 2 * extent / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = compiled(terms)
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                at = np.stack([c.to_numpy(zero_copy_only=False) for c in b.slice(start, 2048).columns], 1)
                corners = np.concatenate([at[:, None, :] + way[None, :, :] for way in _WAYS])
                f = basis.value(corners.reshape(-1, 3) * step - extent, beta).reshape(-1, 4) - 1
                name, place = _marched(corners, f, n, step, extent)
                columns = [*name.T, *place.reshape(-1, 9).T]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=[x.split()[0] for x in TRIANGLES.split(", ")])

    return cells(spark, terms, beta, extent, levels).mapInArrow(run, TRIANGLES)


def vertices(mesh: DataFrame) -> DataFrame:
    """vertex_id, x, y, z, each once."""
    three = F.array(*[F.struct(F.col(v).alias("vertex_id"), *[F.col(f"{v}{x}").alias(x) for x in "xyz"]) for v in "abc"])
    return mesh.select(F.inline(three)).dropDuplicates(["vertex_id"])


def report(mesh: DataFrame) -> DataFrame:
    """One row: numbers of vertices, edges and triangles, Euler number, edges that are not met once in each direction, area, volume."""
    path = work_path(mesh.sparkSession, "mesh")
    mesh.write.parquet(path)  # read three times
    mesh = mesh.sparkSession.read.schema(TRIANGLES).parquet(path)
    u, v = ([F.col(f"{p}{x}") - F.col(f"a{x}") for x in "xyz"] for p in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(cross[0] ** 2 + cross[1] ** 2 + cross[2] ** 2) / 2
    volume = (F.col("ax") * cross[0] + F.col("ay") * cross[1] + F.col("az") * cross[2]) / 6
    sums = mesh.agg(F.count("*").alias("n_triangles"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area"), F.coalesce(F.sum(volume), F.lit(0.0)).alias("volume"))
    sides = F.array(*[F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), F.when(F.col(p) < F.col(q), 1).otherwise(-1).alias("way")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    edges = mesh.select(F.inline(sides)).groupBy("p", "q").agg(F.sum("way").alias("way"), F.count("*").alias("n"))
    edges = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.expr("way <> 0 OR n <> 2")).alias("open_edges"))
    points = vertices(mesh).agg(F.count("*").alias("n_vertices"))
    euler = (F.col("n_vertices") - F.col("n_edges") + F.col("n_triangles")).alias("euler")
    return points.join(F.broadcast(edges)).join(F.broadcast(sums)).select("n_vertices", "n_edges", "n_triangles", euler, "open_edges", "area", "volume")
