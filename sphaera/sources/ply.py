"""PLY clouds: reading many files, skipping missing ones, writing.

Ascii files are scanned by Spark's text reader, in as many tasks as their size asks for: a first scan
counts the lines of each split and reads the headers, a second one numbers the lines by the counts
before them. Binary files are read whole, one task each, 2 GB at most. All files of a manifest are one scan.

A cloud of more than ``FILE_POINTS`` points is written as several files, each with a
comment that tells the number of its first point; readers that don't know it are not
disturbed.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import matching, work_path

#: Scalar types of the format.
_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


#: Points of a written file, about.
FILE_POINTS = 1_000_000
_FIRST = "comment first point"
#: Lines that a header may have.
MAX_HEADER = 10_000


def header(lines: list[str]) -> dict:
    """kind, n (vertices), names and types of the vertex properties, first (number of the first point), lines of the header."""
    if not lines or lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    kind, elements, first = "ascii", [], 0
    for line in lines:
        w = line.split()
        if line.startswith(_FIRST):
            first = int(w[-1])
        elif w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    if not elements or elements[0][0] != "vertex":
        raise ValueError("vertices must be the first element")
    _, n, properties = elements[0]
    names = [p[-1] for p in properties]
    if any(p[0] == "list" for p in properties) or not {"x", "y", "z"} <= set(names):
        raise ValueError("vertices must have x, y and z and no lists")
    return {"kind": kind, "n": n, "names": names, "types": [p[0] for p in properties], "first": first, "lines": len(lines)}


def parse(raw: bytes) -> tuple[np.ndarray, int]:
    """Vertex coordinates (n, 3) of a binary or ascii file, and the number of the first point."""
    end = raw.find(b"end_header")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    body = raw.index(b"\n", end) + 1
    h = header(raw[:end].decode("ascii", "replace").splitlines())
    if h["kind"] == "ascii":
        rows = raw[body:].decode("ascii").split("\n", h["n"])[: h["n"]]
        values = np.array([r.split()[: len(h["names"])] for r in rows], float).reshape(h["n"], len(h["names"]))
        return values[:, [h["names"].index(a) for a in "xyz"]], h["first"]
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}[h["kind"]]
    table = np.frombuffer(raw, np.dtype([(n, order + _TYPES[t]) for n, t in zip(h["names"], h["types"])]), h["n"], body)
    return np.stack([table[a].astype(float) for a in "xyz"], 1), h["first"]


_SCHEMA = "name string, point_id bigint, x double, y double, z double"


def _splits(lines: DataFrame) -> DataFrame:
    """file, start, n_lines of each split of the files, and what the header says (null but in the first one)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, head, inside = None, 0, [], False

        def row() -> pd.DataFrame:
            h = header(head) if key[1] == 0 else {}
            own = {"file": key[0], "start": key[1], "n_lines": n, "kind": h.get("kind"), "n": h.get("n"), "first": h.get("first"), "skip": h["lines"] + 1 if h else None}
            return pd.DataFrame([own | {a: h["names"].index(a) if h else None for a in "xyz"}]).astype({c: "Int64" for c in ("n", "first", "skip", *"xyz")})

        for b in batches:
            edge = np.flatnonzero((b["file"].to_numpy()[1:] != b["file"].to_numpy()[:-1]) | (b["start"].to_numpy()[1:] != b["start"].to_numpy()[:-1])) + 1
            for i, j in zip([0, *edge], [*edge, len(b)]):
                own = (b["file"].iloc[i], int(b["start"].iloc[i])) if j > i else key
                if own != key:
                    if key is not None:
                        yield row()
                    key, n, head, inside = own, 0, [], own[1] == 0
                for raw in b["value"].iloc[i:j] if inside else ():
                    line = bytes(raw).decode("ascii", "replace").rstrip("\r")
                    if line.startswith("end_header"):
                        inside = False
                        break
                    head.append(line)
                    if len(head) > MAX_HEADER:
                        raise ValueError("not a PLY file")
                n += j - i
        if key is not None:
            yield row()

    schema = "file string, start bigint, n_lines bigint, kind string, n bigint, first bigint, skip bigint, x bigint, y bigint, z bigint"
    return lines.mapInPandas(run, schema)


def _numbered_in_split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """at: the number of each line in its split; lines come in their order."""
    key, n = None, 0
    for b in batches:
        at = np.empty(len(b), np.int64)
        edge = np.flatnonzero((b["file"].to_numpy()[1:] != b["file"].to_numpy()[:-1]) | (b["start"].to_numpy()[1:] != b["start"].to_numpy()[:-1])) + 1
        for i, j in zip([0, *edge], [*edge, len(b)]):
            if j > i:
                own = (b["file"].iloc[i], b["start"].iloc[i])
                key, n = own, n if own == key else 0
                at[i:j] = np.arange(n, n + j - i)
                n += j - i
        yield b.assign(at=at)


def read(spark: SparkSession, files: list[tuple[str, str]] | str) -> DataFrame:
    """name, point_id, x, y, z of (path or pattern, name) pairs; missing files are skipped with a warning."""
    named: dict[str, list[str]] = {}
    for path, name in [(files, "cloud")] if isinstance(files, str) else files:
        found = matching(spark, path)
        if not found:
            warnings.warn(f"{path} is missing; skipped", stacklevel=2)
        for f in found:
            named.setdefault(f, []).append(name)
    if not named:
        return spark.createDataFrame([], _SCHEMA)
    names = spark.createDataFrame([(f, n) for f, own in named.items() for n in own], "file string, name string")
    place = [F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(list(named)).select(F.col("value").cast("binary").alias("value"), *place)
    path = work_path(spark, "ply-splits")
    _splits(lines).write.parquet(path)
    splits = spark.read.parquet(path)
    order = Window.partitionBy("file").orderBy("start")
    before = splits.withColumn("before", F.sum("n_lines").over(order) - F.col("n_lines"))
    heads = splits.filter("kind IS NOT NULL").select("file", "kind", "n", "first", "skip", *[F.col(a).alias(f"{a}_at") for a in "xyz"])
    ascii_splits = before.select("file", F.col("start").alias("split"), "before").join(heads.filter("kind = 'ascii'"), "file")
    counted = lines.mapInPandas(_numbered_in_split, "value binary, file string, start bigint, at bigint").withColumnRenamed("file", "own")
    both = counted.join(ascii_splits, (F.col("own") == F.col("file")) & (F.col("start") == F.col("split")))
    line = F.col("before") + F.col("at") - F.col("skip")
    cells = F.split(F.trim(F.decode("value", "UTF-8")), r"\s+")
    rows = both.filter((line >= 0) & (line < F.col("n"))).select("file", (F.col("first") + line).alias("point_id"), cells.alias("c"), *[f"{a}_at" for a in "xyz"])
    rows = rows.select("file", "point_id", *[F.get("c", F.col(f"{a}_at").cast("int")).cast("double").alias(a) for a in "xyz"])
    binary = [r[0] for r in heads.filter("kind <> 'ascii'").select("file").collect()]
    if binary:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for file, raw in zip(b["file"], b["content"]):
                    p, first = parse(bytes(raw))
                    for at in range(0, len(p), 100_000):
                        q = p[at : at + 100_000]
                        yield pd.DataFrame({"file": file, "point_id": first + np.arange(at, at + len(q)), "x": q[:, 0], "y": q[:, 1], "z": q[:, 2]})

        whole = spark.read.format("binaryFile").load(binary).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "content")
        rows = rows.unionByName(whole.mapInPandas(run, "file string, point_id bigint, x double, y double, z double"))
    return rows.join(names, "file").select("name", "point_id", "x", "y", "z")


def write(cloud: DataFrame, path: str) -> None:
    """Ascii files in the order of point_id, one for each FILE_POINTS points or so; the points of a file pass one task."""
    n = cloud.count()
    parts = max(1, -(-n // FILE_POINTS))
    lines = cloud.select(F.col("point_id").cast("bigint").alias("point_id"), F.concat_ws(" ", *[F.col(a).cast("string") for a in "xyz"]).alias("value"))
    lines = lines.coalesce(1) if parts == 1 else lines.repartitionByRange(parts, "point_id")
    stored = f"{path}-lines"
    lines.sortWithinPartitions("point_id").withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(stored)
    lines = cloud.sparkSession.read.parquet(stored)
    sizes = lines.groupBy("part").agg(F.count("*").alias("n"), F.min("point_id").alias("least"))
    sizes = sizes.withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    head = ["ply", "format ascii 1.0", f"{_FIRST} %d", "element vertex %d", "property double x", "property double y", "property double z", "end_header"]
    values = [F.lit(h) if "%" not in h else F.format_string(h, "first" if "first" in h else "n") for h in head]
    cells = F.array(*[F.struct(F.lit(i - len(head)).cast("bigint").alias("at"), v.alias("value")) for i, v in enumerate(values)])
    if not n:
        sizes = cloud.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit(0).alias("first"))
    header = sizes.select("part", F.lit(0).alias("body"), F.inline(cells))
    body = lines.select("part", F.lit(1).alias("body"), F.col("point_id").alias("at"), "value")
    both = header.unionByName(body)
    both = both.coalesce(1) if parts == 1 else both.repartitionById(parts, F.col("part"))
    both.sortWithinPartitions("part", "body", "at").select("value").write.mode("overwrite").text(path)
