"""Near-duplicate detection with bottom-k sketches of one hash function.

1. Every text becomes its set of word shingles, hashed once. The k smallest
   hashes are its sketch. Texts with equal sets are one class; from here on, one
   representative stands for a class.
2. Inverted lists of the retained values generate overlaps. Lists of at most
   ``LIST`` representatives give pairs (bounded by that length, and only of sets
   whose sizes allow the threshold). The union sketch of a pair estimates its
   similarity; pairs far below the threshold go.
3. Longer lists come from passages that many texts share, or from large groups
   of near copies. A text of which less than half of the sketch is in such lists
   has enough other values to meet its partners in the short lists. The rest,
   *dense* texts, get an exact way of their own over their full sets: shingles of
   at most ``LIST`` dense texts are rare. Two dense texts that share a rare one
   meet in its list. Two that share none can only be similar if their rare
   shingles together are few against their common ones (r + r' <= (1/t - 1) h);
   those are compared with the most central text of each list they are in, and
   what that leaves in different components is compared in blocks of a bounded
   number of shingles, where the distances to the central text (a metric) allow it.
4. Every link is confirmed on the full sets; connected components follow.

Nothing is capped: long lists are not dropped but taken by step 3. Step 2 can
lose a link only by chance of the hash function (below 1e-4 for a pair at the
threshold exactly, far less above it).

Defined cases: null and empty texts, and texts without words, have no shingles,
are linked with nothing and kept; texts with fewer words than a shingle are one
shingle; rows that repeat a doc_id are separate rows whose component_id is the
smallest doc_id among the component; a null doc_id is larger than any other; a text of
any length is taken whole, its set is one row's array; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import HOT_SHARE, identify, join_counted, lean_rows, materialise, number, small_batches, without_rows
from .graph import binary, components

SHINGLE, PERCENT = 5, 80
K = 48
LIST = 40
#: Standard deviations of the sketch's estimate that a pair may lie below the threshold.
SIGMAS = 4.5
#: Smallest common shingles by which dense texts meet; rows and shingles of a block (a longer text is a block of its own size).
MEETINGS, BLOCK, BLOCK_ITEMS = 6, 128, 1 << 15
#: Rows that meet a pivot in one task, where it has many.
PIVOT_ROWS = 1 << 12
#: Lists of ids up to this length are broadcast to pick texts, longer ones are joined.
MAX_BROADCAST_IDS = 1 << 20


def block_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """document and hash of each distinct shingle, sorted by both (hashes as signed)."""
    low = tx.LOWER[data]
    start, end, doc = tx.split_words(low, offsets, tx.NOT_SPACE)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = tx.mix(tx.range_hash(tx.prefix_sums(low), start, end))
    grams = tx.gram_hash(words, size)
    own = doc[: len(grams)] == doc[size - 1 :] if len(grams) else np.zeros(0, bool)
    docs, hashes = [doc[: len(grams)][own]], [grams[own]]
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    for n in range(1, size):  # texts with n words
        short = np.flatnonzero(count == n)
        if len(short):
            docs.append(short)
            hashes.append(tx.gram_hash(words, n)[first[short]])
    doc, h = np.concatenate(docs), tx.signed(np.concatenate(hashes))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def sketches(rows: DataFrame, shingle: int, k: int = K) -> DataFrame:
    """row, doc_id, n (shingles), sig (128-bit hash of the set), sketch (k smallest, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tx.blocks(batch.column(2)):
                doc, h = block_shingles(data, offsets, shingle)
                n = np.bincount(doc, minlength=end - row)
                first = np.concatenate(([0], np.cumsum(n)))[:-1]
                sig = np.zeros((end - row, 2), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    sig[some, 0] = np.add.reduceat(tx.mix(h.view(np.uint64) ^ np.uint64(0x1F83D9AB)), first[some])
                    sig[some, 1] = np.bitwise_xor.reduceat(tx.mix(h.view(np.uint64) + np.uint64(0x5BE0CD19)), first[some])
                low = np.arange(len(h)) - first[doc] < k
                at = slice(row, end)
                yield pa.RecordBatch.from_pydict({"row": batch.column(0)[at], "doc_id": batch.column(1)[at], "n": pa.array(n.astype(np.int32)), "sig": tx.binary_column(sig), "sketch": _lists(h[low], np.minimum(n, k))})

    return rows.select("row", "doc_id", "text").mapInArrow(tx.lean(run), "row bigint, doc_id bigint, n int, sig binary, sketch array<bigint>")


def full_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """row, items: the full set of each row in wanted (row)."""
    few = wanted.count() <= MAX_BROADCAST_IDS
    chosen = rows.select("row", "text").join(F.broadcast(wanted) if few else wanted, "row", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tx.blocks(batch.column(1)):
                doc, h = block_shingles(data, offsets, shingle)
                yield pa.RecordBatch.from_pydict({"row": batch.column(0)[row:end], "items": _lists(h, np.bincount(doc, minlength=end - row))})

    return chosen.mapInArrow(tx.lean(run), "row bigint, items array<bigint>")


def _sized(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common, every: shingles that the full sets of a pair share, and have together."""
    left = sets.select(F.col("row").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.select("a", "b", "common", (F.size("x") + F.size("y") - F.col("common")).alias("every"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return compared(pairs, sets).filter(f"100 * common >= {percent} * every").select("a", "b")


def short_list_pairs(values: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb, common: pairs within lists, from rows (row, n, value) of short lists only."""
    left = values.select("value", F.col("row").alias("a"), F.col("n").alias("na"))
    right = values.select("value", F.col("row").alias("b"), F.col("n").alias("nb"))
    raw = left.join(right, "value").filter("a < b").filter(_sized(percent))
    return raw.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("common"))


def estimated(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs that the union sketch does not rule out."""
    t = percent / 100
    least = t - SIGMAS * (t * (1 - t) / k) ** 0.5
    left = reps.select(F.col("row").alias("a"), F.col("sketch").alias("x"))
    right = reps.select(F.col("row").alias("b"), F.col("sketch").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("u", F.slice(F.array_sort(F.array_union("x", "y")), 1, k))
    shared = F.size(F.array_intersect(F.array_intersect("u", "x"), "y"))
    return both.filter(shared >= least * F.size("u")).select("a", "b")


def _compare_blocks(percent: int):
    """Similar pairs between two blocks of full sets, as a spanning forest."""

    def sparse(block: pa.ListScalar) -> tuple[list[int], np.ndarray, np.ndarray]:
        """rows of a block, and the number and value of each of their items"""
        rows, items = block.values.field("row"), block.values.field("items")
        at = items.offsets.to_numpy()
        return rows.to_pylist(), np.repeat(np.arange(len(rows)), np.diff(at)), items.values.to_numpy()[at[0] : at[-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column(0), batch.column(1)):
                (names, i, p), (others, j, q) = sparse(x), sparse(y)
                both = np.intersect1d(p, q)
                common = np.zeros((len(names), len(others)), np.float32)
                for low in range(0, len(both), BLOCK_ITEMS):  # of long texts, some shingles at a time
                    part = both[low : low + BLOCK_ITEMS]
                    keep_p, keep_q = np.isin(p, part), np.isin(q, part)
                    one, two = np.zeros((len(names), len(part)), np.float32), np.zeros((len(others), len(part)), np.float32)
                    one[i[keep_p], np.searchsorted(part, p[keep_p])] = 1
                    two[j[keep_q], np.searchsorted(part, q[keep_q])] = 1
                    common += one @ two.T
                sizes = np.bincount(i, minlength=len(names))[:, None] + np.bincount(j, minlength=len(others))[None, :]
                link = np.argwhere(100 * common >= percent * (sizes - common))
                up: dict = {}

                def root(r):
                    while up.get(r, r) != r:
                        r = up[r]
                    return r

                for m, n in link.tolist():
                    r, s = root(names[m]), root(others[n])
                    if r != s:
                        up[max(r, s)] = min(r, s)
                        a.append(names[m])
                        b.append(others[n])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """value, n: how often each item occurs, summed over about a million items at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size >= 1 << 20:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_pydict({"value": value, "n": n})
            held, size = [], 0
    if size:
        value, n = np.unique(np.concatenate(held), return_counts=True)
        yield pa.RecordBatch.from_pydict({"value": value, "n": n})


def _split_items(common: np.ndarray, meetings: int):
    """Of each set: its size, its number of common items and the smallest of them, and the other items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            flat, at = flat[at[0] : at[-1]], at - at[0]
            doc = np.repeat(np.arange(len(lists)), np.diff(at))
            hit = np.isin(flat, common)
            h = np.bincount(doc[hit], minlength=len(lists))
            own, who = flat[hit], doc[hit]  # items ascend within a set
            low = np.arange(len(own)) - (np.cumsum(h) - h)[who] < meetings
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "n": pa.array(np.diff(at).astype(np.int32)), "h": pa.array(h.astype(np.int64)), "meet": _lists(own[low], np.minimum(h, meetings)), "rare": _lists(flat[~hit], np.diff(at) - h)})

    return run


def _of_list(members: DataFrame, lists: DataFrame, *columns: str) -> DataFrame:
    """members with columns of their list (v), which may hold any share of them."""
    keyed = lists.select(binary("v").alias("__v"), "size", *columns)
    return join_counted(members.withColumn("__v", binary("v")), keyed, "__v", "size", members.count(), F.col("row")).drop("__v", "size")


def compared_to_pivots(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """compared() for rows and their pivots (row, pivot), of which few may have most of the rows: a pivot's set goes to as many tasks as its rows ask for."""
    pairs = materialise(pairs, "near-dense-to-pivots")
    floor = max(2, int(pairs.count() * HOT_SHARE))
    # at most 1 / HOT_SHARE of them
    hot = pairs.groupBy("pivot").agg(F.count("*").alias("size")).filter(F.col("size") > floor).select("pivot", F.ceil(F.col("size") / PIVOT_ROWS).cast("int").alias("parts"))
    hot = materialise(hot, "near-dense-hot-pivots")
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(F.broadcast(hot), "pivot", "left").select("row", "pivot", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"))
    centres = pairs.select("pivot").distinct().join(F.broadcast(hot), "pivot", "left").select("pivot", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    centres = centres.join(sets.select(F.col("row").alias("pivot"), F.col("items").alias("y")), "pivot")
    both = dealt.join(sets.select("row", F.col("items").alias("x")), "row").join(centres, ["pivot", "part"])
    both = both.select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b"), "x", "y", F.size(F.array_intersect("x", "y")).alias("common"))
    return both.select("a", "b", "common", (F.size("x") + F.size("y") - F.col("common")).alias("every")).distinct()


def dense_links(dense: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """All links among the dense texts (row), exactly; known: links found so far, which save comparisons."""
    own = materialise(sets.join(dense.select("row"), "row", "left_semi").select("row", "items", F.size("items").alias("n")), "near-dense-sets")
    counts = own.select("items").mapInArrow(tx.lean(_count_items), "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("df"))
    common = materialise(counts.filter(f"df > {LIST}").select("value"), "near-dense-common")
    if common.count() <= MAX_BROADCAST_IDS:
        known_common = np.sort(np.array([r[0] for r in common.collect()], np.int64))
        per_row = own.mapInArrow(tx.lean(_split_items(known_common, MEETINGS)), "row bigint, n int, h bigint, meet array<bigint>, rare array<bigint>")
    else:  # too many for a broadcast: the same by a join
        tokens = own.select("row", F.explode("items").alias("value")).join(common.withColumn("c", F.lit(True)), "value", "left")
        per_row = tokens.groupBy("row").agg(F.count("*").cast("int").alias("n"), F.count("c").alias("h"), F.slice(F.array_sort(F.collect_list(F.when(F.col("c"), F.col("value")))), 1, MEETINGS).alias("meet"), F.collect_list(F.when(F.col("c").isNull(), F.col("value"))).alias("rare"))
    per_row = materialise(per_row, "near-dense-rows")

    # pairs that share a rare shingle: what they share is at most those and the fewer common ones
    h = per_row.select("row", "h")
    rare = per_row.select("row", "n", F.explode("rare").alias("value"))
    pairs = short_list_pairs(rare.join(rare.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "value"), percent)
    pairs = pairs.join(h.withColumnsRenamed({"row": "a", "h": "ha"}), "a").join(h.withColumnsRenamed({"row": "b", "h": "hb"}), "b")
    pairs = pairs.filter(f"{100 + percent} * (common + least(ha, hb)) >= {percent} * (na + nb)")

    # pairs that share none: r + r' <= (1/t - 1) min(h, h'), so each has r <= (1/t - 1) h
    slack = 100 / percent - 1
    members = materialise(per_row.filter((F.col("n") - F.col("h")) <= slack * F.col("h")).select("row", (F.col("n") - F.col("h")).alias("r"), F.col("h"), F.explode("meet").alias("v")), "near-dense-members")
    pivots = materialise(members.groupBy("v").agg(F.min(F.struct("r", "row"))["row"].alias("pivot"), F.count("*").alias("size")), "near-dense-pivots")
    with_pivot = _of_list(members, pivots, "pivot")
    central = materialise(compared_to_pivots(with_pivot.filter("row <> pivot").select("row", "pivot").distinct(), own), "near-dense-central")
    near = central.filter(f"100 * common >= {percent} * every").select("a", "b")
    links = materialise(known.unionByName(verified(pairs.select("a", "b").distinct(), own, percent)).unionByName(near).distinct(), "near-dense-links")

    labels = components(links)
    label = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    pivots = pivots.join(label("pivot"), "pivot", "left")
    placed = _of_list(members, pivots, "pivot", "pivot_label").join(label("row"), "row", "left")
    apart = F.coalesce("row_label", "row") != F.coalesce("pivot_label", "pivot")
    # distance is a metric: similar texts differ in their distance to the pivot by 1 - t at most
    far = central.select("a", "b", (1 - F.col("common") / F.col("every")).alias("far"))
    placed = placed.join(far, (F.col("a") == F.least("row", "pivot")) & (F.col("b") == F.greatest("row", "pivot")), "left").drop("a", "b")
    band = F.floor(F.coalesce("far", F.lit(0.0)) / (1 - percent / 100 + 1e-9)).cast("int")
    placed = placed.select("v", "row", F.floor(F.col("r") / F.col("h") / slack * 10).cast("int").alias("level"), band.alias("band"), apart.alias("apart"), (F.col("r") + F.col("h")).alias("n"))
    placed = materialise(placed, "near-dense-placed")
    if placed.filter("apart").isEmpty():
        return links
    place = ["v", "level", "band", "apart"]
    counts = placed.groupBy(*place).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).alias("parts"))
    # only lists with a text apart from its pivot need blocks
    counts = counts.join(placed.filter("apart").select("v").distinct(), "v", "left_semi")
    dealt = placed.drop("n").join(counts, place).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    blocks = dealt.join(own.select("row", "items"), "row").groupBy(*place, "part").agg(F.collect_list(F.struct("row", "items")).alias("rows"))
    blocks = materialise(blocks.withColumn("id", F.xxhash64("level", "band", "apart", "part")), "near-dense-blocks")
    one, two = blocks.filter("apart").alias("p"), blocks.alias("q")
    met = one.join(two, F.expr("p.v = q.v AND p.level + q.level <= 10 AND abs(p.band - q.band) <= 1 AND (NOT q.apart OR p.id <= q.id)"))
    found = met.select(F.col("p.rows").alias("x"), F.col("q.rows").alias("y")).mapInArrow(tx.lean(_compare_blocks(percent)), "a bigint, b bigint")
    return links.unionByName(materialise(found.filter("a <> b").distinct(), "near-block-links"))


def annotate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, k: int = K) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept: one row per row of docs."""
    return annotate_rows(identify(docs, text, doc_id), shingle, percent, k)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest doc_id (all rows with it, if ids repeat)."""
    numbered = number(docs, doc_id, text)
    found = annotate_rows(lean_rows(numbered, text, doc_id), shingle, percent)
    return without_rows(numbered, found.filter("NOT kept").select("row")).select(*docs.columns)


def annotate_rows(rows: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, k: int = K) -> DataFrame:
    """The same for rows (row, doc_id, text)."""
    small_batches(rows.sparkSession)
    base = materialise(sketches(rows, shingle, k), "near-sketches")
    full = base.filter("n > 0")
    classes = materialise(full.groupBy("sig").agg(F.min("row").alias("row"), F.count("*").alias("size"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-classes")

    exploded = classes.select("row", "n", F.explode("sketch").alias("value"))
    df = exploded.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = materialise(exploded.join(df, "value"), "near-values")
    pairs = short_list_pairs(shared.filter(f"df <= {LIST}"), percent)
    # a text that is not dense has at least half of its sketch in short lists, and a partner most of those
    pairs = pairs.filter(f"8 * common >= least(na, nb, {k})").select("a", "b")
    pairs = materialise(estimated(pairs, classes, percent, k), "near-pairs")
    dense = shared.filter(f"df > {LIST}").groupBy("row", "n").agg(F.count("*").alias("hot")).filter(f"2 * hot >= least(n, {k})").select("row")
    dense = materialise(dense, "near-dense")

    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).union(dense).distinct()
    sets = materialise(full_sets(rows, materialise(wanted, "near-wanted"), shingle), "near-sets")
    links = materialise(verified(pairs, sets, percent), "near-links")
    if not dense.isEmpty():
        links = dense_links(dense, sets, links, percent)
    labels = components(links)

    named = classes.select("sig", "size", "row", "first_id").join(labels.select(F.col("node").alias("row"), "label"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")).withColumn("label", binary("label"))
    named = join_counted(named.withColumn("label", binary("label")), least, "label", "members", classes.count(), F.col("row")).select("sig", "size", "component_id")
    found = join_counted(full.select("row", "doc_id", "n", "sig"), named, "sig", "size", max(1, base.count()), F.col("row")).select("row", "doc_id", "n", "component_id")
    alone = base.filter("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("row", "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return annotate(docs, shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op6_minhash_dedup": op6_minhash_dedup}
ORACLE_SQL = {
    "op6_minhash_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), r AS (
  SELECT doc_id AS node, doc_id AS label FROM d UNION SELECT b, label FROM r JOIN e ON node = a
), m AS (
  SELECT node, min(label) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
}
