"""Toxicity classifier with counterfactual regularisation.

A logistic regression on the presence of hashed words and word beginnings. For
each labelled text that mentions an identity term, twins are made in which that
term is swapped for each other term of its kind; training penalises the squared
difference between a text's score and its twins' (before the logistic function;
all twins of a text together weigh one),
so neutral mentions of a group cannot carry the label.

Fitting takes a bounded sample: the ``MAX_TRAIN`` labelled texts with the
smallest hash of doc_id (documented parameter), fewer if they and their twins hold more than
``MAX_SAMPLE`` selected features, so what the driver takes has a bound. Scoring covers every row and
whole texts: one vectorised pass without a shuffle, and the broadcast model has
at most ``MAX_FEATURES`` weights.

Inputs of a score are the text alone. Defined cases: null and empty texts get
the score of a text without any known feature; rows that repeat a doc_id are
scored one by one; labels that repeat a doc_id count as toxic if any is; null
labels are left out; with no labels of one kind the score is the share of toxic
labels, 0 without any; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import fields, materialise, small_batches, smallest_hashes

MAX_TRAIN = 8000
MAX_FEATURES, MAX_SAMPLE = 1 << 16, 1 << 23
#: Of training texts that must have a feature, and its least z-score.
MIN_TEXTS, MIN_Z = 3, 4.0
PREFIXES = (4, 5, 6)
RIDGE, COUNTERFACTUAL = 5e-6, 1.0
THRESHOLD = 0.7
#: Features of training rows that a task holds before it passes them on.
HELD_FEATURES = 1 << 20

#: Terms of one kind can stand for each other in a sentence.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("she", "he"), ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "citizens", "refugees", "foreigners"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs", "athées"), ("frauen", "männer"),
    ("christen", "muslime", "juden", "atheisten"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos", "ateos"),
)


def word_features(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of feature hashes for each word: itself and its first 4, 5, 6 bytes."""
    sums = tx.prefix_sums(low)
    out = np.empty((len(start), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = tx.mix(tx.range_hash(sums, start, end) + np.uint64(1))
    for k, n in enumerate(PREFIXES):
        cut = np.minimum(end, start + n)
        out[:, k + 1] = tx.mix(tx.range_hash(sums, start, cut) + np.uint64(1 + n))
    return out


def features_of(word: str) -> np.ndarray:
    raw = tx.LOWER[np.frombuffer(word.encode(), np.uint8)]
    return word_features(raw, np.array([0]), np.array([len(raw)]))[0]


def _training_rows(rows: DataFrame, identity: tuple, twins: bool) -> DataFrame:
    """toxic, key (of the text), twin (whether a twin of the text with that key), features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {int(features_of(w)[0]): (w, kind) for kind in identity for w in kind}
        known = np.array(sorted(own), np.uint64)
        of = {w: features_of(w) for kind in identity for w in kind}

        def packed(labels: list, keys: list, flags: list, lists: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"toxic": pa.array(labels, pa.int32()), "key": pa.array(keys, pa.int64()), "twin": pa.array(flags, pa.bool_()), "features": pa.array(lists, pa.list_(pa.int64()))})

        for batch in batches:
            labels, keys, flags, lists, held = [], [], [], [], 0
            for i in range(batch.num_rows):
                raw = tx.LOWER[np.frombuffer((batch.column(1)[i].as_py() or "").encode(), np.uint8)]
                start, end, _ = tx.split_words(raw, np.array([0, len(raw)]), tx.ALNUM)
                found = word_features(raw, start, end)
                every = [np.unique(found)]
                if twins and len(found):
                    for h in known[np.isin(known, found[:, 0])].tolist():
                        word, kind = own[h]
                        rest = found[found[:, 0] != np.uint64(h)]
                        every += [np.unique(np.concatenate((rest.ravel(), of[w]))) for w in kind if w != word]
                labels += [batch.column(0)[i].as_py()] * len(every)
                keys += [batch.column(2)[i].as_py()] * len(every)
                flags += [k > 0 for k in range(len(every))]
                lists += [tx.signed(x) for x in every]
                if sum(map(len, lists[-len(every) :])) + held > HELD_FEATURES:
                    yield packed(labels, keys, flags, lists)
                    labels, keys, flags, lists, held = [], [], [], [], 0
                else:
                    held += sum(map(len, lists[-len(every) :]))
            yield packed(labels, keys, flags, lists)

    return rows.mapInArrow(tx.lean(run), "toxic int, key bigint, twin boolean, features array<bigint>")


class Model:
    """Weights by feature hash, sorted, and the intercept."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known, weights, bias
        table = np.zeros(1 << 16, bool)
        table[(known >> np.uint64(48)).astype(np.int64)] = True
        self.table = table

    def score_block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        low = tx.LOWER[data]
        start, end, doc = tx.split_words(low, offsets, tx.ALNUM)
        total = np.full(len(offsets) - 1, self.bias)
        if len(start) and len(self.known):
            found = word_features(low, start, end)
            at, kind = np.nonzero(self.table[(found >> np.uint64(48)).astype(np.int64)])
            h = found[at, kind]
            near = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[near] == h
            pairs = np.unique(doc[at[hit]] * len(self.known) + near[hit])
            np.add.at(total, pairs // len(self.known), self.weights[pairs % len(self.known)])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(toxic: np.ndarray, keys: np.ndarray, twin: np.ndarray, lists: list[np.ndarray], counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = 30) -> Model:
    """Truncated Newton steps on the mean log loss, the ridge and the counterfactual penalty."""
    real = ~twin
    n, n_pos = int(real.sum()), int(toxic[real].sum())
    none = np.zeros(0, np.uint64)
    if not 0 < n_pos < n or not lists:
        share = n_pos / n if n else 0.0
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0))
    texts = [x.view(np.uint64) for x in lists]
    size = np.array([len(x) for x in texts])
    share = n_pos / n
    row = np.repeat(np.arange(len(texts)), size)
    good, column = np.unique(np.concatenate(texts), return_inverse=True)
    if not len(good):
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))))
    by_key = {h: i for i, h in enumerate(keys.tolist()) if real[i]}
    base = np.array([by_key[h] for h in keys.tolist()])
    pairs = np.flatnonzero(twin)
    y, m, k = toxic.astype(float), len(good), len(texts)
    # the twins of a text weigh as much as one text, however many they are
    kinds, of, n_twins = np.unique(keys[pairs], return_inverse=True, return_counts=True)
    own, n_own = np.unique(keys[real], return_counts=True)
    n_texts = n_own[np.searchsorted(own, kinds)]
    weigh = 2 * counterfactual / max(1, n_texts.sum()) * (n_texts / n_twins)[of]

    def scores(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=v[:-1][column], minlength=k) + v[-1]

    def back(g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, weights=g[row], minlength=m), g.sum())

    def twins(s: np.ndarray) -> np.ndarray:
        g = np.zeros(k)
        gap = weigh * (s[pairs] - s[base[pairs]])
        np.add.at(g, pairs, gap)
        np.add.at(g, base[pairs], -gap)
        return g

    def loss(v: np.ndarray, s: np.ndarray) -> float:
        return float((np.logaddexp(0, s) - y * s)[real].sum() / n + ridge / 2 * v[:-1] @ v[:-1] + (weigh / 2 * (s[pairs] - s[base[pairs]]) ** 2).sum())

    decay = np.append(np.full(m, ridge), 1e-9)
    v = np.append(np.zeros(m), np.log(share / (1 - share)))
    s = scores(v)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        grad = back(np.where(real, (p - y) / n, 0.0) + twins(s)) + decay * v
        size = np.linalg.norm(grad)
        if size < 1e-6:
            break
        curve = np.where(real, p * (1 - p) / n, 0.0)
        step, left = np.zeros(m + 1), -grad
        way, rr = left.copy(), left @ left
        for _ in range(60):
            t = scores(way)
            bent = back(curve * t + twins(t)) + decay * way
            a = rr / (way @ bent)
            step += a * way
            left -= a * bent
            new = left @ left
            if new < (0.05 * size) ** 2:
                break
            way, rr = left + new / rr * way, new
        now, rate = loss(v, s), 1.0
        while loss(v + rate * step, scores(v + rate * step)) > now + 1e-4 * rate * (grad @ step) and rate > 1e-6:
            rate /= 2
        v = v + rate * step
        s = scores(v)
    w, b = v[:-1], float(v[-1])
    return Model(good, w, b)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_train: int = MAX_TRAIN, counterfactual: float = COUNTERFACTUAL, identity: tuple = IDENTITY) -> Model:
    """Learns from the labelled rows that are not held out."""
    chosen = labels.select(F.col(doc_id).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = smallest_hashes(chosen, "doc_id", max_train, chosen.count())
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.xxhash64("doc_id", "text").alias("key"))
    sample = materialise(_training_rows(rows, identity, counterfactual > 0), "toxicity-sample")
    names = _select(sample)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(3).values.to_numpy(zero_copy_only=False)
            keep = np.isin(found, shared.value)
            at = np.concatenate(([0], np.cumsum(keep)))[batch.column(3).offsets.to_numpy()]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found[keep]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["toxic", "key", "twin", "features"])

    narrowed = materialise(sample.mapInArrow(tx.lean(narrow), sample.schema), "toxicity-narrow")
    # texts in the order of their keys, which are hashes, as far as the bound goes; at most max_train keys
    sizes = narrowed.groupBy("key").agg(F.sum(F.size("features")).alias("size")).toArrow().sort_by("key")
    fits = sizes.column("key").to_numpy()[np.cumsum(sizes.column("size").to_numpy()) <= MAX_SAMPLE]
    if len(fits) < len(sizes):
        narrowed = narrowed.filter(F.col("key") <= int(fits[-1])) if len(fits) else narrowed.limit(0)
    found = narrowed.toArrow()
    lists = [x.to_numpy() for part in found.column("features").chunks for x in _split(part)]
    return fit(found.column("toxic").to_numpy().astype(np.int64), found.column("key").to_numpy(), found.column("twin").to_numpy().astype(bool), lists, counterfactual)


def _split(part: pa.ListArray) -> Iterator[pa.Array]:
    at = part.offsets.to_numpy()
    for a, b in zip(at[:-1], at[1:]):
        yield part.values.slice(a, b - a)


def _select(sample: DataFrame) -> np.ndarray:
    """The features that the labels depend on most, at most MAX_FEATURES of them; counted in Spark."""
    real = sample.filter("NOT twin")
    n, n_pos = real.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_pos < n:
        return np.zeros(0, np.int64)
    share = n_pos / n
    by = real.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("df"), F.sum("toxic").alias("pos"))
    z = F.abs(F.col("pos") - F.col("df") * share) / F.sqrt(F.col("df") * share * (1 - share))
    best = by.filter(F.col("df") >= MIN_TEXTS).withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    return np.sort(np.array([r[0] for r in best.select("feature").collect()], np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.weights, model.bias))
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            found = [own.score_block(data, offsets) for _, _, data, offsets in tx.blocks(batch.column(1))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": np.concatenate(found) if found else np.zeros(0)})

    return lean.mapInArrow(tx.lean(run), f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.weights, model.bias))
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            found = [own.score_block(data, offsets) for _, _, data, offsets in tx.blocks(batch.column(at_text))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) < threshold))

    return docs.mapInArrow(tx.lean(run), fields(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
