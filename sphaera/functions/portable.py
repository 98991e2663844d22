"""Functions with the same result in every engine: randomness, rounding, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Modulus of the generator, a Mersenne prime.
P = 2147483647
#: Smallest positive normal double, and the spacing of doubles at 1.
REALMIN, EPS = 2.2250738585072014e-308, 2.220446049250313e-16


def _fifth(h: Column) -> Column:
    sq = (h * h) % P
    return (((sq * sq) % P) * h) % P


def uniform(seed: int, iteration: Column | int, draw: Column) -> Column:
    """A number in (0, 1) from integers alone: powers and an affine step modulo P."""
    it = F.lit(iteration).cast("long") if isinstance(iteration, int) else iteration.cast("long")
    h = (F.lit(seed * 7919 + 12345).cast("long") + it * 1000003 + draw.cast("long") * 10007) % P
    h = _fifth((_fifth(h) * 48271 + 1013904223) % P)
    return (h.cast("double") + 0.5) / float(P)


def uniform_sql(source: str, seed: int, iteration: str, draw: str, name: str, keep: str = "*") -> str:
    """The same over a SQL source, as a subquery with one more column."""
    fifth = lambda h: f"((({h}*{h}) % {P}) * (({h}*{h}) % {P}) % {P}) * {h} % {P}"
    one = f"SELECT {keep}, (CAST({seed * 7919 + 12345} AS BIGINT) + CAST({iteration} AS BIGINT) * 1000003 + CAST({draw} AS BIGINT) * 10007) % {P} AS h0 FROM {source}"
    two = f"SELECT *, {fifth('h0')} AS h1 FROM ({one})"
    three = f"SELECT *, (48271 * h1 + 1013904223) % {P} AS h2 FROM ({two})"
    return f"SELECT * EXCLUDE (h0, h1, h2, h3), (CAST(h3 AS DOUBLE) + 0.5) / {P}.0 AS {name} FROM (SELECT *, {fifth('h2')} AS h3 FROM ({three}))"


def gaussian(seed: int, iteration: Column | int, draw: Column) -> Column:
    """Box-Muller on two streams of uniform()."""
    u, v = uniform(seed, iteration, draw), uniform(seed + 1, iteration, draw)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(v * 6.283185307179586)


def quantised(c: Column, digits: int = 6) -> Column:
    """Rounded half up to so many decimals, without a negative zero."""
    return F.floor(c * float(10**digits) + 0.5).cast("double") / float(10**digits)


def quantised_sql(e: str, digits: int = 6) -> str:
    return f"CAST(floor(({e}) * 1E{digits} + 0.5) AS DOUBLE) / 1E{digits}"


def half_up(c: Column) -> Column:
    """Nearest integer, halves away from zero for numbers that aren't negative."""
    return F.floor(c + 0.5)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that later filters aren't pushed into long expressions and multiplied there."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


#: Size of the quantile sketches, and the error of their ranks: a single-sided one of a share of the rows,
#: kept with a probability of 99 % by the sketch's published bound. MARGIN times that leaves less than 1e-13, half a rank included.
SKETCH_K = 4096
RANK_ERROR = 2.296 / SKETCH_K**0.9723
MARGIN = 4
#: Fewer rows are counted whole.
FEW_ROWS = 1024


def hazen(rows: DataFrame, keys: list[str], value: str, percents: list[float]) -> DataFrame:
    """Midpoint percentiles (Hyndman and Fan's type 5) by keys: p<percent> columns.

    Exact in two scans, and no task sorts a whole key. The first makes a mergeable (KLL) sketch a key,
    whose error bound tells the interval that holds the order statistics asked for; the second counts
    the rows below it and each value in it, under 1 % of the rows. Should an interval
    miss its rank against all odds, the query fails instead of giving another number.
    """
    by = keys or ["__all"]
    v = F.col(value).cast("double").alias("__v")
    good = settled(rows.select(*(keys or [F.lit(0).alias("__all")]), v)).filter(finite(F.col("__v")))
    sketched = good.groupBy(*by).agg(F.kll_sketch_agg_double("__v", SKETCH_K).alias("__sketch"), F.count("*").cast("double").alias("__n"))
    bounds, entries = [], []
    for k, p in enumerate(percents):
        h = F.greatest(F.lit(1.0), F.least(F.col("__n"), F.col("__n") * (p / 100) + 0.5))
        for name, end, share in (("low", 0.0, max(0.0, p / 100 - MARGIN * RANK_ERROR)), ("high", 1.0, min(1.0, p / 100 + MARGIN * RANK_ERROR))):
            at = [F.kll_sketch_get_quantile_double("__sketch", F.lit(f)) for f in (end, share)]
            bounds.append(F.when(F.col("__n") < FEW_ROWS, at[0]).otherwise(at[1]).alias(f"__{name}{k}"))
        bounds += [F.floor(h).alias(f"__first{k}"), F.ceil(h).alias(f"__second{k}"), (h - F.floor(h)).alias(f"__share{k}")]
        cell = F.struct(F.lit(k).alias("__k"), *[F.col(f"__{n}{k}").alias(f"__{n}") for n in ("first", "second", "share")], F.when(F.col("__v") >= F.col(f"__low{k}"), F.col("__v")).alias("__x"))
        entries.append(F.when(F.col("__v") <= F.col(f"__high{k}"), cell))
    both = good.join(settled(sketched.select(*by, *bounds)), by)
    counts = both.select(*by, F.explode(F.array(*entries)).alias("__cell")).filter("__cell IS NOT NULL").select(*by, "__cell.*").groupBy(*by, "__k", "__first", "__second", "__share", "__x").agg(F.count("*").alias("__c"))
    ranked = counts.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*by, "__k").orderBy(F.asc_nulls_first("__x"))))
    holds = lambda rank: (F.col("__upto") >= F.col(rank)) & (F.col("__upto") - F.col("__c") < F.col(rank)) & F.col("__x").isNotNull()
    pairs = ranked.groupBy(*by, "__k", "__share").agg(F.max(F.when(holds("__first"), F.col("__x"))).alias("__a"), F.max(F.when(holds("__second"), F.col("__x"))).alias("__b"))
    missed = F.raise_error(F.lit("a percentile lies outside the interval of its sketch; run again")).cast("double")
    pairs = pairs.withColumn("__y", F.when(F.col("__a").isNull() | F.col("__b").isNull(), missed).otherwise(F.col("__a") + F.col("__share") * (F.col("__b") - F.col("__a"))))
    out = [F.max(F.when(F.col("__k") == k, F.col("__y"))).alias(f"p{p:g}".replace(".", "_")) for k, p in enumerate(percents)]
    return pairs.groupBy(*by).agg(*out).drop("__all")


def hazen_sql(source: str, keys: str, value: str, percents: list[float]) -> str:
    """The same as SQL."""
    by = f"PARTITION BY {keys}" if keys else ""
    cols = []
    for p in percents:
        h = f"greatest(1.0, least(CAST(n AS DOUBLE), n * {p / 100!r} + 0.5))"
        low, high = f"max(CASE WHEN i = floor({h}) THEN v END)", f"max(CASE WHEN i = ceil({h}) THEN v END)"
        cols.append(f"{low} + max({h} - floor({h})) * ({high} - {low}) AS p{p:g}".replace(f"p{p:g}", f"p{p:g}".replace(".", "_")))
    lead = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {lead}{', '.join(cols)} FROM (SELECT {lead}v, row_number() OVER ({by} ORDER BY v) AS i, count(*) OVER ({by}) AS n FROM (SELECT {lead}CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL AND isfinite({value}))){group}"
