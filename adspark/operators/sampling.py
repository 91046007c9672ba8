"""Splits, samples and orderings from keyed uniforms.

All randomness is ``u(salt, key)``: the same row gets the same draw on any
partitioning, on re-execution after a lost executor, and in the SQL oracle.
Exact per-group quotas use the blocked rank of ``ordering.ranked_within`` so
a hot group is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.functions.hashing import TWO_32, u
from adspark.operators.ordering import blocks_for, ranked_within, running_sum_ranged
from adspark.session import materialize, staged


MAX_BROADCAST_LABELS = 10_000


def hash_split(df: DataFrame, key: str = "event_id", by: str | None = "campaign_id", seed: int = 42,
               fractions=(0.8, 0.1, 0.1), names=("train", "val", "test"), out: str = "split") -> DataFrame:
    """Assign each row to a split by thresholds on ``u(seed:group, key)``."""
    draw = u(f"split{seed}", F.col(by), F.col(key)) if by else u(f"split{seed}", F.col(key))
    cuts = [round(sum(fractions[: i + 1]), 12) for i in range(len(fractions))]
    expr = None
    for cut, name in zip(cuts[:-1], names[:-1]):
        expr = F.when(draw < cut, F.lit(name)) if expr is None else expr.when(draw < cut, F.lit(name))
    expr = expr.otherwise(F.lit(names[-1]))
    return df.withColumn(out, expr)


def stratified_split(df: DataFrame, label: str = "conversion_flag", key: str = "event_id", seed: int = 7,
                     fractions=(0.7, 0.15, 0.15), names=("train", "val", "test"), out: str = "split",
                     n_blocks: int | None = None) -> DataFrame:
    """Exact quotas per label value: first round(n*f1) rows by draw -> names[0], ....

    The label counts, which the quotas need, also give the number of blocks.
    """
    counts = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    values, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    ranked = ranked_within(df, [label], u(f"strat{seed}", F.col(key)), key, n_blocks=n_blocks or blocks_for(total))
    # One row per label value, usually two; a label with many values is joined by shuffle.
    few = values <= MAX_BROADCAST_LABELS
    j = ranked.join(F.broadcast(counts) if few else counts, label, "inner")
    c1 = F.round(F.col("_n") * fractions[0])
    c2 = c1 + F.round(F.col("_n") * fractions[1])
    expr = (F.when(F.col("_rank") <= c1, F.lit(names[0]))
            .when(F.col("_rank") <= c2, F.lit(names[1])).otherwise(F.lit(names[2])))
    return j.withColumn(out, expr).drop("_rank", "_n")


def sample_per_group(df: DataFrame, n: int, by: str = "campaign_id", key: str = "event_id",
                     seed: int = 11, n_blocks: int | None = None) -> DataFrame:
    """At most ``n`` rows per group, the ``n`` smallest draws.

    Blocks that start past ``n`` are dropped before the per-block window, so
    a group much larger than ``n`` is never sorted whole.
    """
    return ranked_within(df, [by], u(f"sample{seed}", F.col(key)), key,
                         n_blocks=n_blocks or blocks_for(df.count()), max_rank=n).drop("_rank")


def ratio_sample(df: DataFrame, k: float = 1.0, label: str = "conversion_flag", key: str = "event_id",
                 seed: int = 5, replace: bool = False) -> DataFrame:
    """One positive for every ``k`` negatives, about.

    Without replacement: all positives, and Bernoulli(min(1, kP/N)) on the
    negatives; when k P > N there are simply fewer than k negatives each.

    With replacement: both classes are resampled with weights 1 and 1/k to the
    table's own expected size, so a row of weight w gets Poisson(n w / sum w)
    copies (``copy_id``). Any rate works: it is cut into draws of at most
    ``POISSON_RATE`` each, with a keyed uniform and the inverse CDF for each.
    """
    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()
    p, n = counts["p"], counts["n"]
    pos = F.col(label) == 1
    if not replace:
        rate = (k * p / n) if n else 0.0
        return df.where(pos | (u(f"ratio{seed}", F.col(key)) < F.lit(min(1.0, rate))))
    unit = (p + n) / (p + n / k) if p + n else 0.0
    copies = F.when(pos, _poisson(unit, f"ratio{seed}", key)).otherwise(_poisson(unit / k, f"ratio{seed}", key))
    return (df.withColumn("_copies", copies).where(F.col("_copies") > 0)
            .withColumn("copy_id", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies"))


def weighted_sample(df: DataFrame, weight: Column, n: int, key: str = "event_id", seed: int = 13, draw: str = "draw_id",
                    rows_per_block: int = 1_000_000) -> DataFrame:
    """Exactly ``n`` draws with replacement, each row's chance in proportion to its ``weight``.

    Returns a row per draw: the columns of ``df`` and ``draw`` (0 to n - 1). A
    multinomial sample, as a weighted sampler that draws a set number gives.
    ``key`` must be unique; rows whose weight is null or not above 0 are never
    drawn, and without any weight there are no draws.

    Draw j is a keyed uniform point on the line of all weights, laid end to end
    in the order of ``key``; the row it falls on is drawn. The line is cut into
    as many cells as there are rows: a row has an entry in each cell that it
    touches (at most rows + cells in all), points and rows meet in an equi-join
    on the cell. A heavy row covers many cells, so its draws are spread.
    """
    rows = staged(df.select("*", weight.cast("double").alias("_w")).where(F.col("_w") > 0), "weighted")
    line = staged(running_sum_ranged(rows.select(key, "_w"), [key], "_w", rows_per_block, "_hi"), "line")
    cells, total = line.agg(F.count(F.lit(1)), F.max("_hi")).first()
    if not cells or n <= 0:
        return df.limit(0).withColumn(draw, F.lit(0).cast("bigint"))
    cell = lambda x: F.floor(x * F.lit(float(cells)) / F.lit(total)).cast("bigint")
    line = line.withColumn("_lo", F.col("_hi") - F.col("_w")).select(key, "_lo", "_hi", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))).alias("_cell"))
    point = (u(f"point{seed}", F.col("id")) + u(f"fine{seed}", F.col("id")) / F.lit(TWO_32)) * F.lit(total)
    points = df.sparkSession.range(n).select(F.col("id").alias(draw), point.alias("_at")).withColumn("_cell", cell(F.col("_at")))
    hit = points.join(line, "_cell").where((F.col("_lo") <= F.col("_at")) & (F.col("_at") < F.col("_hi"))).select(key, draw)
    return rows.drop("_w").join(hit, key)


def ratio_sample_exact(df: DataFrame, k: float = 1.0, n: int | None = None, label: str = "conversion_flag", key: str = "event_id",
                       seed: int = 13) -> DataFrame:
    """Exactly ``n`` draws (by default as many as rows), about one positive for every ``k`` negatives per positive weight.

    Positives weigh ``k`` and others 1, which is the same as 1 and 1/k.
    """
    weight = F.when(F.col(label) == 1, F.lit(float(k))).otherwise(F.lit(1.0))
    return weighted_sample(df, weight, df.count() if n is None else n, key, seed)


POISSON_RATE = 16.0


def _poisson(rate: float, salt: str, key: str) -> Column:
    """Poisson(rate) copies from the uniforms u(salt, key, 1), u(salt, key, 2), ..."""
    draws = max(1, math.ceil(rate / POISSON_RATE))
    part = rate / draws
    cdf, term, acc, m = [], math.exp(-part), 0.0, 0
    while acc < 1.0 - 1e-15 and m < 200:
        acc += term
        cdf.append(acc)
        m += 1
        term *= part / m
    uniforms = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: u(salt, F.col(key), i))
    steps = F.array(*map(F.lit, cdf))
    return F.aggregate(uniforms, F.lit(0), lambda t, x: t + F.size(F.filter(steps, lambda c: x >= c)))


def shuffled_order(df: DataFrame, key: str = "event_id", seed: int = 3, out: str = "imp_id",
                   n_blocks: int | None = None) -> DataFrame:
    """A random permutation: ``imp_id`` = 1-based position in order of u(seed, key) (P5).

    Global position by two-level counting (blocks of the draw), never a
    single-partition window over all rows.
    """
    return ranked_within(df, [], u(f"perm{seed}", F.col(key)), key, n_blocks=n_blocks or blocks_for(df.count()), rank_col=out)


def assign_users(df: DataFrame, num_users: int, key: str = "event_id", seed: int = 1,
                 out: str = "user_id") -> DataFrame:
    """Synthetic user id uniform over 0..num_users-1."""
    return df.withColumn(out, F.floor(u(f"user{seed}", F.col(key)) * num_users).cast("bigint"))
