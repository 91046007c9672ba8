"""Feature engineering (F3-F16): encoders, scalers, cyclical time, processed rows.

Fitted transforms are tables, not pickled objects:

* encoder  ``(feature, category, code)`` - long form, one row per category
* scaler   ``(feature, mean, scale)``
* sizes    ``(feature, size)``

Fitting is a distributed pass (distinct values per feature, a window over the
distinct values only; one ``agg`` for the scaler). Applying the encoder is one
left join per feature against its dictionary, broadcast only after the
dictionary's row count has been checked against a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.timefeat import cyclical
from adspark.operators.ordering import range_blocks

# Feature lists and order of the processed layout.
CATEGORICAL_FEATURES = ["campaign_id", "cnxn_type", "dma", "country", "prizm_premier_code",
                        "ua_browser", "ua_os", "ua_device_family", "ua_device_brand"]
NUMERIC_CATEGORICALS = {"campaign_id", "dma"}
BOOLEAN_FEATURES = ["ua_is_mobile", "ua_is_tablet", "ua_is_pc", "ua_is_bot"]
CYCLICAL_FEATURES = [("impression_hour", 24.0, "hour"), ("impression_dayofweek", 7.0, "day")]
NUMERIC_FEATURES = BOOLEAN_FEATURES + ["hour_sin", "hour_cos", "day_sin", "day_cos"]
TARGET = "conversion_flag"

MAX_BROADCAST_ROWS = 1_000_000


def category_value(df_col: Column, feature: str) -> Column:
    """Normalised category text: numeric features null -> -1, strings null -> "-1"."""
    if feature in NUMERIC_CATEGORICALS:
        return F.coalesce(df_col.cast("bigint"), F.lit(-1)).cast("string")
    return F.coalesce(df_col.cast("string"), F.lit("-1"))


def _long_categories(df: DataFrame, features: list[str]) -> DataFrame:
    items = []
    for f in features:
        sort_num = F.coalesce(F.col(f).cast("bigint"), F.lit(-1)) if f in NUMERIC_CATEGORICALS \
            else F.lit(None).cast("bigint")
        items.append(F.struct(F.lit(f).alias("feature"), category_value(F.col(f), f).alias("category"),
                              sort_num.alias("sort_num")))
    return df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*")


def fit_ordinal_encoder(df: DataFrame, features: list[str] = CATEGORICAL_FEATURES, rows_per_block: int = 1_000_000) -> DataFrame:
    """Sorted categories per feature -> codes 0..n-1 (numbers sort numerically).

    The distinct categories of all features are cut into ranges of (feature,
    order) that follow the data, numbered within each range and moved on by
    the ranges before it: a dictionary of any size spreads over tasks.
    """
    cats = _long_categories(df, features).distinct()
    order = [F.col("sort_num").asc_nulls_last(), F.col("category").asc()]
    cut = range_blocks(cats, [F.col("feature"), *order], rows_per_block)
    sizes = cut.groupBy("feature", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("feature", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = cut.withColumn("_in", F.row_number().over(Window.partitionBy("feature", "_b").orderBy(*order)) - 1)
    return inside.join(offset, ["feature", "_b"]).select("feature", "category", (F.col("_off") + F.col("_in")).cast("bigint").alias("code"))


def category_sizes(encoder: DataFrame) -> DataFrame:
    """Distinct categories + 1 per feature."""
    return encoder.groupBy("feature").agg((F.count(F.lit(1)) + 1).cast("bigint").alias("size"))


def _dictionary_sizes(encoder: DataFrame) -> dict[str, int]:
    rows = encoder.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per feature
    return {r["feature"]: r["n"] for r in rows}


def ordinal_encode(df: DataFrame, encoder: DataFrame, features: list[str] = CATEGORICAL_FEATURES,
                   unknown: str = "collide", out_prefix: str | None = None,
                   max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Replace each feature by its code.

    unknown="collide": unseen -> 0, the code of the first category (reference).
    unknown="reserve": codes shifted by one, unseen -> 0.
    """
    sizes = _dictionary_sizes(encoder)
    out = df
    for i, f in enumerate(features):
        key = f"_k{i}"
        d = encoder.where(F.col("feature") == f).select(F.col("category").alias(key), F.col("code").alias(f"_c{i}"))
        if sizes.get(f, 0) <= max_broadcast_rows:
            d = F.broadcast(d)
        out = out.withColumn(key, category_value(F.col(f), f)).join(d, key, "left").drop(key)
        code = F.col(f"_c{i}")
        if unknown == "collide":
            enc = F.coalesce(code, F.lit(0).cast("bigint"))
        elif unknown == "reserve":
            enc = F.coalesce(code + 1, F.lit(0).cast("bigint"))
        else:
            raise ValueError(unknown)
        name = f"{out_prefix}{i}" if out_prefix else f
        out = out.withColumn(name, enc).drop(f"_c{i}")
    return out


def numeric_features(df: DataFrame) -> DataFrame:
    """Booleans -> double and sin/cos of hour (24) and day of week (7)."""
    out = df
    for b in BOOLEAN_FEATURES:
        out = out.withColumn(b, F.col(b).cast("double"))
    for col, period, stem in CYCLICAL_FEATURES:
        s, c = cyclical(F.col(col), period)
        out = out.withColumn(f"{stem}_sin", s).withColumn(f"{stem}_cos", c)
    return out


def fit_scaler(df: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Mean and population std per column; zero std -> scale 1."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("mean"),
                     F.when(F.coalesce(F.col(f"{c}__s"), F.lit(0.0)) == 0.0, F.lit(1.0))
                     .otherwise(F.col(f"{c}__s")).alias("scale")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scaler_params(scaler: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """The fitted (mean, scale) by column, of all columns or the named ones: one row per column."""
    rows = (scaler if columns is None else scaler.where(F.col("feature").isin(columns))).collect()
    return {r["feature"]: (r["mean"], r["scale"]) for r in rows}


def scale_features(df: DataFrame, scaler: DataFrame | dict, columns: list[str] = NUMERIC_FEATURES,
                   out_type: str = "float") -> DataFrame:
    """(x - mean) / scale, computed in double, cast last (F8)."""
    params = scaler if isinstance(scaler, dict) else scaler_params(scaler, columns)
    out = df
    for c in columns:
        m, s = params[c]
        out = out.withColumn(c, ((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).cast(out_type))
    return out


def processed_features(df: DataFrame, encoder: DataFrame, scaler: DataFrame | dict,
                       unknown: str = "collide", keep: list[str] | None = None) -> DataFrame:
    """Flat ``cat_0..cat_8`` (bigint), ``num_0..num_7`` (float), float target."""
    enc = ordinal_encode(numeric_features(df), encoder, unknown=unknown)
    sc = scale_features(enc, scaler)
    cols = [F.col(f).cast("bigint").alias(f"cat_{i}") for i, f in enumerate(CATEGORICAL_FEATURES)]
    cols += [F.col(f).cast("float").alias(f"num_{i}") for i, f in enumerate(NUMERIC_FEATURES)]
    cols += [F.col(TARGET).cast("float").alias(TARGET)]
    return sc.select(*(keep or []), *cols)


def feature_vectors(processed: DataFrame, n_cat: int = 9, n_num: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Pack to ``cat array<bigint>``, ``num array<float>``, ``label float``."""
    return processed.select(*(keep or []),
                            F.array(*[F.col(f"cat_{i}") for i in range(n_cat)]).alias("cat"),
                            F.array(*[F.col(f"num_{i}") for i in range(n_num)]).alias("num"),
                            F.col(TARGET).alias("label"))


def one_hot(df: DataFrame, encoder: DataFrame, feature: str, drop_first: bool = True,
            max_levels: int = 1_000) -> DataFrame:
    """0/1 column per level of ``feature`` from the encoder table, first level dropped (F16).

    The level list is read from the fitted dictionary (bounded, checked):
    above ``max_levels`` columns a table is better served by ``one_hot_sparse``.
    """
    levels = [r["category"] for r in encoder.where(F.col("feature") == feature)
              .orderBy("code").limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"{feature} has more than {max_levels} levels; use one_hot_sparse")
    if drop_first:
        levels = levels[1:]
    v = category_value(F.col(feature), feature)
    return df.select("*", *[(v == F.lit(lv)).cast("tinyint").alias(f"{feature}_{lv}") for lv in levels])


def one_hot_sparse(df: DataFrame, encoder: DataFrame, features: list[str] = CATEGORICAL_FEATURES, drop_first: bool = False,
                   out: str = "onehot") -> DataFrame:
    """All ``features`` one-hot encoded as one sparse vector, for dictionaries of any size (F16).

    Adds a struct of size (levels of all features), indices (ascending, one per
    feature that has a known level) and values (ones). Feature by feature, the
    levels follow each other in code order; an unseen category has no index,
    nor has the first level with ``drop_first``. The codes come from the
    encoder's joins, so nothing grows with the number of levels but the index.
    """
    sizes = _dictionary_sizes(encoder)
    skip = 1 if drop_first else 0
    coded = ordinal_encode(df, encoder, features, unknown="reserve", out_prefix="_code")
    index, start = [], 0
    for i, f in enumerate(features):
        index.append(F.when(F.col(f"_code{i}") > skip, F.col(f"_code{i}") - (1 + skip) + start))
        start += max(sizes.get(f, 0) - skip, 0)
    held = F.array_compact(F.array(*index))
    vector = F.struct(F.lit(start).cast("bigint").alias("size"), held.alias("indices"), F.transform(held, lambda _: F.lit(1.0)).alias("values"))
    return coded.withColumn(out, vector).drop(*[f"_code{i}" for i in range(len(features))])


def counterfactual_features(processed: DataFrame, camps: list[dict], codes: dict, score,
                            campaign_slot: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Each encoded impression with the best candidate campaign's code in slot ``cat_<slot>``.

    Every candidate replaces the campaign in turn; ``score`` maps a candidate
    struct (its parameters and ``code``) to a column, and the best one stays
    (ties to list order). The impression side is encoded once, the campaigns
    once (``codes``: campaign_id -> code, bounded by the campaign list), and the
    candidates live in one array per row, never as rows.
    """
    from adspark.operators.candidates import candidate_array
    cands = candidate_array(camps, {"code": codes})
    slot = f"cat_{campaign_slot}"
    best = F.array_max(F.transform(cands, lambda c: F.struct(score(c).alias("score"), (-c["ordinal"]).alias("neg_ordinal"),
                                                             c["campaign_id"].alias("campaign_id"), c["code"].alias("code"))))
    return (processed.withColumn("_best", best)
            .select(*(keep or []), F.col("_best.campaign_id").alias("candidate_campaign_id"), F.col("_best.score").alias("candidate_score"),
                    *[F.col("_best.code").alias(slot) if f"cat_{i}" == slot else F.col(f"cat_{i}") for i in range(9)]))


def apply_batches(df: DataFrame, fn, schema) -> DataFrame:
    """Run a user function over Arrow batches of pandas frames."""
    def run(it):
        for pdf in it:
            yield fn(pdf)
    return df.mapInPandas(run, schema)
