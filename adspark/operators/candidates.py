"""Campaign dimension, candidate scoring, argmax, bid and market.

Candidate pairing never joins: a list of campaigns is carried into every task
as one literal ``array<struct>``; higher-order functions score, filter and pick
the argmax per impression with no shuffle. Pairs become rows only for named
impressions (``candidates_of``).

A campaign table of any length is visited in blocks (``campaign_blocks``),
best bound first: no score exceeds what a campaign pays (``score_bound``), so
an impression leaves once its k-th best is above the next block's bound
(``top_candidates_pruned``). One block at a time is in the plan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.hashing import normal, u
from adspark.operators.ordering import range_blocks, spread
from adspark.session import shared_path

#: Campaigns in one literal array; longer tables are visited in blocks of so many.
BLOCK_CAMPAIGNS = 10_000
#: Campaigns whose parameters (a row of numbers each) the driver holds as a list.
MAX_CAMPAIGNS = 200_000
CPM = 1.0  # dollars per thousand impressions that the random policy bids


def campaign_params(rates: DataFrame, budget: float = 1000.0, seed: int = 0,
                    vpc_lo: float = 0.5, vpc_hi: float = 500.0) -> DataFrame:
    """Campaign dimension from observed rates (B1).

    value_per_conv = clip(U(0.8, 1.2) / rate, 0.5, 500); target_cpa =
    U(1.1, 3.0) * value_per_conv; budget fixed. Campaigns with rate 0 are
    left out. ``ordinal`` is the list order (campaign id ascending) used to
    break score ties. The window runs over the per-campaign table only.
    """
    r = rates.where(F.col("conv_rate") > 0)
    uv = F.lit(0.8) + F.lit(0.4) * u(f"vpc{seed}", F.col("campaign_id"))
    uc = F.lit(1.1) + F.lit(1.9) * u(f"cpa{seed}", F.col("campaign_id"))
    vpc = F.least(F.greatest(uv / F.col("conv_rate"), F.lit(vpc_lo)), F.lit(vpc_hi))
    return (r.select("campaign_id", F.col("conv_rate").alias("true_conv_rate"), vpc.alias("value_per_conv"))
            .withColumn("target_cpa", F.col("value_per_conv") * uc)
            .withColumn("budget", F.lit(float(budget)))
            .withColumn("ordinal", F.row_number().over(Window.orderBy("campaign_id")).cast("int")))


def collect_campaigns(campaigns: DataFrame, max_campaigns: int = MAX_CAMPAIGNS) -> list[dict]:
    """The campaign dimension as a list, refusing anything above the bound."""
    rows = campaigns.orderBy("ordinal").limit(max_campaigns + 1).collect()
    if len(rows) > max_campaigns:
        raise ValueError(f"more than {max_campaigns} campaigns: use the block forms (top_candidates_pruned, best_campaign_pruned)")
    return [_params(r) for r in rows]


def _params(row) -> dict:
    d = row.asDict()
    d.setdefault("cand_weight", 0.0)
    return d


def score_bound(predictor: str, rule: str = "value") -> Column:
    """The most that a campaign can score, whatever the impression (a probability is at most 1)."""
    if predictor == "cpm":
        return F.lit(1.0)
    pconv = F.col("true_conv_rate") if predictor == "rate" else F.lit(1.0)
    return pconv * F.col("value_per_conv") if rule == "value" else pconv / F.col("target_cpa")


def campaign_blocks(campaigns: DataFrame, bound: Column, size: int = BLOCK_CAMPAIGNS) -> Iterator[tuple[list[dict], float]]:
    """The campaign table in blocks of about ``size``, highest bound first, each with its highest bound.

    The table is sorted and cut in Spark; the driver holds one block at a time.
    """
    cut = range_blocks(campaigns.withColumn("_bound", bound), [F.desc("_bound"), F.col("ordinal")], size, "_block")
    tops = cut.groupBy("_block").agg(F.max("_bound").alias("top")).orderBy("_block").collect()  # one row per block
    for r in tops:
        rows = cut.where(F.col("_block") == r["_block"]).drop("_block", "_bound").orderBy("ordinal").collect()
        yield [_params(x) for x in rows], r["top"]


def candidate_array(camps: list[dict], extra: dict | None = None) -> Column:
    """Literal array<struct> of the campaign list (plus per-campaign extras such as cut-offs).

    Built as ``from_json`` of one JSON text, which constant folding turns into
    a single literal value: the plan and generated code stay small even for
    thousands of campaigns.
    """
    extra = extra or {}
    items = []
    for c in camps:
        d = {"campaign_id": int(c["campaign_id"]), "ordinal": int(c["ordinal"]),
             "true_conv_rate": float(c["true_conv_rate"]), "value_per_conv": float(c["value_per_conv"]),
             "target_cpa": float(c["target_cpa"]), "budget": float(c["budget"]),
             "cand_weight": float(c.get("cand_weight") or 0.0)}
        if c.get("cand_factors") is not None:
            d["cand_factors"] = [float(x) for x in c["cand_factors"]]
        for k, v in extra.items():
            val = v.get(c["campaign_id"])
            d[k] = None if val is None else int(val)
        items.append(d)
    fields = ["campaign_id bigint", "ordinal int", "true_conv_rate double", "value_per_conv double",
              "target_cpa double", "budget double", "cand_weight double", "cand_factors array<double>"] + [f"{k} bigint" for k in extra]
    schema = f"array<struct<{', '.join(f.replace(' ', ':') for f in fields)}>>"
    return F.from_json(F.lit(json.dumps(items, allow_nan=True)), schema)


def literal_map(d: dict, value_type: str = "double") -> Column:
    """A constant ``map<string, value_type>`` from a small dict; look up with a string key."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in d.items()}, allow_nan=True)),
                       f"map<string,{value_type}>")


def pconv_expr(predictor: str, imp_id: Column, c: Column, imp_logit: Column | None = None, imp_vector: Column | None = None) -> Column:
    """P(conversion) of an impression for candidate ``c``.

    ``model`` adds the campaign's weight to the impression's logit; ``factors``
    also the product of the impression's vector and the campaign's.
    """
    if predictor == "factors":
        if imp_logit is None or imp_vector is None:
            raise ValueError("the factors predictor needs the impression-side logit and vector")
        pair = F.aggregate(F.zip_with(imp_vector, c["cand_factors"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(imp_logit + c["cand_weight"] + pair)))
    if predictor == "heuristic":
        return F.lit(1.0)
    if predictor == "random":
        return u("pconv", imp_id, c["campaign_id"])
    if predictor in ("rate", "cpm"):
        return c["true_conv_rate"]
    if predictor == "model":
        if imp_logit is None:
            raise ValueError("model predictor needs the impression-side logit column")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(imp_logit + c["cand_weight"])))
    raise ValueError(f"unknown predictor {predictor!r}")


def score_expr(pconv: Column, c: Column, rule: str = "value") -> Column:
    """Score = pconv * value_per_conv, or pconv / target_cpa."""
    if rule == "value":
        return pconv * c["value_per_conv"]
    if rule == "target_cpa":
        return pconv / c["target_cpa"]
    raise ValueError(rule)


def scored_candidates(cands: Column, predictor: str, imp_id: Column, rule: str = "value",
                      imp_logit: Column | None = None, imp_vector: Column | None = None) -> Column:
    """array<struct(score, neg_ordinal, campaign_id, pconv, value_per_conv)> per impression."""
    return F.transform(cands, lambda c: _scored(c, predictor, imp_id, rule, imp_logit, imp_vector))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda, Spark evaluates an expression at each of its places."""
    return F.transform(F.array(value), use)[0]


def _scored(c: Column, predictor: str, imp_id: Column, rule: str, imp_logit: Column | None, imp_vector: Column | None) -> Column:
    def one(p):
        # The constant-CPM policy picks any eligible campaign with the same chance.
        s = u("pick", imp_id, c["campaign_id"]) if predictor == "cpm" else score_expr(p, c, rule)
        return F.struct(s.alias("score"), (-c["ordinal"]).alias("neg_ordinal"),
                        c["campaign_id"].alias("campaign_id"), p.alias("pconv"),
                        c["value_per_conv"].alias("value_per_conv"))
    return _once(pconv_expr(predictor, imp_id, c, imp_logit, imp_vector), one)


SCORED = "struct<score:double,neg_ordinal:int,campaign_id:bigint,pconv:double,value_per_conv:double>"


def best_candidate(cands: Column, predictor: str, imp_id: Column, rule: str = "value",
                   imp_logit: Column | None = None, imp_vector: Column | None = None) -> Column:
    """The greatest of ``scored_candidates``.

    The keyed uniform of ``random`` costs far more than a comparison and is
    below 1, so a campaign that pays less than the best score so far is passed
    over without drawing it. That holds in any order and saves most where the
    campaigns that pay most come first (``best_first``).
    """
    if predictor != "random":
        return F.array_max(scored_candidates(cands, predictor, imp_id, rule, imp_logit, imp_vector))

    def better(best, c):
        most = F.greatest(score_expr(F.lit(1.0), c, rule), F.lit(0.0))
        return F.when(best["score"] > most, best).otherwise(F.greatest(best, _scored(c, predictor, imp_id, rule, imp_logit, imp_vector)))
    return F.aggregate(cands, F.lit(None).cast(SCORED), better)


def best_first(camps: list[dict], rule: str = "value") -> list[dict]:
    """Campaigns by falling bound of their score; ties in a choice still go by ``ordinal``."""
    return sorted(camps, key=lambda c: -c["value_per_conv"] if rule == "value" else c["target_cpa"])


def market_price(bid: Column, imp_id: Column, model: str = "relative",
                 median: float = 0.005, sigma: float = 0.5) -> Column:
    """Market price (B8): bid*U(0.9,1.1) (current) or log-normal around a median (earlier model)."""
    if model == "relative":
        return bid * (F.lit(0.9) + F.lit(0.2) * u("price", imp_id))
    if model == "lognormal":
        z = normal(u("price1", imp_id), u("price2", imp_id))
        return F.lit(median) * F.exp(F.lit(sigma) * z)
    raise ValueError(model)


def best_campaign(df: DataFrame, cands: Column, predictor: str = "random", beta: float = 1.0,
                  rule: str = "value", price_model: str = "relative", imp_id: str = "imp_id",
                  imp_logit: str | None = None, imp_vector: str | None = None) -> DataFrame:
    """Argmax campaign, bid, market price and win per impression; no shuffle.

    Ties go to the lowest ordinal (first in list order, T12). Empty
    candidate arrays give no row (nothing to bid on).
    """
    logit = F.col(imp_logit) if imp_logit else None
    best = best_candidate(cands, predictor, F.col(imp_id), rule, logit, F.col(imp_vector) if imp_vector else None)
    out = spread(df).withColumn("_n_elig", F.size(cands).cast("bigint")).where(F.col("_n_elig") > 0)
    # Out of an array of one: columns and filters on the choice then do not score every pair again.
    out = out.select("*", F.explode_outer(F.array(best)).alias("_best"))
    return _outcome(out, F.lit(predictor == "cpm"), beta, price_model, imp_id)


def best_by_policy(df: DataFrame, cands: Column, policies: dict[str, str], beta: float = 1.0, rule: str = "value",
                   price_model: str = "relative", imp_id: str = "imp_id", imp_logit: str | None = None) -> DataFrame:
    """``best_campaign`` for each policy (name -> predictor), a row per impression and ``policy``; the input is read once."""
    logit = F.col(imp_logit) if imp_logit else None
    chosen = [F.struct(F.lit(name).alias("policy"), F.lit(p == "cpm").alias("flat"),
                       best_candidate(cands, p, F.col(imp_id), rule, logit).alias("best")) for name, p in policies.items()]
    out = spread(df).withColumn("_n_elig", F.size(cands).cast("bigint")).where(F.col("_n_elig") > 0)
    out = out.select("*", F.explode_outer(F.array(*chosen)).alias("_p")).select("*", "_p.policy", F.col("_p.flat").alias("_flat"), F.col("_p.best").alias("_best"))
    return _outcome(out.drop("_p"), F.col("_flat"), beta, price_model, imp_id).drop("_flat")


def _outcome(out: DataFrame, flat: Column, beta: float, price_model: str, imp_id: str) -> DataFrame:
    """Bid, market price and win from the chosen candidate ``_best`` among ``_n_elig``; ``flat``: bids a constant CPM."""
    ev = F.col("_best.pconv") * F.col("_best.value_per_conv")
    bid = F.when(flat, F.lit(CPM / 1000)).otherwise(F.greatest(F.lit(0.0), F.lit(float(beta)) * ev))
    out = out.select("*", F.col("_best.campaign_id").alias("campaign_id_chosen"),
                     F.col("_best.value_per_conv").alias("campaign_value_per_conv"),
                     F.col("_best.pconv").alias("pconv"), F.col("_best.score").alias("chosen_score"),
                     ev.alias("expected_value"), bid.alias("bid"),
                     F.col("_n_elig").alias("eligible_campaigns"))
    out = out.withColumn("market_price", market_price(F.col("bid"), F.col(imp_id), price_model))
    return out.withColumn("win", F.col("bid") > F.col("market_price")).drop("_best", "_n_elig")


def top_candidates_pruned(df: DataFrame, campaigns: DataFrame, k: int, predictor: str = "random", imp_id: str = "imp_id",
                          rule: str = "value", imp_logit: str | None = None, block: int = BLOCK_CAMPAIGNS) -> DataFrame:
    """``top_candidates`` over a campaign table of any length: the same array ``top``, without a limit.

    Blocks of campaigns come by falling bound. A round merges one block into
    each impression's best ``k`` and lets go of the impressions whose k-th best
    is above the next block's bound: nothing later can enter (an equal score
    could, by its list order, so those stay). A round's impressions are written
    to the shared folder, which cuts lineage; the rounds end when none is left.
    Candidates without a score sort last, and an empty table gives empty arrays.
    """
    logit = F.col(imp_logit) if imp_logit else None
    live, done, merged = spread(df), [], False
    blocks = campaign_blocks(campaigns, score_bound(predictor, rule), block)
    ahead = next(blocks, None)
    if ahead is None:
        return top_candidates(df, candidate_array([]), k, predictor, imp_id, rule, imp_logit)
    while ahead is not None:
        (camps, _), ahead = ahead, next(blocks, None)
        scored = scored_candidates(candidate_array(camps), predictor, F.col(imp_id), rule, logit)
        every = F.concat("top", scored) if merged else scored
        live = live.withColumn("top", F.slice(F.sort_array(every, asc=False), 1, k))
        if ahead is None:
            break
        path, merged = shared_path(df.sparkSession, "candidates"), True
        settled = (F.size("top") == k) & (F.element_at("top", -1)["score"] > F.lit(float(ahead[1])))
        live = live.withColumn("_settled", F.coalesce(settled, F.lit(False)))
        live.write.parquet(path)
        written = df.sparkSession.read.schema(live.schema).parquet(path)
        done.append(written.where("_settled").drop("_settled"))
        live = written.where("NOT _settled").drop("_settled")
        if live.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, live])


def best_campaign_pruned(df: DataFrame, campaigns: DataFrame, predictor: str = "random", beta: float = 1.0, rule: str = "value",
                         price_model: str = "relative", imp_id: str = "imp_id", imp_logit: str | None = None,
                         block: int = BLOCK_CAMPAIGNS) -> DataFrame:
    """``best_campaign`` over a campaign table of any length (B6): the first of ``top_candidates_pruned``."""
    n = campaigns.count()
    top = top_candidates_pruned(df, campaigns, 1, predictor, imp_id, rule, imp_logit, block)
    out = top.where(F.size("top") > 0).withColumn("_best", F.element_at("top", 1)).withColumn("_n_elig", F.lit(n).cast("bigint")).drop("top")
    return _outcome(out, F.lit(predictor == "cpm"), beta, price_model, imp_id)


def candidate_statistics_blocked(df: DataFrame, campaigns: DataFrame, predictor: str = "random", imp_id: str = "imp_id",
                                 rule: str = "value", imp_logit: str | None = None, block: int = BLOCK_CAMPAIGNS) -> DataFrame:
    """``candidate_statistics`` over a campaign table of any length (B14): a pass over the impressions for each block.

    Statistics of every campaign need every pair scored; a block's rows are
    written before the next block is read, so one block is in a plan at a time.
    """
    path = shared_path(df.sparkSession, "candidate-statistics")
    schema = None
    for camps, _ in campaign_blocks(campaigns, score_bound(predictor, rule), block):
        part = candidate_statistics(df, candidate_array(camps), predictor, imp_id, rule, imp_logit)
        part.write.mode("append").parquet(path)
        schema = part.schema
    if schema is None:
        return candidate_statistics(df, candidate_array([]), predictor, imp_id, rule, imp_logit)
    return df.sparkSession.read.schema(schema).parquet(path)


def top_candidates(df: DataFrame, cands: Column, k: int, predictor: str = "random", imp_id: str = "imp_id",
                   rule: str = "value", imp_logit: str | None = None) -> DataFrame:
    """The ``k`` best candidates of each impression as an array ``top``, best first.

    Entries are (score, neg_ordinal, campaign_id, pconv, value_per_conv). The
    output is linear in the impressions; pairs never become rows.
    """
    logit = F.col(imp_logit) if imp_logit else None
    sc = scored_candidates(cands, predictor, F.col(imp_id), rule, logit)
    return spread(df).withColumn("top", F.slice(F.sort_array(sc, asc=False), 1, k))


def candidate_statistics(df: DataFrame, cands: Column, predictor: str = "random", imp_id: str = "imp_id",
                         rule: str = "value", imp_logit: str | None = None) -> DataFrame:
    """Per campaign: impressions scored, mean and maximum pconv and score, and its parameters.

    Scores are expanded inside the task and aggregated there before the
    shuffle, which carries one row per campaign and task.
    """
    logit = F.col(imp_logit) if imp_logit else None

    def one(c):
        return _once(pconv_expr(predictor, F.col(imp_id), c, logit), lambda p: F.struct(
            c["campaign_id"].alias("campaign_id"), p.alias("pconv"), score_expr(p, c, rule).alias("score"),
            c["value_per_conv"].alias("value_per_conv"), c["true_conv_rate"].alias("true_conv_rate"), c["budget"].alias("budget")))
    pairs = spread(df).select(F.inline(F.transform(cands, one)))
    return pairs.groupBy("campaign_id", "value_per_conv", "true_conv_rate", "budget").agg(
        F.count(F.lit(1)).alias("impressions"), F.avg("pconv").alias("mean_pconv"), F.max("pconv").alias("max_pconv"),
        F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))


def candidates_of(df: DataFrame, imp_ids: list, cands: Column, predictor: str = "random", imp_id: str = "imp_id",
                  rule: str = "value", imp_logit: str | None = None, imp_vector: str | None = None) -> DataFrame:
    """Every candidate of the named impressions as rows (B14): the table one looks at for a single decision."""
    logit = F.col(imp_logit) if imp_logit else None

    def one(c):
        p = pconv_expr(predictor, F.col(imp_id), c, logit, F.col(imp_vector) if imp_vector else None)
        return F.struct(c["campaign_id"].alias("campaign_id"), c["ordinal"].alias("ordinal"),
                        p.alias("pconv"), score_expr(p, c, rule).alias("score"),
                        c["value_per_conv"].alias("value_per_conv"), c["true_conv_rate"].alias("true_conv_rate"),
                        c["budget"].alias("budget"))
    return df.where(F.col(imp_id).isin(*imp_ids)).select("*", F.inline(F.transform(cands, one)))
