"""Capped allocation: frequency cap, budget pacing and the exact replay.

The reference allocates impressions one at a time: eligibility (budget left
and fewer than tau wins for this user), argmax, bid, market, state update.
Here the same result is reached as a fixpoint of data-parallel rounds:

* From the previous round's assignment, two cut-off tables are derived:
  per campaign the first ``imp_id`` at which cumulative won spend reaches
  the budget; per (user, campaign) the ``imp_id`` of the tau-th win.
  A candidate is eligible for impression j iff j <= both cut-offs.
* Every impression is re-decided against those cut-offs (array filter and
  argmax, no shuffle); the user cut-offs arrive through one join on user_id.
* Stop when the cut-offs no longer change. Round r fixes at least the first
  r impressions, so the fixpoint is unique and equals the serial loop.

Campaign cut-offs are one row per campaign (bounded, folded into the literal
candidate array). User cut-offs stay a distributed table. Each round's
assignment is cut from its lineage with ``checkpoint()`` into the shared
checkpoint folder. A replay that has not converged after ``max_rounds``
raises; it never returns a partial answer.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor


from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspark.operators.candidates import (
    best_by_policy,
    best_campaign,
    best_first,
    candidate_array,
    literal_map,
    market_price,
    pconv_expr,
    score_expr,
    scored_candidates,
)
from adspark.operators.ordering import running_sum_blocked, spread
from adspark.session import checkpoint_root, materialize, shared_path, staged

NO_ACCESS = -(2 ** 62)
_POOL = ThreadPoolExecutor(max_workers=2, thread_name_prefix="adspark-cutoffs")
MAX_BROADCAST_CUTS = 2_000_000  # (user, campaign) cut-off entries shipped to every task at most


def frequency_cap(log: DataFrame, tau: int, user: str = "user_id", campaign: str = "campaign_id",
                  order: str = "imp_id") -> DataFrame:
    """Keep the first ``tau`` wins per (user, campaign) in impression order."""
    w = Window.partitionBy(user, campaign).orderBy(order)
    wins = log.where(F.col("win"))
    return wins.withColumn("win_no", F.row_number().over(w).cast("bigint")).where(F.col("win_no") <= tau)


def budget_pacing(log: DataFrame, budgets: DataFrame, campaign: str = "campaign_id", order: str = "imp_id",
                  price: str = "market_price", block_size: int = 100_000) -> DataFrame:
    """Keep won rows while spend before them is under budget; running budget_remaining.

    The running sum is two-level (per campaign and imp_id block) so a hot
    campaign is spread over many tasks.
    """
    wins = staged(log.where(F.col("win")), "wins")  # read twice below
    cum = running_sum_blocked(wins, [campaign], order, price, block_size, out_col="_spent")
    b = materialize(budgets.select(campaign, "budget"))  # one row per campaign, computed once
    j = cum.join(F.broadcast(b) if _small(b) else b, campaign, "inner")
    return (j.withColumn("spent_before", F.col("_spent") - F.col(price))
             .where(F.col("spent_before") < F.col("budget"))
             .withColumn("budget_remaining", F.col("budget") - F.col("_spent"))
             .drop("_spent"))


def _small(df: DataFrame, limit: int = 100_000) -> bool:
    return df.limit(limit + 1).count() <= limit


def _budget_cutoffs(assign: DataFrame, camps: list[dict], spent0: dict, block_size: int) -> dict:
    """campaign_id -> last eligible imp_id (absent = no limit)."""
    budgets = {c["campaign_id"]: c["budget"] for c in camps}
    wins = assign.where(F.col("win")).select("imp_id", F.col("campaign_id_chosen").alias("cid"), "market_price")
    cum = running_sum_blocked(wins, ["cid"], "imp_id", "market_price", block_size, out_col="_cum")
    bud = literal_map({cid: float(b - spent0.get(cid, 0.0)) for cid, b in budgets.items()})
    hit = (cum.where(F.col("_cum") >= bud[F.col("cid").cast("string")])
           .groupBy("cid").agg(F.min("imp_id").alias("cut")).collect())  # at most one row per campaign
    cuts = {r["cid"]: r["cut"] for r in hit}
    for cid, b in budgets.items():
        if spent0.get(cid, 0.0) >= b:
            cuts[cid] = NO_ACCESS
    return cuts


def _user_cutoffs(assign: DataFrame, tau: int, wins0: DataFrame | None) -> DataFrame:
    """(user_id, map<campaign_id, last eligible imp_id>) for pairs whose cap binds."""
    wins = assign.where(F.col("win")).select("imp_id", "user_id", F.col("campaign_id_chosen").alias("cid"))
    need = F.lit(tau)
    if wins0 is not None:
        wins = wins.join(wins0.select("user_id", F.col("campaign_id").alias("cid"), "n_prior"),
                         ["user_id", "cid"], "left")
        need = F.lit(tau) - F.coalesce(F.col("n_prior"), F.lit(0))
    w = Window.partitionBy("user_id", "cid").orderBy("imp_id")
    # The literal bound lets Spark stop ranking a hot pair after tau rows.
    cut = (wins.withColumn("_k", F.row_number().over(w)).where((F.col("_k") <= tau) & (F.col("_k") == need))
           .select("user_id", "cid", F.col("imp_id").alias("cut")))
    if wins0 is not None:
        full = (wins0.where(F.col("n_prior") >= tau)
                .select("user_id", F.col("campaign_id").alias("cid"), F.lit(NO_ACCESS).cast("bigint").alias("cut")))
        cut = cut.unionByName(full)
    # One row per user with at most one entry per campaign: bounded by the campaign count.
    return cut.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("cid", "cut"))).alias("ucut"))


def _prepare(base: DataFrame, camps: list[dict], predictor: str, rule: str, imp_logit: str | None,
             shortlist: int) -> DataFrame:
    """Round-invariant part: each impression's best ``shortlist`` campaign ordinals, best first.

    Scores do not depend on budgets or caps, so the candidate order is
    computed once and kept as a short ``array<int>`` of ordinals (4 bytes per
    entry). Each round walks it to the first eligible campaign and scores only
    that one; a row whose whole shortlist became ineligible is re-scored in
    full in that round (exact fallback).
    """
    logit = F.col(imp_logit) if imp_logit else None
    sc = scored_candidates(candidate_array(camps), predictor, F.col("imp_id"), rule, logit)
    # Descending by (score, -ordinal): best score first, ties to the lowest ordinal.
    order = F.transform(F.sort_array(sc, asc=False), lambda c: (-c["neg_ordinal"]).cast("int"))
    return spread(base).select("imp_id", "user_id", "imp_campaign_id_sampled_from",
                               *([imp_logit] if imp_logit else []),
                               F.slice(order, 1, shortlist).alias("_ords"))


def _by_ordinal(camps: list[dict], extra: dict | None = None) -> Column:
    """Literal array of campaign structs indexed by ordinal (position = ordinal)."""
    n = max((c["ordinal"] for c in camps), default=0)
    slots = {c["ordinal"]: c for c in camps}
    filled = [slots.get(i) or dict(campaign_id=-1, ordinal=i, true_conv_rate=0.0, value_per_conv=0.0,
                                   target_cpa=1.0, budget=0.0) for i in range(1, n + 1)]
    return candidate_array(filled, extra)


def _decide(pre: DataFrame, camps: list[dict], bcut: dict, ucut: DataFrame | None,
            beta: float, price_model: str, ucut_entries: int | None = None, predictor: str = "random",
            rule: str = "value", imp_logit: str | None = None) -> DataFrame:
    """One round: first eligible campaign of the shortlist (full re-score if none is left)."""
    # Budget cut-offs ride in the ordinal-indexed campaign array (O(1) lookup).
    by_ord = _by_ordinal(camps, {"bcut": {c["campaign_id"]: bcut.get(c["campaign_id"]) for c in camps}})
    if ucut is not None:
        # Broadcast the user cut-offs only when their counted size is under the
        # bound; beyond it, a shuffle join (AQE splits a hot user's partition).
        small = ucut_entries is not None and ucut_entries <= MAX_BROADCAST_CUTS
        d = pre.join(F.broadcast(ucut) if small else ucut, "user_id", "left")
    else:
        d = pre

    def ok(c):
        cond = c["bcut"].isNull() | (F.col("imp_id") <= c["bcut"])
        if ucut is not None:
            lim_u = F.col("ucut")[c["campaign_id"]]
            cond = cond & (lim_u.isNull() | (F.col("imp_id") <= lim_u))
        return cond & (c["campaign_id"] >= 0)

    first = F.filter(F.col("_ords"), lambda o: ok(F.element_at(by_ord, o)))
    n_elig = F.size(F.filter(by_ord, ok))
    logit = F.col(imp_logit) if imp_logit else None
    full = F.array_max(F.filter(
        scored_candidates(by_ord, predictor, F.col("imp_id"), rule, logit),
        lambda s: ok(F.element_at(by_ord, -s["neg_ordinal"]))))
    chosen_ord = F.when(F.size(first) > 0, first[0]).otherwise(-full["neg_ordinal"])
    out = (d.withColumn("eligible_campaigns", n_elig.cast("bigint"))
           .where(F.col("eligible_campaigns") > 0)
           .withColumn("_c", F.element_at(by_ord, chosen_ord)))
    c = F.col("_c")
    pconv = pconv_expr(predictor, F.col("imp_id"), c, logit)
    out = out.withColumn("pconv", pconv)
    ev = F.col("pconv") * c["value_per_conv"]
    bid = F.greatest(F.lit(0.0), F.lit(float(beta)) * ev)
    out = out.select("imp_id", "user_id", "imp_campaign_id_sampled_from", "eligible_campaigns",
                     c["campaign_id"].alias("campaign_id_chosen"),
                     c["value_per_conv"].alias("campaign_value_per_conv"), "pconv",
                     score_expr(F.col("pconv"), c, rule).alias("chosen_score"),
                     ev.alias("expected_value"), bid.alias("bid"))
    out = out.withColumn("market_price", market_price(F.col("bid"), F.col("imp_id"), price_model))
    return out.withColumn("win", F.col("bid") > F.col("market_price"))


def _flat_cuts(a: DataFrame) -> DataFrame:
    return a.select("user_id", F.explode("ucut").alias("cid", "cut"))


def _signature(a: DataFrame | None) -> tuple:
    """Order-free 128-bit fingerprint of a user cut-off table (one small aggregate)."""
    if a is None:
        return ()
    r = _flat_cuts(a).agg(F.count(F.lit(1)).alias("n"),
                          F.bit_xor(F.xxhash64("user_id", "cid", "cut")).alias("h1"),
                          F.bit_xor(F.xxhash64(F.lit("s2"), "user_id", "cid", "cut")).alias("h2")).first()
    return (r["n"], r["h1"], r["h2"])


def _same_cuts(a: DataFrame | None, b: DataFrame | None) -> bool:
    """Exact equality of two user cut-off tables."""
    if a is None or b is None:
        return a is None and b is None
    fa, fb = _flat_cuts(a), _flat_cuts(b)
    return fa.exceptAll(fb).limit(1).count() == 0 and fb.exceptAll(fa).limit(1).count() == 0


#: Rows of the first block of ``allocation_replay``; each later one has twice the rows of the one before.
FIRST_BLOCK = 100_000


def allocation_replay(imps: DataFrame, camps: list[dict], predictor: str = "random", beta: float = 1.0,
                      tau: int | None = 3, rule: str = "value", price_model: str = "relative",
                      imp_logit: str | None = None, max_rounds: int = 200, block_size: int = 100_000,
                      spent0: dict | None = None, wins0: DataFrame | None = None,
                      return_rounds: bool = False, shortlist: int = 16, first_block: int = FIRST_BLOCK):
    """Exact sequential allocation (B12) as a fixpoint; returns the auction log.

    ``imps`` needs ``imp_id`` (unique, the processing order), ``user_id`` and
    ``imp_campaign_id_sampled_from``. ``camps`` is the bounded campaign list
    (``collect_campaigns``). ``spent0`` / ``wins0`` carry state from earlier
    blocks (spend per campaign; ``(user_id, campaign_id, n_prior)`` wins).
    ``tau=None`` disables the frequency cap; a budget of ``inf`` disables pacing.

    More than ``first_block`` impressions are replayed in ordered blocks, each
    twice as long as the one before, with carried state: the rounds that the
    early impressions need pass over few rows. Once every budget is spent no
    later impression has a candidate, and none gets a row in the log, so no
    further block is replayed.
    """
    kw = dict(predictor=predictor, beta=beta, tau=tau, rule=rule, price_model=price_model, imp_logit=imp_logit,
              max_rounds=max_rounds, block_size=block_size, shortlist=shortlist)
    base = staged(imps.select("imp_id", "user_id", "imp_campaign_id_sampled_from", *([imp_logit] if imp_logit else [])), "replay-imps")
    n, ends = base.count(), []
    while sum(ends) + first_block * 2 ** len(ends) < n:
        ends.append(first_block * 2 ** len(ends))
    if not ends:
        log, rounds = _replay(base, camps, spent0, wins0, **kw)
    else:
        log, rounds = _replay_in_order(base, camps, [sum(ends[:i + 1]) / n for i in range(len(ends))], spent0, wins0, **kw)
    return (log, rounds) if return_rounds else log


def _replay(imps: DataFrame, camps: list[dict], spent0: dict | None, wins0: DataFrame | None, predictor: str, beta: float,
            tau: int | None, rule: str, price_model: str, imp_logit: str | None, max_rounds: int, block_size: int,
            shortlist: int) -> tuple[DataFrame, int]:
    """The fixpoint over one block; returns its log and the number of rounds."""
    checkpoint_root(imps.sparkSession)
    spent0 = spent0 or {}
    base = imps.select("imp_id", "user_id", "imp_campaign_id_sampled_from",
                       *([imp_logit] if imp_logit else []))
    bcut, ucut = {}, None
    for cid, b in ((c["campaign_id"], c["budget"]) for c in camps):
        if spent0.get(cid, 0.0) >= b:
            bcut[cid] = NO_ACCESS
    if tau is not None and wins0 is not None:
        ucut = _user_cutoffs(base.limit(0).withColumn("win", F.lit(True))
                             .withColumn("campaign_id_chosen", F.lit(None).cast("bigint")), tau, wins0)
    # Read back in few partitions, however many tasks scored it: every round passes over it.
    pre = staged(_prepare(base, camps, predictor, rule, imp_logit, shortlist), "shortlists")
    rounds, sig, prev = 0, _signature(ucut), None
    while True:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"allocation did not converge in {max_rounds} rounds")
        # The assignment is read three times; persisted, not checkpointed: its
        # lineage is short because the user cut-offs it depends on are.
        assign = _decide(pre, camps, bcut, ucut, beta, price_model, sig[0] if sig else None,
                         predictor, rule, imp_logit)
        assign = assign.persist(StorageLevel.MEMORY_AND_DISK)
        # The two cut-off tables are independent jobs: submitted concurrently.
        fut_b = _POOL.submit(_budget_cutoffs, assign, camps, spent0, block_size)
        if tau is not None:
            new_u = _user_cutoffs(assign, tau, wins0).checkpoint()
            new_sig = _signature(new_u)
        else:
            new_u, new_sig = None, ()
        new_b = fut_b.result()
        if new_b == bcut and new_sig == sig and _same_cuts(new_u, ucut):
            break
        if prev is not None:
            prev.unpersist()
        prev = assign
        bcut, ucut, sig = new_b, new_u, new_sig
    if prev is not None:
        prev.unpersist()
    log = materialize(_log(assign, camps, spent0, block_size))
    assign.unpersist()
    return log, rounds


# The columns of the documented auction log.
LOG_COLUMNS = ["imp_id", "imp_campaign_id_sampled_from", "user_id", "campaign_id", "campaign_value_per_conv",
               "expected_value", "bid", "market_price", "win", "pconv", "utility", "budget_remaining",
               "eligible_campaigns", "chosen_score"]


def _log(assign: DataFrame, camps: list[dict], spent0: dict, block_size: int) -> DataFrame:
    """The 14-column auction log; budget_remaining after this impression's update."""
    start = literal_map({c["campaign_id"]: float(c["budget"] - spent0.get(c["campaign_id"], 0.0)) for c in camps})
    a = (assign.withColumnRenamed("campaign_id_chosen", "campaign_id")
         .withColumn("_spend", F.when(F.col("win"), F.col("market_price")).otherwise(F.lit(0.0))))
    cum = running_sum_blocked(a, ["campaign_id"], "imp_id", "_spend", block_size, out_col="_cum")
    out = (cum.withColumn("budget_remaining", start[F.col("campaign_id").cast("string")] - F.col("_cum"))
           .withColumn("utility", F.when(F.col("win"), F.col("expected_value") - F.col("market_price"))
                       .otherwise(F.lit(0.0))))
    return out.select(*LOG_COLUMNS)


def decisions(imps: DataFrame, camps: list[dict], predictor: str = "random", beta: float = 1.0, rule: str = "value",
              price_model: str = "relative", imp_logit: str | None = None) -> DataFrame:
    """Each impression's winning candidate, price and outcome with every campaign eligible.

    The log without its running budget: one pass, no shuffle. Other columns of
    ``imps`` (its time) stay.
    """
    out = best_campaign(imps, candidate_array(best_first(camps, rule)), predictor=predictor, beta=beta, rule=rule,
                        price_model=price_model, imp_logit=imp_logit)
    return out.withColumnRenamed("campaign_id_chosen", "campaign_id")


def decisions_by_policy(imps: DataFrame, camps: list[dict], policies: dict[str, str], beta: float = 1.0, rule: str = "value",
                        price_model: str = "relative", imp_logit: str | None = None) -> DataFrame:
    """``decisions`` of several policies (name -> predictor) with a column ``policy``, from one pass over the impressions (L1).

    The impression side is read and scored once; a row per policy comes out of
    an array of decisions.
    """
    out = best_by_policy(imps, candidate_array(best_first(camps, rule)), policies, beta=beta, rule=rule, price_model=price_model, imp_logit=imp_logit)
    return out.withColumnRenamed("campaign_id_chosen", "campaign_id")


def stateless_auction(imps: DataFrame, camps: list[dict], predictor: str = "random", beta: float = 1.0,
                      rule: str = "value", price_model: str = "relative", imp_logit: str | None = None,
                      block_size: int = 100_000) -> DataFrame:
    """One pass with every campaign eligible (no budget or cap binds): the unconstrained log.

    With no state to filter on, the argmax is one pass over the candidates: no
    sorting, no shuffle before the per-campaign running budget.
    """
    base = imps.select("imp_id", "user_id", "imp_campaign_id_sampled_from", *([imp_logit] if imp_logit else []))
    assign = best_campaign(base, candidate_array(best_first(camps, rule)), predictor=predictor, beta=beta, rule=rule,
                           price_model=price_model, imp_logit=imp_logit)
    # Written, so scored once: the running budget reads it twice.
    return _log(staged(assign, "decisions"), camps, {}, block_size)


def eligible_counts(imps: DataFrame, camps: list[dict], first_pass: DataFrame, tau: int,
                    block_size: int = 100_000) -> DataFrame:
    """Eligible campaigns per impression under the cut-offs implied by a log.

    This is one round of the fixpoint: cut-offs from ``first_pass`` (budget
    reached, tau-th win), then a count of candidates each impression may bid on.
    """
    wins = first_pass.where(F.col("win")).select("imp_id", "user_id", F.col("campaign_id").alias("campaign_id_chosen"), "market_price", "win")
    a = staged(wins, "wins")  # read by both kinds of cut-offs
    bcut = _budget_cutoffs(a, camps, {}, block_size)
    ucut = _user_cutoffs(a, tau, None)
    cands = candidate_array(camps, {"bcut": bcut})
    d = spread(imps.select("imp_id", "user_id")).join(ucut, "user_id", "left")

    def ok(c):
        lim = F.col("ucut")[c["campaign_id"]]
        return ((c["bcut"].isNull() | (F.col("imp_id") <= c["bcut"]))
                & (lim.isNull() | (F.col("imp_id") <= lim)))
    return d.select("imp_id", "user_id", F.size(F.filter(cands, ok)).cast("bigint").alias("eligible_campaigns"))


def allocation_replay_blocked(imps: DataFrame, camps: list[dict], block_rows: int, **kw) -> DataFrame:
    """Exact replay over ordered blocks of about ``block_rows`` impressions with carried state.

    As ``allocation_replay``, with blocks of one size: no block is longer.
    """
    n = imps.count()
    n_blocks = max(1, -(-n // block_rows))
    if n_blocks == 1:
        return allocation_replay(imps, camps, **kw)
    how = dict(predictor="random", beta=1.0, tau=3, rule="value", price_model="relative", imp_logit=None, max_rounds=200,
               block_size=100_000, shortlist=16) | kw
    spent0, wins0 = how.pop("spent0", None), how.pop("wins0", None)
    return _replay_in_order(imps, camps, [i / n_blocks for i in range(1, n_blocks)], spent0, wins0, **how)[0]


def _replay_in_order(imps: DataFrame, camps: list[dict], shares: list[float], spent0: dict | None, wins0: DataFrame | None,
                     **kw) -> tuple[DataFrame, int]:
    """The replay block by block, cut at these shares of the rows; returns the whole log and the number of rounds.

    Block edges come from approximate quantiles of ``imp_id`` (a bounded
    sketch); each block runs the fixpoint on its own rows, starting from the
    spend per campaign (one row per campaign) and the wins per (user,
    campaign) of all earlier blocks. Block logs are appended to a table in the
    shared checkpoint folder, which is returned.
    """
    edges = imps.agg(F.percentile_approx("imp_id", shares, 10_000)).first()[0]
    out = shared_path(imps.sparkSession, "replay-blocks")
    spent0, rounds, lo = dict(spent0 or {}), 0, None
    for hi in [*sorted(set(edges or [])), None]:
        rows = imps if lo is None else imps.where(F.col("imp_id") > lo)
        # Rows without an id sort first, so they are in the first block.
        rows = rows if hi is None else rows.where((F.col("imp_id") <= hi) | F.col("imp_id").isNull())
        log, more = _replay(rows, camps, spent0, wins0, **kw)
        part, rounds, lo = f"{out}/block={-1 if hi is None else hi}", rounds + more, hi
        log.write.parquet(part)
        won = imps.sparkSession.read.schema(log.schema).parquet(part).where("win")
        for r in won.groupBy("campaign_id").agg(F.sum("market_price").alias("s")).collect():  # <= campaigns
            spent0[r["campaign_id"]] = spent0.get(r["campaign_id"], 0.0) + r["s"]
        if all(spent0.get(c["campaign_id"], 0.0) >= c["budget"] for c in camps):
            break
        new = won.groupBy("user_id", "campaign_id").agg(F.count(F.lit(1)).alias("n_prior"))
        if wins0 is not None:
            new = (wins0.unionByName(new).groupBy("user_id", "campaign_id")
                   .agg(F.sum("n_prior").alias("n_prior")))
        wins0 = materialize(new)
    return imps.sparkSession.read.schema(log.schema).parquet(f"{out}/block=*"), rounds
