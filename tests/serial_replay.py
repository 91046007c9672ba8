"""A plain serial allocation loop over collected rows: the test oracle for the fixpoint."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def u(salt, *keys) -> float:
    s = ":".join([str(salt)] + [str(k) for k in keys])
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 4294967296.0


def serial_replay(imps, camps, predictor="random", beta=1.0, tau=3, rule="value"):
    """imps: list of (imp_id, user_id, sampled_from) in order; camps: list of dicts by ordinal."""
    budget = {c["campaign_id"]: c["budget"] for c in camps}
    stock = defaultdict(int)
    log = []
    for imp_id, user_id, src in imps:
        elig = [c for c in camps if budget[c["campaign_id"]] > 0
                and (tau is None or stock[(user_id, c["campaign_id"])] < tau)]
        if not elig:
            continue
        best, best_s, best_p = None, None, None
        for c in elig:
            if predictor == "random":
                p = u("pconv", imp_id, c["campaign_id"])
            elif predictor == "heuristic":
                p = 1.0
            else:
                p = c["true_conv_rate"]
            s = p * c["value_per_conv"] if rule == "value" else p / c["target_cpa"]
            if best is None or s > best_s:
                best, best_s, best_p = c, s, p
        ev = best_p * best["value_per_conv"]
        bid = max(0.0, beta * ev)
        price = bid * (0.9 + 0.2 * u("price", imp_id))
        won = bid > price
        cid = best["campaign_id"]
        if won:
            budget[cid] -= price
            stock[(user_id, cid)] += 1
        log.append(dict(imp_id=imp_id, campaign_id=cid, win=won, market_price=price,
                        budget_remaining=budget[cid], eligible_campaigns=len(elig), pconv=best_p))
    return log
