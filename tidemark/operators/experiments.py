"""Experiments and flags: exposures, arm tables, and statistics of the few rows that arm tables have."""

from __future__ import annotations

import math
import statistics

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.web import stable_bucket


def first_exposures(exposures: DataFrame) -> DataFrame:
    """(user, variant, first_ms) of users seen in one variant only; others are contaminated and left out."""
    first = exposures.groupBy("user").agg(F.min_by("variant", "ts_ms").alias("variant"), F.min("ts_ms").alias("first_ms"), F.count_distinct("variant").alias("variants"))
    return first.filter("variants = 1").drop("variants")


def user_values(exposed: DataFrame, metric: DataFrame, window_ms: int, how: str = "binary") -> DataFrame:
    """(user, variant, value): a user's metric events (user, ts_ms, value) in [first, first + window], as 0/1, count or sum."""
    inside = (F.col("ts_ms") >= F.col("first_ms")) & (F.col("ts_ms") <= F.col("first_ms") + window_ms)
    joined = exposed.join(metric, "user", "left").withColumn("v", F.when(inside, F.col("value")))
    value = {"binary": F.max(F.when(inside, 1.0).otherwise(0.0)), "count": F.count("v").cast("double"), "sum": F.coalesce(F.sum("v"), F.lit(0.0))}[how]
    return joined.groupBy("user", "variant").agg(value.alias("value"))


def arms(values: DataFrame, winsorize: float | None = None) -> DataFrame:
    """(variant, n, mean, variance); values may be cut at the pooled percentiles winsorize and 1 - winsorize."""
    if winsorize:
        cut = values.agg(F.percentile("value", winsorize).alias("lo"), F.percentile("value", 1 - winsorize).alias("hi"))
        values = values.join(F.broadcast(cut)).withColumn("value", F.greatest("lo", F.least("hi", "value")))  # one row
    return values.groupBy("variant").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of a share by Wilson's score interval."""
    p = hits / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def variant_of(salt: str, user: Column, weights: dict[str, int]) -> Column:
    """The variant whose range of 1 to 100 holds the user's bucket; empty beyond the weights."""
    bucket, out, upto = stable_bucket(F.lit(salt), user), None, 0
    for name, weight in weights.items():
        upto += weight
        out = F.when(bucket <= upto, name) if out is None else out.when(bucket <= upto, name)
    return out.otherwise("")


def flag(rules: list[dict], context: Column, salt: str, user: Column, rollout_pct: int) -> Column:
    """True where all rules hold over the context map and the user's bucket is in the rollout.

    Operators: is_set, not_set, eq, neq, in, not_in, contains, starts_with, ends_with, gt, gte, lt, lte. A missing
    attribute fails every rule but not_set.
    """
    ok = stable_bucket(F.lit(salt), user) <= rollout_pct
    for rule in rules:
        of, value = context[rule["attribute"]], rule.get("value")
        number = of.try_cast("double")
        tests = {
            "is_set": lambda: of.isNotNull(), "not_set": lambda: of.isNull(), "eq": lambda: of == value, "neq": lambda: of != value, "in": lambda: of.isin(value), "not_in": lambda: ~of.isin(value),
            "contains": lambda: F.contains(of, F.lit(value)), "starts_with": lambda: F.startswith(of, F.lit(value)), "ends_with": lambda: F.endswith(of, F.lit(value)),
            "gt": lambda: number > value, "gte": lambda: number >= value, "lt": lambda: number < value, "lte": lambda: number <= value,
        }
        ok = ok & F.coalesce(tests[rule["op"]](), F.lit(False))
    return ok


def newcombe(k1: int, n1: int, k2: int, n2: int, z: float = 1.959963984540054) -> tuple[float, float]:
    """Interval of the difference of two shares, second minus first."""

    def bounds(k: int, n: int) -> tuple[float, float]:
        p = k / n
        spread = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        return (p + z * z / (2 * n) - spread) / (1 + z * z / n), (p + z * z / (2 * n) + spread) / (1 + z * z / n)

    (l1, u1), (l2, u2), p1, p2 = bounds(k1, n1), bounds(k2, n2), k1 / n1, k2 / n2
    return p2 - p1 - math.hypot(p2 - l2, u1 - p1), p2 - p1 + math.hypot(u2 - p2, p1 - l1)


def holm(p: list[float]) -> list[float]:
    """Step-down adjusted p-values, in the order given."""
    out, highest = [0.0] * len(p), 0.0
    for rank, i in enumerate(sorted(range(len(p)), key=p.__getitem__)):
        highest = max(highest, min(1.0, (len(p) - rank) * p[i]))
        out[i] = highest
    return out


def chi_square(table: list[tuple[int, int]], yates: bool | None = None) -> tuple[float, float]:
    """(statistic, p) of arms (n, hits) against equal shares; two arms are corrected for continuity."""
    hits, n = np.array([k for _, k in table], float), np.array([m for m, _ in table], float)
    both = np.stack((hits, n - hits))
    expected = both.sum(axis=1, keepdims=True) * both.sum(axis=0) / both.sum()
    off = np.abs(both - expected) - (0.5 if (len(table) == 2 if yates is None else yates) else 0.0)
    stat = float((np.maximum(off, 0) ** 2 / expected).sum())
    return stat, upper_gamma((len(table) - 1) / 2, stat / 2)


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function for whole and half a, by its recurrence."""
    if x <= 0:
        return 1.0
    at, out = (1.0, math.exp(-x)) if a == int(a) else (0.5, math.erfc(math.sqrt(x)))
    while at < a:
        out += math.exp(at * math.log(x) - x - math.lgamma(at + 1))
        at += 1
    return out


def welch(n1: int, m1: float, v1: float, n2: int, m2: float, v2: float) -> tuple[float, float, float]:
    """(difference, t, degrees of freedom) of two arms, second minus first."""
    a, b = v1 / n1, v2 / n2
    return m2 - m1, (m2 - m1) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))


def beats_control(arms_: dict[str, tuple[int, int]], control: str, draws: int = 4000, seed: int = 1) -> dict[str, float]:
    """Chance that each arm's share (n, hits) exceeds the control's, from draws of Beta(1 + hits, 1 + misses)."""
    rng = np.random.default_rng(seed)
    drawn = {name: rng.beta(1 + k, 1 + n - k, draws) for name, (n, k) in arms_.items()}
    return {name: float((x > drawn[control]).mean()) for name, x in drawn.items() if name != control}


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the table (a, b), (c, d): all tables with its margins that are no likelier than it."""
    rows, column, n = (a + b, c + d), a + c, a + b + c + d
    if not n:
        return 1.0
    everything = math.lgamma(n + 1) - math.lgamma(column + 1) - math.lgamma(n - column + 1)

    def log_choose(m: int, k: int) -> float:
        return math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)

    def chance(x: int) -> float:
        return math.exp(log_choose(rows[0], x) + log_choose(rows[1], column - x) - everything)

    observed = chance(a) * (1 + 1e-9)
    return min(1.0, sum(p for x in range(max(0, column - rows[1]), min(rows[0], column) + 1) if (p := chance(x)) <= observed))


def sample_ratio(exposures: list[int], weights: list[float]) -> tuple[float, float]:
    """(statistic, p) of the arms' exposures against their allocation."""
    n, total = sum(exposures), sum(weights)
    if not n or total <= 0:
        return 0.0, 1.0
    stat = sum((x - n * w / total) ** 2 / (n * w / total) for x, w in zip(exposures, weights, strict=True) if w > 0)
    return stat, upper_gamma((len(exposures) - 1) / 2, stat / 2)


def sample_size(share: float, lift: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Exposures per arm that show an absolute lift over a share; 0 where there is none to show."""
    if not (0 < share < 1 and lift > 0 and share + lift < 1):
        return 0
    normal, other = statistics.NormalDist(), share + lift
    middle = (share + other) / 2
    root = normal.inv_cdf(1 - alpha / 2) * math.sqrt(2 * middle * (1 - middle)) + normal.inv_cdf(power) * math.sqrt(share * (1 - share) + other * (1 - other))
    return math.ceil((root / lift) ** 2)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by the continued fraction of its nearer side (Lentz's evaluation)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """p of Student's t in both directions."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    """Quantile above one half of Student's t, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_two_sided(middle, df) / 2 < p else (low, middle)
    return (low + high) / 2


def welch_test(n1: int, m1: float, v1: float, n2: int, m2: float, v2: float, alpha: float = 0.05) -> dict[str, float]:
    """Welch's test of two arms, second minus first: diff, t, df, p and the interval low, high.

    Arms of one row are no evidence; two arms without spread are certain evidence where their means differ.
    """
    out = {"diff": m2 - m1, "t": 0.0, "df": 0.0, "p": 1.0, "low": m2 - m1, "high": m2 - m1}
    if min(n1, n2) < 2:
        return out
    if v1 / n1 + v2 / n2 <= 0:
        return out | {"df": float(n1 + n2 - 2), "p": float(m1 == m2)}
    diff, t, df = welch(n1, m1, v1, n2, m2, v2)
    reach = t_quantile(1 - alpha / 2, df) * math.sqrt(v1 / n1 + v2 / n2)
    return {"diff": diff, "t": t, "df": df, "p": t_two_sided(t, df), "low": diff - reach, "high": diff + reach}


#: Significance of the tests, and of a broken allocation.
ALPHA, ALPHA_RATIO = 0.05, 0.001


#: Least exposures of an arm for a metric of counts or sums.
LEAST_CONTINUOUS = 30


def required_exposures(least: int, planned: int = 0, floor: int = 0, override: bool = False) -> int:
    """Exposures that every arm needs: the greatest of the three, of which an override waives the planned one."""
    return max(least, floor, 0 if override else planned)


def omnibus(n: list[int], hits: list[int]) -> tuple[float, float, bool]:
    """(statistic, p, small) of all arms against equal shares, two corrected for continuity; small where an expected
    count is below 5. Arms without exposures and cells that expect nothing are left out."""
    total = sum(n)
    if len(n) < 2 or not total:
        return 0.0, 1.0, False
    share, stat, small = sum(hits) / total, 0.0, False
    for exposures, k in zip(n, hits, strict=True):
        for observed, expected in ((k, exposures * share), (exposures - k, exposures * (1 - share))):
            if expected > 0:
                small = small or expected < 5
                stat += max(0.0, abs(observed - expected) - (0.5 if len(n) == 2 else 0.0)) ** 2 / expected
    return stat, upper_gamma((len(n) - 1) / 2, stat / 2), small


def _gates(n: list[int], weights: list[float] | None, required: int) -> dict:
    out = {"test": "none", "p": 1.0, "horizon_met": len(n) > 1 and min(n) >= required, "required": required, "ratio_p": 1.0, "ratio_broken": False, "pairwise": [], "winner": ""}
    if weights and len(weights) == len(n) > 1:
        out["ratio_p"] = sample_ratio(n, weights)[1]
        out["ratio_broken"] = out["ratio_p"] < ALPHA_RATIO
    return out


def _winner(out: dict, names: list[str], scores: list[float]) -> str:
    """The arm with the best score if it beats the control's and its own comparison survives; never the control."""
    if not out["horizon_met"] or out["ratio_broken"] or out["test"] == "none" or out["p"] >= ALPHA:
        return ""
    best = max(range(1, len(names)), key=lambda i: scores[i])
    return names[best] if scores[best] > scores[0] and out["pairwise"][best - 1]["significant"] else ""


def results(arm_rows: list[tuple[str, int, int]], weights: list[float] | None = None, required: int = 100) -> dict:
    """Verdict over arms (variant, exposures, conversions), the control first.

    A chi-square test over all arms (corrected for two), Fisher's exact test where two arms have an expected count
    below 5, none where more have; each arm against the control, exactly where their own table has such a count, with
    Newcombe intervals and Holm's correction. A winner needs every arm at the horizon of required exposures, an
    allocation as declared, a test with p below ALPHA, and the best arm above the control to survive Holm.
    """
    names, n, hits = [a[0] for a in arm_rows], [a[1] for a in arm_rows], [a[2] for a in arm_rows]
    out = _gates(n, weights, required)
    if len(n) < 2:
        return out
    _, p, small = omnibus(n, hits)
    if small and len(n) == 2:
        out |= {"test": "fisher-exact", "p": fisher_exact(hits[0], n[0] - hits[0], hits[1], n[1] - hits[1])}
    elif not small:
        out |= {"test": "chi-square-yates" if len(n) == 2 else "chi-square", "p": p}
    alone, exact = [], []
    for m, k in zip(n[1:], hits[1:], strict=True):
        _, p, few = omnibus([n[0], m], [hits[0], k])
        few = few and n[0] > 0 and m > 0
        alone.append(1.0 if not (n[0] and m) else fisher_exact(hits[0], n[0] - hits[0], k, m - k) if few else p)
        exact.append(few)
    shares = [k / m if m else 0.0 for m, k in zip(n, hits, strict=True)]
    for i, adjusted in enumerate(holm(alone), 1):
        low, high = newcombe(hits[0], n[0], hits[i], n[i]) if n[0] and n[i] else (0.0, 0.0)
        relative = (shares[i] - shares[0]) / shares[0] if shares[0] else 0.0
        out["pairwise"].append({"variant": names[i], "lift": shares[i] - shares[0], "relative": relative, "low": low, "high": high, "p": alone[i - 1], "adjusted_p": adjusted, "significant": adjusted <= ALPHA, "exact": exact[i - 1]})
    return out | {"winner": _winner(out, names, shares)}


def continuous_results(arm_rows: list[tuple[str, int, float, float]], exposures: list[int], weights: list[float] | None = None, required: int = 100) -> dict:
    """Verdict over arms (variant, n, mean, variance) of a count or a sum, the control first; exposures per arm.

    Welch's test of each arm against the control with Holm's correction; p is the smallest corrected one. The horizon is
    at least LEAST_CONTINUOUS. Otherwise as results().
    """
    out = _gates(exposures, weights, max(required, LEAST_CONTINUOUS))
    if len(arm_rows) < 2:
        return out
    names, means = [a[0] for a in arm_rows], [a[2] for a in arm_rows]
    tests = [welch_test(*arm_rows[0][1:], *arm[1:], ALPHA) for arm in arm_rows[1:]]
    for i, adjusted in enumerate(holm([t["p"] for t in tests]), 1):
        t = tests[i - 1]
        out["pairwise"].append({"variant": names[i], "lift": t["diff"], "relative": t["diff"] / means[0] if means[0] else 0.0, "low": t["low"], "high": t["high"], "p": t["p"], "adjusted_p": adjusted, "significant": adjusted <= ALPHA, "t": t["t"], "df": t["df"]})
    out |= {"test": "welch-t", "p": min(1.0, *(x["adjusted_p"] for x in out["pairwise"]))}
    return out | {"winner": _winner(out, names, means)}


def verdict(arm_table: DataFrame, control: str, weights: dict[str, float] | None = None, required: int = 100, binary: bool = True) -> DataFrame:
    """(variant, n, mean, lift, low, high, p, adjusted_p, significant, winner, test, horizon_met, ratio_broken) of arms().

    An arm table has a row for each variant, which the driver reads; the control comes first, then by name.
    """
    rows = sorted(arm_table.collect(), key=lambda r: (r["variant"] != control, r["variant"]))  # a row per variant
    names, n = [r["variant"] for r in rows], [r["n"] for r in rows]
    shares = [weights.get(v, 0.0) for v in names] if weights else None
    if binary:
        out = results([(r["variant"], r["n"], round(r["n"] * r["mean"])) for r in rows], shares, required)
    else:
        out = continuous_results([(r["variant"], r["n"], r["mean"], r["variance"] or 0.0) for r in rows], n, shares, required)
    pairs = {x["variant"]: x for x in out["pairwise"]}
    table = [
        (r["variant"], r["n"], r["mean"], *(pairs.get(r["variant"], {}).get(k) for k in ("lift", "low", "high", "p", "adjusted_p", "significant")), r["variant"] == out["winner"], out["test"], out["horizon_met"], out["ratio_broken"])
        for r in rows
    ]
    return arm_table.sparkSession.createDataFrame(
        table, "variant string, n long, mean double, lift double, low double, high double, p double, adjusted_p double, significant boolean, winner boolean, test string, horizon_met boolean, ratio_broken boolean"
    )
