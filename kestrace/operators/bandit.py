"""Bandit state as sums, and scores from it as column arithmetic.

An arm's matrix is the identity plus the sum of x x', its vector the sum of reward times
x, its Beta prior 1 plus the sums of rewards and of their complements. All are plain
aggregates, so training is one groupBy with partial sums, states merge by adding, and a
state as of any moment is a running sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.spans import seeded_uniform

PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def sums(reward: Column) -> dict[str, Column]:
    """The summands of a reward event: s00 to s33, t0 to t3, n, and the Beta parts."""
    x = [F.col(f"x{i}") for i in range(4)]
    out = {f"s{i}{j}": x[i] * x[j] for i, j in PAIRS}
    return out | {f"t{i}": reward * x[i] for i in range(4)} | {"n": F.lit(1).cast("long"), "good": reward, "bad": 1.0 - reward}


#: Parts of 1 that Beta parts are summed in: a double holds such sums of 9e9 rewards exactly.
WHOLE = 1e6


def beta_sum(x: Column) -> Column:
    """Sum of x, whole WHOLEths apart from what is left of each: a long sum of tenths has no error that grows."""
    whole = F.rint(x * WHOLE)
    return F.sum(whole) / WHOLE + F.sum(x - whole / WHOLE)


def arm_state(rewards: DataFrame, by: str = "sidecar") -> DataFrame:
    """(by, arm_index, n, a00..a33, b0..b3, alpha, beta) from rewards with x0..x3 and reward."""
    parts = sums(F.col("reward"))
    total = rewards.groupBy(by, "arm_index").agg(*[(beta_sum(c) if k in ("good", "bad") else F.sum(c)).alias(k) for k, c in parts.items()])
    return as_state(total, [by, "arm_index"])


def as_state(total: DataFrame, keep: list[str]) -> DataFrame:
    """Sums with the priors added."""
    a = [(F.coalesce(f"s{i}{j}", F.lit(0.0)) + F.lit(float(i == j))).alias(f"a{i}{j}") for i, j in PAIRS]
    b = [F.coalesce(f"t{i}", F.lit(0.0)).alias(f"b{i}") for i in range(4)]
    beta = [(1.0 + F.coalesce("good", F.lit(0.0))).alias("alpha"), (1.0 + F.coalesce("bad", F.lit(0.0))).alias("beta")]
    return total.select(*keep, F.coalesce("n", F.lit(0)).cast("long").alias("n"), *a, *b, *beta)


def merge_states(states: DataFrame, by: list[str]) -> DataFrame:
    """Arms of several independent learners as one: what they learned adds up, the priors count once."""
    a = [(F.sum(f"a{i}{j}") - F.lit(float(i == j)) * (F.count(F.lit(1)) - 1)).alias(f"a{i}{j}") for i, j in PAIRS]
    b = [F.sum(f"b{i}").alias(f"b{i}") for i in range(4)]
    prior = lambda c: (F.sum(c) - (F.count(F.lit(1)) - 1)).alias(c)
    return states.groupBy(*by).agg(F.sum("n").alias("n"), *a, *b, prior("alpha"), prior("beta"))


def factorised(state: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l00..l33 of each arm's matrix and w with L w = b.

    One projection whose columns refer to those before them.
    """
    c = F.col
    steps = [
        ("l00", F.sqrt("a00")), ("l10", c("a01") / c("l00")), ("l20", c("a02") / c("l00")), ("l30", c("a03") / c("l00")),
        ("l11", F.sqrt(c("a11") - c("l10") * c("l10"))), ("l21", (c("a12") - c("l20") * c("l10")) / c("l11")), ("l31", (c("a13") - c("l30") * c("l10")) / c("l11")),
        ("l22", F.sqrt(c("a22") - c("l20") * c("l20") - c("l21") * c("l21"))), ("l32", (c("a23") - c("l30") * c("l20") - c("l31") * c("l21")) / c("l22")),
        ("l33", F.sqrt(c("a33") - c("l30") * c("l30") - c("l31") * c("l31") - c("l32") * c("l32"))),
    ]
    steps += [(f"w{i}", value) for i, value in enumerate(_substituted("b", [F.col(f"w{i}") for i in range(4)]))]
    return state.select("*", *[value.alias(name) for name, value in steps])


def _substituted(given: str, found: list[Column] | None = None) -> list[Column]:
    """Forward substitution, L x = given: each x by those before it, as found names them or else written out."""
    out: list[Column] = []
    for i in range(4):
        value = F.col(f"{given}{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * (found[j] if found else out[j])
        out.append(value / F.col(f"l{i}{i}"))
    return out


FACTORS = [*(f"l{i}{j}" for i in range(4) for j in range(i + 1)), *(f"w{i}" for i in range(4))]


def ucb_scores(rows: DataFrame, alpha: float = 1.0) -> DataFrame:
    """rows (x0..x3, FACTORS) with ucb: the mean estimate plus alpha times its width."""
    z = _substituted("x")
    mean = sum((z[i] * F.col(f"w{i}") for i in range(1, 4)), z[0] * F.col("w0"))
    spread = sum((z[i] * z[i] for i in range(1, 4)), z[0] * z[0])
    return rows.withColumn("ucb", mean + alpha * F.sqrt(spread))


def with_policy(rows: DataFrame, state: DataFrame, by: str = "sidecar") -> DataFrame:
    """rows with their arm's factors, n, alpha and beta; unseen arms have the priors.

    A state has at most 256 arms for each value of by; Spark broadcasts it when it is small.
    """
    policy = factorised(state).select(by, "arm_index", "n", "alpha", "beta", *FACTORS)
    joined = rows.join(policy, [by, "arm_index"], "left")
    prior = {"n": 0, "alpha": 1.0, "beta": 1.0} | {f"l{i}{i}": 1.0 for i in range(4)} | {f: 0.0 for f in FACTORS if f[0] == "w" or f[1] != f[2]}
    return joined.fillna(prior)


def arm_stats(state: DataFrame, confidence: int = 10) -> DataFrame:
    """n, confident, the vector's norm, the Beta mean and observations of each arm."""
    norm = F.sqrt(sum((F.col(f"b{i}") * F.col(f"b{i}") for i in range(1, 4)), F.col("b0") * F.col("b0")))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    keep = [c for c in state.columns if c in ("sidecar", "arm_index")]
    # The Beta parts of n rewards add up to n but for the rounding of both.
    both = F.col("alpha") + F.col("beta") - 2
    seen = F.floor(both + F.abs(both) * 1e-15 + 1e-9).cast("long")
    return state.select(*keep, "n", (F.col("n") >= confidence).alias("confident"), norm.alias("b_norm"), "alpha", "beta", mean.alias("thompson_mean"), seen.alias("observations"))


#: Cells of the grid on which a Beta density is summed.
BETA_GRID = 2048


def beta_quantile(alpha: float, beta: float, u: np.ndarray, grid: int = BETA_GRID) -> np.ndarray:
    """Quantiles of Beta(alpha, beta) at u: the density summed over the middles of equal cells, and interpolated."""
    x = (np.arange(grid) + 0.5) / grid
    log = (alpha - 1) * np.log(x) + (beta - 1) * np.log1p(-x)
    mass = np.cumsum(np.exp(log - log.max()))
    return np.interp(u * mass[-1], np.concatenate([[0], mass]), np.concatenate([[0], x]))


def thompson_draws(rows: DataFrame, seed: str, *keys: str) -> DataFrame:
    """rows (alpha, beta) with u, uniform by keys and seed, and draw, its Beta quantile, for priors with a closed form.

    Beta(1, 1) gives u, a lone alpha or beta a power; other arms need general_draws.
    """
    u = seeded_uniform(*[F.col(k) for k in keys], F.lit(seed))
    draw = F.when(F.col("beta") == 1, F.pow("u", 1 / F.col("alpha"))).when(F.col("alpha") == 1, 1 - F.pow(1 - F.col("u"), 1 / F.col("beta")))
    return rows.withColumn("u", u).withColumn("draw", F.when((F.col("alpha") == 1) & (F.col("beta") == 1), F.col("u")).otherwise(draw))


@F.pandas_udf(DoubleType())
def _quantiles(alpha: pd.Series, beta: pd.Series, u: pd.Series) -> pd.Series:
    """Of a batch's rows with a u; each pair of priors is summed once."""
    out = pd.Series(np.nan, u.index)
    asked = pd.DataFrame({"alpha": alpha, "beta": beta, "u": u}).dropna()
    for (a, b), part in asked.groupby(["alpha", "beta"]):
        out[part.index] = beta_quantile(a, b, part["u"].to_numpy())
    return out


def general_draws(rows: DataFrame, seed: str, *keys: str, confidence: int | None = None) -> DataFrame:
    """thompson_draws for any priors.

    Arrow batches of three numbers go to Python, for the rows whose priors have no closed
    form. confidence: only rows of arms with fewer observations (n) need a draw; so an
    arm has at most that many different priors. Others have none.
    """
    out = thompson_draws(rows, seed, *keys)
    open_ = F.col("draw").isNull() if confidence is None else F.col("draw").isNull() & (F.col("n") < confidence)
    found = _quantiles(F.when(open_, F.col("alpha")), F.when(open_, F.col("beta")), F.when(open_, F.col("u")))
    return out.withColumn("found", found).withColumn("draw", F.coalesce("draw", F.when(open_, F.col("found")))).drop("found")
