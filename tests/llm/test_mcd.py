"""op3's estimates against a plain minimum covariance determinant from many starts."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sylva.llm import op03_quality as op03


def plain(x: np.ndarray, share: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """Concentration steps of the nearest share of rows from random subsets, with the same floors."""
    h, best = int(np.ceil(share * len(x))), None
    for _ in range(40):
        part = x[rng.choice(len(x), 30, replace=False)]
        for _ in range(60):
            mean, cov = part.mean(0), np.cov(part.T, bias=True) * op03.consistency(share) + np.diag(np.square(op03.FLOORS))
            d = x - mean
            part = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))[:h]]
        mean, cov = part.mean(0), np.cov(part.T, bias=True) * op03.consistency(share) + np.diag(np.square(op03.FLOORS))
        if best is None or np.linalg.slogdet(cov)[1] < np.linalg.slogdet(best[1])[1]:
            best = mean, cov
    return best


def test_estimates_come_near_a_plain_mcd(spark):
    rng, frames = np.random.default_rng(6), []
    for source, n, far in (("one", 900, 0.0), ("two modes", 900, 2.0), ("junk", 700, 0.0)):
        x = rng.multivariate_normal([2, 0.3, 0.2, 0.1], np.diag([0.3, 0.2, 0.2, 0.1]) ** 2 + 0.01, n)
        if far:
            x[: n // 5] += far
        if source == "junk":
            x[:100] += [0, 4, 4, 0]
        frames.append(pd.DataFrame(x, columns=op03.FEATURES).assign(lang="en", source=source))
    rows = spark.createDataFrame(pd.concat(frames))
    got = {r["source"]: r for r in op03.fit_mcd(rows).where("level = 2").collect()}
    for f in frames:
        x, r = f[list(op03.FEATURES)].to_numpy(), got[f["source"].iloc[0]]
        mean, cov = plain(x, op03.COVERAGE, rng)
        assert abs(r["logdet"] - np.linalg.slogdet(cov)[1]) < 0.35  # shares end at the edge of a bin
        far = lambda m, p: np.einsum("ij,jk,ik->i", x - m, p, x - m) > op03.CUTOFF
        a, b = far(np.array(r["mean"]), np.array(r["prec"]).reshape(op03.P, op03.P)), far(mean, np.linalg.inv(cov))
        assert (a != b).mean() < 0.005 and a[:100].all() == b[:100].all()


def test_small_groups_have_their_own_centre_as_far_as_they_go(spark):
    rng = np.random.default_rng(1)
    parts = [("big", 500, 2.0), ("few", 20, 2.3), ("lone", 1, 2.1)]
    rows = pd.concat([pd.DataFrame(rng.normal([at, 0.2, 0.2, 0.1], 0.05, (n, 4)), columns=op03.FEATURES).assign(lang="en", source=s) for s, n, at in parts])
    got = {r["source"]: r["mean"][0] for r in op03.pooled(op03.fit_mcd(spark.createDataFrame(rows))).collect()}
    assert abs(got["big"] - 2) < 0.02 and 2.03 < got["few"] < 2.25 and abs(got["lone"] - 2) < 0.05


def test_no_rows_no_estimates(spark):
    empty = spark.createDataFrame([], "lang string, source string, f_length double, f_symbols double, f_lines double, f_repeats double")
    assert op03.pooled(op03.fit_mcd(empty)).select(F.col("lang")).count() == 0
