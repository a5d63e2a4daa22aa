"""Geostatistics: variograms, covariance models, likelihood fits, kriging and its Bayesian form."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import near_pairs

#: A kriging system is dense; data beyond this need a moving neighbourhood.
MOST_POINTS = 5000


def variogram(points: DataFrame, width: float, limit: float, value: str = "z") -> DataFrame:
    """bin, n, distance, gamma: mean of half squared differences of pairs (of different ids) up to `limit` apart. Pairs are formed of places, from
    the count, mean and squared deviations of each one's values, so rows that share a place cost no pairs; pairs of equal ids are taken off again."""
    c = F.col
    rows = points.select("id", *[c(k).cast("double").alias(k) for k in "xy"], c(value).cast("double").alias("z")).where("id is not null and x is not null and y is not null")
    # n rows, k of them with a value, their mean m and sum of squared deviations s
    sums = [F.count("*").alias("n"), F.count("z").alias("k"), F.avg("z").alias("m"), F.when(F.count("z") > 1, F.var_pop("z") * F.count("z")).otherwise(0.0).alias("s")]

    def within(g: DataFrame, sign: int) -> DataFrame:
        return g.where("n > 1").select(F.lit(0.0).alias("d"), (sign * (c("n") * (c("n") - 1) / 2)).cast("long").alias("n"), (sign * (c("k") * (c("k") - 1) / 2)).cast("long").alias("k"), F.when(c("k") > 1, sign * c("k") * c("s") / 2).alias("g"))

    def between(pairs: DataFrame, sign: int) -> DataFrame:
        gap = c("a_m") - c("b_m")
        g = (c("b_k") * c("a_s") + c("a_k") * c("b_s") + c("a_k") * c("b_k") * gap * gap) / 2
        return pairs.select("d", (sign * c("a_n") * c("b_n")).alias("n"), (sign * c("a_k") * c("b_k")).alias("k"), (sign * g).alias("g"))

    places = rows.groupBy("x", "y").agg(*sums).where("abs(x) < double('infinity') and abs(y) < double('infinity')")
    twice = rows.groupBy("id", "x", "y").agg(*sums).withColumn("all", F.sum("n").over(Window.partitionBy("id"))).where("all > 1 and abs(x) < double('infinity') and abs(y) < double('infinity')").drop("all")
    a, b = (twice.select("id", *[c(k).alias(f"{u}_{k}") for k in "xynkms"]) for u in "ab")
    dx, dy = c("a_x") - c("b_x"), c("a_y") - c("b_y")
    again = a.join(b, "id").where("a_x < b_x or a_x = b_x and a_y < b_y").withColumn("d", F.sqrt(dx * dx + dy * dy))
    parts = [within(places, 1), between(near_pairs(places.withColumn("id", F.struct("x", "y")), limit), 1), within(twice, -1), between(again, -1)]
    d = reduce(DataFrame.unionByName, parts).where(c("d") < limit).groupBy(F.floor(c("d") / width).alias("bin"))
    total = d.agg(F.sum("n").alias("n"), F.sum(c("n") * c("d")).alias("d"), F.sum("k").alias("k"), F.sum("g").alias("g")).where("n > 0")
    return total.select("bin", "n", (c("d") / c("n")).alias("distance"), F.when(c("k") > 0, c("g") / c("k")).alias("gamma"))


def _trend(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    cols = [np.ones_like(x)]
    if order >= 1:
        cols += [x, y]
    if order >= 2:
        cols += [x * x, y * y, x * y]
    return np.column_stack(cols)


def detrend(points: DataFrame, order: int = 1, value: str = "z") -> DataFrame:
    """points with the residual `r` of a polynomial surface, fitted by sums over all rows."""
    x, y = F.col("x"), F.col("y")
    terms = [F.lit(1.0), x, y, x * x, y * y, x * y][: {0: 1, 1: 3, 2: 6}[order]]
    k = len(terms)
    row = points.agg(*[F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(terms[i] * F.col(value)).alias(f"b{i}") for i in range(k)]).first()
    beta = np.linalg.lstsq(np.array([[row[f"a{i}_{j}"] for j in range(k)] for i in range(k)]), np.array([row[f"b{i}"] for i in range(k)]), rcond=None)[0]
    fit = sum([t * float(b) for t, b in zip(terms[1:], beta[1:], strict=True)], terms[0] * float(beta[0]))
    return points.withColumn("r", F.col(value) - fit)


def covariance(d: Column, model: str, sill: float, scale: float) -> Column:
    h = d / scale
    if model == "exponential":
        return sill * F.exp(-h)
    if model == "spherical":
        return F.when(h < 1, sill * (1 - 1.5 * h + 0.5 * F.pow(h, 3))).otherwise(0.0)
    if model == "matern1.5":
        return sill * (1 + h) * F.exp(-h)
    raise ValueError(f"no column form for {model}")


def bessel_k(nu: float, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """Modified Bessel function of the second kind by its integral of exp(-x cosh t) cosh(nu t)."""
    t = np.linspace(0, 12, steps)
    with np.errstate(over="ignore", under="ignore"):
        f = np.exp(-np.multiply.outer(x, np.cosh(t))) * np.cosh(nu * t)
    return np.trapezoid(f, t, axis=-1)


def covariances(d: np.ndarray, model: str, sill: float, scale: float, kappa: float = 0.5) -> np.ndarray:
    h = d / scale
    if model == "exponential":
        return sill * np.exp(-h)
    if model == "spherical":
        return np.where(h < 1, sill * (1 - 1.5 * h + 0.5 * h**3), 0.0)
    flat = np.maximum(h, 1e-8)
    known = {0.5: np.exp(-h), 1.5: (1 + h) * np.exp(-h)}
    if kappa in known:
        return sill * known[kappa]
    values, back = np.unique(flat.round(10), return_inverse=True)
    rho = 2 ** (1 - kappa) / math.gamma(kappa) * values**kappa * bessel_k(kappa, values)
    return sill * np.where(h < 1e-8, 1.0, rho[back].reshape(h.shape))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def gather(points: DataFrame, value: str = "z") -> tuple[np.ndarray, np.ndarray]:
    rows = points.select("x", "y", value).orderBy("x", "y").limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"kriging over more than {MOST_POINTS} points needs a neighbourhood")
    m = np.array([[r[0], r[1], r[2]] for r in rows], float)
    return m[:, :2], m[:, 2]


def nelder_mead(f, start: np.ndarray, step: float = 0.5, rounds: int = 300) -> np.ndarray:
    simplex = [start] + [start + step * e for e in np.eye(len(start))]
    scores = [f(s) for s in simplex]
    for _ in range(rounds):
        order = np.argsort(scores)
        simplex, scores = [simplex[i] for i in order], [scores[i] for i in order]
        if abs(scores[-1] - scores[0]) < 1e-9:
            break
        centre = np.mean(simplex[:-1], axis=0)
        for factor in (1.0, 2.0, -0.5):
            x = centre + factor * (centre - simplex[-1])
            y = f(x)
            if factor == 1.0:
                best = (x, y)
                if y < scores[0]:
                    continue
                if y < scores[-2]:
                    break
                continue
            if y < best[1]:
                best = (x, y)
            if factor == 2.0 and best[1] < scores[-2]:
                break
        if best[1] < scores[-1]:
            simplex[-1], scores[-1] = best
        else:
            simplex = [simplex[0]] + [(s + simplex[0]) / 2 for s in simplex[1:]]
            scores = [scores[0]] + [f(s) for s in simplex[1:]]
    return simplex[int(np.argmin(scores))]


def fit(points: DataFrame, model: str = "exponential", start: tuple[float, float] = (1.0, 1.0), nugget: float = 0.1, kappa: float = 0.5, order: int = 0) -> dict:
    """Maximum likelihood of sill, scale and nugget with a polynomial mean."""
    at, z = gather(points)
    d, x = _distance(at, at), _trend(at[:, 0], at[:, 1], order)

    def loss(p: np.ndarray) -> float:
        sill, scale, nug = np.exp(p)
        c = covariances(d, model, sill, scale, kappa) + (nug + 1e-9) * np.eye(len(z))
        try:
            low = np.linalg.cholesky(c)
        except np.linalg.LinAlgError:
            return 1e12
        wx, wz = np.linalg.solve(low, x), np.linalg.solve(low, z)
        r = wz - wx @ np.linalg.lstsq(wx, wz, rcond=None)[0]
        return float(2 * np.log(np.diag(low)).sum() + r @ r)

    sill, scale, nug = np.exp(nelder_mead(loss, np.log(np.array([*start, max(nugget, 1e-3)]))))
    return {"model": model, "sill": float(sill), "scale": float(scale), "nugget": float(nug), "kappa": kappa, "order": order}


class System:
    """A kriging system solved once: universal kriging with a polynomial mean."""

    def __init__(self, at: np.ndarray, z: np.ndarray, p: dict):
        self.at, self.z, self.p = at, z, p
        c = covariances(_distance(at, at), p["model"], p["sill"], p["scale"], p["kappa"]) + (p["nugget"] + 1e-12) * np.eye(len(z))
        self.low = np.linalg.cholesky(c)
        x = _trend(at[:, 0], at[:, 1], p["order"])
        self.wx, self.wz = np.linalg.solve(self.low, x), np.linalg.solve(self.low, z)
        self.gram = np.linalg.inv(self.wx.T @ self.wx)
        self.beta = self.gram @ self.wx.T @ self.wz

    def predict(self, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        c = covariances(_distance(to, self.at), p["model"], p["sill"], p["scale"], p["kappa"])
        w = np.linalg.solve(self.low, c.T)
        x = _trend(to[:, 0], to[:, 1], p["order"])
        mean = x @ self.beta + w.T @ (self.wz - self.wx @ self.beta)
        u = x - w.T @ self.wx
        return mean, np.maximum(p["sill"] - (w**2).sum(0) + np.einsum("ij,jk,ik->i", u, self.gram, u), 0)


def krige(points: DataFrame, grid: DataFrame, p: dict) -> DataFrame:
    """grid (x, y, ...) with prediction and variance; the solved system (MOST_POINTS at most) is broadcast, the grid is mapped."""
    system = grid.sparkSession.sparkContext.broadcast(System(*gather(points), p))

    def run(batches):
        for b in batches:
            if len(b):
                mean, var = system.value.predict(b[["x", "y"]].to_numpy(float))
                yield b.assign(prediction=mean, variance=var)

    from pyspark.sql.types import DoubleType, StructField, StructType

    return grid.mapInPandas(run, StructType([*grid.schema.fields, StructField("prediction", DoubleType()), StructField("variance", DoubleType())]))


def bayes_krige(points: DataFrame, grid: DataFrame, model: str, scales: list[float], nuggets: list[float], draws: int = 1000, kappa: float = 0.5, order: int = 0, seed: int = 42) -> DataFrame:
    """x, y, mean, low, high (2.5 and 97.5 %): flat prior on the mean, 1/sill on the sill, uniform on grids of scale and relative nugget."""
    at, z = gather(points)
    d, x = _distance(at, at), _trend(at[:, 0], at[:, 1], order)
    n, k = x.shape
    found = []
    for s in scales:
        for t in nuggets:
            low = np.linalg.cholesky(covariances(d, model, 1.0, s, kappa) + (t + 1e-9) * np.eye(n))
            wx, wz = np.linalg.solve(low, x), np.linalg.solve(low, z)
            g = wx.T @ wx
            r = wz - wx @ np.linalg.solve(g, wx.T @ wz)
            s2 = float(r @ r) / (n - k)
            found.append((s, t, s2, -np.log(np.diag(low)).sum() - 0.5 * np.linalg.slogdet(g)[1] - 0.5 * (n - k) * np.log(s2)))
    logs = np.array([f[3] for f in found])
    prob = np.exp(logs - logs.max())
    rng = np.random.default_rng(seed)
    counts = rng.multinomial(draws, prob / prob.sum())
    parts = [(System(at, z, {"model": model, "sill": 1.0, "scale": s, "nugget": t, "kappa": kappa, "order": order}), s2, int(c)) for (s, t, s2, _), c in zip(found, counts, strict=True) if c]
    shared = grid.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            to, sims = b[["x", "y"]].to_numpy(float), []
            rng = np.random.default_rng([seed, int(abs(to[0, 0] * 1e6)) % (1 << 31)])
            for system, s2, c in shared.value:
                mean, var = system.predict(to)
                sill = s2 * (n - k) / rng.chisquare(n - k, c)
                sims.append(mean[:, None] + np.sqrt(var)[:, None] * np.sqrt(sill)[None, :] * rng.standard_normal((len(to), c)))
            all_ = np.concatenate(sims, axis=1)
            q = np.quantile(all_, [0.025, 0.975], axis=1)
            yield pd.DataFrame({"x": to[:, 0], "y": to[:, 1], "mean": all_.mean(1), "low": q[0], "high": q[1]})

    return grid.select("x", "y").mapInPandas(run, "x double, y double, mean double, low double, high double")


def cross_validate(points: DataFrame, p: dict, folds: int | None = None, share: float = 0.1, seed: int = 42) -> DataFrame:
    """fold, x, y, z, prediction, variance: leave-one-out with folds=None, else repeated hold-outs of `share`. A fold is one row of a distributed map."""
    at, z = gather(points)
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((at, z))

    def run(batches):
        at, z = shared.value
        for b in batches:
            for f in b["id"]:
                out = np.zeros(len(z), bool)
                if folds is None:
                    out[int(f)] = True
                else:
                    out[np.random.default_rng([seed, int(f)]).permutation(len(z))[: max(1, round(share * len(z)))]] = True
                mean, var = System(at[~out], z[~out], p).predict(at[out])
                yield pd.DataFrame({"fold": int(f), "x": at[out, 0], "y": at[out, 1], "z": z[out], "prediction": mean, "variance": var})

    return spark.range(len(z) if folds is None else folds).mapInPandas(run, "fold long, x double, y double, z double, prediction double, variance double")


def grid(spark, x: tuple[float, float], y: tuple[float, float], n: int) -> DataFrame:
    """An n by n regular grid."""
    step = lambda r: (r[1] - r[0]) / (n - 1)
    return spark.range(n * n).select((x[0] + F.floor(F.col("id") / n) * step(x)).alias("x"), (y[0] + F.col("id") % n * step(y)).alias("y"))


def to_metres(df: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    return df.withColumns({c: F.col(c) * 1000 for c in columns})
