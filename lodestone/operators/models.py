"""Statistical models: pipelines on Spark's estimators, ordered probit with survey weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(name: str, q: str = "`") -> str:
    return q + (name.replace("`", "``") if q == "`" else name.replace("\\", "\\\\").replace("'", "\\'")) + q


def preprocessing(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], parts: Sequence[Column] | None = None) -> list[tuple[list, dict]]:
    """For each part of df's rows: stages that add `features` (standardised numbers, then one-hot categories, the commonest first; unseen ones
    become all zeros), and the kinds of its members for tree learners. All parts are summed up in one pass, and the stages are one expression
    and one assembler, which cost far less a row than a stage for each step."""
    parts = parts or [F.lit(True)]
    of = lambda c, p: F.when(p, F.col(c).cast("double"))
    stats = df.agg(F.lit(0), *[f(of(c, p)) for p in parts for c in numbers for f in (F.avg, F.stddev_samp)]).first()[1:]
    levels = {c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(parts)]).collect() for c in categories}
    out = []
    for i in range(len(parts)):
        own = stats[2 * len(numbers) * i :]
        number = lambda v: "double('NaN')" if v is None or not math.isfinite(v) else f"({float(v)!r}D)"
        terms = [f"(cast({_quoted(c)} as double) - {number(own[2 * m])}) * {number(1 / own[2 * m + 1] if own[2 * m + 1] else 0.0)}" for m, c in enumerate(numbers)]
        hot = [(c, r.v) for c in categories for r in sorted(levels[c], key=lambda r: (-r[f"n{i}"], r.v)) if r[f"n{i}"]]
        terms += [f"cast(coalesce(cast({_quoted(c)} as string) = {_quoted(v, chr(39))}, false) as double)" for c, v in hot]
        names = [f"_f{m}" for m in range(len(terms))]
        stages = [SQLTransformer(statement=f"select *, {', '.join(f'{t} as {n}' for t, n in zip(terms, names, strict=True))} from __THIS__"), VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")]
        kinds = {"numeric": [{"idx": m, "name": c} for m, c in enumerate(numbers)], "binary": [{"idx": len(numbers) + m, "name": f"{c}_{v}"} for m, (c, v) in enumerate(hot)]}
        out.append((stages, {"ml_attr": {"attrs": {k: v for k, v in kinds.items() if v}, "num_attrs": len(names)}}))
    return out


def featured(df: DataFrame, stages: list, kinds: dict) -> DataFrame:
    return PipelineModel(stages).transform(df).select("label", F.col("features").alias("features", metadata=kinds))


def classifier(kind: str, seed: int = 42, **params):
    make = {"forest": RandomForestClassifier, "boosting": GBTClassifier, "logistic": LogisticRegression, "network": MultilayerPerceptronClassifier}[kind]
    return make(featuresCol="features", labelCol="label", **({} if kind == "logistic" else {"seed": seed}), **params)


def train(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], kind: str, **params) -> PipelineModel:
    return trained(df, numbers, categories, [classifier(kind, **params)])[0]


def trained(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], models: Sequence) -> list[PipelineModel]:
    """Each classifier fitted to df, behind preprocessing that is worked out once."""
    [(stages, kinds)] = preprocessing(df, numbers, categories)
    rows = featured(df, stages, kinds)
    return [PipelineModel([*stages, m.fit(rows)]) for m in models]


def cross_validated(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], model, maps: Sequence[dict], folds: int = 3, seed: int = 42) -> list[float]:
    """The mean accuracy of each setting, over the folds that CrossValidator draws. A fold's preprocessing is that of its training rows; its
    models are fitted one after the other, so one fit's data is held at a time, and tried in one pass."""
    marked = df.select("label", *numbers, *categories, F.rand(seed).alias("_at"))
    inside = [(F.col("_at") >= i * (1.0 / folds)) & (F.col("_at") < (i + 1) * (1.0 / folds)) for i in range(folds)]
    found = []
    for test, (stages, kinds) in zip(inside, preprocessing(marked, numbers, categories, [~t for t in inside]), strict=True):
        rows = featured(marked.where(~test), stages, kinds)
        tried = PipelineModel(stages).transform(marked.where(test)).select("label", "features")
        for n, m in enumerate(maps):
            fitted = model.fit(rows, m)
            tried = fitted.transform(tried).withColumnRenamed(fitted.getPredictionCol(), f"_p{n}").drop(fitted.getRawPredictionCol(), fitted.getProbabilityCol())
        found.append(tried.agg(*[F.count_if(F.col(f"_p{n}") == F.col("label")) / F.count("*") for n in range(len(maps))]).first())
    return np.mean(np.array(found, float), axis=0).tolist()


def grid_search(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], kind: str, grid: dict[str, Sequence], folds: int = 3, seed: int = 42):
    """The best model by cross-validated accuracy, its settings and all mean accuracies."""
    model = classifier(kind, seed)
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(model.getParam(name), list(values))
    maps = build.build()
    means = cross_validated(df, numbers, categories, model, maps, folds, seed)
    best = int(np.argmax(means))
    settings = [{p.name: v for p, v in m.items()} for m in maps]
    return trained(df, numbers, categories, [model.copy(maps[best])])[0], settings[best], list(zip(settings, means, strict=True))


_cdf = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))


def _density(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), np.exp(-0.5 * np.where(np.isfinite(x), x, 0) ** 2) / math.sqrt(2 * math.pi), 0.0)


def ordered_probit(df: DataFrame, y: str, x: Sequence[str], factors: Sequence[str] = (), weight: str | None = None, cluster: str | None = None, rounds: int = 30) -> DataFrame:
    """term, estimate, se. y are consecutive classes in order; factors become indicators without their first level; se are linearised
    by cluster (rows, if none is given). Each Newton step sums gradients and outer products over the partitions."""
    levels = {f: [r[0] for r in df.where(F.col(f).isNotNull()).select(f).distinct().orderBy(f).collect()][1:] for f in factors}  # a factor has few levels
    cols = [*[F.col(c).cast("double") for c in x], *[(F.col(f) == v).cast("double") for f in factors for v in levels[f]]]
    names = [*x, *[f"{f}={v}" for f in factors for v in levels[f]]]
    classes = [r[0] for r in df.where(F.col(y).isNotNull()).select(y).distinct().orderBy(y).collect()]
    code = F.array_position(F.array(*map(F.lit, classes)), F.col(y)) - 1
    rows = df.select(code.cast("int").alias("y"), F.array(*cols).alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(cluster) if cluster else F.monotonically_increasing_id()).cast("string").alias("g"))
    rows = rows.where("y >= 0 and w > 0 and not exists(x, v -> v is null)").cache()
    k, cuts = len(names), len(classes) - 1
    size = k + cuts

    def terms(pdf, theta):
        a = np.concatenate([[-np.inf], np.cumsum(np.concatenate([theta[k : k + 1], np.exp(theta[k + 1 :])])), [np.inf]])
        xs = np.stack(pdf["x"].to_numpy()) if k else np.zeros((len(pdf), 0))
        yy, w = pdf["y"].to_numpy(), pdf["w"].to_numpy()
        mu = xs @ theta[:k]
        up, low = a[yy + 1] - mu, a[yy] - mu
        p = np.maximum(_cdf(up) - _cdf(low), 1e-12)
        du, dl = _density(up) / p, _density(low) / p
        grad = np.zeros((len(yy), size))
        grad[:, :k] = -(du - dl)[:, None] * xs
        for j in range(cuts):
            step = 1.0 if j == 0 else math.exp(theta[k + j])
            grad[:, k + j] = step * (du * ((yy >= j) & (yy < cuts)) - dl * (yy > j))
        return grad, w, np.log(p)

    def sums(theta):
        def run(batches):
            import pandas as pd

            total = np.zeros(size + size * size + 1)
            for b in batches:
                if len(b):
                    g, w, ll = terms(b, theta)
                    total += np.concatenate([(g * w[:, None]).sum(0), ((g * w[:, None]).T @ g).ravel(), [float(w @ ll)]])
            yield pd.DataFrame({"s": [total.tolist()]})

        parts = rows.select("y", "x", "w").mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(size + size * size + 1)
        for r in parts:
            flat[r.i] = r.v
        return flat[:size], flat[size:-1].reshape(size, size), flat[-1]

    theta = np.zeros(size)
    theta[k:] = [-1.0] + [math.log(2 / max(1, cuts))] * (cuts - 1)
    g, h, ll = sums(theta)
    for _ in range(rounds):
        step = np.linalg.solve(h + 1e-9 * np.eye(size), g)
        t = 1.0
        while t > 1e-4 and (new := sums(theta + t * step))[2] < ll:
            t /= 2
        if t <= 1e-4:
            break
        theta, (g, h, ll_new) = theta + t * step, new
        done, ll = abs(ll_new - ll) < 1e-9 * (1 + abs(ll)), ll_new
        if done:
            break

    def score(batches):
        import pandas as pd

        for b in batches:
            if len(b):
                gr, w, _ = terms(b, theta)
                yield pd.DataFrame({"g": b["g"], "s": list(gr * w[:, None])})

    per = rows.mapInPandas(score, "g string, s array<double>").select("g", F.posexplode("s").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v"))
    wide = per.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    meat_rows = wide.agg(*[F.sum(F.coalesce(F.col("m")[i], F.lit(0.0)) * F.coalesce(F.col("m")[j], F.lit(0.0))).alias(f"c{i}_{j}") for i in range(size) for j in range(size)], F.count("*").alias("n")).first()
    meat = np.array([[meat_rows[f"c{i}_{j}"] for j in range(size)] for i in range(size)]) * meat_rows["n"] / max(1, meat_rows["n"] - 1)
    bread = np.linalg.inv(h + 1e-9 * np.eye(size))
    jac = np.eye(size)
    for j in range(1, cuts):
        jac[k + j, k + 1 : k + j + 1] = np.exp(theta[k + 1 : k + j + 1])
        jac[k + j, k] = 1.0
    cov = jac @ bread @ meat @ bread @ jac.T
    ends = np.cumsum(np.concatenate([theta[k : k + 1], np.exp(theta[k + 1 :])]))
    rows.unpersist()
    out = [(n, float(e), float(math.sqrt(max(0, c)))) for n, e, c in zip([*names, *[f"cut{i + 1}" for i in range(cuts)]], [*theta[:k], *ends], np.diag(cov), strict=True)]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, se double")


def scored(files: DataFrame, infer, schema: str) -> DataFrame:
    """Plugs model inference (images, captions) in: a function from an iterator of pandas batches, which may load its model once, to batches of `schema`."""
    return files.mapInPandas(infer, schema)
