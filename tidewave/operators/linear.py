"""Linear models on mergeable sums: Gram matrices per partition, ridge paths, nested cross-validation.

A series never travels: each task reduces its rows to sums of fixed size (n, sum x, X'X, X'Y, ...), and models
are fitted, judged and correlated from those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = "n double, sx array<double>, xx array<double>, sy array<double>, xy array<double>, yy array<double>"


def gram_rows(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Long form for few predictors, in SQL: by, i, j and the sum of products; j = p is the target."""
    cols = [*xs, y]
    n = len(cols)
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s_{i}_{j}") for i in range(n) for j in range(i, n)])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{i}_{j}").alias("product")) for i in range(n) for j in range(i, n)])
    return sums.select(*by, "n", F.explode(cells).alias("c")).select(*by, "n", "c.*")


def partial_sums(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by and SUMS of array columns x and y, one row per key and task, reduced batch by batch."""
    names = by
    schema = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by) + ", " + SUMS

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        for pdf in batches:
            for key, g in pdf.groupby(names, sort=False, dropna=False):
                a, b = (np.stack(g[c].to_numpy()).astype(np.float64) for c in (x, y))
                if not (np.isfinite(a).all() and np.isfinite(b).all()):
                    raise ValueError(f"values that aren't finite in {key}")
                new = [np.array(float(len(g))), a.sum(0), a.T @ a, b.sum(0), a.T @ b, (b * b).sum(0)]
                old = held.get(key)
                held[key] = new if old is None else [p + q for p, q in zip(old, new, strict=True)]
            if len(held) > 1000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, float(v[0]), *[m.ravel().tolist() for m in v[1:]]) for k, v in held.items()], columns=[*names, "n", "sx", "xx", "sy", "xy", "yy"])

    return df.select(*by, x, y).mapInPandas(reduce_, schema)


def merged_in_tree(partials: DataFrame, by: list[str], merge: Callable[[pd.DataFrame], list], fan: int = 32) -> DataFrame:
    """One row a key: `merge` takes the rows of a key to the values of all other columns, in their order, and must be associative.

    Partials of neighbouring tasks are merged first, `fan` at a time, then what they gave, so of ten thousand tasks' partials no task holds more than
    `fan` at once; arrays travel whole.
    """
    columns = [c for c in partials.columns if c not in by]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key[: len(by)], *merge(pdf), key[-1] // fan)], columns=[*by, *columns, "_g"])

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *merge(pdf))], columns=[*by, *columns])

    parts = partials.withColumn("_g", F.expr(f"spark_partition_id() div {fan}")).select(*by, *columns, "_g")
    level = ", ".join(f"{c} {t}" for c, t in parts.dtypes)
    for _ in range(2):
        parts = parts.groupBy(*by, "_g").applyInPandas(run, level)
    return parts.drop("_g").groupBy(*by).applyInPandas(last, ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in [*by, *columns])).select(*partials.columns)


def added(partials: DataFrame, by: list[str], fan: int = 32) -> DataFrame:
    """merged_in_tree by sums: numbers, and arrays of numbers of one length a key, are added up."""
    columns = [(c, t.startswith("array")) for c, t in partials.dtypes if c not in by]
    return merged_in_tree(partials, by, lambda pdf: [np.sum(np.stack(pdf[c].to_numpy()), axis=0).tolist() if many else pdf[c].sum() for c, many in columns], fan)


def merged_sums(partials: DataFrame, by: list[str]) -> DataFrame:
    """One row of SUMS per key."""
    return added(partials, by)


def sums_of(row) -> dict[str, np.ndarray]:
    """A row of SUMS as matrices."""
    p, q = len(row["sx"]), len(row["sy"])
    return {"n": float(row["n"]), "sx": np.array(row["sx"]), "xx": np.array(row["xx"]).reshape(p, p), "sy": np.array(row["sy"]), "xy": np.array(row["xy"]).reshape(p, q), "yy": np.array(row["yy"])}


def total(parts: list[dict]) -> dict:
    return {k: sum(p[k] for p in parts) for k in parts[0]}


def centred(s: dict, mean_x: np.ndarray | None = None, mean_y: np.ndarray | None = None) -> dict:
    """Covariance sums around the given means, by default the sums' own."""
    n = s["n"]
    mx = s["sx"] / n if mean_x is None else mean_x
    my = s["sy"] / n if mean_y is None else mean_y
    return {
        "n": n, "mx": mx, "my": my,
        "xx": s["xx"] - np.outer(mx, s["sx"]) - np.outer(s["sx"], mx) + n * np.outer(mx, mx),
        "xy": s["xy"] - np.outer(mx, s["sy"]) - np.outer(s["sx"], my) + n * np.outer(mx, my),
        "yy": s["yy"] - 2 * my * s["sy"] + n * my * my,
    }


def ridge_solutions(xx: np.ndarray, xy: np.ndarray, alphas: list[float]) -> list[np.ndarray]:
    """(xx + alpha I)^-1 xy for each alpha from one eigendecomposition. Directions without any variance or penalty get no coefficient."""
    values, vectors = np.linalg.eigh((xx + xx.T) / 2)
    turned, values = vectors.T @ xy, np.maximum(values, 0.0)
    return [vectors @ (turned / np.where(values + a > 1e-12, values + a, np.inf)[:, None]) for a in alphas]


def correlations(s: dict, w: np.ndarray) -> np.ndarray:
    """r of each target with its prediction, from centred sums alone; missing where a variance isn't positive."""
    cross, own = (w * s["xy"]).sum(0), np.einsum("ij,ik,kj->j", w, s["xx"], w)
    den = own * s["yy"]
    return np.where(den > 0, cross / np.sqrt(np.where(den > 0, den, 1)), np.nan)


def errors(s: dict, w: np.ndarray) -> float:
    """Mean squared error over all targets, from sums around the training means."""
    sse = s["yy"] - 2 * (w * s["xy"]).sum(0) + np.einsum("ij,ik,kj->j", w, s["xx"], w)
    return float(np.maximum(sse, 0).sum() / (s["n"] * len(s["yy"])))


def pooled_cosine(s: dict, w: np.ndarray) -> float:
    """The cosine of all targets and predictions as one vector, around the means of s; 0 where one of them is zero."""
    own = float(np.einsum("ij,ik,kj->", w, s["xx"], w))
    den = np.sqrt(max(own, 0.0) * max(float(s["yy"].sum()), 0.0))
    return float(np.clip((w * s["xy"]).sum() / den, -1, 1)) if den > 0 else 0.0


def ridge_path(train: dict, validation: dict, alphas: list[float], metric: str = "mse") -> tuple[float, np.ndarray, np.ndarray, list[float]]:
    """The mean covariance is regularised; the first strictly better alpha stays. Validation sums are taken around the training means.

    metric: "mse", or "correlation" for the pooled cosine. Returns alpha, weights, intercept, the scores.
    """
    t = centred(train)
    v = centred(validation, t["mx"], t["my"])
    best, scores = None, []
    for a, w in zip(alphas, ridge_solutions(t["xx"] / t["n"], t["xy"] / t["n"], alphas), strict=True):
        score = -errors(v, w) if metric == "mse" else pooled_cosine(v, w)
        scores.append(score)
        if best is None or score > best[0]:
            best = (score, a, w)
    _, a, w = best
    return a, w, t["my"] - t["mx"] @ w, scores


def balanced_folds(ids: list, weights: list[float], n: int) -> dict:
    """Longest first (ties by id) to the lightest fold (ties to the lowest)."""
    loads, out = [0.0] * n, {}
    for w, i in sorted(zip(weights, ids, strict=True), key=lambda x: (-x[0], x[1])):
        k = min(range(n), key=lambda f: (loads[f], f))
        out[i], loads[k] = k, loads[k] + w
    return out


def cv_scores(stories: dict, ids: list, folds: int, alphas: list[float]) -> list[float]:
    """Per alpha, the mean of Fisher's z of r over held-out stories and targets, stories weighted by their samples; stories are centred sums."""
    parts = balanced_folds(ids, [stories[i]["n"] for i in ids], min(folds, len(ids)))
    z, weight = np.zeros(len(alphas)), np.zeros(len(alphas))
    for k in sorted(set(parts.values())):
        fit = [stories[i] for i in ids if parts[i] != k]
        if not fit:
            continue
        f = total(fit)
        for a, w in enumerate(ridge_solutions(f["xx"], f["xy"], alphas)):
            for i in (i for i in ids if parts[i] == k):
                r = correlations(stories[i], w)
                r = np.clip(r[np.isfinite(r)], -0.999999, 0.999999)
                z[a] += stories[i]["n"] * np.arctanh(r).sum()
                weight[a] += stories[i]["n"] * len(r)
    return [float(x / y) if y else -np.inf for x, y in zip(z, weight, strict=True)]


def nested_cv(stories: dict, alphas: list[float], folds: int = 5) -> list[dict]:
    """Story-grouped nested cross-validation over sums per story: {id: sums}, each centred on its own means.

    The summed X'X is regularised; inner folds choose alpha by cv_scores (ties to the smaller alpha). A row per outer fold: alpha, its
    score as a correlation, r of each held-out story, and the sums that pooled_r needs.
    """
    ids = sorted(stories)
    own = {i: centred(stories[i]) for i in ids}
    outer = balanced_folds(ids, [own[i]["n"] for i in ids], min(folds, len(ids)))
    rows = []
    for k in sorted(set(outer.values())):
        train, test = [i for i in ids if outer[i] != k], [i for i in ids if outer[i] == k]
        if not train:
            continue
        scores = cv_scores(own, train, folds, alphas)
        score, alpha = max(zip(scores, alphas, strict=True), key=lambda x: (x[0], -x[1]))
        f, h = total([own[i] for i in train]), total([own[i] for i in test])
        w = ridge_solutions(f["xx"], f["xy"], [alpha])[0]
        rows.append({
            "fold": k, "alpha": float(alpha), "score": float(np.tanh(score)), "n_test": float(h["n"]), "stories": test,
            "r": [[float(x) for x in correlations(own[i], w)] for i in test], "cross": (w * h["xy"]).sum(0), "predicted": np.einsum("ij,ik,kj->j", w, h["xx"], w), "actual": h["yy"],
        })
    return rows


def pooled_r(rows: list[dict]) -> np.ndarray:
    """Out-of-sample r of each target over all outer folds together."""
    cross, own, yy = (sum(r[k] for r in rows) for k in ("cross", "predicted", "actual"))
    den = np.sqrt(np.maximum(own * yy, 0))
    return np.clip(np.where(den > 0, cross / np.where(den > 0, den, 1), np.nan), -1, 1)


def grouped_cv(sums: DataFrame, by: list[str], story: str, alphas: list[float], folds: int = 5) -> DataFrame:
    """nested_cv for each key over rows of SUMS per story: by, fold, alpha, score, n_test, r (mean over the fold's stories by target), and pooled_r, one number a target, on every row.

    A key's stories are a design's (tens), each of fixed size.
    """
    schema = ", ".join(f"{b} {sums.schema[b].dataType.simpleString()}" for b in by) + ", fold int, alpha double, score double, n_test double, r array<double>, pooled_r array<double>"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = nested_cv({r[story]: sums_of(r) for _, r in pdf.iterrows()}, alphas, folds)
        whole = pooled_r(rows).tolist() if rows else []
        return pd.DataFrame([(*key, r["fold"], r["alpha"], r["score"], r["n_test"], np.mean(r["r"], axis=0).tolist(), whole) for r in rows], columns=[*by, "fold", "alpha", "score", "n_test", "r", "pooled_r"])

    return sums.groupBy(*by).applyInPandas(run, schema)


def response_waveform(sums: DataFrame, by: list[str], story: str, alphas: list[float], folds: int = 5) -> DataFrame:
    """by, alpha, cv_r, lag, z: alpha by cross-validation over all stories (cv_r is its score as a correlation), weights refitted on all of them, z-scored over lags per target and averaged over targets.

    Weights that are the same at all lags have no waveform: an error.
    """
    schema = ", ".join(f"{b} {sums.schema[b].dataType.simpleString()}" for b in by) + ", alpha double, cv_r double, lag int, z double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = {r[story]: centred(sums_of(r)) for _, r in pdf.iterrows()}
        score, alpha = max(zip(cv_scores(own, sorted(own), folds, alphas), alphas, strict=True), key=lambda x: (x[0], -x[1]))
        f = total(list(own.values()))
        w = ridge_solutions(f["xx"], f["xy"], [alpha])[0]
        s = w.std(0)
        if not (s > np.finfo(float).eps).all():
            raise ValueError(f"constant weights over lags: {key}")
        z = ((w - w.mean(0)) / s).mean(1)
        return pd.DataFrame([(*key, float(alpha), float(np.tanh(score)), k, float(v)) for k, v in enumerate(z)], columns=[*by, "alpha", "cv_r", "lag", "z"])

    return sums.groupBy(*by).applyInPandas(run, schema)


def fit_paths(sums: DataFrame, by: list[str], role: str, alphas: list[float], metric: str = "mse") -> DataFrame:
    """ridge_path for each key, from its rows of SUMS with role "train" and "validation"."""
    schema = ", ".join(f"{b} {sums.schema[b].dataType.simpleString()}" for b in by) + ", alpha double, score double, weights array<double>, intercept array<double>"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: total([sums_of(r) for _, r in g.iterrows()]) for k, g in pdf.groupby(role)}
        if not {"train", "validation"} <= parts.keys():
            return pd.DataFrame(columns=[*by, "alpha", "score", "weights", "intercept"])
        a, w, b, scores = ridge_path(parts["train"], parts["validation"], alphas, metric)
        return pd.DataFrame([(*key, float(a), max(scores), w.ravel().tolist(), b.tolist())], columns=[*by, "alpha", "score", "weights", "intercept"])

    return sums.groupBy(*by).applyInPandas(run, schema)


def predicted(x: Column, weights: Column, intercept: Column) -> Column:
    """One target's prediction as a dot product of arrays."""
    return F.aggregate(F.zip_with(x, weights, lambda a, b: a.cast("double") * b), intercept, lambda s, v: s + v)
