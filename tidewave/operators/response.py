"""Lagged response models from lag products: no design matrix, no group that holds a series.

A stimulus x of N samples and lags from `first` to `last` (L of them) has the design X[t, j] = x[t - first - j], for the n = N - L + 1 samples t
at which all lags exist. With windows that start at i, X'X[j, k] is the sum over i of x[i + p] x[i + p + d], where d = |j - k| and p counts from the later lag. For
each d that is one sum over all starts, plus the products that enter at the end, less those that leave at the beginning, and these need the first
and the last L - 1 samples only. So a chunk gives L sums and its share of X'y; chunks carry the L - 1 samples behind them.

Columns are standardised afterwards, in the sums: every design column and every response to mean 0 and (population) deviation 1 over the valid samples of its story.
A stimulus's X'X is made once and joined to all subjects' X'Y; eigenvectors are made once a fold of a design.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import added, balanced_folds

#: Deviations up to the single-precision step count as constant.
CONSTANT = float(np.finfo(np.float32).eps)


def _typed(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def stimulus_chunks(stimulus: DataFrame, story: list[str], t: str, x: str, lags: int, size: int) -> DataFrame:
    """story, chunk, n (valid starts of the story), shift (its mean) and x, the chunk's samples and lags - 1 more. t counts from 0 without gaps; gaps and values that aren't finite are errors."""
    ok = F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = stimulus.groupBy(*story).agg(F.count(F.lit(1)).alias("_rows"), F.max(t).alias("_last"), F.min(t).alias("_first"), F.avg(x).alias("shift"), F.count(F.when(ok, 1)).alias("_ok"))
    sound = (F.col("_first") == 0) & (F.col("_last") + 1 == F.col("_rows")) & (F.col("_ok") == F.col("_rows")) & (F.col("_rows") >= lags + 2)
    n = F.when(sound, F.col("_rows") - (lags - 1)).otherwise(F.raise_error(F.lit(f"a stimulus must be finite, without gaps and of {lags + 2} samples at least")).cast("long"))
    whole = whole.select(*story, n.alias("n"), "shift")
    # a sample belongs to its chunk, and to those before whose last windows reach it
    ks = F.sequence(F.greatest(F.lit(0), F.floor((F.col(t) - (lags - 1)) / size)).cast("long"), F.floor(F.col(t) / size).cast("long"))
    dealt = stimulus.select(*story, F.col(t).cast("long").alias("_t"), F.col(x).cast("double").alias("_x"), F.explode(ks).alias("chunk"))
    packed = dealt.groupBy(*story, "chunk").agg(F.array_sort(F.collect_list(F.struct("_t", "_x"))).alias("_s"))  # size + lags - 1 at most
    return packed.join(whole, story).where(F.col("chunk") * size < F.col("n")).select(*story, "chunk", "n", "shift", F.transform("_s", lambda s: s["_x"]).alias("x"))


def lag_products(chunks: DataFrame, story: list[str], lags: int, size: int) -> DataFrame:
    """story, n, means, deviations and xx (lags x lags, row by row) of the design, standardised: one row a story."""
    part = f"{_typed(chunks, story)}, n long, total double, a array<double>, head array<double>, tail array<double>"

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                x, n, at = np.asarray(r.x, float) - r.shift, r.n, r.chunk * size
                own = x[: max(0, min(size, n - at))]  # the window starts of this chunk
                a = [float(own @ x[d : d + len(own)]) for d in range(lags)]
                head = x[: lags - 1] if at == 0 else x[:0]
                tail = x[n - at :] if n - at <= size else x[:0]  # the last chunk with a start has all samples behind it
                rows.append((*[getattr(r, c) for c in story], n, float(own.sum()), a, head.tolist(), tail.tolist()))
            yield pd.DataFrame(rows, columns=[*story, "n", "total", "a", "head", "tail"])

    if size < lags:
        raise ValueError(f"chunks of {size} samples are shorter than {lags} lags")
    parts = chunks.mapInPandas(reduce_, part)
    sums = parts.groupBy(*story).agg(F.max("n").alias("n"), F.sum("total").alias("total"), *[F.sum(F.col("a")[d]).alias(f"a{d}") for d in range(lags)], F.max_by("head", F.size("head")).alias("head"), F.max_by("tail", F.size("tail")).alias("tail"))
    sums = sums.select(*story, "n", "total", F.array(*[F.col(f"a{d}") for d in range(lags)]).alias("a"), "head", "tail")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                mean, std, xx = standardised_products(r.n, r.total, np.asarray(r.a), np.asarray(r.head), np.asarray(r.tail))
                rows.append((*[getattr(r, c) for c in story], r.n, mean.tolist(), std.tolist(), xx.ravel().tolist()))
            yield pd.DataFrame(rows, columns=[*story, "n", "mean", "std", "xx"])

    return sums.mapInPandas(finish, f"{_typed(chunks, story)}, n long, mean array<double>, std array<double>, xx array<double>")


def standardised_products(n: int, total: float, a: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column means, deviations and X'X of the standardised design, from sums over starts and the samples at both ends."""
    lags = len(a)
    raw, sums = np.empty((lags, lags)), np.empty(lags)
    for d in range(lags):
        enter = np.concatenate([[0.0], np.cumsum(tail[: lags - 1 - d] * tail[d:] if d < lags - 1 else [])])
        leave = np.concatenate([[0.0], np.cumsum(head[: lags - 1 - d] * head[d:] if d < lags - 1 else [])])
        for p in range(lags - d):  # lags j = L - 1 - p - d and k = L - 1 - p
            j, k = lags - 1 - p - d, lags - 1 - p
            raw[j, k] = raw[k, j] = a[d] + enter[p] - leave[p]
    enter, leave = np.concatenate([[0.0], np.cumsum(tail)]), np.concatenate([[0.0], np.cumsum(head)])
    sums[::-1] = total + enter[:lags] - leave[:lags]
    mean = sums / n
    std = np.sqrt(np.maximum(np.diag(raw) / n - mean**2, 0))
    if not (std > CONSTANT).all():
        raise ValueError(f"constant columns in a design: {np.flatnonzero(~(std > CONSTANT)).tolist()}")
    return mean, std, (raw - n * np.outer(mean, mean)) / np.outer(std, std)


def cross_products(responses: DataFrame, chunks: DataFrame, by: list[str], story: list[str], t: str, y: str, first: int, lags: int, size: int) -> DataFrame:
    """by, story, seen, sy, syy (a number a channel), xy (lags x channels): sums of raw products over the valid samples, one row a (by, story).

    responses has by, story, t and the array y of all channels. Samples behind the stimulus's end are left out; seen is how many were valid.
    """
    last = first + lags - 1
    keys = [*by, *story]
    start = F.col(t).cast("long") - last
    own = responses.select(*keys, start.alias("_i"), F.transform(y, lambda v: v.cast("double")).alias("_y")).where("_i >= 0").withColumn("chunk", F.expr(f"_i div {size}"))
    packed = own.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("_i", "_y"))).alias("_s"))  # `size` samples at most
    met = packed.join(chunks, [*story, "chunk"])
    schema = f"{_typed(responses, keys)}, seen long, sy array<double>, syy array<double>, xy array<double>"

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                at = r.chunk * size
                i = np.asarray(r.i)
                ys = np.asarray(r.y).reshape(len(i), -1)[i < r.n]  # samples behind the last valid one are left out
                i = i[i < r.n] - at
                if not np.isfinite(ys).all():
                    raise ValueError("responses that aren't finite")
                x = np.asarray(r.x, float) - r.shift
                # column j is the lag first + j: x[i + L - 1 - j], one product of vectors a lag
                xy = np.stack([x[i + lags - 1 - j] @ ys for j in range(lags)])
                key = tuple(getattr(r, c) for c in keys)
                new = [len(ys), ys.sum(0), (ys * ys).sum(0), xy]
                old = held.get(key)
                held[key] = new if old is None else [p + q for p, q in zip(old, new, strict=True)]
            if len(held) > 256:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, seen, sy.tolist(), syy.tolist(), xy.ravel().tolist()) for k, (seen, sy, syy, xy) in held.items()], columns=[*keys, "seen", "sy", "syy", "xy"])

    parts = met.select(*keys, "chunk", "n", "shift", "x", F.transform("_s", lambda s: s["_i"]).alias("i"), F.flatten(F.transform("_s", lambda s: s["_y"])).alias("y")).mapInPandas(reduce_, schema)
    return added(parts, keys)


def standardised(cross: DataFrame, designs: DataFrame, story: list[str], lags: int) -> DataFrame:
    """cross_products with xy and the responses standardised (yss is n for each channel), and y_std, the responses' deviations. Joined to designs by story."""
    keys = [c for c in cross.columns if c not in ("seen", "sy", "syy", "xy")]
    schema = f"{_typed(cross, keys)}, n long, y_std array<double>, xy array<double>, yss array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.seen != r.n:
                    raise ValueError(f"responses at {r.seen} of {r.n} valid samples")
                sy, xy = np.asarray(r.sy), np.asarray(r.xy).reshape(lags, -1)
                mean = sy / r.n
                std = np.sqrt(np.maximum(np.asarray(r.syy) / r.n - mean**2, 0))
                if not (std > CONSTANT).all():
                    raise ValueError(f"constant channels in responses: {np.flatnonzero(~(std > CONSTANT)).tolist()}")
                z = (xy - r.n * np.outer(r.mean, mean)) / np.outer(r.std, std)
                rows.append((*[getattr(r, c) for c in keys], r.n, std.tolist(), z.ravel().tolist(), [float(r.n)] * len(sy)))
            yield pd.DataFrame(rows, columns=[*keys, "n", "y_std", "xy", "yss"])

    return cross.join(designs.select(*story, "n", "mean", "std"), story).select(*cross.columns, "n", "mean", "std").mapInPandas(run, schema)


def ridge_operators(xx: np.ndarray, alphas: list[float]) -> list[np.ndarray]:
    """(xx + alpha I)^-1 for each alpha from one eigendecomposition."""
    values, vectors = np.linalg.eigh((xx + xx.T) / 2)
    return [(vectors / (np.maximum(values, 0) + a)) @ vectors.T for a in alphas]


def fold_plans(designs: DataFrame, group: list[str], story: str, folds: int, alphas: list[float]) -> DataFrame:
    """One row per group of stories (a day): stories, n, xx of each, and the steps of its plan: fold, inner (-1 for the outer fold itself), places of the stories held out, operators of all alphas in a row.

    Outer folds hold whole stories, balanced by samples, and so do the inner folds of each one's training stories. Eigenvectors are made here, once for all subjects.
    """
    schema = f"{_typed(designs, group)}, stories array<{designs.schema[story].dataType.simpleString()}>, n array<double>, xx array<array<double>>, fold array<int>, inner array<int>, out array<array<int>>, operators array<array<double>>"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(story)
        ids, n, xx = pdf[story].tolist(), pdf["n"].astype(float).tolist(), [np.asarray(x).reshape(int(len(x) ** 0.5), -1) for x in pdf["xx"]]
        if len(ids) < 3:
            raise ValueError(f"{len(ids)} stories: nested folds need three at least")
        at, plan = list(range(len(ids))), []

        def add(fold: int, inner: int, of: list[int], out: list[int]) -> None:
            rest = sum(xx[i] for i in of if i not in out)
            plan.append((fold, inner, out, np.concatenate([o.ravel() for o in ridge_operators(rest, alphas)]).tolist()))

        outer = balanced_folds(at, n, min(folds, len(at)))
        for f in sorted(set(outer.values())):
            test = [i for i in at if outer[i] == f]
            train = [i for i in at if outer[i] != f]
            add(f, -1, at, test)
            inner = balanced_folds(train, [n[i] for i in train], min(folds, len(train)))
            for k in sorted(set(inner.values())):
                add(f, k, train, [i for i in train if inner[i] == k])
        return pd.DataFrame([(*key, ids, n, [x.ravel().tolist() for x in xx], *map(list, zip(*plan, strict=True)))], columns=[*group, "stories", "n", "xx", "fold", "inner", "out", "operators"])

    return designs.groupBy(*group).applyInPandas(run, schema)  # tens of stories a group, each of fixed size


def scores_of(xx: np.ndarray, xy: np.ndarray, yss: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r of each channel with its prediction, the cross sums and the predictions' own, from standardised sums."""
    own, cross = np.einsum("ij,ij->j", w, xx @ w), np.einsum("ij,ij->j", w, xy)
    den = np.sqrt(np.maximum(own, 0) * np.maximum(yss, 0))
    return np.clip(np.where(den > 0, cross / np.where(den > 0, den, 1), np.nan), -1, 1), cross, own


def _evaluated(plan: pd.Series, rows: pd.DataFrame, story: str, alphas: list[float]) -> list[tuple]:
    """Per held-out story of one subject: (story, fold, alpha, inner score, n, r, cross, predicted_ss, yss)."""
    ids, n = list(plan["stories"]), list(plan["n"])
    p = int(round(len(plan["xx"][0]) ** 0.5))
    xx = [np.asarray(x).reshape(p, p) for x in plan["xx"]]
    own = {r[story]: (np.asarray(r["xy"]).reshape(p, -1), np.asarray(r["yss"])) for _, r in rows.iterrows()}
    if set(own) != set(ids):
        raise ValueError(f"stories without responses, or responses without stories: {sorted(set(ids) ^ set(own))}")
    xy, yss = [own[i][0] for i in ids], [own[i][1] for i in ids]
    folds: dict[int, dict[int, tuple]] = {}
    for f, k, held, operators in zip(plan["fold"], plan["inner"], plan["out"], plan["operators"], strict=True):
        folds.setdefault(f, {})[k] = (list(held), list(np.asarray(operators).reshape(-1, p, p)))
    out = []
    for f, parts in sorted(folds.items()):
        test, operators = parts[-1]
        train = [i for i in range(len(ids)) if i not in test]
        z, weight = np.zeros(len(alphas)), np.zeros(len(alphas))
        for k, (held, inner) in sorted(parts.items()):
            if k < 0 or len(held) == len(train):
                continue
            rest = sum(xy[i] for i in train if i not in held)
            for a, operator in enumerate(inner):
                w = operator @ rest
                for i in held:
                    r, _, _ = scores_of(xx[i], xy[i], yss[i], w)
                    r = np.clip(r[np.isfinite(r)], -0.999999, 0.999999)
                    z[a] += n[i] * np.arctanh(r).sum()
                    weight[a] += n[i] * len(r)
        inner_scores = np.where(weight > 0, z / np.where(weight > 0, weight, 1), -np.inf)
        best = max(range(len(alphas)), key=lambda a: (inner_scores[a], -alphas[a]))
        w = operators[best] @ sum(xy[i] for i in train)
        for i in test:
            r, cross, predicted = scores_of(xx[i], xy[i], yss[i], w)
            out.append((ids[i], f, float(alphas[best]), float(np.tanh(inner_scores[best])), int(n[i]), r.tolist(), cross.tolist(), predicted.tolist(), yss[i].tolist()))
    return out


def cross_validated(sums: DataFrame, plans: DataFrame, by: list[str], group: list[str], story: str, alphas: list[float], blocks: int = 16) -> DataFrame:
    """by, group, story, fold, alpha, inner_score, n and arrays r, cross, predicted_ss, yss by channel: nested cross-validation of each subject's responses.

    A group's plan meets its subjects in `blocks` tasks. Sums over rows of cross, predicted_ss and yss give pooled correlations (see pooled).
    """
    keys = [*by, *group]
    schema = f"{_typed(sums, [*keys, story])}, fold int, alpha double, inner_score double, n long, r array<double>, cross array<double>, predicted_ss array<double>, yss array<double>"
    left = sums.withColumn("_block", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int"))
    right = plans.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    columns = [*keys, story, "fold", "alpha", "inner_score", "n", "r", "cross", "predicted_ss", "yss"]

    def run(_: tuple, rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(plan):
            for key, own in rows.groupby(keys, sort=False):
                found += [(*key, *x) for x in _evaluated(plan.iloc[0], own, story, alphas)]
        return pd.DataFrame(found, columns=columns)

    return left.groupBy(*group, "_block").cogroup(right.groupBy(*group, "_block")).applyInPandas(run, schema)


def pooled(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, channel (its place), r over all held-out samples together, samples: from rows of cross_validated."""
    cells = F.arrays_zip(F.col("cross"), F.col("predicted_ss"), F.col("yss"))
    long = scores.select(*by, "n", F.posexplode(cells).alias("channel", "x"))
    sums = long.groupBy(*by, "channel").agg(F.sum("x.cross").alias("c"), F.sum("x.predicted_ss").alias("p"), F.sum("x.yss").alias("y"), F.sum("n").alias("samples"))
    den = F.sqrt(F.col("p") * F.col("y"))
    return sums.select(*by, "channel", F.when(den > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / den))).alias("r"), "samples")


def as_sums(sums: DataFrame, designs: DataFrame, story: list[str]) -> DataFrame:
    """Standardised sums as rows of linear.SUMS, for grouped_cv and response_waveform."""
    zeros = lambda c: F.transform(c, lambda _: F.lit(0.0))
    keys = [c for c in sums.columns if c not in ("n", "y_std", "xy", "yss")]
    joined = sums.join(designs.select(*story, "mean", "xx"), story)
    return joined.select(*keys, F.col("n").cast("double").alias("n"), zeros("mean").alias("sx"), "xx", zeros("yss").alias("sy"), "xy", F.col("yss").alias("yy"))
