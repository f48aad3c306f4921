"""Approximate nearest neighbours by inner product, in balanced posting lists (operator 12).

Vectors get one more coordinate, which makes all of them equally long, so the largest inner product is the smallest distance. A bounded sample is
halved again and again at the median between two means, so all posting lists are equally large on the sample; 16 lists that lie side by side are a cell.
The lists' centroids with a graph of their neighbours (pruned to those that no other neighbour is nearer to) go to the tasks, where each vector walks the graph: it is
filed under the nearest list and, if it lies near a boundary, under further ones, leaving out lists whose centroid is nearer to one
taken already than to the vector. A query takes the lists whose distance is at most `ratio` times the nearest one's; as long as the last list of its walk is still within, it
walks again with a beam twice as wide, so the walk's width is no cap. Then the queries of a cell meet the cell's vectors in blocks: first in each query's FIRST nearest lists,
whose k + 1 best bound the others, then in the rest, which return only what reaches the bound. So a query gets few rows back, however many lists it takes.

Sizes: the fit takes at most SAMPLE rows with the smallest id hashes (their vectors, at most SAMPLE_BYTES, reach the driver), and makes at most LISTS lists, so the broadcast
is at most LISTS * (d + 1 + 2 * DEGREE) numbers. Every row is indexed. More rows than lists can hold evenly are dealt to segments, more queries to blocks, so no task holds more
than SEGMENT vectors and BLOCK queries at a time, however frequent a vector or how skewed the lists. Of vectors that are equal the k + 1 smallest ids are
kept as candidates, since no others can be among k neighbours, and equal queries are searched once.

Recall of 20 neighbours on the given tables (most directions uniform in 64 dimensions, the hardest kind), all queries: with a ratio of 1.2 check_s 0.975, check_h 0.981, check_l
0.965, with 1.25 0.991, 0.996 and 0.990; RATIO lies between.

Defined cases: vectors that are null, empty, all zero or hold a null, NaN or infinity take no part, nor do rows without an id or with another length than most rows have (ties:
the longer); rows of one id count as one, with the smallest vector in array order; scores are sums in double precision in order of the components; ties go to the smaller id; a
query with fewer candidates gets all of them; an empty table gives an empty result; columns other than id and vector are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions

SAMPLE, SAMPLE_BYTES = 1 << 16, 64 << 20
#: Vectors a list, lists at most, lists a cell, neighbours of a centroid in the graph.
LIST, LISTS, CELL, DEGREE = 256, 8192, 16, 24
#: Lists that hold a vector at most, and how much farther than the nearest centroid the others may be.
REPLICAS, CLOSURE = 4, 1.25
#: How much farther than the nearest centroid a list may be to be searched.
RATIO = 1.22
#: Lists that are searched first.
FIRST = 4
SEGMENT, BLOCK = 8192, 4096


def _halves(x: np.ndarray) -> np.ndarray:
    """Which half of x each row is in: the median along the line between two means that were moved apart."""
    a, b = x[0], x[((x - x[0]) ** 2).sum(1).argmax()]
    for _ in range(4):
        along = x @ (b - a)
        right = np.zeros(len(x), bool)
        right[np.argsort(along, kind="stable")[len(x) // 2 :]] = True
        a, b = x[~right].mean(0), x[right].mean(0)
    return right


def balanced_centroids(x: np.ndarray, n: int) -> np.ndarray:
    """Centroids of n (a power of two) equally large groups of rows, groups that were split last side by side."""
    groups = [x]
    while len(groups) < n:
        groups = [g[side] for g in groups for right in [_halves(g)] for side in (~right, right)]
    return np.stack([g.mean(0) for g in groups])


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Per centroid up to 2 * degree others: nearest ones that no taken one is nearer to, filled up with the nearest, and links back; -1 where there are fewer."""
    n = len(c)
    out = [[] for _ in range(n)]
    squares = (c * c).sum(1)
    for a in range(0, n, 1024):
        d = squares[a : a + 1024, None] - 2 * c[a : a + 1024] @ c.T + squares
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argsort(d, 1)[:, : min(2 * degree, n - 1)]
        for i, row in enumerate(near):
            own, between = d[i, row], squares[row, None] - 2 * c[row] @ c[row].T + squares[row]
            taken: list[int] = []
            for j in range(len(row)):
                if len(taken) < degree and not (between[j, taken] < own[j]).any():
                    taken.append(j)
            rest = [j for j in range(len(row)) if j not in taken]
            out[a + i] = [int(x) for x in row[taken + rest[: max(0, degree // 2 - len(taken))]]]
    for i in range(n):
        for j in out[i][: degree // 2]:
            if i not in out[j] and len(out[j]) < 2 * degree:
                out[j].append(i)
    graph = np.full((n, max(1, max(map(len, out), default=1))), -1, np.int32)
    for i, row in enumerate(out):
        graph[i, : len(row)] = row
    return graph


class Index:
    """Centroids, their graph and the entries of walks through it."""

    def __init__(self, sample: np.ndarray, lists: int, longest: float):
        self.longest = longest
        c = balanced_centroids(self.lifted(sample), lists)
        # as long as the vectors: a mean of many directions is short, and would seem near to everything
        self.centroids = c * (longest / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12 * longest))
        self.squares = (self.centroids**2).sum(1)
        self.graph = neighbour_graph(self.centroids)
        self.entries = np.arange(CELL // 2, lists, CELL) if lists > CELL else np.arange(lists)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """x with the coordinate that makes all rows as long as the longest vector."""
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))])

    def _distances(self, x: np.ndarray, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return np.maximum(self.squares[lists] - 2 * np.einsum("ij,ij->i", x[rows], self.centroids[lists]) + (x * x).sum(1)[rows], 0)

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row the lists nearest to it as far as the graph leads, nearest first, and their squared distances; -1 and infinity where there are fewer."""
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        at = np.full((n, beam), -1)
        far = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        fresh = np.broadcast_to(self.entries, (n, len(self.entries)))
        every = np.arange(n)[:, None]
        while True:
            new = np.sort(fresh, 1)
            use = (new >= 0) & ~seen[every, new]
            use[:, 1:] &= new[:, 1:] != new[:, :-1]
            rows, places = np.nonzero(use)
            if not len(rows):
                return at, far
            seen[rows, new[rows, places]] = True
            d = np.full(new.shape, np.inf)
            d[rows, places] = self._distances(x, rows, new[rows, places])
            at, far = np.hstack([at, np.where(use, new, -1)]), np.hstack([far, d])
            done = np.hstack([done, ~use])
            best = np.lexsort((at, far))[:, :beam]
            at, far, done = at[every, best], far[every, best], done[every, best]
            # the four best that were not followed yet
            turn = np.argsort(done, 1, kind="stable")[:, :4]
            follow = np.where(done[every, turn], -1, at[every, turn])
            np.put_along_axis(done, turn, True, 1)
            fresh = np.where(follow[:, :, None] >= 0, self.graph[follow], -1).reshape(n, -1)

    def filed(self, x: np.ndarray, replicas: int = REPLICAS, closure: float = CLOSURE) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for each list that a vector is filed under."""
        at, far = self.walk(self.lifted(x), 4 * replicas)
        take = np.zeros(at.shape, bool)
        take[:, 0] = True
        for j in range(1, at.shape[1]):
            ok = (at[:, j] >= 0) & (far[:, j] <= closure**2 * far[:, 0]) & (take.sum(1) < replicas)
            for i in range(j):
                between = ((self.centroids[at[:, i]] - self.centroids[at[:, j]]) ** 2).sum(1)
                ok &= ~(take[:, i] & (between < far[:, j]))
            take[:, j] = ok
        rows, places = np.nonzero(take)
        return rows, at[rows, places]

    def searched(self, x: np.ndarray, held: np.ndarray, least: int, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for each list that a query is to search: within ratio of the nearest, and as many more as hold `least` vectors; held has the lists' sizes."""
        lifted = np.column_stack([x, np.zeros(len(x))])
        todo, beam, out = np.arange(len(x)), 64, []
        while len(todo):
            at, far = self.walk(lifted[todo], beam)
            sizes = np.where(at >= 0, held[at], 0)
            take = (at >= 0) & ((far <= ratio**2 * far[:, :1]) | (sizes.cumsum(1) - sizes < least))
            whole = beam >= len(self.centroids)
            ends = ~take[:, -1] | whole
            rows, places = np.nonzero(take & ends[:, None])
            out.append((todo[rows], at[rows, places]))
            if whole and (at < 0).any():  # lists that the graph doesn't reach
                some = ends & (at < 0).any(1)
                missing = np.ones((some.sum(), len(self.centroids)), bool)
                r, p = np.nonzero(at[some] >= 0)
                missing[r, at[some][r, p]] = False
                r, lists = np.nonzero(missing)
                out.append((todo[np.flatnonzero(some)[r]], lists))
            todo, beam = todo[~ends], beam * 2
        return np.concatenate([r for r, _ in out]), np.concatenate([a for _, a in out])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the rows that take part, but for their length."""
    v = F.col("v")
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) if kind in ("float", "double") else F.forall(v, lambda x: x.isNotNull())
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.where(real & F.exists(v, lambda x: x != 0))


def _one_each(rows: DataFrame) -> DataFrame:
    """Of rows with one id the one with the smallest vector; ids alone are counted first, since there are hardly ever any."""
    repeated = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, "id", "left_anti").unionByName(rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in order of the components, so that equal vectors have equal scores."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def best_of(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k nearest rows of x to each q; ties to the smaller id."""
    s = q @ x.T
    least = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k] if s.shape[1] > k else s.min(1)
    rows, at = np.nonzero(s >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None])
    score = exact_scores(q[rows], x[at])
    order = np.lexsort((ids[at], -score, rows))
    rows, at, score = rows[order], at[order], score[order]
    first = np.searchsorted(rows, np.arange(len(q)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], ids[at[keep]], score[keep]


def fit(rows: DataFrame, dims: int, n: int, longest: float, sample: int = SAMPLE, per_list: int = LIST) -> Index:
    """An Index from the `sample` rows with the smallest id hashes (fewer if they have more than SAMPLE_BYTES)."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(sample, SAMPLE_BYTES // (8 * dims)))).toPandas()
    lists = 1
    while lists < min(LISTS, len(some) // 8, n / per_list):
        lists *= 2
    return Index(_matrix(some["v"]), lists, longest)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", ratio: float = RATIO, sample: int = SAMPLE, per_list: int = LIST, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id (named id_col) and score for the rows of vectors for which `queries`, a condition over id_col, holds."""
    spark = vectors.sparkSession
    id_type, v_type = (vectors.schema[c].dataType.simpleString() for c in (id_col, vector_col))
    schema = f"query_id {id_type}, rank int, {id_col} {id_type}, score double"
    rows = usable(vectors, id_col, vector_col)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shape = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).orderBy(F.desc("n"), F.desc("dims")).first()
    if shape is None:
        return spark.createDataFrame([], schema)
    rows = _one_each(rows.where(F.size("v") == shape["dims"]))
    index = spark.sparkContext.broadcast(fit(rows, shape["dims"], shape["n"], shape["most"] ** 0.5, sample, per_list))

    # of equal vectors the first k + 1: nothing else can be among k neighbours
    alike = rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1).select("id", "v")

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                some = pdf.iloc[a : a + 1024]
                at, lists = index.value.filed(_matrix(some["v"]))
                yield pd.DataFrame({"id": some["id"].to_numpy()[at], "list": lists.astype(np.int32), "v": some["v"].to_numpy()[at]})

    filed = cut(alike.mapInPandas(file, f"id {id_type}, list int, v {v_type}"), "posting-lists")
    sizes = {r["list"]: r["n"] for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # LISTS at most
    held = np.zeros(len(index.value.centroids), np.int64)
    held[list(sizes)] = list(sizes.values())
    least = REPLICAS * (k + 1)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                some = pdf.iloc[a : a + 1024]
                at, lists = index.value.searched(_matrix(some["v"]), held, least, ratio)
                found = pd.DataFrame({"at": at, "cell": (lists // CELL).astype(np.int32), "list": lists.astype(np.int32)})
                found["early"] = found.groupby("at").cumcount() < FIRST  # a row's lists come nearest first
                found = found.groupby(["at", "cell", "early"])["list"].agg(list).reset_index()
                yield pd.DataFrame({"rep": some["id"].to_numpy()[found["at"]], "cell": found["cell"], "early": found["early"], "lists": found["list"], "v": some["v"].to_numpy()[found["at"]]})

    asked = rows.withColumnRenamed("id", id_col).where(queries).withColumnRenamed(id_col, "id")
    groups = cut(asked.groupBy("v").agg(F.min("id").alias("rep")), "queries")
    plans = cut(groups.select(F.col("rep").alias("id"), "v").mapInPandas(search, f"rep {id_type}, cell int, early boolean, lists array<int>, v {v_type}"), "searches")
    early = cut(_best(_met(filed, plans.where("early").withColumn("bound", F.lit(float("-inf"))), held, k, segment, block, id_type), k), "nearest-lists")
    bounds = early.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select("rep", F.when(F.col("n") > k, F.col("least")).otherwise(float("-inf")).alias("bound"))
    late = _met(filed, plans.where("NOT early").join(bounds, "rep", "left").fillna(float("-inf"), ["bound"]), held, k, segment, block, id_type)
    return _ranked(_best(early.select("rep", "id", "score").unionByName(late), k), asked, groups, k, id_col)


def _met(filed: DataFrame, plans: DataFrame, held: np.ndarray, k: int, segment: int, block: int, id_type: str) -> DataFrame:
    """rep, id, score: of each (cell, segment) the k + 1 nearest to each query group that searches it, as far as they reach its bound."""
    spark: SparkSession = filed.sparkSession
    asks = {r["cell"]: r["n"] for r in plans.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # LISTS / CELL at most
    cells = [int(held[c : c + CELL].sum()) for c in range(0, len(held), CELL)]
    sizes = spark.createDataFrame([(c, -(-n // segment), -(-asks.get(c, 0) // block)) for c, n in enumerate(cells) if n and c in asks], "cell int, segments int, blocks int")
    sizes = F.broadcast(sizes)  # a row a cell
    places = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.withColumn("cell", F.expr(f"list div {CELL}").cast("int")).join(sizes, "cell").withColumn("segment", F.pmod(F.xxhash64("id"), F.col("segments")).cast("int")).withColumn("block", places("blocks"))
    right = plans.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("segment", places("segments"))
    keys = ["cell", "segment", "block"]

    def meet(_: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(x) and len(q):
            xs, qs, ids = _matrix(x["v"]), _matrix(q["v"]), x["id"].to_numpy()
            at = np.repeat(np.arange(len(q)), q["lists"].map(len))
            lists = np.concatenate(q["lists"].to_numpy())
            own = x["list"].to_numpy()
            for c in np.unique(lists):
                mine, some = own == c, at[lists == c]
                if mine.any():
                    r, i, s = best_of(ids[mine], xs[mine], qs[some], k + 1)
                    parts.append((some[r], i, s))
        if not parts:
            return pd.DataFrame({"rep": [], "id": [], "score": []})
        r, i, s = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])  # a vector that is in several lists has one score
        r, i, s = r[new], i[new], s[new]
        keep = (np.arange(len(r)) - np.searchsorted(r, np.arange(len(q)))[r] < k + 1) & (s >= q["bound"].to_numpy()[r])
        return pd.DataFrame({"rep": q["rep"].to_numpy()[r[keep]], "id": i[keep], "score": s[keep]})

    return left.select(*keys, "list", "id", "v").groupBy(*keys).cogroup(right.select(*keys, "rep", "lists", "v", "bound").groupBy(*keys)).applyInPandas(meet, f"rep {id_type}, id {id_type}, score double")


def _best(met: DataFrame, k: int) -> DataFrame:
    """rep, id, score, place (from 1): the k + 1 best of each rep; a vector that is in several lists counts once."""
    best = met.repartition(partitions(met.sparkSession), "rep").groupBy("rep", "id").agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)


def _ranked(best: DataFrame, asked: DataFrame, groups: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k nearest of each query: of the k + 1 of its group those that aren't itself."""
    whole = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))  # k + 1 at most
    members = asked.join(groups, "v").select("id", "rep")
    own = members.join(cut(whole, "neighbours"), "rep").select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
