"""Filter interaction audit by removal ranks (operator 13).

A document's failed filters are one mask of n bits. Which of a chain of filters removes it is a product of two
small matrices in the (min, +) semiring: the mask matrix has 0 where a mask fails a filter and n where it passes,
the position matrix (each order's inverse permutation) has the place of each filter in each order, and the smallest sum over filters is
the removal step, n or more where nothing removes it. Steps scatter each mask's counts to (order, step): what is removed, kept, redundant
and lost, and, over all orders, the filters' Shapley sums. So Spark only counts documents by part and mask: the table
that reaches the matrices has 2^n counts a part, whatever the number of documents.

The copy filter needs other rows: digests (SHA-256) are counted with their smallest id, those of more than one row are joined back.
A digest, a part or a null id that holds a third of all rows is pre-aggregated in each task, or is on the side of a join that AQE splits.

Defined cases: a null text is empty and fails the first filter only (no words), and the copy filter as other empty texts do; a null part is the
empty string; a null id is never larger or smaller than another, so such rows fail no copy filter, make none fail and have no labels; rows of one id with one
text are copies of neither each other nor later ids' rows alone; a label holds if any row of the id has it; very long texts are cut into words within
their row; an empty table gives an empty result; columns other than id, text and part are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
#: Orders are n!; eight filters have 40 320.
MOST_FILTERS = 8
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: The bytes that begin a code point.
LEADS = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def counted(text: bytes) -> tuple[int, int, int, int]:
    """Words (between the bytes 09-0D and 20), distinct words, A-Z and code points of a text in UTF-8."""
    words = text.split()
    return len(words), len(set(words)), len(text) - len(text.translate(None, CAPITALS)), len(text) - len(text.translate(None, LEADS))


def counts_of(text: Column) -> Column:
    """What counted() tells of a text that isn't null: a struct of n, distinct, capitals and characters."""

    @F.pandas_udf("n long, distinct long, capitals long, characters long")
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counted(t.encode()) for t in texts], columns=["n", "distinct", "capitals", "characters"], dtype="int64")

    return counts(text)


def text_filters(text: Column, counts: Column) -> dict[str, Column]:
    """The four failure conditions that a text alone decides, by letter, from it and its counts_of."""
    return {
        "A": counts["n"] < 50,
        "B": 100 * counts["distinct"] < 65 * counts["n"],
        "C": 100 * counts["capitals"] > 5 * counts["characters"],
        "D": text.rlike(r"[#$%&*|]"),
    }


def removal_steps(n: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of n filters, and per mask and order the step (from 0) that removes it, n where none does: a min-plus product."""
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"{n} filters: from 1 to {MOST_FILTERS} can be audited in all orders")
    orders = list(permutations(range(n)))
    fails = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    cost = np.where(fails == 1, 0, n)
    position = np.argsort(np.array(orders), axis=1)  # the inverse permutations: where each filter stands
    steps = np.full((1 << n, len(orders)), n)
    for f in range(n):
        np.minimum(steps, cost[:, [f]] + position[:, f], out=steps)
    return orders, steps


def scatters(n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """orders, and the 0/1 matrices (masks, orders * n) that take a mask's count to where it is removed, redundant, or its filter's only failure."""
    orders, steps = removal_steps(n)
    here = np.arange(n)[None, None, :]
    masks = np.arange(1 << n)[:, None, None]
    fails = (masks >> np.array(orders)[None]) & 1  # whether the filter at (order, step) fails
    removed = steps[:, :, None] == here
    redundant = (fails == 1) & (steps[:, :, None] < here)
    unique = masks == 1 << np.array(orders)[None]
    return orders, *(m.reshape(1 << n, -1).astype(np.int64) for m in (removed, redundant, unique))


def audited(counts: DataFrame, letters: str) -> DataFrame:
    """SCHEMA from rows of part, mask, n, good, toxic: one row per part, order and step. Bit i of a mask is filter letters[i]."""
    n = len(letters)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^n cells a part at most

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders, removed_at, redundant_at, unique_at = scatters(n)
        names = ["".join(letters[f] for f in o) for o in orders]
        at = np.array(orders)
        for pdf in batches:
            for a in range(0, len(pdf), 64):
                some = pdf.iloc[a : a + 64]
                size = np.zeros((3, len(some), 1 << n), np.int64)
                for i, cells in enumerate(some["cells"]):
                    for c in cells:
                        size[:, i, c["mask"]] += c["n"], c["good"], c["toxic"]
                removed, good, toxic = (size @ removed_at).reshape(3, len(some), len(orders), n)
                redundant, unique = ((size[0] @ m).reshape(removed.shape) for m in (redundant_at, unique_at))
                whole = size[0].sum(1)[:, None, None]
                by_filter = np.stack([(removed * (at == f)).sum((1, 2)) for f in range(n)], 1)
                columns = [whole - removed.cumsum(2), removed, redundant, unique, good, toxic, by_filter[:, at]]
                per = len(orders) * n
                out = {"part": np.repeat(some["part"].to_numpy(), per), "filter_order": np.tile(np.repeat(names, n), len(some)), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(some) * len(orders))}
                yield pd.DataFrame(out | {c: v.ravel() for c, v in zip(COUNTS, columns, strict=True)})

    return parts.mapInPandas(rows, SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text", filters: dict[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """The audit of docs by part: `filters` (by default text_filters, by single letters) and the copy filter, in all orders.

    Filters may use the columns id, part, text (never null) and counts (see counts_of).

    labels has id_col, quality and toxic (0 or 1), from which good_lost and toxic_lost are counted.
    """
    filters = text_filters(F.col("text"), F.col("counts")) if filters is None else filters
    letters = "".join([*filters, copies])
    if len(set(letters)) != len(filters) + 1:
        raise ValueError(f"filters {letters!r}: each needs a letter of its own")
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    # one scan of the texts; from here on a document is some 60 bytes
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = read.withColumn("counts", counts_of(F.col("text"))).select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    slim = cut(slim, "filter-masks")
    # both are written, so that each is one sorted side of a join; behind an aggregate AQE splits no hot key of the other side
    firsts = cut(slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first"), "copies")
    held = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    held = cut(held, "labels-by-id")
    rows = slim.join(firsts, "digest", "left").join(held, "id", "left")
    full = F.col("mask") + F.when(F.col("id") > F.col("first"), 1 << len(filters)).otherwise(0)
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias
    counts = rows.groupBy("part", full.alias("mask")).agg(F.count(F.lit(1)).alias("n"), one("good")("good"), one("bad")("toxic"))
    return audited(counts, letters)
