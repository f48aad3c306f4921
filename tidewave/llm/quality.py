"""Quality scores from a byte-level convolutional network in numpy (operator 3).

A text is its UTF-8 bytes, each with one more bit: whether the four bytes from there stood there, or up to 32 bytes before, already.
Learned filters look at six places of that sequence at every byte; their largest response in each of the
overlapping chunks (256 bytes, every 128) is rectified, and mean and maximum over all chunks of the whole
document go through one logistic unit. Training is plain numpy on the driver, by Adam with gradients through
the pooled places only, over a bounded sample of labelled rows; scoring is a pandas UDF over all documents.

Defined cases: null text is the empty text, which gets a score like any other; texts are scored whole,
in pieces of fixed memory; rows with a null label or without a document are no examples; without any example every score is
0.5; repeated rows each get their score; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that training takes at most, those first in the order of a hash of their ids.
SAMPLE = 4096
PLACES = (0, 1, 2, 3, 5, 8)
FILTERS, BLOCK, PAD, SYMBOLS = 12, 128, 512, 513
LAGS = range(2, 33)
NEVER = -1e9  # the response at a padding place
GAP = 36  # places between texts, so that no text sees another
STEPS, BATCH, RATE = 700, 64, 0.01
PIECE = 2048  # blocks whose responses are in memory at a time


@dataclass
class Model:
    tables: np.ndarray  # [place, symbol, filter]
    bias: np.ndarray  # [filter]
    head: np.ndarray  # [2 * filter + 1]


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one sequence of symbols, each padded by GAP places and to whole blocks; and the first block of each, and the end."""
    lengths = np.array([len(t) for t in texts])
    n_blocks = -(-(lengths + GAP) // BLOCK)
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    raw = np.full(first[-1] * BLOCK + 64, 255, np.uint8)  # no byte of UTF-8
    for t, f in zip(texts, first, strict=False):
        raw[f * BLOCK : f * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    pad = raw == 255
    four = np.zeros(len(raw), np.uint32)
    for k in range(4):
        four[: len(raw) - 3] |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    again = np.zeros(len(raw), bool)
    for lag in LAGS:
        again[lag:] |= four[lag:] == four[:-lag]
    out = raw.astype(np.int16) + np.int16(256) * again
    out[pad] = PAD
    return out, first


def _pooled(model: Model, sym: np.ndarray, n_blocks: int, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest response of each filter in each block, and (if asked for) where it is."""
    best = np.empty((n_blocks, FILTERS), np.float32)
    where = np.empty((n_blocks, FILTERS), np.int64) if places else None
    for a in range(0, n_blocks, PIECE):
        b = min(n_blocks, a + PIECE)
        lo, n = a * BLOCK, (b - a) * BLOCK
        r = model.tables[0].take(sym[lo : lo + n], axis=0)
        for table, p in zip(model.tables[1:], PLACES[1:], strict=True):
            r += table.take(sym[lo + p : lo + p + n], axis=0)
        r = r.reshape(b - a, BLOCK, FILTERS)
        if places:
            at = r.argmax(1)
            where[a:b] = at + (np.arange(a, b) * BLOCK)[:, None]
            best[a:b] = np.take_along_axis(r, at[:, None, :], 1)[:, 0]
        else:
            best[a:b] = r.max(1)
    return best + model.bias, where


def _documents(best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk maxima (a block and the next of its text), and mean and maximum over the chunks of each text."""
    last = np.zeros(len(best), bool)
    last[first[1:] - 1] = True
    chunk = np.maximum(best, np.where(last[:, None], best, np.roll(best, -1, axis=0)))
    active = np.maximum(chunk, 0)
    n = np.diff(first)[:, None]
    return chunk, np.add.reduceat(active, first[:-1], axis=0) / n, np.maximum.reduceat(active, first[:-1], axis=0)


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    sym, first = symbols(texts)
    best, _ = _pooled(model, sym, first[-1])
    _, mean, top = _documents(best, first)
    z = np.hstack([mean, top, np.ones((len(texts), 1), np.float32)]) @ model.head
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.1, (len(PLACES), SYMBOLS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS + 1).astype(np.float32))
    m.tables[1:, PAD], m.tables[0, PAD] = 0, NEVER
    m.head[-1] = 0
    if not len(texts):
        m.head[:] = 0
        return m
    weights = [m.tables, m.bias, m.head]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    order: list[int] = []
    cells = SYMBOLS * FILTERS
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, len(texts)):
            order += rng.permutation(len(texts)).tolist()
        pick, order = order[:BATCH], order[BATCH:]
        sym, first = symbols([texts[i] for i in pick])
        best, where = _pooled(m, sym, first[-1], places=True)
        chunk, mean, top = _documents(best, first)
        x = np.hstack([mean, top, np.ones((len(pick), 1), np.float32)])
        p = 1 / (1 + np.exp(-np.clip(x @ m.head, -30, 30)))
        dz = (p - labels[pick]).astype(np.float32) / len(pick)
        g_head = x.T @ dz
        # back to the chunks: every active chunk has its share of the mean, one has the maximum's
        doc = np.repeat(np.arange(len(pick)), np.diff(first))
        g = (dz[:, None] * m.head[:FILTERS] / np.diff(first)[:, None])[doc] * (chunk > 0)
        is_top = (np.maximum(chunk, 0) == top[doc]) & (chunk > 0)
        g += (dz[:, None] * m.head[FILTERS:-1])[doc] * is_top / np.maximum(1, np.add.reduceat(is_top.astype(np.float32), first[:-1], axis=0))[doc]
        own = best == chunk  # the maximum lies in the chunk's first block, else in the next
        place = np.where(own, where, np.roll(where, -1, axis=0))
        g_tables = np.empty_like(m.tables)
        f = np.arange(FILTERS)
        for k, off in enumerate(PLACES):
            g_tables[k] = np.bincount((sym[place + off].astype(np.int64) * FILTERS + f).ravel(), g.ravel(), minlength=cells).reshape(SYMBOLS, FILTERS)
        rate = RATE * (1 - 0.9 * step / steps)
        for w, gw, (a, b) in zip(weights, (g_tables, g.sum(0), g_head), state, strict=True):
            a += 0.1 * (gw - a)
            b += 0.001 * (gw * gw - b)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        m.tables[1:, PAD], m.tables[0, PAD] = 0, NEVER
    return m


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most `sample` labelled rows that aren't held out."""
    known = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).orderBy(F.xxhash64(id_col, text_col)).limit(sample).collect()  # bounded by sample
    return train([(r[text_col] or "").encode() for r in rows], np.array([r["label"] for r in rows], np.float32))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, group, size = [], [], 0
            for t in texts:
                b = t.encode()
                group.append(b)
                size += len(b)
                if size >= PIECE * BLOCK:
                    out += score(shared.value, group).tolist()
                    group, size = [], 0
            if group:
                out += score(shared.value, group).tolist()
            yield pd.Series(out, dtype="float64")

    out = docs.withColumn("score", scores(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
