"""Best-fit packing with certified bounds (operator 2).

Documents become pieces of at most `capacity` tokens. Pieces of just that length are sequences by themselves and go nowhere; the
others are dealt into partitions, and each
partition packs its own by best-fit decreasing. Lower bounds from dual feasible functions, over the
partition's own lengths, say how few sequences it could need: a partition that needs no more is
certified and closed. The others exchange all their pieces: these are dealt again in another mixture and packed anew,
until all are certified, the bound of all lengths together is met, or two rounds in a row make no
sequence less. The best round stays. A partition never holds more than its share of pieces; what is
open in a last, single partition is packed in other orders of nearly equal lengths, which stand for an exchange there.

Only the counts of lengths (at most `capacity` numbers) and one line of figures a round reach the driver.

Defined cases: null text is the empty text, one piece with the end id alone; very long texts are cut in pieces of the capacity;
repeated rows and ties in length are packed each by itself, null ids too; an empty table gives an empty result; of docs, further
columns are ignored, and of pieces they pass through, but for those named like an output, which it replaces, and may have any other name.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .tokens import encoder

#: Pieces that one task packs at most, on average.
TASK_PIECES = 100_000
#: Rounds without a gain after which the exchange ends.
IDLE = 2


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 and, if asked for, ids. A document's first piece takes the remainder."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for pdf in batches:
            ids = pdf[id_col].tolist()
            rows = []
            for doc, b in zip(ids, enc.encode(t or "" for t in pdf["t"]), strict=True):
                b = memoryview(b + end)
                n = len(b) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    part = b[4 * at : 4 * (at + size)]
                    rows.append((doc, piece, at, size, zlib.crc32(part), *([np.frombuffer(part, "<u4").tolist()] if with_ids else ())))
                    at, piece = at + size, piece + 1
            names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            if len(out):
                out[id_col] = pd.array(out[id_col], dtype=pdf[id_col].dtype) if pdf[id_col].dtype != float else out[id_col].astype("Int64")
            yield out

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(cut_up, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The largest of the bounds of two families of dual feasible functions over counts[length]."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return 0
    have, x = counts[lengths].astype(np.int64), lengths.astype(np.int64)
    best = -(-int((have * x).sum()) // capacity)
    # u_eps: below eps nothing, above capacity - eps a whole sequence, else itself
    for eps in range(1, capacity // 2 + 1):
        value = np.where(x > capacity - eps, capacity, np.where(x < eps, 0, x))
        best = max(best, -(-int((have * value).sum()) // capacity))
    # f_k: multiples of 1 / (k + 1) stay, all else is rounded down to multiples of 1 / k
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((have * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each length, and how many sequences. Bins are kept by room, so each step looks at bits of one number.

    order: the lengths' order if it isn't the decreasing one.
    """
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: a sequence with room r is open
    for i in (np.argsort(-lengths, kind="stable") if order is None else order).tolist():
        x = int(lengths[i])
        fit = rooms >> x
        if fit:
            r = x + ((fit & -fit).bit_length() - 1)
            b = bins[r].pop()
            if not bins[r]:
                rooms &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        seq[i], offset[i] = b, capacity - r
        if r > x:
            bins[r - x].append(b)
            rooms |= 1 << (r - x)
    return seq, offset, n


def _packed(lengths: np.ndarray, capacity: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing; after the first round (seed > 0) over lengths blurred by a few hundredths, so that equal pieces meet other company."""
    if not seed:
        return best_fit_decreasing(lengths, capacity)
    blur = np.random.default_rng(seed).uniform(1 - 0.02 * (1 + seed % 4), 1, len(lengths))
    return best_fit_decreasing(lengths, capacity, np.argsort(-lengths * blur, kind="stable"))


def _round(pieces: DataFrame, number: int, parts: int, capacity: int, base: int = 0) -> DataFrame:
    """pieces, dealt into parts tasks and packed there; adds sequence_id, offset and gap (sequences of its task above the task's bound). base: parts of the rounds before, so that ids stay apart."""
    names = pieces.columns
    same = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # the lengths of a batch in turn, so that all parts get the same mixture
            rank = np.empty(len(pdf), np.int64)
            rank[np.argsort(pdf["length"].to_numpy(), kind="stable")] = np.arange(len(pdf))
            yield pdf.assign(_pk_part=(rank + zlib.crc32(f"{number} {len(pdf)} {pdf['length'].sum()}".encode())) % parts)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)  # a share of the pieces, TASK_PIECES on average
        if not got:
            return
        for part, pdf in pd.concat(got, ignore_index=True).groupby("_pk_part"):
            lengths = pdf["length"].to_numpy(np.int64)
            bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            tries = range(16) if parts == 1 else (number,)
            best = None
            for seed in tries:
                found = _packed(lengths, capacity, seed)
                best = found if best is None or found[2] < best[2] else best
                if best[2] <= bound:
                    break
            seq, offset, n = best
            yield pdf[names].assign(sequence_id=((base + int(part)) << 32) | seq, offset=offset, _pk_gap=n - bound)

    dealt = pieces.mapInPandas(deal, same + ", _pk_part long").repartition(parts, "_pk_part")
    return dealt.mapInPandas(pack, same + ", sequence_id long, offset long, _pk_gap long")


#: Packed by a certified partition.
SETTLED = "_pk_gap <= 0"


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = 1024, task_pieces: int = TASK_PIECES) -> DataFrame:
    """pieces (any columns; length at most capacity) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    bound, closed, used = lower_bound(counts, capacity), [full.select(*names, "sequence_id", "offset")], int(counts[capacity])
    open_, n, best, idle = pieces.where(F.col("length") < capacity), int(counts[:capacity].sum()), None, 0
    base = 0
    for number in itertools.count() if n else ():
        parts = max(1, math.ceil(n / task_pieces))
        packed = cut(_round(open_, number, parts, capacity, base), "packed")
        base += parts
        total = packed.where("offset = 0").agg(F.count("*").alias("bins"), F.count(F.when(F.expr(SETTLED), 1)).alias("settled")).first()
        idle = 0 if best is None or total["bins"] < best[0] else idle + 1
        if not idle:
            best = (total["bins"], packed)
        if used + best[0] <= bound or total["bins"] == total["settled"] or parts == 1 or idle == IDLE:
            closed.append(best[1].select(*names, "sequence_id", "offset"))
            break
        if total["settled"]:  # what is certified leaves the exchange
            closed.append(packed.where(SETTLED).select(*names, "sequence_id", "offset"))
            open_ = packed.where(f"NOT ({SETTLED})").select(*names)
            used, n = used + total["settled"], open_.count()
            best = (total["bins"] - total["settled"], packed.where(f"NOT ({SETTLED})"))
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids (pieces made with_ids): sequence_id, ids. A sequence is at most capacity ids."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
