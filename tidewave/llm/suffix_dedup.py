"""Removal of long repeated byte strings by externally sorted, induced suffixes (operator 6).

A byte goes if a string of `length` bytes that covers it also starts anywhere else. The suffixes of all
texts would be sorted for that; here a sample of them is sorted and the rest is induced from it, the
way induced sorting does, with common-prefix values carried along and cut at `length`:

1. Sample. In each window of `length` bytes the k-gram with the smallest hash is its anchor, so equal
   windows have equal anchors at equal places. An anchor with the windows it serves is a suffix tuple:
   hash of the k-gram, digest of its context (all bytes of its windows), document, place.
2. External sort. Spark's sorter, which spills runs to disk and merges them by priority queue, brings tuples in order
   of k-gram and context. Tuples alone with their k-gram end here. Equal contexts mean that all their windows repeat.
3. Induction. Where contexts differ, one suffix per context is fetched from its document and these are sorted, by Spark again, on what
   follows the anchor, with the common prefix of neighbours. The order of the suffixes one byte to the left
   follows from that by a stable sort on that byte, and their common prefixes by range minima, and so on from right to left until the windows end.
   A window repeats if its common prefix with a neighbour is at least `length`.

K-grams that are very frequent (approx_top_k names them) aren't sifted by one task each: their contexts are counted
with partial sums and joined back. K-grams with more than `group` different contexts (by default, a fourth of a task's share) are dealt out by window
digest instead, exactly. All bytes of anything larger than a group stay in Spark's spillable sorts.

Contexts count as equal when both the k-gram's hash and the context's are, 128 bits; among 1e12 contexts (100 TB) two unlike
ones are taken for equal with a probability under 1e-14. Where contexts differ, bytes decide.

Defined cases: null text is the empty text; texts shorter than `length` lose nothing; very long texts are read in overlapping parts;
rows equal in id and text (ties) are documents of their own that repeat each other; null ids are an id like any other; an empty table gives an
empty result; further columns are ignored, whatever their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

GRAM = 32
#: Contexts of one k-gram that a task takes whatever its share is.
GROUP = 2_000
#: K-grams that approx_top_k names at least, and its counters for each of them.
TOP, COUNTERS = 64, 16
BUFFER = 2 << 20  # bytes that a task looks at at a time
PLACE = (1 << 23) - 1
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if n not in _pow:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        _pow.clear()
        _pow[n] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (np.uint64(base), np.uint64(inverse)))
    return _pow[n]


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes."""
    power, inverse = (p[: len(buf) + 1] for p in _powers(BUFFER + (1 << 16)))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * inverse[: len(sums) - k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(buf: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over texts that end at `ends` in buf: for each anchor its first and last window, its place, its hash."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(buf) < length:
        return none
    w = length - k + 1
    h = gram_hashes(buf, k)
    key = (h & ~np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    n = -(-len(key) // w) * w
    grid = np.full(n, ~np.uint64(0))
    grid[: len(key)] = key
    grid = grid.reshape(-1, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(buf) - length + 1
    place = (np.minimum(after[:m], before[w - 1 : w - 1 + m]) & np.uint64(PLACE)).astype(np.int64)
    valid = np.zeros(m + 1, bool)
    begin = 0
    for e in ends.tolist():
        if e - length >= begin:
            valid[begin : e - length + 1] = True
        begin = e
    valid = valid[:m]
    change = valid.copy()
    change[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    lo, hi = np.flatnonzero(change), np.flatnonzero(last)
    return (lo, hi, place[lo], h[place[lo]]) if len(lo) else none


def _tuples(ids: list, hashes: list, texts: list[bytes], length: int, k: int) -> pd.DataFrame:
    """Suffix tuples of some texts; texts longer than BUFFER in overlapping parts."""
    out = {c: [] for c in ("gram", "ctx", "id", "th", "at")}
    group: list[tuple[int, int, bytes]] = []  # row, offset in its text, bytes
    size = 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        data = b"".join(g[2] for g in group)
        ends = np.cumsum([len(g[2]) for g in group])
        lo, hi, at, h = anchors(np.frombuffer(data, np.uint8), ends, length, k)
        which = np.searchsorted(ends, lo, side="right")
        begins = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh3_64_intdigest
        spans = zip(lo.tolist(), (hi + length).tolist(), (at - lo).tolist(), strict=True)
        # `at` may lie after the last window's start
        ctx = np.fromiter((digest(data[a:b], t) for a, b, t in spans), np.uint64, len(lo)).view(np.int64)
        offset = np.array([g[1] for g in group], np.int64)
        out["gram"].append(h.view(np.int64))
        out["ctx"].append(ctx)
        rows = np.array([g[0] for g in group])[which]
        out["id"] += [ids[r] for r in rows.tolist()]
        out["th"] += [hashes[r] for r in rows.tolist()]
        out["at"].append((lo - begins[which] + offset[which]) << 16 | (at - lo) << 8 | (hi - lo))
        group, size = [], 0

    for row, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), BUFFER):
            part = t[a : a + BUFFER + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > BUFFER + length:
                flush()
            group.append((row, a, part))
            size += len(part)
    flush()
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return pd.DataFrame({"gram": cat(out["gram"]), "ctx": cat(out["ctx"]), "id": out["id"], "th": out["th"], "at": cat(out["at"])})


def _spans(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    lo = at >> 16
    return lo, lo + (at & 255) + length


def _sift(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Tuples in order of gram and ctx -> kind 0: spans that repeat; kind 1: one tuple of each context whose k-gram has others (n: 2 if several have it)."""
    held: pd.DataFrame | None = None  # the run of the last context so far: its first two rows

    def sift(rows: pd.DataFrame, open_: bool, before: tuple | None) -> tuple[pd.DataFrame, pd.DataFrame | None, tuple | None]:
        gram, ctx = rows["gram"].to_numpy(), rows["ctx"].to_numpy()
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])])
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        count = np.bincount(run)
        g = gram[start]
        beside = np.zeros(len(start), bool)
        beside[1:] |= g[1:] == g[:-1]
        beside[:-1] |= g[1:] == g[:-1]
        beside[0] |= before is not None and before[0] == g[0]
        done = len(start) - open_
        again = (count[run] > 1) & ~rows["told"].to_numpy()
        sure = rows[again]
        lo, hi = _spans(sure["at"].to_numpy(), length)
        a = pd.DataFrame({"kind": 0, "gram": 0, "ctx": 0, "id": sure["id"].to_numpy(), "th": sure["th"].to_numpy(), "at": lo, "n": hi})
        pick = start[:done][beside[:done]]
        ask = rows.iloc[pick]
        b = pd.DataFrame({"kind": 1, "gram": ask["gram"].to_numpy(), "ctx": ask["ctx"].to_numpy(), "id": ask["id"].to_numpy(), "th": ask["th"].to_numpy(), "at": ask["at"].to_numpy(), "n": np.minimum(count[:done][beside[:done]], 2)})
        rest = None
        if open_:
            rest = rows.iloc[start[-1] : start[-1] + 2].copy()
            rest["told"] = count[-1] > 1
            before = (g[-2],) if len(g) > 1 else before
        return pd.concat([a, b], ignore_index=True), rest, before

    before: tuple | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.assign(told=False)
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        found, held, before = sift(rows, True, before)
        if len(found):
            yield found
    if held is not None:
        yield sift(held, False, before)[0]


def induce(group: np.ndarray, right: list[bytes], left: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that repeat within a group, as (row, bytes before the anchor).

    Rows are in order of group, then right (from the anchor on); left is what stands before, nearest byte last.
    """
    n = len(group)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([min(len(r), length) for r in right])
    text = np.zeros((n, length), np.uint8)
    for i, r in enumerate(right):
        text[i, : size[i]] = np.frombuffer(r, np.uint8, size[i])
    unlike = text[1:] != text[:-1]
    common = np.where(unlike.any(1), unlike.argmax(1), length)
    lcp = np.concatenate([[0], np.where(group[1:] == group[:-1], np.minimum(common, np.minimum(size[1:], size[:-1])), 0)])
    depth = np.array([len(x) for x in left])
    back = np.zeros((n, max(1, depth.max())), np.uint8)
    for i, x in enumerate(left):
        back[i, : len(x)] = np.frombuffer(x, np.uint8)[::-1]
    rows, group = np.arange(n), group.copy()
    out_rows, out_t = [], []
    for t in range(int(depth.max()) + 1):
        if t:
            # those without a byte there, or without anything in common with a neighbour, can't match any more
            after = np.append(lcp[1:], 0)
            live = (depth[rows] >= t) & ((lcp > 0) | (after > 0))
            if live.sum() < 2:
                break
            old = np.flatnonzero(live)
            byte = back[rows[old], t - 1].astype(np.int64)
            order = np.argsort((group[old] << 8) | byte, kind="stable")
            at, byte, g = old[order], byte[order], group[old][order]
            low = np.zeros(len(at), np.int64)
            pair = np.flatnonzero((g[1:] == g[:-1]) & (byte[1:] == byte[:-1])) + 1
            if len(pair):
                ends = np.stack([at[pair - 1] + 1, at[pair] + 1], 1).ravel()
                low[pair] = np.minimum.reduceat(np.append(lcp, 0), ends)[::2]
                low[pair] = np.where(low[pair] > 0, low[pair] + 1, 0)
            rows, group, lcp = rows[at], g, low
        near = np.maximum(lcp, np.append(lcp[1:], 0))
        hit = near >= length
        out_rows.append(rows[hit])
        out_t.append(np.full(int(hit.sum()), t))
    return np.concatenate(out_rows), np.concatenate(out_t)


def _induced(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    rest: pd.DataFrame | None = None

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pd.factorize(pdf["gram"])[0].astype(np.int64)
        row, t = induce(group, pdf["right"].tolist(), pdf["left"].tolist(), length)
        at = pdf["at"].to_numpy()
        start = (at >> 16)[row] + ((at >> 8) & 255)[row] - t
        alone = pdf["n"].to_numpy()[row] < 2  # the others' windows are known to repeat
        row, start = row[alone], start[alone]
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        if not len(row):
            return pd.DataFrame({"id": pdf["id"].iloc[:0], "th": pdf["th"].iloc[:0], "s": [], "e": []}).astype({"s": "int64", "e": "int64"})
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        own = pdf.iloc[row[first]]
        return pd.DataFrame({"id": own["id"].to_numpy(), "th": own["th"].to_numpy(), "s": start[first], "e": start[last] + length})

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        g = pdf["gram"].to_numpy()
        begin = int(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))[-1])
        rest, pdf = pdf.iloc[begin:], pdf.iloc[:begin]
        if len(pdf):
            yield spans(pdf)
    if rest is not None and len(rest):
        yield spans(rest)


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = GRAM, group: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), s, e: spans of bytes to remove, which may overlap."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    if not gram <= length // 2 or length - gram > 255:
        raise ValueError("gram must be at most half of length, and length - gram at most 255")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("b"))
    id_type = base.schema["id"].dataType.simpleString()

    def fixed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf if id_type == "string" or pdf["id"].dtype.kind in "iu" else pdf.assign(id=pd.array([None if pd.isna(x) else int(x) for x in pdf["id"]], dtype="Int64"))

    def tuples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fixed(_tuples(pdf["id"].tolist(), pdf["th"].tolist(), [bytes(b) for b in pdf["b"]], length, gram))

    suffixes = base.where(F.length("b") >= length).mapInPandas(tuples, f"gram long, ctx long, id {id_type}, th long, at long")
    suffixes = cut(suffixes, "suffixes")
    hot = _hot_grams(suffixes, n)
    ordered = suffixes.where(~F.col("gram").isin(hot)).repartition(n, "gram").sortWithinPartitions("gram", "ctx", "id", "th", "at")
    sifted = cut(ordered.mapInPandas(lambda x: map(fixed, _sift(x, length)), f"kind int, gram long, ctx long, id {id_type}, th long, at long, n long"), "suffix-tuples")
    sure = sifted.where("kind = 0").select("id", "th", F.col("at").alias("s"), F.col("n").alias("e"))
    asking = sifted.where("kind = 1").select("gram", "id", "th", "at", "n")
    if hot:
        hot_sure, hot_asking = _sift_hot(suffixes.where(F.col("gram").isin(hot)), length)
        sure, asking = sure.unionByName(hot_sure), asking.unionByName(hot_asking)
    asked = asking.groupBy(F.col("id").alias("a_id"), F.col("th").alias("a_th")).agg(F.collect_list(F.struct("gram", "at", "n")).alias("asked"))

    # the bytes of a tuple's windows: from its first window's start to its last one's end
    have = base.join(asked, base["id"].eqNullSafe(asked["a_id"]) & (base["th"] == asked["a_th"])).dropDuplicates(["id", "th"])
    contexts = have.select("id", "th", "b", F.explode("asked").alias("x")).select("id", "th", "x.gram", "x.at", "x.n", F.expr("shiftright(x.at, 16)").alias("lo"), F.expr("shiftright(x.at, 8) & 255L").alias("t"), F.expr("x.at & 255L").alias("m"), "b")
    cutting = contexts.select("gram", "id", "th", "at", "n", F.expr("substring(b, cast(lo + t + 1 as int), cast(m - t as int) + %d)" % length).alias("right"), F.expr("substring(b, cast(lo + 1 as int), cast(t as int))").alias("left"))
    cutting = cut(cutting, "suffix-contexts")
    group = max(GROUP, cutting.count() // (4 * n)) if group is None else group
    large = cut(cutting.groupBy("gram").count().where(F.col("count") > group).select("gram"), "large-grams")
    few, spans = cutting, []
    if not large.isEmpty():
        few = cutting.join(large, "gram", "left_anti")
        spans.append(_by_windows(cutting.join(large, "gram", "left_semi"), length))
    sorted_ = few.repartition(n, "gram").sortWithinPartitions("gram", "right", "left", "id", "th", "at")
    spans.append(sorted_.mapInPandas(lambda x: map(fixed, _induced(x, length)), f"id {id_type}, th long, s long, e long"))
    out = sure
    for s in spans:
        out = out.unionByName(s)
    return cut(out, "spans")


def _hot_grams(suffixes: DataFrame, n: int) -> list[int]:
    """K-grams so frequent that one would be more than a fourth of a task's share, so at most 4 a task; how tuples are dealt depends on it, not the result."""
    top = min(50_000, max(TOP, 4 * n))
    r = suffixes.agg(F.expr(f"approx_top_k(gram, {top}, {min(1_000_000, max(4096, COUNTERS * top))})").alias("t"), F.count("*").alias("n")).first()
    return [x["item"] for x in (r["t"] or []) if x["count"] > r["n"] / (4 * n)]


def _sift_hot(suffixes: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """What _sift does, for tuples of hot k-grams: contexts are counted before any shuffle, and the tuples meet those that repeat in a join that AQE splits."""
    first = F.min(F.struct("id", "th", "at"))
    contexts = cut(suffixes.groupBy("gram", "ctx").agg(F.count("*").alias("n"), first.alias("first")), "hot-contexts")
    again = contexts.where("n > 1").select("gram", "ctx")
    lo = F.expr("shiftright(at, 16)")
    sure = suffixes.join(again, ["gram", "ctx"], "left_semi").select("id", "th", lo.alias("s"), (lo + F.expr("at & 255L") + length).alias("e"))
    several = contexts.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")  # at most 4 n rows
    asking = contexts.join(F.broadcast(several), "gram").select("gram", "first.id", "first.th", "first.at", F.least("n", F.lit(2)).cast("long").alias("n"))
    return sure, asking


def _by_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same answer for contexts of very large groups: each window's digest is counted."""
    whole = contexts.select("id", "th", "n", F.expr("shiftright(at, 16)").alias("lo"), F.expr("at & 255L").alias("m"), F.concat("left", "right").alias("b"))
    windows = whole.select("id", "th", "n", "lo", F.explode(F.expr("transform(sequence(0, cast(m as int)), j -> struct(j, unhex(sha2(substring(b, j + 1, %d), 256)) AS d))" % length)).alias("w"))
    windows = windows.select("id", "th", "n", (F.col("lo") + F.col("w.j")).alias("s"), F.col("w.d").alias("d"))
    counted = windows.groupBy("d").agg(F.sum("n").alias("k")).where("k > 1").select("d")
    return windows.where("n < 2").join(counted, "d").select("id", "th", "s", (F.col("s") + length).alias("e"))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, group: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids with kept (the remaining bytes), n_bytes, n_removed and spans (maximal removed runs: s, e)."""
    spans = repeated_spans(docs, length, gram, group, id_col, text_col)
    each = spans.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("found"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), F.xxhash64(text).alias("th"), text.cast("binary").alias("b"))
    out = base.join(each, base[id_col].eqNullSafe(each["_id"]) & (base["th"] == each["_th"]), "left")

    @F.pandas_udf("kept binary, n_removed long, spans array<struct<s:long,e:long>>, kept_sha256 string")
    def removed(b: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for x, fs in zip(b, found, strict=True):
            runs: list[list[int]] = []
            for f in () if fs is None else fs:
                if runs and f["s"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], f["e"])
                else:
                    runs.append([f["s"], f["e"]])
            parts, at = [], 0
            for s, e in runs:
                parts.append(x[at:s])
                at = e
            kept = b"".join([*parts, x[at:]])
            rows.append((kept, sum(e - s for s, e in runs), [{"s": int(s), "e": int(e)} for s, e in runs], hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["kept", "n_removed", "spans", "kept_sha256"])

    out = out.select(id_col, F.length("b").cast("long").alias("n_bytes"), removed("b", "found").alias("r"))
    return out.select(id_col, "n_bytes", "r.*")
