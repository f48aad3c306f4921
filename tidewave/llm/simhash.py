"""SimHash near-duplicates over a hierarchical index in Gray order (operator 10).

Each document becomes a 64-bit fingerprint; equal fingerprints are grouped at once, so copies cost one
row. Fingerprints that differ in at most k bits agree on at least two of k + 2 bit blocks, so each pair
of blocks is a mask, and a bucket is a mask with the bits found under it. Rows are shuffled by bucket and
sorted, by Spark, in Gray rank; in a task each bucket becomes a tree: upper nodes hold the bits that all
below share (a mask and a value), and their agreement grows towards the leaves. Node pairs are compared
from the roots down on the bits both share; differences only add up on the way, so a pair of groups above k
is dropped whole, and so are groups that are known to hang together already. What comes out are links
that join all that the bucket holds together, fewer than its rows. The bits that a bucket of more than block rows doesn't share
are cut in blocks again, and it is dealt by masks of those, and so on, so no pair within k bits is lost and none is made by the square. The links then make components with the large-star, small-star
rounds, on tables in the shared folder.

Defined cases: null or wordless text has fingerprint zero and links like any other; a text with fewer
words than a shingle has one shingle; a null id never names a component that has others; repeated rows
appear as often as in the input; very long texts are hashed whole, a fixed number of shingles at a time; an empty table gives an empty result; further
columns are ignored but for those named in keep, which pass through and may have any name but fp and component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions

FANOUT = 8
#: Rows of one bucket that a task holds in memory.
BLOCK = 20_000
SLICE = 200_000  # node pairs expanded at a time
WINDOW = 100_000  # shingles hashed at a time
#: MinHash bands: sets of similarity j share one with probability 1 - (1 - j ** ROWS) ** BANDS, 0.9998 at 0.8.
BANDS, ROWS = 16, 4
#: In each band's order of sketches, a text is compared with so many that follow it.
AHEAD = 3
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased. Methods of bytes know ASCII only: split's white space is \\x20 and \\x09-\\x0D."""
    return text.encode().lower().split() if text else []


def _sketch(text: str, shingle: int, seed: int, bands: int) -> tuple[int, np.ndarray, bytes]:
    """The fingerprint, the keys of so many MinHash bands, and a byte of each of their minima."""
    from xxhash import xxh64_intdigest as h

    words = words_of(text)
    if not words:
        return 0, np.zeros(bands, np.int64), bytes(bands * ROWS)
    n = max(1, len(words) - shingle + 1)
    votes, least = np.zeros(64, np.int64), np.full(bands * ROWS, ~np.uint64(0))
    for a in range(0, n, WINDOW):
        part = words[a : a + WINDOW + shingle - 1]
        if len(part) >= shingle:
            runs = map(b" ".join, zip(*(part[j:] for j in range(shingle)), strict=False))
        else:
            runs = [b" ".join(part)]
        hashes = np.fromiter(map(h, runs, repeat(seed)), np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        if bands:
            once = np.unique(hashes)
            for b in range(0, len(once), 1000):
                np.minimum(least, (once[b : b + 1000, None] * FACTORS[: bands * ROWS]).min(0), out=least)
    key = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, ROWS).T:
        key = (key ^ column) * FACTORS[0]
        key ^= key >> np.uint64(32)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0]), key.view(np.int64), least.astype(np.uint8).tobytes()


def fingerprint(text: str, shingle: int, seed: int = 42) -> int:
    """64 bits; bit i is set if more than half of the shingles' hashes have it. As a signed integer."""
    return _sketch(text, shingle, seed, 0)[0]


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, fp (signed 64 bits) and the columns named in keep."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return docs.select(id_col, *keep, fp(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))


def masks(max_differing: int, agree: int = 2, within: int = (1 << 64) - 1) -> list[int]:
    """Masks of which any two fingerprints at most so far apart agree on one: all choices of `agree` among max_differing + agree blocks of the bits within."""
    free = [b for b in range(64) if within >> b & 1]
    n = min(max_differing + agree, len(free))
    edges = [len(free) * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, n - max_differing)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(c: Column) -> Column:
    """The place of a code word in Gray order, as a signed number that sorts like the unsigned one."""
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c.bitwiseXOR(F.lit(-(1 << 63)))


class _Union:
    """Labels of connected rows: the smallest row reached."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join rows a[i], b[i]; the pairs that joined two groups."""
        label, made = self.label, []
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            low, high = np.minimum(x, y), np.maximum(x, y)
            root, first = np.unique(high, return_index=True)  # each root moves under one smaller root
            label[root] = low[first]
            made += zip(a[first].tolist(), b[first].tolist(), strict=True)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
        return made


def bucket_links(bucket: np.ndarray, fp: np.ndarray, max_differing: int, steps: tuple[int, ...] = ()) -> list[tuple[int, int]]:
    """Links (row, row) that connect, within each bucket, all that pairs at most max_differing bits apart connect.

    With steps, smaller distances come first, so links are no longer (by a step) than they need be.

    bucket: ascending numbers; fp: uint64, in Gray order within each bucket.
    """
    n = len(fp)
    levels = [(np.arange(n + 1), np.full(n, ~np.uint64(0)), fp.copy(), bucket)]  # first child, shared mask, shared bits, bucket
    while len(levels[-1][3]) > len(np.unique(levels[-1][3])):
        _, mask, value, own = levels[-1]
        m = len(own)
        new = np.concatenate([[True], own[1:] != own[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        at = np.flatnonzero((np.arange(m) - begin) % FANOUT == 0)
        group = np.cumsum(np.isin(np.arange(m), at)) - 1
        unlike = np.bitwise_or.reduceat(value ^ value[at][group], at)
        shared = np.bitwise_and.reduceat(mask, at) & ~unlike
        levels.append((np.append(at, m), shared, value[at] & shared, own[at]))
    union, out = _Union(n), []

    def whole() -> list[np.ndarray]:
        """Per level and node: the label all rows below share, or -1."""
        low = high = union.label
        got = [low]
        for at, *_ in levels[1:]:
            low, high = np.minimum.reduceat(low, at[:-1]), np.maximum.reduceat(high, at[:-1])
            got.append(np.where(low == high, low, -1))
        return got

    top = len(levels) - 1
    roots = np.arange(len(levels[top][3]))
    same, dirty = whole(), False
    stack = [(far, top, roots, roots) for far in sorted({*steps, max_differing}, reverse=True)]
    while stack:
        far, level, a, b = stack.pop()
        if len(a) > SLICE // FANOUT**2:
            half = len(a) // 2
            stack += [(far, level, a[half:], b[half:]), (far, level, a[:half], b[:half])]
            continue
        if dirty:
            same, dirty = whole(), False
        known = (same[level][a] == same[level][b]) & (same[level][a] >= 0)
        a, b = a[~known], b[~known]
        if not len(a):
            continue
        if level == 0:
            made = union.join(a, b)
            out += made
            dirty = dirty or bool(made)
            continue
        at = levels[level][0]
        k = np.arange(FANOUT)
        ca, cb = at[a][:, None] + k, at[b][:, None] + k
        ok = (ca < at[a + 1][:, None])[:, :, None] & (cb < at[b + 1][:, None])[:, None, :]
        ok &= (ca[:, :, None] < cb[:, None, :]) if level == 1 else (ca[:, :, None] <= cb[:, None, :])
        i, x, y = np.nonzero(ok)
        ca, cb = ca[i, x], cb[i, y]
        _, mask, value, _ = levels[level - 1]
        near = np.bitwise_count((value[ca] ^ value[cb]) & mask[ca] & mask[cb]) <= far
        ca, cb = ca[near], cb[near]
        if len(ca):
            twin = ca == cb  # groups with themselves go first: what they join needs no comparison later
            stack.append((far, level - 1, ca[~twin], cb[~twin]))
            stack.append((far, level - 1, ca[twin], cb[twin]))
    return out


def near_links(fps: DataFrame, max_differing: int = 4, block: int = BLOCK, steps: tuple[int, ...] = (), agree: int | None = None) -> DataFrame:
    """fps: distinct fp. Links a, b between fingerprints that connect all pairs at most max_differing bits apart.

    agree: blocks in a mask, 2 or as many more as keep an average bucket under a tenth of a block. It sets the work's layout only.
    """
    spark = fps.sparkSession
    if agree is None:
        n, agree = fps.count(), 2
        while n >> (64 * agree // (max_differing + agree)) > block // 10:
            agree += 1
    each = F.array(*[F.lit(_signed(m)) for m in masks(max_differing, agree)])
    rows, buckets = fps.select("fp", F.posexplode(each).alias("m", "mask")).select("fp", F.col("m").cast("long").alias("m"), "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")), []
    while True:
        large = cut(rows.groupBy("m", "mask", "key").count().where(F.col("count") > block).select("m", "mask", "key"), "large-buckets")
        finer = []
        for r in large.select("mask").distinct().collect():  # at most as many as there are masks
            free = ~r["mask"] & ((1 << 64) - 1)
            if free.bit_count() > max_differing:  # else all in the bucket are near each other, and no more than 2 ** max_differing
                finer += [(r["mask"], k, _signed(r["mask"] & ((1 << 64) - 1) | x)) for k, x in enumerate(masks(max_differing, 2, free))]
        if not finer:
            buckets.append(rows.select("m", "key", "fp"))
            break
        finer = F.broadcast(spark.createDataFrame(finer, "mask long, k long, finer long"))
        large = large.join(finer.select("mask").distinct(), "mask", "left_semi")
        buckets.append(rows.join(large, ["m", "mask", "key"], "left_anti").select("m", "key", "fp"))
        inner = rows.join(large, ["m", "mask", "key"], "left_semi").join(finer, "mask")
        rows = cut(inner.select("fp", F.xxhash64("m", "key", "k").alias("m"), F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")), "finer-buckets")
    rows = reduce(DataFrame.unionByName, buckets)
    names = ["m", "key"]
    dealt = rows.repartition(partitions(spark), *names).sortWithinPartitions(*names, gray_rank(F.col("fp")))

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def found(pdf: pd.DataFrame) -> pd.DataFrame:
            k = pdf[names].to_numpy()
            new = np.concatenate([[True], (k[1:] != k[:-1]).any(1)])
            bucket = np.cumsum(new) - 1
            count = np.bincount(bucket)
            some = count[bucket] > 1
            fp = pdf["fp"].to_numpy()[some]
            pairs = bucket_links(bucket[some], fp.view(np.uint64), max_differing, steps) if len(fp) else []
            a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
            return pd.DataFrame({"a": fp[a], "b": fp[b]})

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            k = pdf[names].to_numpy()
            begin = int(np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)]))[-1])
            rest, pdf = pdf.iloc[begin:], pdf.iloc[:begin]
            if len(pdf):
                yield found(pdf)
        if rest is not None and len(rest):
            yield found(rest)

    return dealt.mapInPandas(links, "a long, b long")


def components(spark: SparkSession, links: DataFrame, rounds: int = 50) -> DataFrame:
    """links a, b -> node, root: the smallest node of its component; nodes with links only."""
    pairs = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def star(p: DataFrame, large: bool) -> DataFrame:
        """Link each node's neighbours (the larger ones, or the smaller ones and itself) to the smallest node around it."""
        both = p.unionByName(p.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else p
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        at = both.join(low, "u")
        if large:
            return at.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return at.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()

    def sign(p: DataFrame) -> tuple:
        return tuple(p.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = sign(pairs)
    for _ in range(rounds):
        if not before[0]:
            break
        pairs = cut(star(star(pairs, True), False), "stars")
        after = sign(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not done after {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_differing: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """One row per document: id_col, keep, fp and component_id, the smallest id that links reach."""
    spark = docs.sparkSession
    marked = cut(fingerprints(docs, shingle, seed, id_col, text_col, keep), "fingerprints")
    groups = marked.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = cut(components(spark, cut(near_links(groups.select("fp"), max_differing, block), "near-links")).select(F.col("node").alias("fp"), "root"), "roots")
    named = groups.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(lows, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(id_col, *keep, "fp", "component_id")


def shingles(text: str | None, k: int) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def sketches(docs: DataFrame, shingle: int, seed: int, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns named in keep, fp, bands (a key each) and least, a byte of each minimum."""

    @F.pandas_udf("fp long, bands array<long>, least binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_sketch(t, shingle, seed, BANDS) for t in texts], columns=["fp", "bands", "least"])

    return docs.select(id_col, *keep, sketch(F.coalesce(F.col(text_col), F.lit(""))).alias("s")).select(id_col, *keep, "s.*")


def _followers(members: DataFrame, similarity: float, ahead: int) -> DataFrame:
    """members (node, th, bands, least, group) -> pairs a, a_th, b, b_th of different groups, at most BANDS * ahead a member.

    For each band, members are sorted by its key and then by the keys of the bands after it, so those that agree on more
    bands stand closer; each meets the next ones of its key, if their minima agree about as often as similar texts' do.
    """
    least_equal = (similarity - 0.2) * BANDS * ROWS  # four deviations below what is expected
    turned = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.concat(F.slice("bands", b + 1, F.lit(BANDS)), F.slice("bands", F.lit(1), b)).alias("keys")))
    each = members.select("node", "th", "least", "group", F.explode(turned).alias("x")).select("x.band", F.slice("x.keys", 1, 6).alias("keys"), "node", "th", "least", "group")
    ordered = each.repartitionByRange(partitions(members.sparkSession), "band", "keys", "node", "th").sortWithinPartitions("band", "keys", "node", "th")
    kind = members.schema["node"].dataType.simpleString()

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf.assign(key=[k[0] for k in pdf["keys"]]).drop(columns="keys")
            new = 0 if rest is None else len(rest)
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            minima = np.frombuffer(b"".join(pdf["least"]), np.uint8).reshape(len(pdf), -1)
            band, key, group = (pdf[c].to_numpy() for c in ("band", "key", "group"))
            for step in range(1, ahead + 1):
                i = np.arange(max(0, new - step), len(pdf) - step)
                i = i[(band[i] == band[i + step]) & (key[i] == key[i + step]) & (group[i] != group[i + step])]
                i = i[(minima[i] == minima[i + step]).sum(1) >= least_equal]
                a, b = pdf.iloc[i], pdf.iloc[i + step]
                yield pd.DataFrame({"a": a["node"].to_numpy(), "a_th": a["th"].to_numpy(), "b": b["node"].to_numpy(), "b_th": b["th"].to_numpy()})
            rest = pdf.iloc[-ahead:]

    return ordered.mapInPandas(follow, f"a {kind}, a_th long, b {kind}, b_th long").distinct()


def _met_pairs(members: DataFrame, similarity: float, block: int = 256) -> DataFrame:
    """members (node, th, bands, group, hashes) -> pairs a, a_th, b, b_th of different groups, one for any two groups that met in a task and are similar.

    All members of a band's key meet each other, in blocks dealt over tasks: memory is bounded by two blocks, work is
    quadratic in what the earlier steps left apart. Two members are judged in the first band they share.
    """
    each = members.select("node", "th", "group", "bands", F.posexplode("bands").alias("band", "key"))
    keys = each.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("band", "key", F.ceil(F.col("n") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("node", "th"), F.col("blocks"))
    dealt = each.join(keys, ["band", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).select("band", "key", "p", "q", "own", "node", "th")
    dealt = dealt.join(members.select("node", "th", "group", "bands", "hashes"), ["node", "th"])
    kind = members.schema["node"].dataType.simpleString()

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, group, node, th = (pdf[c].to_numpy() for c in ("own", "group", "node", "th"))
        left, right = np.flatnonzero(own == key[2]), np.flatnonzero(own == key[3])
        bands = np.stack(pdf["bands"].to_numpy())
        sets = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
        size = np.array([len(x) for x in sets])
        _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        text = np.repeat(np.arange(len(sets)), size)[count[word] > 1]  # a shingle of one text is shared with none
        word = np.unique(word[count[word] > 1], return_inverse=True)[1]
        order = np.argsort(word, kind="stable")
        word, text = word[order], text[order]
        shared = np.zeros((len(left), len(right)), np.float64)
        for a in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
            i, j = np.searchsorted(word, (a, a + 4096))
            has = np.zeros((len(sets), 4096), np.float32)
            has[text[i:j], word[i:j] - a] = 1
            shared += has[left] @ has[right].T
        either = size[left][:, None] + size[right] - shared
        ok = (shared >= (similarity - 1e-9) * either) & (group[left][:, None] != group[right])
        x, y = np.nonzero(ok)
        x, y = left[x], right[y]
        first = (bands[x] == bands[y]).argmax(1) == key[0] if len(x) else np.zeros(0, bool)
        x, y = x[first], y[first]
        found = pd.DataFrame({"a": node[x], "a_th": th[x], "b": node[y], "b_th": th[y], "l": np.minimum(group[x], group[y]), "h": np.maximum(group[x], group[y])})
        return found.drop_duplicates(["l", "h"])[["a", "a_th", "b", "b_th"]]

    return dealt.groupBy("band", "key", "p", "q").applyInPandas(meet, f"a {kind}, a_th long, b {kind}, b_th long").distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_differing: int = 10, steps: tuple[int, ...] = (2, 4, 6, 8), seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Groups by similarity of shingle sets (Jaccard), with fingerprints and MinHash bands as the indexes: id_col, component_id.

    Equal texts are one node. Nodes of one fingerprint are linked to its smallest; fingerprints at most max_differing bits apart
    by the shortest links that connect them; nodes that share a band to the smallest that has it. Bands see sets, so they also
    find pairs whose fingerprints lie far apart. Each link's similarity is then computed from whole texts, and those below the
    threshold are cut. Nodes whose bands still hold several groups are then sorted band by band, and each is tested with those
    that follow it in that order (_followers), which joins most of a large family with few pairs. What still lies in several groups of
    a band is compared with all the others there (_met_pairs), so every similar pair that shares a band ends in one group. Rows of one id are one document.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    marked = cut(sketches(plain, shingle, seed, "id", "t", ("th",)), "fingerprints")
    nodes = cut(marked.groupBy("fp", "th").agg(F.min("id").alias("node"), F.first("bands").alias("bands"), F.first("least").alias("least")), "nodes")
    lows = nodes.groupBy("fp").agg(F.min(F.struct("node", "th")).alias("low"))
    low_end = [F.col("low.node").alias("b"), F.col("low.th").alias("b_th")]
    own_end = [F.col("node").alias("a"), F.col("th").alias("a_th")]
    within = nodes.select("fp", "node", "th").join(lows, "fp").where(F.col("node") != F.col("low.node")).select(*own_end, *low_end)
    links = cut(near_links(lows.select("fp"), max_differing, block, steps), "near-links").distinct()
    end = lambda x: lows.select(F.col("fp").alias(x), F.col("low.node").alias(f"n_{x}"), F.col("low.th").alias(f"th_{x}"))
    between = links.join(end("a"), "a").join(end("b"), "b").select(F.col("n_a").alias("a"), F.col("th_a").alias("a_th"), F.col("n_b").alias("b"), F.col("th_b").alias("b_th"))
    banded = nodes.select("node", "th", F.posexplode("bands").alias("band", "key"))
    heads = banded.groupBy("band", "key").agg(F.min(F.struct("node", "th")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = banded.join(heads, ["band", "key"]).where(F.col("node") != F.col("low.node")).select(*own_end, *low_end)

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = shingles(x, shingle), shingles(y, shingle)
            out.append(len(p & q) / len(p | q) if p or q else 1.0)
        return pd.Series(out, dtype="float64")

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs, the larger end first, that are similar. Only texts of their ends are moved."""
        x, y = F.struct(F.col("a").alias("n"), F.col("a_th").alias("th")), F.struct(F.col("b").alias("n"), F.col("b_th").alias("th"))
        new = cut(pairs.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y")).select(F.col("x.n").alias("a"), F.col("x.th").alias("a_th"), F.col("y.n").alias("b"), F.col("y.th").alias("b_th")).distinct(), "pairs")
        ends = new.select(F.col("a").alias("id"), F.col("a_th").alias("th")).unionByName(new.select(F.col("b").alias("id"), F.col("b_th").alias("th"))).distinct()
        texts = cut(plain.join(ends, ["id", "th"], "left_semi").select("id", "th", "t").dropDuplicates(["id", "th"]), "pair-texts")
        side = lambda x: texts.select(F.col("id").alias(x), F.col("th").alias(f"{x}_th"), F.col("t").alias(f"{x}_t"))
        judged = new.join(side("a"), ["a", "a_th"]).join(side("b"), ["b", "b_th"]).withColumn("j", jaccard("a_t", "b_t"))
        return cut(judged.where(F.col("j") >= similarity).select("a", "b"), "similar")

    good = similar(within.unionByName(between).unionByName(shared))
    roots = cut(components(spark, good), "roots")
    named = nodes.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    mixed = named.select("node", "th", "group", F.posexplode("bands").alias("band", "key")).groupBy("band", "key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("band", "key")
    open_ = banded.join(mixed, ["band", "key"], "left_semi").select("node", "th").distinct()
    members = cut(named.join(open_, ["node", "th"], "left_semi").select("node", "th", "bands", "least", "group"), "open-members")
    more = similar(_followers(members, similarity, AHEAD))
    good = cut(good.unionByName(more), "similar")
    roots = cut(components(spark, good), "roots")
    left = members.drop("group", "least").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([b"".join(sorted(blake2b(x, digest_size=8).digest() for x in shingles(t, shingle))) for t in texts])

    kept = left.join(plain.select(F.col("id").alias("node"), "th", "t").dropDuplicates(["node", "th"]), ["node", "th"]).withColumn("hashes", hashes("t")).drop("t")
    rest = similar(_met_pairs(cut(kept, "open-members"), similarity))
    roots = cut(components(spark, good.unionByName(rest)), "roots")
    named = nodes.join(roots, "node", "left").select("fp", "th", F.coalesce("root", "node").alias("component_id"))
    return marked.select("id", "fp", "th").join(named, ["fp", "th"]).select(F.col("id").alias(id_col), "component_id")
