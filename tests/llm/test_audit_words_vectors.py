"""Operators 11, 12 and 13 against brute force on small fixtures."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.llm import ann, filter_audit, spelling

# spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(seed, letters="abÀ", n=220, least=6, most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("pairs", [1 << 14, 40, 1])
def test_near_pairs_whatever_is_cut_again(spark, pairs):
    words = [*some_words(1), *("commonstem" + w for w in some_words(2, n=60, least=1, most=3)), *(w + "ending" for w in some_words(3, n=40, least=1, most=3))]
    due = {tuple(sorted((a, b), key=lambda w: (-len(w), w))) for a, b in combinations(sorted(set(words)), 2) if one_edit(a, b)}
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in set(words)], "word string"), pairs).collect()
    assert len(got) == len(due) and {(r["a"], r["b"]) for r in got} == due


def variants_by_hand(n, times):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("pairs", [1 << 14, 2])
def test_forms_and_roots(spark, pairs):
    rng = random.Random(4)
    n = {w: rng.choice([5, 6, 25, 30, 125, 700, 4000]) for w in some_words(5, "ab", 160, 6, 8)}
    n |= {"abcdefg": 3125, "abcdef": 625, "bcdefg": 625, "bcdef": 125, "acdef": 5, "abcdefgh": 15625, "abcdefghi": 78125}  # a long chain, and ties
    rows = [(w, k) for w, k in n.items()]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long"), 5, pairs).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == variants_by_hand(n, 5) and len(got) == len(n)


TEXTS = [
    (1, "Gardens gardens GARDENS garden-s gardensé ÉGARDENS étagère", "x"), (2, None, "x"), (3, "", "x"), (4, "short words only", "x"), (None, "gardens gardens", "x"),
    (5, "gardens" * 20_000, "x"), (6, "étagère Étagère " * 9, "x"), (6, "étagère Étagère " * 9, "x"), *((i, "The spelling of gardens variants " * 7, "y") for i in range(100, 160)),
]


def test_vocabulary(spark):
    count = Counter()
    for i, text, _ in TEXTS:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 6
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, word string").repartition(3)  # with a column that is named like an output
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs, spoil=7).collect()}
    assert got == {w: n for w, n in count.items() if n >= 5}
    assert {"gardens", "étagère", "Étagère"} < got.keys() and len(got) > 6


def test_words_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(docs, spoil=199)).collect() == []


# nearest neighbours


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, list string")


def nearest_by_hand(rows, asked, k):
    out = {}
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    for i in asked:
        s = ann.exact_scores(np.broadcast_to(x[ids == i][0], x.shape), x)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def unit(rng, n, d=12):
    x = rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(1)
    x = unit(rng, 1500)
    x[700:900] = x[600] + rng.normal(size=(200, 12)) * 0.01  # near copies
    x[900:1300] = x[40]  # a third are one vector, which is a query too
    x[1300:] *= rng.uniform(0.2, 3, (200, 1)).astype(np.float32)  # of other lengths
    rows = [(i, [float(v) for v in x[i]], "z") for i in range(len(x))]
    due = nearest_by_hand(rows, range(0, 1500, 20), 20)
    for parts, segment, block in ((3, 8192, 4096), (7, 50, 5)):
        got = found(ann.nearest(vectors(spark, rows).repartition(parts), F.col("vec_id") % 20 == 0, per_list=64, segment=segment, block=block))
        assert got.keys() == due.keys() and all(len(v) == 20 for v in got.values())
        recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in due[q]}) / 20 for q in due])
        assert recall >= 0.95
        assert all(dict(due[q]).get(i, s) == s for q in due for i, s in got[q])  # the scores are the measure itself
        assert got[40] == due[40] and got[900] == due[900] and got[1280] == due[1280]  # of equal vectors those with the smallest ids
        assert {900, 901, 902} < {i for i, _ in got[40]} and 40 in dict(got[1280]) and all(v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())


def test_given_tables_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    due = nearest_by_hand(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = found(ann.nearest(e, F.col("vec_id") % 20 == 0, per_list=32))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in due[q]}) / 20 for q in due]) >= 0.9 and got.keys() == due.keys()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_that_take_no_part(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], ""), (1, [0.5, 0.5], ""), (2, None, ""), (3, [], ""), (4, [0.0, 0.0], ""), (5, [nan, 1.0], ""), (20, [inf, 1.0], ""), (40, [None, 1.0], ""), (60, [1.0, 2.0, 3.0], ""), (None, [1.0, 1.0], ""), (80, [-1.0, 0.0], ""), (80, [-1.0, 0.0], ""), (100, [0.25, 0.0], ""), (100, [2.0, 0.0], ""), (7, [0.5, 0.5], "")]
    got = found(ann.nearest(vectors(spark, rows, kind), F.col("vec_id") % 20 == 0))
    assert got[0] == [(1, 0.5), (7, 0.5), (100, 0.25), (80, -1.0)]  # all candidates there are; of the rows of one id the smallest vector
    assert got.keys() == {0, 80, 100} and got[80] == [(100, -0.25), (1, -0.5), (7, -0.5), (0, -1.0)]
    assert ann.nearest(vectors(spark, [], kind), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(vectors(spark, [(20, [1.0], "")], kind), F.col("vec_id") % 20 == 0).collect() == []


def test_walks_widen_until_the_ratio_holds():
    rng = np.random.default_rng(3)
    x = unit(rng, 4000, 16).astype(float)
    index = ann.Index(x, 256, 1.0)
    assert np.bincount(np.argmin(((x[:, None] - index.centroids[None, :, :-1]) ** 2).sum(2), 1), minlength=256).max() < 100
    q = unit(rng, 60, 16).astype(float)
    d = np.sqrt(((np.column_stack([q, np.zeros(60)])[:, None] - index.centroids) ** 2).sum(2))
    rows, lists = index.searched(q, np.full(256, 100), 1, 1.4)
    got = np.zeros(d.shape, bool)
    got[rows, lists] = True
    due = d <= 1.4 * d.min(1, keepdims=True)
    assert due.sum(1).max() > 64 and (got & due).sum() / due.sum() > 0.99 and len(rows) == got.sum()
    rows, lists = index.searched(q, np.ones(256, int), 10_000, 1.0)  # too few vectors: all lists
    assert len(rows) == 60 * 256 and len(set(zip(rows.tolist(), lists.tolist(), strict=True))) == 60 * 256


# filter audit


def audit_by_hand(docs, labels):
    smallest = {}
    for i, text, _, _ in docs:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, source, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and smallest[t] < i,
        }
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        per = Counter()
        for order in permutations("ABCDE"):
            left = rows
            gone = []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                out[part, "".join(order), step] = [len(left) - len(here), len(here), sum(f in r[0] for r in gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), f]
                per[f] += len(here)
                gone += here
                left = [r for r in left if f not in r[0]]
        for key, v in out.items():
            if key[0] == part:
                v[6] = per[v[6]]
    return out


def test_filter_audit(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(80)]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 80])]) for _ in range(rng.choice([10, 49, 50, 60]))) + rng.choice(["", " #", " ÀÉ", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJ"]) for _ in range(60)]
    docs = [(rng.randint(1, 90), rng.choice(texts), rng.choice(["s", "t", "", None]), 1) for _ in range(150)]
    docs += [(None, texts[0], "s", 1), (None, None, None, 1), (5, None, "s", 1), (7, "", "s", 1), (7, "", "s", 1), (9, " \t\n\x0b\x0c\r ", "s", 1), (11, "a b\x85c d " * 60, "u", 1), (12, "Z" + "x y " * 50_000, "u", 1)]
    docs += [(1000 + i, "the same text", "hot", 1) for i in range(80)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(1, 95)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (1000, 1, 1), (1001, 1, 1)]
    got = filter_audit.audit_filters(spark.createDataFrame(docs, "doc_id long, text string, source string, mask int").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    due = audit_by_hand(docs, labels)
    assert len(got) == len(due) == 5 * 600
    for r in got:
        assert [r[c] for c in filter_audit.COUNTS] == due[r["part"], r["filter_order"], r["step"]], r


def test_filter_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels).collect() == []
    one = filter_audit.audit_filters(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), labels).collect()
    assert len(one) == 600 and {(r["part"], r["kept"]) for r in one if r["step"] == 5} == {("", 0)}


def test_filters_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "ab", "s"), (3, "abc", "s"), (4, "abc", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(docs, labels, filters={"L": F.length("text") > 1, "M": F.length("text") > 2}).where("filter_order = 'LME'").orderBy("step").collect()
    assert [(r["removed"], r["redundant"], r["unique_fails"]) for r in got] == [(3, 0, 1), (0, 2, 0), (0, 1, 0)]
    with pytest.raises(ValueError):
        filter_audit.removal_steps(9)
    with pytest.raises(ValueError):
        filter_audit.audit_filters(docs, labels, filters={"E": F.lit(True)})
