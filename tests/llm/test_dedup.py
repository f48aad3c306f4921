"""Operators 5, 6, 7 and 10 against brute force on small fixtures."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.llm import exact_dedup, line_dedup, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def saved(spark, rows, path):
    frame(spark, rows).repartition(3).write.parquet(str(path))
    return str(path)


TRICKY = [(1, "a\nb", None), (2, None, "x"), (3, "", "x"), (4, "a\nb", "y"), (4, "a\nb", "y"), (None, "a\nb", "y"), (None, "é" * 9, "y"), (5, "é" * 5000, "z"), (6, "x" * 300_000, "z"), (7, "x" * 300_000, "z")]


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("rows", [TRICKY, []], ids=["tricky", "empty"])
def test_exact_dedup(spark, tmp_path, rows):
    got = exact_dedup.exact_dedup(spark, saved(spark, rows, tmp_path / "t")).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in got) == exact_by_hand(rows)
    kept = [r["digest"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t, _ in rows})


def test_exact_dedup_tells_texts_with_one_digest_apart(spark, tmp_path):
    rows = [(i, t, None) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "ddd", None])]
    got = exact_dedup.exact_dedup(spark, saved(spark, rows, tmp_path / "t"), digest=lambda t: F.length(t).cast("string")).collect()
    assert {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(0, 2, 2, False), (2, 2, 2, True), (1, 4, 2, False), (4, 4, 2, True), (3, 3, 1, True), (5, 5, 1, True), (6, 6, 1, True)}


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    rows = [(1, "a", None), (2, "b", None), (3, "a", None)]
    path, work = saved(spark, rows, tmp_path / "t"), str(tmp_path / "work")
    assert exact_dedup.exact_dedup(spark, path, work=work).where("kept").count() == 2
    frame(spark, [(9, "a", None), (8, "c", None)]).write.mode("append").parquet(path)
    got = exact_dedup.exact_dedup(spark, path, work=work).collect()
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in got} == {(1, 9, 3), (3, 9, 3), (9, 9, 3), (2, 2, 1), (8, 8, 1)}


def strip_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def lines_by_hand(rows, least=10):
    where = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(strip_key(x)) >= least:
                where[strip_key(x)].add(i)
    out = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(where[strip_key(x)]) < 2 or min(where[strip_key(x)]) == i]
        out[(i, len(lines), len(lines) - len(keep), "\n".join(keep))] += 1
    return out


def line_rows(n=120, seed=5):
    r = random.Random(seed)
    common = ["  The Same Old Line\t", "the same old line", "another RATHER long line", "short", "", "É accent line here", "é accent line here"]
    rows = [(r.randrange(n), "\n".join(r.choice(common) if r.random() < 0.6 else f"line of its own {r.random()}" for _ in range(r.randrange(0, 200))), "x") for _ in range(n)]
    return rows + [(n, None, None), (n + 1, "", None), (None, "the same old line", None), (n + 2, "\n\n", "x"), (n + 3, "the same old line\n" * 3000, "x")]


@pytest.mark.parametrize("rows", [line_rows(), TRICKY, []], ids=["lines", "tricky", "empty"])
def test_line_dedup(spark, rows):
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got) == lines_by_hand(rows)


def test_line_dedup_without_and_with_salted_keys_is_one_result(spark):
    rows = line_rows(60, 8) + [(900, "\n".join(["the same old line", f"only here {i}"][i % 2] for i in range(70_000)), None)]
    a, b = (line_dedup.dedup_lines(frame(spark, rows), top=top, salts=5).select("doc_id", "text").collect() for top in (1, 64))
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def repeats_by_hand(rows, length):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[(i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def repeat_rows(seed, n=60):
    r = random.Random(seed)
    alphabet = ["ab", "abcdefgh ", "é€xyz "][seed % 3]
    make = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    passages = [make(k) for k in (39, 40, 41, 60, 150, 400)]
    rows = []
    for i in range(n):
        t = "".join(r.choice(passages)[r.choice([0, 0, 1, 5]) :] if r.random() < 0.5 else make(r.randrange(0, 90)) for _ in range(r.randrange(0, 8)))
        rows.append((i, t, None))
    return rows + [(n, None, None), (n + 1, "", None), (n + 2, "z" * 500, None), (None, passages[-1], None), (3, rows[3][1], None), (n + 3, passages[4] * 3, None)]


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("group", [50_000, 2])
def test_suffix_dedup(spark, seed, group):
    rows = repeat_rows(seed)
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=40, gram=8, group=group).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == repeats_by_hand(rows, 40)
    for r in got:
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_dedup_of_hot_grams(spark, monkeypatch, seed):
    rows = repeat_rows(seed)
    monkeypatch.setattr(suffix_dedup, "_hot_grams", lambda s, n: [r["gram"] for r in s.select("gram").distinct().collect()][::2])
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=40, gram=8).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == repeats_by_hand(rows, 40)


def test_suffix_dedup_in_small_parts(spark, monkeypatch):
    rows = repeat_rows(1)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 97)
    ids, th, texts = [r[0] or -1 for r in rows], list(range(len(rows))), [(r[1] or "").encode() for r in rows]
    whole = suffix_dedup._tuples(ids, th, texts, 40, 8)
    covered = Counter()
    for t, at in zip(whole["th"], whole["at"], strict=True):
        for p in range(at >> 16, (at >> 16) + (at & 255) + 1):
            covered[t, p] += 1
    assert set(covered) == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 39)} and set(covered.values()) == {1}


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def fingerprint_by_hand(text, k):
    from xxhash import xxh64_intdigest

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps, far):
    todo, out = dict(fps), {}
    while todo:
        i = min(todo)
        group, edge = set(), [i]
        while edge:
            a = edge.pop()
            if a in todo:
                group.add(a)
                fp = todo.pop(a)
                edge += [b for b, f in todo.items() if bin(f ^ fp).count("1") <= far]
        out.update(dict.fromkeys(group, min(group)))
    return out


def near_rows(seed=4, n=150):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(500)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            words = (r.choice(rows)[1] or "a").split(" ")
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 40, 200]))]
        rows.append((i, " ".join(words), "x"))
    return rows + [(n, None, None), (n + 1, " \t\n", None), (n + 2, "one two\tthree four five", None)]


@pytest.mark.parametrize("block", [20_000, 7])
def test_near_duplicates(spark, block):
    rows = near_rows()
    got = simhash.near_duplicates(frame(spark, rows), block=block).collect()
    fps = {i: fingerprint_by_hand(t, 4) for i, t, _ in rows}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == components_by_hand(fps, 4)


def test_near_duplicates_of_odd_rows(spark):
    rows = [*TRICKY, (9, "same words here now", "q"), (9, "same words here now", "q")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"] == 9} == {9}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("far", [0, 1, 4, 8])
def test_bucket_links_join_all_that_is_near(far):
    rng = np.random.default_rng(far)
    n = 900
    fp = rng.integers(0, 1 << 63, n // 9, dtype=np.uint64).repeat(9)
    for i in range(n):
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            fp[i] ^= np.uint64(1) << np.uint64(b)
    fp = np.unique(fp)
    bucket = np.sort(rng.integers(0, 5, len(fp)))
    gray = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    order = np.lexsort((gray, bucket))
    fp, bucket = fp[order], bucket[order]
    union = simhash._Union(len(fp))
    links = simhash.bucket_links(bucket, fp, far)
    assert all(bucket[a] == bucket[b] and bin(int(fp[a] ^ fp[b])).count("1") <= far for a, b in links)
    union.join(*np.array(links, dtype=np.int64).reshape(-1, 2).T)
    for k in range(5):
        own = {int(i): int(fp[i]) for i in np.flatnonzero(bucket == k)}
        assert {i: int(union.label[i]) for i in own} == components_by_hand(own, far)


def test_similar_groups(spark):
    r = random.Random(6)
    vocabulary = [f"W{i}" for i in range(900)]
    rows, groups = [], defaultdict(set)
    for g in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice([60, 150, 400]))]
        for _ in range(r.choice([1, 2, 5])):
            words = list(base)
            for _ in range(len(words) // 100 + r.randrange(2)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            groups[g].add(len(rows))
            rows.append((len(rows), " ".join(words), "x"))
    n = len(rows)
    rows += [(n, None, None), (n + 1, "", None), (n + 2, rows[0][1], "x"), (n + 2, rows[0][1], "x")]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, rows)).collect()}
    assert set(got) == {i for i, *_ in rows} and got[n] == got[n + 1] == n and got[n + 2] == got[0]
    sets = {i: simhash.shingles(t, 5) for i, t, _ in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    own = {i: g for g, ids in groups.items() for i in ids}
    assert all(own[got[i]] == own[i] for i in own), "unlike texts are joined"
    pairs = [(a, b) for ids in groups.values() for a in ids for b in ids if a < b and near(a, b)]
    assert len(pairs) > 20 and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def test_pairs_of_just_the_similarity_are_found(spark):
    r = random.Random(11)
    rows, pairs = [], []
    for _ in range(300):
        base = [f"W{r.randrange(5000)}" for _ in range(400)] + ["again and again"] * r.choice([0, 0, 60])
        other = list(base[:400]) + ["again and again"] * r.choice([0, 60])
        for at in r.sample(range(0, 400, 5), 7):
            other[at + 2] = "changed"
        p, q = " ".join(base), " ".join(other)
        a, b = simhash.shingles(p, 5), simhash.shingles(q, 5)
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), p, "x"), (len(rows) + 1, q, "x")]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, rows)).collect()}
    assert len(pairs) > 150 and sum(got[a] == got[b] for a, b in pairs) >= 0.995 * len(pairs)


def test_a_cut_link_hides_no_pair(spark):
    """Families around a base with the smallest id: most members are below 0.8 to it and to most others."""
    r = random.Random(3)
    rows, near = [], []
    for g in range(3):
        base = [f"B{g}x{r.randrange(5000)}" for _ in range(300)]
        rows.append((len(rows), " ".join(base), "x"))
        for _ in range(100):
            words = list(base)
            for at in r.sample(range(0, 300, 10), 9):
                words[at + 2] = f"W{r.randrange(5000)}"
            twin = list(words)
            for at in r.sample(range(5, 300, 10), 5):
                twin[at + 2] = f"W{r.randrange(5000)}"
            near.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(words), "x"), (len(rows) + 1, " ".join([*twin, *["again and again"] * 60]), "x")]
    sets = {i: simhash.shingles(t, 5) for i, t, _ in rows}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in near)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, rows)).collect()}
    assert sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)


def test_most_similar_pairs_of_a_large_family_are_joined(spark, monkeypatch):
    """700 copies of one text with 0 to 24 changed words: pairs lie between 0.2 and 1; no step makes more than a bounded number of pairs a text."""
    r = random.Random(8)
    base = [f"W{r.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(700):
        words = list(base)
        for at in r.sample(range(150), r.randrange(0, 25)):
            words[at] = f"W{r.randrange(5000)}"
        texts.append(" ".join(words))
    made = []
    follow = simhash._followers
    monkeypatch.setattr(simhash, "_followers", lambda *a: made.append(follow(*a).count()) or follow(*a))
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, [(i, t, "x") for i, t in enumerate(texts)])).collect()}
    sets = [simhash.shingles(t, 5) for t in texts]
    pairs = [(a, b) for a in range(700) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = sum(got[a] == got[b] for a, b in pairs)
    lonely = {i for p in pairs for i in p}
    single = Counter(got.values())
    left = sum(single[got[i]] == 1 for i in lonely)
    print(len(pairs), found, len(lonely), left, made)
    assert len(pairs) > 4000 and found >= 0.97 * len(pairs) and left <= 0.05 * len(lonely) and made[0] <= 700 * simhash.BANDS * simhash.AHEAD


@pytest.mark.parametrize("agree", [1, 3])
def test_any_masks_give_the_same_components(spark, agree):
    fps = spark.createDataFrame(sorted({(fingerprint_by_hand(t, 4) - (1 << 64) * (fingerprint_by_hand(t, 4) >> 63),) for _, t, _ in near_rows()}), "fp long")
    want, got = (sorted(map(tuple, simhash.components(spark, simhash.near_links(fps, 4, agree=k, steps=s)).collect())) for k, s in ((2, ()), (agree, (0, 1, 3))))
    assert got == want


@pytest.mark.parametrize("far", [0, 4, 8])
def test_masks_leave_no_pair_out(far):
    r = random.Random(far)
    ms = simhash.masks(far)
    for _ in range(2000):
        unlike = sum({1 << r.randrange(64) for _ in range(far)})
        assert any(m & unlike == 0 for m in ms)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]
    got = simhash.components(spark, spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)}
