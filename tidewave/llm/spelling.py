"""Spelling variant grouping by asymmetric q-chunks (operator 11).

Two words at one edit are found by a signature of which only one side is cut: of the longer word two disjoint chunks of half its length,
of the other one all grams of that length with their places. One edit spoils one chunk at most, so the other one is a gram of the
other word, moved by one place at most: an equality join on (length, gram, place), for which a chunk is filed under its place and both
places beside it. All that meet are verified by edit distance, so a key may be a hash.

Words that share a chunk with very many others (a long common stem) would meet them all. Where a key has more than PAIRS pairs, its words are cut
again: what is left of both words without the shared chunk and gram is still at one edit at most, so it has chunks and grams of its own,
and so on until keys are small or nothing is left to cut. Which keys are cut again changes the work only, never the result.

A word's form is its near word of largest count, if that is `times` as frequent; forms are followed to their roots by joins that double the
distance each time, which are few, since each step multiplies the count.

Defined cases: a null text has no words; a null id counts as the empty string in the hash; words are counted whatever the number of rows, so repeated rows and ids
count again; ties go to the smallest word in code-point order; very long texts are cut within their row, and a run of letters may be as long as its text; an empty
table gives an empty result; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

LETTERS = "A-Za-zÀ-ÿ"
#: A key that makes more pairs than this is cut again.
PAIRS = 1 << 14


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased; words that have no upper-case letter at all, the most, are only looked at."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def spoiled(word: Column, id_: Column, every: int) -> Column:
    """word, less one code point where the CRC-32 of "<id>:<word>" is divisible by `every`; its place is the CRC modulo the length."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, min_chars: int = 6, min_count: int = 5, spoil: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: runs of LETTERS, A-Z lower-cased, of at least min_chars code points and min_count occurrences. With spoil, runs are spoiled() first."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{LETTERS}]{{{min_chars},}}+"), F.lit(0))
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("word"))
    if spoil:
        words = words.select(spoiled(F.col("word"), F.col("id"), spoil).alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _without(rest: Column, at: Column, n: Column) -> Column:
    return F.concat(F.substring(rest, F.lit(1), at), F.substring(rest, at + n + 1, F.length(rest)))


def _key(length: Column, gram: Column, place: Column) -> Column:
    return F.xxhash64("bucket", length, gram, place)


def chunks(rows: DataFrame) -> DataFrame:
    """word, key, rest: rows of word, bucket and rest under both halves of rest, each at its place and the two beside it."""
    n = F.length("rest")
    q = F.floor(n / 2).cast("int")
    cuts = rows.withColumn("q", q).withColumn("at", F.explode(F.array(F.lit(0), n - q)))
    cuts = cuts.withColumn("gram", F.substring("rest", F.col("at") + 1, F.col("q"))).withColumn("place", F.explode(F.array(*[F.col("at") + d for d in (-1, 0, 1)])))
    return cuts.where("place >= 0").select("word", _key(n, F.col("gram"), F.col("place")).alias("key"), _without(F.col("rest"), F.col("at"), F.col("q")).alias("rest"))


def grams(rows: DataFrame) -> DataFrame:
    """word, key, rest: rows under all their positional grams, for chunks of words as long as rest and of those longer by one."""
    n = F.length("rest")
    sized = rows.withColumn("long", F.explode(F.array(n, n + 1))).withColumn("q", F.floor(F.col("long") / 2).cast("int")).where((F.col("q") >= 1) & (F.col("q") <= n))
    cuts = sized.withColumn("at", F.explode(F.sequence(F.lit(0), n - F.col("q")))).withColumn("gram", F.substring("rest", F.col("at") + 1, F.col("q")))
    return cuts.select("word", _key(F.col("long"), F.col("gram"), F.col("at")).alias("key"), _without(F.col("rest"), F.col("at"), F.col("q")).alias("rest"))


def _met(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    return longer.select("key", F.col("word").alias("a")).join(shorter.select("key", F.col("word").alias("b")), "key")


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """a, b: all unordered pairs of different words at exactly one inserted, deleted or replaced code point, each once."""
    longer = shorter = words.select("word", F.lit(0).cast("long").alias("bucket"), F.col("word").alias("rest"))
    found: list[DataFrame] = []
    while True:
        a, b = cut(chunks(longer), "chunks"), cut(grams(shorter), "grams")
        sizes = a.groupBy("key").agg(F.count(F.lit(1)).alias("x")).join(b.groupBy("key").agg(F.count(F.lit(1)).alias("y")), "key")
        large = cut(sizes.where(F.col("x") * F.col("y") > pairs).select("key"), "large-keys")
        again = not large.isEmpty()
        met = _met(a, b)
        if again:
            large_a, large_b = a.join(large, "key", "left_semi"), b.join(large, "key", "left_semi")
            # one code point can't be cut: such words meet here, and they differ in nothing else
            ends = _met(large_a.where(F.length("rest") < 2), large_b.where(F.length("rest") < 2))
            met = _met(a.join(large, "key", "left_anti"), b).unionByName(ends)
        near = met.where((F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1)
        found.append(cut(near.select("a", "b").distinct(), "near-words"))
        if not again:
            return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).distinct()
        longer = large_a.where(F.length("rest") >= 2).select("word", F.col("key").alias("bucket"), "rest")
        shorter = large_b.where(F.length("rest") >= 1).select("word", F.col("key").alias("bucket"), "rest")


def roots(links: DataFrame) -> DataFrame:
    """word and root of rows of word and form (never a cycle): forms followed to their ends, by doubling."""
    at = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(words: DataFrame, times: int = 5, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words (word, n) with their near words counted and the form that each is a variant of."""
    words = cut(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_pairs(words, pairs)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), "other")).alias("best"))
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.k") >= times * F.col("n"), F.col("best")).alias("best"))
    out = cut(out.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.k")).alias("form_n")), "forms")
    ends = roots(out.where("form IS NOT NULL"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
