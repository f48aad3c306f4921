"""Benchmark decontamination with a broadcast set of item n-grams (operator 9).

Every run of n consecutive item words is a window; an item with fewer words is one shorter window.
Documents become arrays of word hashes; arrays of window hashes grow from them by doubling (2, 4, 8
words, then two overlapping 8s make 13), one pass each. The windows stream through a join with the set
of item windows, and a match counts once the words themselves agree. Spans of hit words are merged
per document.

The set is broadcast only when its measured size is under broadcast_bytes. Above it documents' words are
written once, hashes alone are shuffled to the item windows, and the words are looked up for the few
windows that met; AQE splits that join where one window is very frequent.

Words are kept as keys (common.folded_ascii), which are equal when the words are.

Defined cases: null or wordless texts have no words, no hits and are not contaminated; items without
words have no windows; very long texts are read whole, in time linear in their words and hits; ties (one window in several
items) count for each of them; repeated items and rows count as themselves; an empty table on either side gives
no hits; doc columns other than id and text are not read by find_hits, and decontaminate keeps them, whatever their names are
but for those that start with "_dc_".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, folded_ascii

DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """The keys of a text's words; an array, empty for null. Delimiters are ASCII, so bytes tell them as well as letters."""
    return F.array_remove(F.split(folded_ascii(F.coalesce(text, F.lit(""))), DELIMITERS), "")


def _grow(a: Column, shift: int) -> Column:
    return F.zip_with(a, F.slice(a, shift + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def _windows(df: DataFrame, length: int, known: dict[int, str]) -> DataFrame:
    """Adds column g{length}: hashes of all runs of so many words, garbage in the last length - 1 places."""
    power = 1
    while power * 2 <= length:
        if power * 2 not in known:
            df, known[power * 2] = df.withColumn(f"g{power * 2}", _grow(F.col(known[power]), power)), f"g{power * 2}"
        power *= 2
    if length not in known:
        df, known[length] = df.withColumn(f"g{length}", _grow(F.col(known[power]), length - power)), f"g{length}"
    return df


def _hashed(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df with column words gains w: the hashes of its windows, those of lengths[0] first; w[0] is a mark that every row has."""
    df, known = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w))), {1: "g1"}
    for length in lengths:
        df = _windows(df, length, known)
    parts = [F.slice(F.col(known[k]), 1, F.greatest(F.size("words") - k + 1, F.lit(0))) for k in lengths]
    return df.withColumn("w", F.concat(F.array(F.lit(0).cast("long")), *parts))


def item_windows(items: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows of all items: their words, len and the ids (as strings) of the items that hold them."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    runs = words.select("item", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))).alias("at"), "words")
    runs = runs.select("item", F.slice("words", F.col("at"), n).alias("words"))
    return runs.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("len", F.size("words"))


def find_hits(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: id, text_hash, n_words, spans (merged runs of hit words: at, len), n_hit, items."""
    windows = item_windows(items, n)
    size = windows.agg(F.coalesce(F.sum(F.length(F.array_join("words", " ")) + F.length(F.array_join("items", " ")) + 64), F.lit(0)).alias("b"), F.array_sort(F.collect_set("len")).alias("k")).first()
    lengths = sorted(size["k"], reverse=True)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    small = size["b"] <= broadcast_bytes
    if not small:
        rows = cut(rows, "document-words")
    # the outer form: w is never empty, and for the inner one the optimizer would add a filter that builds all of w again
    each = _hashed(rows, lengths).select("rid", "id", "text_hash", F.size("words").alias("n_words"), *(["words"] if small else []), F.posexplode_outer("w").alias("at", "hash"))
    marks = _hashed(windows, lengths)
    # an item window is its own only run of its length, and has none of the longer ones that stand before
    own = marks.select(F.get("w", F.lit(1)).alias("hash"), F.col("words").alias("i_words"), F.col("len").alias("i_len"), "items")
    start = F.lit(1)  # where the runs of a length begin in w
    place = F.lit(0)
    for k in lengths:
        place = F.when(F.col("i_len") == k, F.col("at") - start).otherwise(place)
        start = start + F.greatest(F.col("n_words") - k + 1, F.lit(0))
    same_words = (place >= 0) & (F.slice("words", F.greatest(place, F.lit(0)) + 1, F.col("i_len")) == F.col("i_words"))
    spread = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_list("hit"), lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1)))))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    if small:
        mark = docs.sparkSession.createDataFrame([(0, [], 0, [])], own.schema)  # meets w[0], so that every row has a line
        own = F.broadcast(own.unionByName(mark))
        met = each.alias("d").join(own.alias("i"), (F.col("d.hash") == F.col("i.hash")) & (((F.col("at") == 0) & (F.col("i_len") == 0)) | ((F.col("at") > 0) & (F.col("i_len") > 0) & same_words)))
        hit = F.when(F.col("i_len") > 0, F.struct(place.alias("at"), F.col("i_len").alias("len")))
        hits = met.select("rid", "id", "text_hash", "n_words", hit.alias("hit"), "items").groupBy("rid", "id", "text_hash").agg(F.max("n_words").alias("n_words"), spread.alias("hits"), names.alias("items"))
    else:
        met = each.where("at > 0").join(own, "hash").select("rid", place.alias("place"), "i_len", "i_words", "items").where("place >= 0")
        sure = met.join(rows.select("rid", "words"), "rid").where(F.slice("words", F.col("place") + 1, F.col("i_len")) == F.col("i_words"))
        found = sure.select("rid", F.struct(F.col("place").alias("at"), F.col("i_len").alias("len")).alias("hit"), "items").groupBy("rid").agg(spread.alias("hits"), names.alias("items"))
        hits = rows.select("rid", "id", "text_hash", F.size("words").alias("n_words")).join(found, "rid", "left").withColumns({"hits": F.coalesce("hits", F.array().cast("array<int>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    # hits: the places of hit words, ascending; a span begins where the place before isn't hit, and ends likewise
    merged = F.expr("""
        transform(array(hits), p -> zip_with(
          filter(p, (x, i) -> i = 0 OR get(p, i - 1) < x - 1), filter(p, (x, i) -> i = size(p) - 1 OR get(p, i + 1) > x + 1),
          (s, e) -> named_struct('at', s, 'len', e - s + 1)))[0]""")
    return hits.select("id", "text_hash", F.col("n_words").cast("long").alias("n_words"), merged.alias("spans"), F.size("hits").cast("long").alias("n_hit"), "items")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents (remove="documents"), or with the hit words of all documents cut out of their texts (remove="spans")."""
    found = find_hits(docs, items, n, id_col, text_col).where("n_hit > 0").select(F.col("id").alias("_dc_id"), F.col("text_hash").alias("_dc_hash"), "spans", contaminated().alias("_dc_bad")).withColumnRenamed("spans", "_dc_spans").dropDuplicates(["_dc_id", "_dc_hash"])
    here = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("_dc_id")) & (here == F.col("_dc_hash"))
    if remove == "documents":
        return docs.join(found.where("_dc_bad"), same, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove: documents or spans, not {remove}")
    out = docs.join(found, same, "left")
    cased = DELIMITERS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    words, gaps = F.array_remove(F.split(F.col(text_col), cased), ""), F.split(F.col(text_col), LETTERS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))
    out = out.withColumn("_dc", F.struct(words.alias("w"), gaps.alias("g"), F.col("_dc_spans").alias("s")))
    # gap i stands before word i. Runs of kept words and the gaps of the spans between them take turns, and the last gap ends the text.
    kept = F.expr("""transform(array(_dc), d -> concat(array_join(zip_with(
          transform(zip_with(concat(array(0), transform(d.s, s -> s.at + s.len)), concat(transform(d.s, s -> s.at), array(size(d.w))), (a, b) -> named_struct('a', a, 'n', b - a)),
                    r -> array_join(zip_with(slice(d.g, r.a + 1, r.n), slice(d.w, r.a + 1, r.n), (g, w) -> concat(g, w)), '')),
          concat(transform(d.s, s -> array_join(slice(d.g, s.at + 1, s.len), '')), array('')),
          (x, y) -> concat(x, y)), ''), array_join(slice(d.g, size(d.w) + 1, size(d.g)), '')))[0]""")
    return out.withColumn(text_col, F.when(F.col("_dc_spans").isNull(), F.col(text_col)).otherwise(kept)).drop("_dc_id", "_dc_hash", "_dc_spans", "_dc_bad", "_dc")
