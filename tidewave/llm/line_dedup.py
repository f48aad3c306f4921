"""Line deduplication by range-partitioned line hashes (operator 7).

Each line becomes a 128-bit hash of its key with its document and position; the text stays where it
is. The hashes are dealt out by range and sorted by hash, document and position, so one running
"first document so far" tells of each line whether an earlier document holds it. The answer is, per
document, a bitmap of the lines to drop, 64 lines to a word, all-zero words left out; documents join it
once to drop the lines.

A very frequent key would make one task long. approx_top_k names such keys, as many as partitions allow; their rows are salted by
document, and the smallest document of each salt meets the others' in a second, tiny aggregate. Which
keys are salted changes the work's layout only, never the result.

Defined cases: null or empty text is one empty line; rows with a null id are left as they are and make
no other line a repeat; very long texts and texts of very many lines are split whole, the work is linear in
both; rows of one id are one document, each row with its own bitmap (keyed by id and
text hash); an empty table gives an empty result; other columns pass through, but for
those named like an output, which it replaces, and may have any name that doesn't start with "_ld_".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, folded_ascii, partitions

#: The bytes that are stripped off both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
#: Keys that approx_top_k names at least, its counters for each of them, and into how many parts a named key is salted.
TOP, COUNTERS, SALTS = 64, 16, 64
_EDGES = ", ".join(f"X'{ord(c):02X}'" for c in SPACE)


def stripped(line: str) -> Column:
    """The column without white space at its ends; btrim walks whole lines, so it sees only those that need it."""
    needs = F.expr(f"substring(cast({line} AS binary), 1, 1) IN ({_EDGES}) OR substring(cast({line} AS binary), -1, 1) IN ({_EDGES})")
    return F.when(needs, F.btrim(F.col(line), F.lit(SPACE))).otherwise(F.col(line))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", F.xxhash64(text).alias("_ld_text")).withColumn("_ld_id", F.col(id_col))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """_ld_id, _ld_text (hash of the text), pos, h1, h2 of every line whose key is long enough: one scan of the texts, and no text in the result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the outer form: a text has a line at least, and for the inner one the optimizer would add a filter that splits each text again
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_ld_id"), F.xxhash64(text).alias("_ld_text"), F.posexplode_outer(F.split(text, "\n")).alias("pos", "line"))
    keys = base.select("_ld_id", "_ld_text", "pos", stripped("line").alias("key")).where(F.length("key") >= min_chars)
    keys = keys.withColumn("key", folded_ascii(F.col("key")))
    return keys.select("_ld_id", "_ld_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, top: int | None = None, salts: int = SALTS) -> DataFrame:
    """Per document with lines to drop: _ld_id, _ld_text (its text's hash) and bitmap, an array of (word, bits)."""
    n = partitions(docs.sparkSession)
    # the hashes are written once, and counted, sampled for ranges and dealt out from there
    rows = cut(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    top = top or min(50_000, max(TOP, 4 * n))  # no more keys than 4 n can hold a fourth of a task's share each
    counts = rows.agg(F.expr(f"approx_top_k(h1, {top}, {min(1_000_000, max(4096, COUNTERS * top))})").alias("t"), F.count("*").alias("n")).first()
    hot = [x["item"] for x in (counts["t"] or []) if x["count"] > counts["n"] / (4 * n)]
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    salted = rows.withColumn("hot", is_hot).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("_ld_id"), F.lit(salts))).otherwise(F.lit(0)))
    ranged = salted.repartitionByRange(n, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "_ld_id", "pos")
    first = F.min("_ld_id").over(Window.partitionBy("h1", "h2", "salt").orderBy("_ld_id", "pos").rowsBetween(Window.unboundedPreceding, 0))
    seen = cut(ranged.withColumn("first", first).where((F.col("_ld_id") > F.col("first")) | F.col("hot")), "line-repeats")
    firsts = seen.where("hot").groupBy("h1", "h2").agg(F.min("first").alias("global_first"))  # at most one row a hot key
    late = seen.where("hot").join(F.broadcast(firsts), ["h1", "h2"]).where(F.col("_ld_id") > F.col("global_first"))
    drops = seen.where("NOT hot").select("_ld_id", "_ld_text", "pos").unionByName(late.select("_ld_id", "_ld_text", "pos")) if hot else seen.select("_ld_id", "_ld_text", "pos")
    words = drops.groupBy("_ld_id", "_ld_text", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("_ld_id", "_ld_text").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, top: int | None = None, salts: int = SALTS) -> DataFrame:
    """docs with text_col replaced by the kept lines, and columns n_lines, n_dropped and bitmap (null: nothing to drop)."""
    docs = docs.drop("n_lines", "n_dropped", "bitmap")
    maps = drop_bitmaps(docs, id_col, text_col, min_chars, top, salts)
    out = _keyed(docs, id_col, text_col).join(maps, ["_ld_id", "_ld_text"], "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    # places of the bits that are set; the lines left are those at all other places. _ld is bound once by the outer transform.
    places = "flatten(transform(_ld.bitmap, w -> filter(sequence(64 * w.word, 64 * w.word + 63), p -> (shiftright(w.bits, p % 64) & 1L) = 1L)))"
    kept = F.expr(f"transform(array(_ld_bound), _ld -> array_join(transform(array_except(sequence(0, size(_ld.lines) - 1), {places}), p -> get(_ld.lines, p)), '\n'))[0]")
    out = out.withColumn("_ld_bound", F.struct(lines.alias("lines"), F.col("bitmap")))
    out = out.withColumn(text_col, F.when(F.col("bitmap").isNull(), F.col(text_col)).otherwise(kept))
    dropped = F.expr("coalesce(aggregate(bitmap, 0L, (a, x) -> a + bit_count(x.bits)), 0L)")
    return out.withColumn("n_lines", F.size("_ld_bound.lines").cast("long")).withColumn("n_dropped", dropped).drop("_ld_bound", "_ld_id", "_ld_text")
