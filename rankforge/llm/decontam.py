"""Benchmark decontamination with SimHash windows, DataFrame functions only.

Words are runs without white space of the lower-cased text; shingles are five
consecutive words (a benchmark item with fewer words is one shingle). A
document is contaminated by an item if one of its windows of the item's length
(the whole document, if it is shorter) has weighted shingle similarity
sum(min) / sum(max) >= ``threshold`` with the item, weights being counts.

1. A bitmap of fixed size over the hashes of all benchmark shingles, in the
   plan as a constant, shrinks each text to the hashes of documents that could
   hold enough shingles of some item. It drops no document that does.
2. A window of k shingles that reaches the threshold t shares at least
   t (k + m) / (1 + t) of the m shingles of its item. The positions of an item's
   shingles so give the starts of the item-sized windows that can reach it; the
   item is then forgotten.
3. SimHash: 64 counters over the shingles of a window give its fingerprint. The
   second and later occurrences of a shingle count as shingles of their own, so
   the weighted similarity is the plain one of these sets, and a shingle that
   repeats often moves the fingerprint no more than others together.
4. Multi-index Hamming blocks: fingerprints are cut into ``radius`` + 1 blocks;
   two of them within ``radius`` bits agree in a block, so an equi-join on
   (length, block, value) finds all items within the radius.
5. The exact similarity of the candidates decides.

Odd input: null, empty and short texts hold nothing; items with null or empty
text match nothing; equal items are reported each; repeated rows are reported
each; rows without doc_id are reported with a null id; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch

WORDS = 5
BITMAP_LONGS = 1 << 14  # 2 ** 20 bits, whatever the size of the benchmark
RADIUS = 24  # of 64 bits: five standard deviations beyond a similarity of 0.8
SMALL_ROWS = 200_000  # rows of (hash, item, length) that are broadcast at most: about 5 MB
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however the optimizer
    merges projections: a lambda over a one-element array binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles_of(words: Column, width: int = WORDS) -> Column:
    """Hashes of the shingles at every position; fewer words: one of them all."""
    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return (F.when(F.size(w) >= width, each).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "), F.size(w))))
                .otherwise(F.array().cast("array<long>")))

    return let(words, grams)


def _runs(width: int):
    return lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width),
                                 lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, width), " "), F.lit(width)))


def fingerprint(shingles: Column) -> Column:
    """SimHash: bit b is set where more than half of the hashes have it set.
    Two counters share a long, so 32 sums over the shingles give all 64."""
    zero, one, n = F.lit(0).cast("long"), F.lit(1).cast("long"), F.size(shingles)

    def lane(b: Column) -> Column:
        each = F.transform(shingles, lambda h: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit((1 << 32) | 1)))
        return F.struct(b.alias("b"), F.aggregate(each, zero, lambda acc, x: acc + x).alias("s"))

    def bits(x: Column) -> Column:
        low = F.when(2 * x["s"].bitwiseAND(F.lit(0xFFFFFFFF)) > n, F.call_function("shiftleft", one, x["b"])).otherwise(zero)
        high = F.when(2 * F.shiftrightunsigned(x["s"], 32) > n, F.call_function("shiftleft", one, x["b"] + 32)).otherwise(zero)
        return low.bitwiseOR(high)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(31)), lane), zero, lambda acc, x: acc.bitwiseOR(bits(x)))


def blocks_of(print_: Column, radius: int) -> Column:
    """The fingerprint in radius + 1 blocks of nearly equal width."""
    n = radius + 1

    def block(k: Column) -> Column:
        lo, hi = F.floor(64 * k / n).cast("int"), F.floor(64 * (k + 1) / n).cast("int")
        ones = F.call_function("shiftleft", F.lit(1).cast("long"), hi - lo) - 1
        return F.call_function("shiftrightunsigned", print_, lo).bitwiseAND(ones)

    return F.transform(F.sequence(F.lit(0), F.lit(radius)), block)


def numbered(shingles: Column) -> Column:
    """The shingles with the second and later occurrences of one hashed with
    their number. The sum of the smaller counts of two texts then is the size
    of an intersection."""
    def occurrence(a: Column):
        return lambda x, i: let(F.size(F.filter(F.slice(a, 1, i), lambda y: y == x)), lambda c: F.when(c == 0, x).otherwise(F.xxhash64(x, c)))

    return let(shingles, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), a).otherwise(F.transform(a, occurrence(a))))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """One row per document and item: doc_id, item_id, similarity (of the best
    window), start_word, n_words, text_key (hash of the text). Runs jobs and
    keeps its tables in the shared folder; the result is lazy."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = (benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
             .select("item_id", F.size("w").alias("n_words"), shingles_of(F.col("w")).alias("item"))
             .withColumn("m", F.size("item")).withColumn("set", numbered(F.col("item"))))
    items = scratch.save(scratch.save(items, "numbered").withColumn("item_print", let(F.col("set"), fingerprint)), "items")
    grams = scratch.save(items.select("item_id", "n_words", "m", F.explode(F.array_distinct("item")).alias("hash")), "grams")
    # the shortest window that can reach the threshold has threshold * m shingles and shares them all
    fewest = F.ceil(F.lit(threshold) * F.col("m") - F.lit(1e-9)).cast("int")
    stats = grams.agg(F.min(fewest), F.count("*"), F.min("n_words")).first()
    least, n_grams, shortest = stats[0] or 1, stats[1], stats[2] or WORDS
    small = F.broadcast if n_grams <= SMALL_ROWS else (lambda df: df)

    # ---- texts that may hold enough benchmark shingles, as hashes
    slot = lambda h: F.pmod(h, F.lit(64 * BITMAP_LONGS))
    words = dict(grams.select(slot(F.col("hash")).alias("s")).groupBy((F.col("s") / 64).cast("int").alias("k"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).collect())
    bitmap = F.split(F.lit(",".join(str(words.get(k, 0)) for k in range(BITMAP_LONGS))), ",").cast("array<long>")
    marked = lambda h: F.getbit(F.get(bitmap, F.shiftright(slot(h), 6).cast("int")),
                                slot(h).bitwiseAND(F.lit(63)).cast("int")) == 1
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    if shortest < WORDS:  # short items: every run of so many words is a shingle, too
        short = [r[0] for r in items.where(F.col("n_words") < WORDS).select("n_words").distinct().collect()]
        runs = [F.when(F.size("w") >= k, let(F.col("w"), _runs(k)))
                .otherwise(F.array().cast("array<long>")) for k in short]
        shortened = scratch.save(hashed.select("doc_id", "text_key", F.explode(F.concat(*runs)).alias("hash"))
                                 .join(small(grams.where(F.col("n_words") < WORDS)), "hash")
                                 .select("doc_id", "text_key", "item_id", "n_words").distinct(), "short")
    enough = lambda g: F.when((F.size(g) > 0) & (F.size(F.filter(g, marked)) >= F.lit(least)), g)
    likely = hashed.select("doc_id", "text_key", let(shingles_of(F.col("w")), enough).alias("grams")).where("grams IS NOT NULL")
    # the row number is written with the row, so it stays
    held = scratch.save(likely.withColumn("row", F.monotonically_increasing_id()), "held")

    # ---- item-sized windows that can reach the threshold
    hits = (held.select("row", F.size("grams").alias("n"), F.posexplode("grams").alias("pos", "hash"))
            .join(small(grams.where(F.col("n_words") >= WORDS)), "hash"))
    k = F.least("n", "m")  # shingles of a window
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (k + F.col("m")) - F.lit(1e-9)).cast("int").alias("need")
    hits = hits.select("row", "n", "item_id", "m", need, "pos")
    spots = (hits.groupBy("row", "n", "item_id", "m", "need").agg(F.sort_array(F.collect_list("pos")).alias("at"))
             .where(F.size("at") >= F.col("need")))
    ends = F.sequence(F.lit(0), F.size("at") - F.col("need"))
    lasts = F.greatest(F.col("n") - F.col("m"), F.lit(0))  # last start of a window that fits
    starts = F.flatten(F.transform(ends, lambda i: F.when(
        F.get("at", i + F.col("need") - 1) - F.col("m") + 1 <= F.get("at", i),
        F.sequence(F.least(F.greatest(F.get("at", i + F.col("need") - 1) - F.col("m") + 1, F.lit(0)), lasts), F.least(F.get("at", i), lasts)))
        .otherwise(F.array().cast("array<int>"))))
    windows = spots.select("row", "m", F.explode(F.array_distinct(starts)).alias("start")).distinct()
    # the windows are cut in the row: exploding first would carry the whole document along with each
    cut = F.transform("wanted", lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), F.slice("grams", x["start"] + 1, x["m"]).alias("window")))
    windows = (windows.groupBy("row").agg(F.collect_list(F.struct("m", "start")).alias("wanted")).join(held, "row")
               .select("row", "doc_id", "text_key", F.inline(cut)).withColumn("window", numbered(F.col("window"))))
    windows = scratch.save(scratch.save(windows, "numbered-windows").withColumn("print", let(F.col("window"), fingerprint)), "windows")

    # ---- multi-index blocks, then the exact similarity
    keyed = windows.select("*", F.posexplode(blocks_of(F.col("print"), radius)).alias("block", "value"))
    sides = items.select("item_id", "set", "m", "item_print", F.posexplode(blocks_of(F.col("item_print"), radius)).alias("block", "value"))
    equal = F.zip_with(blocks_of(F.col("print"), radius), blocks_of(F.col("item_print"), radius), lambda a, b: a == b)
    near = (keyed.join(small(sides), ["m", "block", "value"])
            .where((F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
                   & (F.array_position(equal, F.lit(True)) == F.col("block") + 1)))  # one row for all blocks they share
    both = F.size(F.array_intersect("window", "set"))
    found = (near.select("row", "doc_id", "text_key", "item_id", "m", "start", F.size("window").alias("k"), both.alias("both"))
             .withColumn("similarity", F.col("both") / (F.col("k") + F.col("m") - F.col("both")))
             .where(F.col("similarity") >= threshold)
             .groupBy("row", "doc_id", "text_key", "item_id")
             .agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "k")).alias("best"))
             .select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start_word"),
                     (F.col("best.k") + WORDS - 1).alias("n_words"), "text_key"))
    if shortest < WORDS:
        found = found.unionByName(shortened.select("doc_id", "item_id", F.lit(1.0).alias("similarity"), F.lit(None).cast("int").alias("start_word"),
                                                   "n_words", "text_key"))
    return scratch.save(found, "found")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of the benchmark."""
    found = contaminated(docs, benchmark, threshold).select("text_key").distinct()
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("_rf_key", key).join(found.withColumnRenamed("text_key", "_rf_key"), "_rf_key", "left_anti").select(docs.columns)
