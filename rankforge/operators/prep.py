"""Preparation of query-product judgments (filters, joins, projections,
profiles). Every function takes and returns a lazy DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.config import BROAD_MIN_GRADE, LABEL_GRADES, QUERY_INSTRUCTION, STRICT_MIN_GRADE, TOKEN_BUDGET
from rankforge.functions.text import clean_field, is_ascii, token_count

# ---- fixed values: columns of the saved pair table ----
PAIR_COLUMNS = ("example_id", "query_id", "product_id", "product_locale", "query",
                "esci_label", "grade", "split", "product_title", "product_text_dense")
# ---- end of fixed values ----


# ---------------------------------------------------------------- joins
def join_products(examples: DataFrame, products: DataFrame) -> DataFrame:
    """JN-1: judgments LEFT JOIN products on (locale, product_id).

    Filters written after this join are pushed below it by Catalyst, and the
    locale predicate is inferred for the product scan too."""
    return examples.join(products, ["product_locale", "product_id"], "left")


# ---------------------------------------------------------------- filters
def filter_locale_version(df: DataFrame, locale: str = "us", version: int = 1) -> DataFrame:
    """FLT-1: product_locale = 'us' and small_version = 1."""
    return df.where((F.col("product_locale") == locale) & (F.col("small_version") == version))


def filter_ascii_queries(df: DataFrame, col: str = "query") -> DataFrame:
    """FLT-2: keep ASCII-only queries; a null query is kept (as str(None))."""
    return df.where(F.coalesce(is_ascii(col), F.lit(True)))


def filter_queries_with_exact(df: DataFrame, label: str = "E") -> DataFrame:
    """FLT-3 / WIN-2: keep rows of (locale, query_id) groups with >= 1 label E.

    The group-wise 'any' is a distinct key set (one row per qualifying
    group, aggregated map-side) joined back with a left-semi join. Unlike a
    window over the group, a hot query never has to sit in one window buffer:
    the key set is small (the planner broadcasts it when it is under the
    threshold) and a shuffled semi join is split by AQE's skew handling."""
    keys = ["product_locale", "query_id"]
    groups = df.where(F.col("esci_label") == label).select(*keys).distinct()
    return df.join(groups, keys, "left_semi")


def any_over_group(df: DataFrame, keys, cond, name: str = "any") -> DataFrame:
    """WIN-2 in general form: a boolean column true on every row of a group
    where ``cond`` holds on some row, else false.

    The groups that have such a row are a distinct key set, aggregated before
    its exchange, joined back null-safely: a hot group is never gathered (AQE
    splits its side of the join, or the set is broadcast by its size)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    have = df.where(cond).select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).distinct().withColumn("__any", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    return df.join(have, on, "left").select(*df.columns, F.coalesce("__any", F.lit(False)).alias(name))


def filter_split(df: DataFrame, split: str) -> DataFrame:
    """FLT-4 (prunes the split partition when read from a partitioned table)."""
    return df.where(F.col("split") == split)


def filter_training_positives(df: DataFrame) -> DataFrame:
    """FLT-5: split = train and label E or S."""
    return df.where((F.col("split") == "train") & F.col("esci_label").isin("E", "S"))


def drop_unmapped_labels(df: DataFrame) -> DataFrame:
    """FLT-6."""
    return df.na.drop(subset=["grade"])


def relevance_threshold(mode: str) -> float:
    """FLT-8 thresholds; any other mode is an error."""
    if mode == "strict":
        return STRICT_MIN_GRADE
    if mode == "broad":
        return BROAD_MIN_GRADE
    raise ValueError(f"unknown relevance mode {mode!r}: choose strict or broad")


def relevant_pairs(pairs: DataFrame, mode: str = "broad") -> DataFrame:
    """FLT-8: judged pairs at or above the relevance threshold of ``mode``."""
    return pairs.where(F.col("grade") >= F.lit(relevance_threshold(mode)))


def relevant_sets(pairs: DataFrame, mode: str = "broad") -> DataFrame:
    """AGG-1 in long form: the distinct (query_id, product_id) relevant pairs
    -- what every join consumes; no per-query array is built."""
    return relevant_pairs(pairs, mode).select("query_id", "product_id").distinct()


def relevant_set_arrays(pairs: DataFrame, mode: str = "broad") -> DataFrame:
    """AGG-1 at the edge (reports): query_id -> sorted array of relevant ids.
    One array per query: meant for bounded judgment lists, not for joins."""
    return (relevant_sets(pairs, mode).groupBy("query_id")
            .agg(F.array_sort(F.collect_list("product_id")).alias("relevant")))


def valid_queries(pairs: DataFrame, mode: str = "broad") -> DataFrame:
    """FLT-7 gatekeeper: ids of queries with >= 1 relevant judgment."""
    return relevant_pairs(pairs, mode).select("query_id").distinct()


def gatekeep(df: DataFrame, pairs: DataFrame, mode: str = "broad") -> DataFrame:
    """FLT-7: keep rows whose query passes the gatekeeper (left-semi join)."""
    return df.join(valid_queries(pairs, mode), "query_id", "left_semi")


# ---------------------------------------------------------------- projections
def label_grade(col: str = "esci_label"):
    """PRJ-1: label -> grade through a literal map; unmapped -> null."""
    m = F.create_map(*[x for k, v in LABEL_GRADES.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.try_element_at(m, F.col(col))


def add_product_text(df: DataFrame, color_col: str | None = None) -> DataFrame:
    """PRJ-3: 'title.' brand bullets, empty parts skipped, one space between.
    OPT-5: with ``color_col`` the colour, cleaned like the others, comes last."""
    title = clean_field("product_title")
    brand = clean_field("product_brand")
    bullets = clean_field("product_bullet_point")

    def part(c):
        return F.when(c != "", c)

    text = F.concat_ws(" ", part(F.when(title != "", F.concat(title, F.lit(".")))), part(brand), part(bullets),
                       *([part(clean_field(color_col))] if color_col else []))
    return df.withColumn("product_text_dense", text)


def pair_view(df: DataFrame) -> DataFrame:
    """PRJ-2 (+PRJ-1, FLT-6): grades added, unmapped labels dropped, 10 columns."""
    graded = df.withColumn("grade", label_grade())
    return drop_unmapped_labels(graded).select(*PAIR_COLUMNS)


def bm25_title(col: str = "product_title"):
    """PRJ-4: title as string, null -> ''."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def instructed_query(col: str = "query", instruction: str = QUERY_INSTRUCTION):
    """PRJ-5: instruction prefix + query (products get none)."""
    return F.concat(F.lit(instruction), F.coalesce(F.col(col).cast("string"), F.lit("None")))


def training_pairs(pairs: DataFrame) -> DataFrame:
    """PRJ-6: (sentence_A = instructed query, sentence_B = product text)."""
    return (filter_training_positives(pairs)
            .select(instructed_query().alias("sentence_A"), F.col("product_text_dense").alias("sentence_B")))


# ---------------------------------------------------------------- leakage
def remove_train_test_overlap(df: DataFrame, by_locale: bool = False) -> DataFrame:
    """JN-2: queries judged in train and test for the same locale are found;
    their train rows are dropped in every locale (``by_locale=True``: only in
    that locale)."""
    keys = ["query_id", "product_locale"]
    train = df.where(F.col("split") == "train").select(*keys).distinct()
    test = df.where(F.col("split") == "test").select(*keys).distinct()
    overlap = train.join(test, keys, "left_semi")
    on = keys if by_locale else ["query_id"]
    flagged = overlap.select(*on).distinct().withColumn("__overlap", F.lit(True))
    # one pass over the rows: a left join to the (small) overlap id set
    out = df.join(flagged, on, "left")
    # a row with a null split is in neither split and stays
    drop = F.coalesce((F.col("split") == "train") & F.col("__overlap").isNotNull(), F.lit(False))
    return out.where(~drop).drop("__overlap").select(*df.columns)


# ---------------------------------------------------------------- dedup
def first_per_key(df: DataFrame, key: str, order_col: str = "example_id") -> DataFrame:
    """DST-1/DST-2: one row per key, the first by ``order_col`` (deterministic,
    unlike dropDuplicates)."""
    w = Window.partitionBy(key).orderBy(F.col(order_col).asc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def unique_products(pairs: DataFrame) -> DataFrame:
    return first_per_key(pairs, "product_id").select("product_id", "product_title", "product_text_dense")


def unique_queries(pairs: DataFrame) -> DataFrame:
    return first_per_key(pairs, "query_id").select("query_id", "query")


def distinct_query_ids(df: DataFrame) -> DataFrame:
    """DST-3."""
    return df.select("query_id").distinct()


# ---------------------------------------------------------------- sampling
def sample_queries(df: DataFrame, n: int, seed: int = 0, enabled: bool = True) -> DataFrame:
    """SMP-1: all rows of n query ids drawn without replacement.

    The draw orders distinct ids by md5(id:seed) -- repeatable, and the same
    order in any SQL engine. Off unless ``enabled``; a no-op with <= n ids.
    The picked ids are at most n rows; whether the semi join broadcasts them is
    left to their size."""
    if not enabled:
        return df
    ids = (df.select("query_id").distinct()
           .orderBy(F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.lit(str(seed)))))
           .limit(int(n)))
    return df.join(ids, "query_id", "left_semi")


# ---------------------------------------------------------------- profiles
def null_counts(df: DataFrame) -> DataFrame:
    """AGG-4: null count per column, one pass, long form (column, nulls)."""
    wide = df.select(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, nulls)")


def label_distribution(df: DataFrame, col: str = "esci_label") -> DataFrame:
    """AGG-5: value counts, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col))


def distinct_query_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """AGG-3: distinct queries in total, per locale and per split, long form
    (scope, key, queries). Exact ``count(distinct)`` per group, or a
    HyperLogLog++ sketch (``approximate``) when the id sets are huge."""
    def n():
        if approximate:
            return F.approx_count_distinct("query_id").cast("long").alias("queries")
        return F.count_distinct("query_id").alias("queries")
    total = df.agg(n()).select(F.lit("total").alias("scope"), F.lit("all").alias("key"), "queries")
    per_locale = df.groupBy("product_locale").agg(n()).select(
        F.lit("locale").alias("scope"), F.col("product_locale").alias("key"), "queries")
    per_split = df.groupBy("split").agg(n()).select(
        F.lit("split").alias("scope"), F.col("split").alias("key"), "queries")
    return reduce(DataFrame.unionByName, [total, per_locale, per_split])


PROFILE_PERCENTILES = (50, 75, 90, 95, 99)


def token_length_profile(df: DataFrame, text_col: str = "product_text_dense", length=None,
                         budget: int = TOKEN_BUDGET, approximate: bool = False) -> DataFrame:
    """AGG-6: mean/median/min/max and p50..p99 (linear interpolation) of a
    token count, each percentile marked Safe (<= budget) or Truncated.
    ``approximate=True`` uses percentile_approx for very large inputs."""
    n_tokens = (length if length is not None else token_count(text_col)).cast("double")
    ps = [p / 100.0 for p in PROFILE_PERCENTILES]
    n = F.col("n")
    if approximate:
        pct = F.percentile_approx(n, ps, 10000).cast("array<double>")
        med = F.percentile_approx(n, 0.5, 10000).cast("double")
    else:
        pct = F.percentile(n, F.array(*[F.lit(p) for p in ps]))
        med = F.percentile(n, F.lit(0.5))
    row = df.select(n_tokens.alias("n")).agg(
        F.avg("n").alias("mean"), med.alias("median"), F.min("n").alias("min"),
        F.max("n").alias("max"), pct.alias("pct"))
    stats = [F.struct(F.lit(name).alias("stat"), F.col(name).cast("double").alias("value"),
                      F.lit(None).cast("string").alias("status"))
             for name in ("mean", "median", "min", "max")]
    for i, p in enumerate(PROFILE_PERCENTILES):
        v = F.col("pct")[i]
        stats.append(F.struct(F.lit(f"p{p}").alias("stat"), v.alias("value"),
                              F.when(v <= budget, "Safe").otherwise("Truncated").alias("status")))
    return row.select(F.explode(F.array(*stats)).alias("s")).select("s.*")
