"""Personal data by patterns and by bootstrapped contexts, DataFrame functions only.

Base patterns, leftmost and non-overlapping per kind (fixed values of the
contract): email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone
(8 to 15 digits). Matches that fail their test are dropped.

Bootstrapping: base spans of all kinds are seeds, and other tokens with at least
two digits are instances; the word before one is its pattern. Spark scores the
pattern-instance graph in rounds: a pattern is as good as the instances it
extracts, an instance as good as the patterns that extract it. Patterns above
``confidence`` that were seen with ``support`` different seeds, or instances
that earlier rounds found worth ``confidence``, extract further identifiers anywhere (kind ``context``), unless they overlap a
base span. However many patterns are accepted, they stay a table: each row's
instances, with the words before them, are joined with it.

Offsets count code points. Odd input: null text counts as empty and has no
spans; repeated rows get equal spans; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone", "context")
# The contract's patterns, written so that they never backtrack over long runs:
# possessive repeats, and starts only where a run of their characters starts
# (or the last match ended).
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What may be an identifier after a context: six or more characters, two digits
# before the next separator. An instance holds no separator, so no instance
# hides another one. The word before it ends within the last TAIL characters.
_SEPARATORS = r"\s=:\"'(),;\[\]{}<>"
TWO_DIGITS = rf"(?=[A-Za-z0-9+])(?=[^{_SEPARATORS}0-9]*+[0-9][^{_SEPARATORS}0-9]*+[0-9])"
INSTANCE = rf"(?<=[{_SEPARATORS}]){TWO_DIGITS}[A-Za-z0-9+](?:[A-Za-z0-9._%+@-]*[A-Za-z0-9])"
CONTEXT = rf"(?:^|[^\p{{L}}\p{{N}}_])([\p{{L}}_]{{1,30}})[.,!?]?[{_SEPARATORS}]{{1,8}}$"
TAIL = 40  # a boundary, 30 letters, a mark and 8 separators
SPAN = "array<struct<start:int,end:int,word:string,value:string>>"


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    odd = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(2 * v > 9, 2 * v - 9).otherwise(2 * v)))
    return F.aggregate(odd, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), part)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """Spans of the matches that pass: the pieces between matches and the
    matches themselves alternate, so their lengths give the offsets. ``word`` is
    the word before the span in lower case, '' if there is none."""
    empty = F.array().cast(SPAN)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), empty.alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        before = F.substring(F.concat(acc["last"], pair["piece"]), -TAIL, TAIL)
        span = F.struct(start.alias("start"), end.alias("end"), F.lower(F.regexp_extract(before, CONTEXT, 1)).alias("word"),
                        pair["match"].alias("value"))
        own = F.when(_passes(kind, pair["match"]), F.array(span)).otherwise(empty)
        return F.struct(end.alias("at"), pair["match"].alias("last"), F.concat(acc["spans"], own).alias("spans"))

    pieces = lambda m: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
    pairs = lambda m: F.arrays_zip(pieces(m).alias("piece"), m.alias("match"))
    found = F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),  # binds the matches once
                        lambda m: F.when(F.size(m) > 0, F.aggregate(pairs(m), first, step, lambda a: a["spans"])).otherwise(empty))
    return F.get(found, F.lit(0))


def base_spans(text: Column) -> dict[str, Column]:
    return {"email": F.when(text.contains("@"), spans_of(text, EMAIL, "email")).otherwise(F.array().cast(SPAN)),
            "ip": spans_of(text, IP, "ip"), "card": spans_of(text, CARD, "card"),
            "phone": F.when(text.contains("+"), spans_of(text, PHONE, "phone")).otherwise(F.array().cast(SPAN))}


def joined(spans: list[tuple[str, Column]]) -> Column:
    texts = [F.transform(s, _written(kind)) for kind, s in spans]
    return F.array_join(F.concat(*texts), ",")


def _written(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


# ------------------------------------------------------------- bootstrapping
def edges_of(rows: DataFrame) -> DataFrame:
    """Distinct (pattern, value, seed): the base spans and the free instances
    of annotated rows, with the word before them. Spellings of one card or
    phone number are one value."""
    def edge(kind: str, seed: bool):
        value = lambda s: F.regexp_replace(s["value"], "[^0-9]", "") if kind in ("card", "phone") else s["value"]
        return lambda s: F.struct(s["word"].alias("pattern"), value(s).alias("value"), F.lit(seed).alias("seed"))

    spans = [F.transform(f"_rf_{k}", edge(k, True)) for k in KINDS[:4]] + [F.transform("_rf_free", edge("context", False))]
    return (rows.select(F.explode(F.concat(*spans)).alias("e")).select("e.*").where("pattern <> ''")
            .groupBy("pattern", "value").agg(F.max("seed").alias("seed")))


def context_patterns(rows: DataFrame, scratch: Scratch, rounds: int = 3, support: int = 5,
                     confidence: float = 0.8) -> DataFrame:
    """Context words that extract identifiers with high confidence: pattern,
    trust, seeds (and instances as good as seeds)."""
    edges = scratch.save(edges_of(rows), "edges")
    worth = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("worth", F.lit(0.0)))
    instances = None
    for k in range(rounds):
        known = edges.withColumn("worth", F.lit(0.0)) if instances is None else edges.join(instances, "value", "left")
        # two virtual bad instances keep rare patterns low
        patterns = known.groupBy("pattern").agg((F.sum(worth) / (F.count("*") + 2)).alias("trust"),
                                                F.sum((worth >= confidence).cast("int")).alias("seeds")).where(F.col("seeds") >= support)
        patterns = scratch.save(patterns, f"patterns-{k}")
        # an instance is wrong only if every pattern that extracts it is
        instances = (edges.where("NOT seed").join(patterns, "pattern").groupBy("value")
                     .agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.99)))))).alias("worth")))
    return patterns.where(F.col("trust") >= confidence)


# ------------------------------------------------------------- operator
def annotate(docs: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """``columns`` of every row, a row number, one span array per base kind and
    the instances that overlap no base span, as a written table: the row number
    stays as it is."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = base_spans(text)
    raw = F.when(text.rlike("[0-9]"), spans_of(text, INSTANCE, "context")).otherwise(F.array().cast(SPAN))
    out = docs.select(*columns, F.monotonically_increasing_id().alias("_rf_row"), *[c.alias(f"_rf_{k}") for k, c in base.items()], raw.alias("_rf_raw"))
    others = F.concat(*[F.col(f"_rf_{k}") for k in base])
    free = F.filter("_rf_raw", lambda s: (s["end"] - s["start"] >= 6) & (s["word"] != "") & ~F.exists(
        others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    return scratch.save(out.withColumn("_rf_free", free).drop("_rf_raw"), "rows")


def find(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row plus one span array per kind."""
    scratch = Scratch(docs.sparkSession)
    rows = annotate(docs, columns, scratch)
    patterns = context_patterns(rows, scratch)
    hits = (rows.select("_rf_row", F.explode("_rf_free").alias("s")).join(patterns.select("pattern"), F.col("s.word") == F.col("pattern"))
            .groupBy("_rf_row").agg(F.sort_array(F.collect_list("s")).alias("_rf_context")))
    return (rows.drop("_rf_free").join(hits, "_rf_row", "left").drop("_rf_row")
            .withColumn("_rf_context", F.coalesce("_rf_context", F.array().cast(SPAN))))


def learn(docs: DataFrame) -> list[str]:
    """The context words, best first, for a look at them; ``find`` does not
    collect them."""
    scratch = Scratch(docs.sparkSession)
    best = context_patterns(annotate(docs, [], scratch), scratch).orderBy(F.desc("trust"), F.desc("seeds"), "pattern").collect()
    scratch.drop()
    return [r["pattern"] for r in best]


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, digest of the base spans
    and all spans as text. Runs jobs to learn the contexts; the result is lazy."""
    found = find(docs, ["doc_id"])
    base = [(k, F.col(f"_rf_{k}")) for k in KINDS[:4]]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.size(s).cast("long").alias(f"n_{k}") for k, s in base],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined([*base, ("context", F.col("_rf_context"))]).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, where
    the table has it, is counted anew. Null texts stay null."""
    found = find(docs, docs.columns)
    marked = [F.transform(F.col(f"_rf_{k}"), _named(k)) for k in KINDS]
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))
        return new

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(F.array_sort(F.concat(*marked)), first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    spans = F.size(F.concat(*[F.col(f"_rf_{k}") for k in KINDS]))
    out = found.withColumn("_rf_text", F.when(text.isNull() | (spans == 0), text).otherwise(masked))
    columns = [F.col("_rf_text").alias(c) if c == "text" else
               F.when(spans > 0, F.length("_rf_text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
               else F.col(c) for c in docs.columns]
    return out.select(*columns)


def _named(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
