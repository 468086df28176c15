"""SRC-1: scans with a declared schema, checked against what the files hold.

The file footers tell the columns that are there; the declared ``StructType``
tells those that should be. A missing column is read as nulls, an extra one is
not read, a column of another type is cast with ``try_cast``. A row is bad where
a value does not survive its cast or a required column is null. One scan counts
all findings; a column of the declared type stays a plain column, so filters and
column pruning reach the files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Scan:
    rows: DataFrame      # the declared columns of the good rows
    bad_rows: DataFrame  # the declared columns as they are in the files, and `problems`
    report: DataFrame    # column, status, found_type, declared_type, n_bad


def checked_scan(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = (), drop_bad: bool = True) -> Scan:
    """A scan of the Parquet files in ``path`` as ``schema``. Lazy but for the
    footers. ``drop_bad=False`` keeps bad rows, with null for what is bad."""
    raw = spark.read.parquet(path)
    there = {f.name: f.dataType for f in raw.schema}
    values: dict[str, Column] = {}
    problem: dict[str, Column] = {}
    status: list[tuple[str, str, str | None, str | None]] = []
    for f in schema:
        col, declared = F.col(f"`{f.name}`"), f.dataType.simpleString()
        found = there.get(f.name)
        if found is None:
            values[f.name] = F.lit(None).cast(f.dataType)
            status.append((f.name, "missing", None, declared))
        elif found == f.dataType:
            values[f.name] = col
            status.append((f.name, "as declared", declared, declared))
        else:
            values[f.name] = col.try_cast(f.dataType)
            problem[f.name] = col.isNotNull() & values[f.name].isNull()
            status.append((f.name, "another type", found.simpleString(), declared))
        if f.name in required:
            lacks = values[f.name].isNull()
            problem[f.name] = problem[f.name] | lacks if f.name in problem else lacks
    status += [(name, "extra", t.simpleString(), None) for name, t in there.items() if name not in schema.fieldNames()]
    selected = [c.alias(n) for n, c in values.items()]
    if problem:
        problems = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in problem.items()]))
        bad = F.lit(False)
        for p in problem.values():
            bad = bad | p
        rows = (raw.where(~bad) if drop_bad else raw).select(*selected)
        as_found = [F.col(f"`{n}`").alias(n) if n in there else F.lit(None).alias(n) for n in schema.fieldNames()]
        bad_rows = raw.where(bad).select(*as_found, problems.alias("problems"))
    else:
        rows = raw.select(*selected)
        bad_rows = rows.limit(0).withColumn("problems", F.array().cast("array<string>"))
    counts = raw.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(p).alias(f"bad_{i}") for i, p in enumerate(problem.values())])
    number = {n: f"bad_{i}" for i, n in enumerate(problem)}
    told = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(s).alias("status"), F.lit(a).cast("string").alias("found_type"),
                              F.lit(d).cast("string").alias("declared_type"), (F.col(number[n]) if n in number else F.lit(0)).cast("long").alias("n_bad"))
                     for n, s, a, d in status])
    report = counts.select(F.explode(told).alias("r")).select("r.*")
    return Scan(rows, bad_rows, report)
