"""OPT-3: versioned artifacts. A manifest is published last.

A version is a set of tables, written in a folder of their own under a name that
no other write uses. Only when all of them are complete and counted, one row is
added to the manifests: version, hash of the configuration, model, time, and the
tables with their row counts. Spark adds that row by renaming a finished file, so
a reader sees all of a version or nothing of it; a job that fails or is repeated
before leaves a folder that no manifest names.

Readers choose a version (the newest, or the newest of a configuration or
model), then open its tables by name: all reads of a run come from one version,
whatever is published meanwhile. ``open_version`` compares the row counts.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, config_hash string, config string, model string, created timestamp, tables map<string,long>"


def config_text(config) -> str:
    """A configuration as text that does not depend on the order of its keys."""
    def plain(x):
        if is_dataclass(x):
            x = asdict(x) if not any(isinstance(v, Mapping) and not isinstance(v, dict) for v in vars(x).values()) else vars(x)
        if isinstance(x, Mapping):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x
    return json.dumps(plain(config), sort_keys=True, default=str)


def config_hash(config) -> str:
    return hashlib.sha256(config_text(config).encode()).hexdigest()


@dataclass(frozen=True)
class Version:
    name: str
    config_hash: str
    model: str
    created: dt.datetime
    tables: Mapping[str, int]


def write_version(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> tuple[str, dict[str, int]]:
    """Write the tables of a new version; (version, rows of each). Readers do
    not see it before ``publish_version``."""
    name = uuid.uuid4().hex
    counts = {}
    for table, df in tables.items():
        path = f"{root.rstrip('/')}/versions/{name}/{table}"
        df.write.parquet(path)
        counts[table] = spark.read.parquet(path).count()
    return name, counts


def publish_version(spark: SparkSession, root: str, name: str, counts: Mapping[str, int], config, model: str) -> Version:
    """Make a written version visible. Publishing it again changes nothing."""
    for known in versions(spark, root):
        if known.name == name:
            return known
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = (name, config_hash(config), config_text(config), model, now, dict(counts))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifests")
    return Version(name, row[1], model, now, dict(counts))


def versions(spark: SparkSession, root: str, config=None, model: str | None = None) -> list[Version]:
    """Published versions, oldest first: one row each, whatever they hold."""
    from rankforge.functions.models import path_exists
    path = f"{root.rstrip('/')}/manifests"
    if not path_exists(spark, path):
        return []
    df = spark.read.schema(MANIFEST).parquet(path)
    if config is not None:
        df = df.where(F.col("config_hash") == config_hash(config))
    if model is not None:
        df = df.where(F.col("model") == model)
    return [Version(r["version"], r["config_hash"], r["model"], r["created"], r["tables"]) for r in df.orderBy("created", "version").collect()]


def latest_version(spark: SparkSession, root: str, config=None, model: str | None = None) -> Version:
    found = versions(spark, root, config, model)
    if not found:
        raise ValueError(f"no published version at {root} for this configuration and model")
    return found[-1]


def open_version(spark: SparkSession, root: str, version: Version) -> dict[str, DataFrame]:
    """The tables of one version; raises if rows are missing."""
    out = {}
    for table, n in version.tables.items():
        df = spark.read.parquet(f"{root.rstrip('/')}/versions/{version.name}/{table}")
        if (got := df.count()) != n:
            raise ValueError(f"table {table} of version {version.name} has {got} rows, {n} were published")
        out[table] = df
    return out
