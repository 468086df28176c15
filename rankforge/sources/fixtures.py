"""Fixture views derived from the driver tables.

Each view is one SQL text that runs unchanged in Spark SQL and in DuckDB, so
both engines see the same judgments, products, queries and vectors. They
stand in for the raw shopping-query tables (see FIXTURES.md):

* ``fx_queries``   every distinct part name is a query; every 5th is test.
* ``fx_examples``  judged (query, part) pairs. A pair is judged when
  ``(p_partkey * 31 + query_id * 17) % 40 = 0``; since 31 is invertible mod 40
  that is the equi-join ``p_partkey % 40 = (query_id * 33) % 40`` (no theta
  join). Labels: same name E, same noun S, same adjective C, else I. Rows of
  every 10th query are copied into the other split (leakage to remove).
* ``fx_products``  product table from ``part`` with the dirty cases the field
  cleaner must handle and some products missing (left-join misses).
* ``fx_vec_queries`` / ``fx_vec_products`` / ``fx_vec_qrels``  the embedding
  table split into queries (every 25th id) and products; graded judgments
  from the circular label distance (0 E, 1 S, 2 C), built as five equi-joins.
* ``fx_doc_queries``  the benchmark items, whole text, as queries over the
  documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

_VEC_QRELS_PART = """
SELECT q.query_id, p.product_id, CAST({grade} AS DOUBLE) AS grade
FROM fx_vec_queries q JOIN fx_vec_products p ON p.label = (q.label + {off} + 10) % 10"""

FIXTURE_SQL: dict[str, str] = {
    "fx_queries": """
SELECT query, query_id, CASE WHEN query_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM (SELECT p_name AS query, CAST(dense_rank() OVER (ORDER BY p_name) AS BIGINT) AS query_id
      FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL) d) r""",
    "fx_examples_base": """
SELECT CAST(q.query_id * 1000000 + p.p_partkey AS BIGINT) AS example_id,
       q.query, q.query_id,
       CAST(p.p_partkey AS STRING) AS product_id,
       CASE WHEN p.p_partkey % 7 = 0 THEN 'es' ELSE 'us' END AS product_locale,
       CASE WHEN p.p_name = q.query THEN 'E'
            WHEN split_part(p.p_name, ' ', 2) = split_part(q.query, ' ', 2) THEN 'S'
            WHEN split_part(p.p_name, ' ', 1) = split_part(q.query, ' ', 1) THEN 'C'
            ELSE 'I' END AS esci_label,
       CASE WHEN p.p_partkey % 11 = 0 THEN 0 ELSE 1 END AS small_version,
       q.split
FROM fx_queries q JOIN part p ON p.p_partkey % 40 = (q.query_id * 33) % 40""",
    "fx_examples": """
SELECT example_id, query, query_id, product_id, product_locale, esci_label, small_version, split
FROM fx_examples_base
UNION ALL
SELECT -example_id AS example_id, query, query_id, product_id, product_locale, esci_label,
       small_version, CASE WHEN split = 'test' THEN 'train' ELSE 'test' END AS split
FROM fx_examples_base WHERE query_id % 10 = 0""",
    "fx_products": """
SELECT CAST(p_partkey AS STRING) AS product_id,
       CASE WHEN p_partkey % 7 = 0 THEN 'es' ELSE 'us' END AS product_locale,
       CASE WHEN p_partkey % 19 = 0 THEN concat('  ', p_name, ' ') ELSE p_name END AS product_title,
       CASE WHEN p_partkey % 13 = 0 THEN NULL
            WHEN p_partkey % 17 = 0 THEN 'None' ELSE p_brand END AS product_brand,
       p_type AS product_bullet_point
FROM part WHERE p_partkey % 23 <> 0""",
    "fx_vec_queries": """
SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 25 = 0""",
    "fx_vec_products": """
SELECT vec_id AS product_id, embedding, label FROM embeddings WHERE vec_id % 25 <> 0""",
    "fx_vec_qrels": " UNION ALL ".join(
        _VEC_QRELS_PART.format(grade=g, off=o)
        for o, g in ((0, "1.0"), (1, "0.1"), (-1, "0.1"), (2, "0.01"), (-2, "0.01"))),
    "fx_doc_queries": """
SELECT item_id AS query_id, text AS query FROM benchmark""",
}

# views each fixture needs, in creation order
_DEPENDS = {
    "fx_queries": (),
    "fx_examples_base": ("fx_queries",),
    "fx_examples": ("fx_examples_base",),
    "fx_products": (),
    "fx_vec_queries": (),
    "fx_vec_products": (),
    "fx_vec_qrels": ("fx_vec_queries", "fx_vec_products"),
    "fx_doc_queries": (),
}


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n):
        for d in _DEPENDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return order


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix a query with the fixture views it reads, as CTEs (DuckDB side)."""
    order = _closure(names)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture view as a DataFrame (its inputs registered first)."""
    order = _closure([name])
    needed = set()
    for n in order:
        for t in BASE_TABLES:
            if t in FIXTURE_SQL[n]:
                needed.add(t)
    register_tables(spark, sf_dir, sorted(needed))
    for n in order:
        spark.sql(FIXTURE_SQL[n]).createOrReplaceTempView(n)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
