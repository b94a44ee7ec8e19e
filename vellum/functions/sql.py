"""SQL-callable vector functions (N2) and library search.

Spark 4 SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN expr``) are
inlined into the plan like any expression, so SQL users get the same
codegen'd arithmetic as the DataFrame API in :mod:`vellum.functions.vector`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import MAX_K, MIN_K

_DOT = "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
_SSQ_A = "aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"
_SSQ_B = "aggregate(b, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"

FUNCTIONS = {
    "vec_size": ("a ARRAY<FLOAT>", "INT", "size(a)"),
    "vec_norm": ("a ARRAY<FLOAT>", "DOUBLE", f"sqrt({_SSQ_A})"),
    "vec_dot": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", _DOT),
    # the finish function binds the sum of squares once (no per-component recomputation)
    "vec_normalize": ("a ARRAY<FLOAT>", "ARRAY<DOUBLE>",
                      "aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE), "
                      "s -> transform(a, x -> CASE WHEN s > 0 THEN CAST(x AS DOUBLE) / sqrt(s) "
                      "ELSE CAST(x AS DOUBLE) END))"),
    "cosine_sim": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
                   f"CASE WHEN {_SSQ_A} = 0 OR {_SSQ_B} = 0 THEN 0D "
                   f"ELSE {_DOT} / (sqrt({_SSQ_A}) * sqrt({_SSQ_B})) END"),
    "cosine_dist": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
                    f"1D - CASE WHEN {_SSQ_A} = 0 OR {_SSQ_B} = 0 THEN 0D "
                    f"ELSE {_DOT} / (sqrt({_SSQ_A}) * sqrt({_SSQ_B})) END"),
    "metadata_match": ("m MAP<STRING, STRING>, f MAP<STRING, STRING>", "BOOLEAN",
                       "forall(map_entries(coalesce(f, map())), e -> element_at(m, e.key) <=> e.value)"),
}


def register_sql_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the temporary SQL functions in ``spark``; returns their names."""
    names = []
    for name, (args, ret, body) in FUNCTIONS.items():
        fname = prefix + name
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {fname}({args}) RETURNS {ret} RETURN {body}")
        names.append(fname)
    return names


def register_search_function(spark: SparkSession, index_view: str, name: str = "search_library",
                             chunks_view: str | None = None) -> list[str]:
    """``name(library_id, query, k)`` as a SQL table function over the
    index view: exact top-k by ``(score desc, chunk_id)``.  A ``k`` outside the
    allowed range or a query of another dimension raises.  The constant bound on
    ``rank`` lets every task cut its rows before the shuffle.

    With ``chunks_view``, also ``name_text(library_id, query, k, filters)``: the
    same top-k with document, text and metadata, then filtered (a null map: no filter)
    as the search does; its rank is that before the filter.  A library that is not
    in the index has no rows.  Returns the names created."""
    top = f"""
        SELECT chunk_id, score, rank FROM (
            SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank
            FROM (SELECT chunk_id,
                         CASE WHEN size(vector) <> size(q) THEN CAST(raise_error('the query has another dimension') AS DOUBLE)
                              WHEN k < {MIN_K} OR k > {MAX_K} THEN CAST(raise_error('k is out of range') AS DOUBLE)
                              ELSE aggregate(zip_with(vector, q, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)
                                   * inv_norm
                                   * CASE WHEN aggregate(q, 0D, (s, x) -> s + x * x) > 0
                                          THEN 1D / sqrt(aggregate(q, 0D, (s, x) -> s + x * x)) ELSE 0D END END AS score
                  FROM {index_view} WHERE library_id = lib))
        WHERE rank <= {MAX_K} AND rank <= k"""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(lib STRING, q ARRAY<DOUBLE>, k INT)
        RETURNS TABLE (chunk_id STRING, score DOUBLE, rank INT) RETURN {top}""")
    if chunks_view is None:
        return [name]
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}_text(lib STRING, q ARRAY<DOUBLE>, k INT, f MAP<STRING, STRING>)
        RETURNS TABLE (rank INT, chunk_id STRING, document_id STRING, score DOUBLE, text STRING, metadata MAP<STRING, STRING>)
        RETURN SELECT t.rank, t.chunk_id, c.document_id, t.score, c.text, c.metadata
               FROM ({top}) t JOIN {chunks_view} c ON c.library_id = lib AND c.chunk_id = t.chunk_id
               WHERE forall(map_entries(coalesce(f, map())), e -> element_at(c.metadata, e.key) <=> e.value)""")
    return [name, f"{name}_text"]
