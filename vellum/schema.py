"""Table schemas of the corpus.

The corpus is three normalised tables keyed by ``library_id`` plus the index
tables a build derives from them.  Readers are always given these schemas;
nothing is inferred.  Positions (``doc_pos``, ``chunk_pos``) are orderable
longs, not necessarily dense: appends take ``max + 1``.
"""

from pyspark.sql import types as T

STR_MAP = T.MapType(T.StringType(), T.StringType(), valueContainsNull=True)
VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

LIBRARIES = T.StructType([
    T.StructField("library_id", T.StringType(), False),
    T.StructField("metadata", STR_MAP, True),
])

DOCUMENTS = T.StructType([
    T.StructField("library_id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("doc_pos", T.LongType(), True),
    T.StructField("metadata", STR_MAP, True),
])

CHUNKS = T.StructType([
    T.StructField("library_id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("chunk_pos", T.LongType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("embedding", VECTOR, True),
    T.StructField("metadata", STR_MAP, True),
])

# One row per indexed vector.  The raw vector is kept in float32 (as the
# reference's index does) together with 1/|v| in double, so a score is one
# double dot product times two scalars: no float32 rounding of the unit vector.
INDEX = T.StructType([
    T.StructField("library_id", T.StringType(), False),
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("vector", VECTOR, False),
    T.StructField("inv_norm", T.DoubleType(), False),
    T.StructField("build_id", T.LongType(), False),
])

# One row per indexed library, including libraries whose index is empty.
INDEX_META = T.StructType([
    T.StructField("library_id", T.StringType(), False),
    T.StructField("dim", T.IntegerType(), True),
    T.StructField("n", T.LongType(), False),
    T.StructField("build_id", T.LongType(), False),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("library_id", T.StringType(), True),
    T.StructField("embedding", VECTOR, True),
    T.StructField("k", T.IntegerType(), True),
    T.StructField("filters", STR_MAP, True),
])

HITS = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
])

# Nested snapshot: map<library id, library> as written by the reference's
# persistence layer (inner ids undashed, top-level keys dashed).
SNAP_CHUNK = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("document_id", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("metadata", STR_MAP, True),
])
SNAP_DOCUMENT = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("chunks", T.ArrayType(SNAP_CHUNK), True),
    T.StructField("metadata", STR_MAP, True),
])
SNAP_LIBRARY = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("documents", T.ArrayType(SNAP_DOCUMENT), True),
    T.StructField("metadata", STR_MAP, True),
])
SNAPSHOT = T.MapType(T.StringType(), SNAP_LIBRARY)

# Defaults and bounds fixed by the reference's request schema.
DEFAULT_K = 5
MAX_K = 100
MIN_K = 1
DEFAULT_LEAF_SIZE = 40
