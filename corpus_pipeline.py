"""The training-data pipeline: documents in, encoded documents out.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of ``documents``.  Nulls in any column, empty and very long
texts, repeated rows, empty tables and further columns (dropped) are accepted.
"""

import itertools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import langid, mixing, neardup, secrets
from vellum.llm.bpe import ByteBPE
from vellum.llm.common import cut, ready, table
from vellum.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The least score of a language that is believed.
LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with it as ``lang``.  Goes: texts that
    are null or have no letter, and texts that no learned language codes clearly
    best.  The language trees are learned from the labelled rows of ``docs``; where none
    has a label and a text, no language can be told, and every text with a letter stays, ``lang`` null."""
    ready(spark)
    model = langid.fit(docs)
    if not model.langs:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.lit(None).cast("string"))
    p = docs.select(*COLUMNS, langid.predict(spark, model, F.col("text")).alias("_p"))
    return p.filter((F.col("_p.lang") != langid.UNDETERMINED) & (F.col("_p.score") >= LANGUAGE_SCORE)).select(
        "doc_id", "text", F.col("_p.lang").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group of texts stays, that of the least id
    (five-word shingles, similarity 0.8).  Of rows that repeat id and text one stays, with the
    least lang, source and n_chars; an id with different texts keeps each that is the least of
    its group.  Rows without an id, and texts without words, are in no group and stay."""
    ready(spark)
    d = docs.select(*COLUMNS)
    twice = cut(d.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not (n := twice.count()):
        gone = neardup.near_duplicates(d, width=5).filter("NOT kept").select("doc_id")
        return d.join(gone, "doc_id", "left_anti")
    # of an id that repeats every text is a document of its own, under a name that no other row has
    few = F.broadcast(twice) if n <= neardup.BROADCAST_IDS else twice
    single, rest = d.join(few, "doc_id", "left_anti"), [c for c in COLUMNS if c not in ("doc_id", "text")]
    texts = cut(d.join(few, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_f")).select("doc_id", "text", "_f.*"))
    for seed in itertools.count():
        named = cut(texts.withColumn("_name", F.xxhash64(F.lit(seed), "doc_id", "text")))
        names = named.select("_name")
        if names.distinct().count() == names.count() and not single.join(names, F.col("doc_id") == F.col("_name"), "left_semi").limit(1).count():
            break
    every = single.select("doc_id", "text").unionByName(named.select(F.col("_name").alias("doc_id"), "text"))
    group = cut(neardup.near_duplicates(every, width=5).filter("doc_id IS NOT NULL").select("doc_id", "component_id"))
    owner = group.join(named.select(F.col("_name").alias("doc_id"), F.col("doc_id").alias("_owner")), "doc_id", "left") \
        .select("component_id", F.struct(F.coalesce("_owner", "doc_id"), "doc_id").alias("_k"))
    kept = owner.groupBy("component_id").agg(F.min("_k")["doc_id"].alias("_kept"))
    gone = cut(group.join(kept, "component_id").filter("doc_id != _kept").select(F.col("doc_id").alias("_name")))
    stay = single.join(gone, F.col("doc_id") == F.col("_name"), "left_anti")
    return stay.select(*COLUMNS).unionByName(named.join(gone, "_name", "left_anti").select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by a mark."""
    ready(spark)
    d = docs.select(*COLUMNS)
    found = secrets.find(d, secrets.train(spark, d))
    hit = F.size("_spans") > 0
    return found.select("doc_id", F.when(hit, secrets.redact(F.col("text"), F.col("_spans"))).otherwise(F.col("text")).alias("text"),
                        "lang", "source", "n_chars").withColumn("n_chars", F.when(
                            F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times).  The extra copy is
    drawn by all columns of a row, and by its number among equal rows."""
    ready(spark)
    d = docs.select(*COLUMNS)
    by = mixing.plan(d)
    rates = cut(by.select("source", "source_size", "target").distinct())
    few = rates.count() <= mixing.BROADCAST_SOURCES
    r = rates.withColumnRenamed("source", "_source")
    d, number = d.withColumn("_row", F.xxhash64(*COLUMNS)).withColumn("_n", F.lit(1).cast("long")), F.col("_n")
    twice = cut(d.groupBy("_row").count().filter("count > 1").select("_row"))
    if n := twice.count():
        # only rows that may repeat are compared and numbered
        held = F.broadcast(twice) if n <= neardup.BROADCAST_IDS else twice
        same = d.join(held, "_row", "left_semi").groupBy(*COLUMNS, "_row").count().withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
        d = d.join(held, "_row", "left_anti").select(*COLUMNS, "_row", "_n").unionByName(same.select(*COLUMNS, "_row", "_n"))
    j = d.join(F.broadcast(r) if few else r, F.col("source").eqNullSafe(F.col("_source")))
    key = F.concat_ws(":", mixing.draw_key(), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.col("_row").cast("string"), number.cast("string"))
    n = mixing.copies(F.col("target"), F.col("source_size"), key)
    return j.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids (packed little-endian unsigned 32-bit), with the
    proof that they decode to its text."""
    ready(spark)
    bpe = ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    e = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
                    bpe.encode(F.col("text")).alias("_e"))
    e = e.select("doc_id", "lang", "source", "text_sha256", F.col("_e.n_tokens").alias("n_tokens"), F.col("_e.ids").alias("ids"))
    return e.select("doc_id", "lang", "source", "n_tokens", "ids",
                    (F.sha2(bpe.decode(F.col("ids")), 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets),
          ("mix", mix_sources), ("encode", encode)]
#: Learned models and hash sketches are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet in the
    shared folder and read again as the next one's input."""
    ready(spark)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{i}-{name}")
            docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
