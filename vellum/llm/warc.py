"""Not-modified revisits resolved against the full responses of a web archive.

Records: ``record_id`` string, ``url`` string, ``date`` timestamp, ``kind`` string
(``response`` or ``revisit``), ``headers`` map of lower-case names, ``digest`` string.

A revisit is joined, as of its date, to the latest earlier response of the same
canonical URL (equal dates do not count as earlier; of several responses of one
date the greatest record id wins).  The validators the revisit
carries must agree: its ``etag`` (compared weakly, without ``W/``) when it has
one, else its ``last-modified``, and its payload digest when both have one.
The result takes the response's headers, updated by those of the revisit that a
304 may update (``UPDATABLE``).

The as-of join sorts by (canonical URL, date) over range partitions, so a URL with a
third of all records is spread over many tasks; each partition resolves its own
rows and takes the last response before its first row from a table with one row
per partition.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Headers of a 304 answer that replace those of the stored response; fields that
#: describe the stored body (its type, length, encoding) stay.
UPDATABLE = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that do not choose content.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid|jsessionid"


def canonical_url(url: Column) -> Column:
    """Key under which captures of a page meet: no scheme, fragment, user, ``www.``,
    default port, trailing slash or tracking parameter; host in lower case, the
    other parameters sorted.  Null stays null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)?$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per revisit: record_id, canonical_url, date, refers_to (the response's
    record id), status and headers.  status: ``resolved``; ``mismatch`` (a validator
    differs; headers are the revisit's own); ``no_response`` (no earlier one,
    or no URL or date).  Records of other kinds give no row, missing headers count
    as empty, repeated revisits give repeated rows, an empty table none."""
    spark = records.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    empty = F.create_map().cast("map<string,string>")
    r = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "date", "digest",
        (F.col("kind") == "revisit").alias("is_revisit"), F.coalesce("headers", empty).alias("headers"))
    # at one date revisits come before responses, which are not earlier
    r = r.withColumn("_r", -F.col("is_revisit").cast("int"))
    order = ["canonical_url", "date", "_r", "record_id"]
    r = cut(r.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()))
    response = F.when(~F.col("is_revisit") & F.col("date").isNotNull() & F.col("canonical_url").isNotNull(),
                      F.struct("record_id", "headers", "digest"))
    here = Window.partitionBy("_pid", "canonical_url").orderBy("date", "_r", "record_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_last", F.last(response, ignorenulls=True).over(here))
    # per partition: its last URL and the last response of it there
    tail = r.groupBy("_pid").agg(F.max("canonical_url").alias("url")).filter("url IS NOT NULL")
    ends = (r.filter("NOT is_revisit").join(F.broadcast(tail.withColumnRenamed("_pid", "_p")),
                                            (F.col("_pid") == F.col("_p")) & (F.col("canonical_url") == F.col("url")))
            .filter("date IS NOT NULL")
            .groupBy("_pid", "url").agg(F.max_by(F.struct("record_id", "headers", "digest"),
                                                 F.struct("date", "record_id")).alias("_carry")))
    # a URL that ends one partition and goes on: the newest carry before each partition
    ends = cut(ends)
    later = ends.select(F.col("_pid").alias("_from"), F.col("url").alias("_url"), "_carry")
    heads = r.select("_pid", "canonical_url").distinct().join(
        F.broadcast(later), (F.col("_url") == F.col("canonical_url")) & (F.col("_from") < F.col("_pid")))
    carried = heads.groupBy("_pid", "canonical_url").agg(F.max_by("_carry", "_from").alias("_carry"))
    carried = carried.select(F.col("_pid").alias("_p"), F.col("canonical_url").alias("_url"), "_carry")
    v = r.filter("is_revisit").join(F.broadcast(carried), (F.col("_pid") == F.col("_p")) & (F.col("canonical_url") == F.col("_url")), "left")
    got = F.coalesce("_last", "_carry")
    v = v.select("record_id", "canonical_url", "date", "digest", "headers",
                 F.when(F.col("date").isNotNull(), got).alias("_resp"))
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    same = F.when(etag.isNotNull(), _weak(etag).eqNullSafe(_weak(F.col("_resp.headers")["etag"]))) \
        .when(modified.isNotNull(), modified.eqNullSafe(F.col("_resp.headers")["last-modified"])).otherwise(F.lit(True))
    same = same & F.coalesce(F.col("digest") == F.col("_resp.digest"), F.lit(True))
    allowed = F.array(*map(F.lit, UPDATABLE))
    update = F.map_filter("headers", lambda k, _: F.array_contains(allowed, k))
    merged = F.map_concat(F.map_filter("_resp.headers", lambda k, _: ~F.map_contains_key(update, k)), update)
    found = F.col("_resp").isNotNull()
    return v.select("record_id", "canonical_url", "date", F.col("_resp.record_id").alias("refers_to"),
                    F.when(~found, "no_response").when(same, "resolved").otherwise("mismatch").alias("status"),
                    F.when(found & same, merged).otherwise(F.col("headers")).alias("headers"))
