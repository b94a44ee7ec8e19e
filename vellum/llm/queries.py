"""Registered queries of this subpackage: one per operator, over whole tables.

Queries that answer per document give a row for every row: one without an id is answered like any other,
with a null id (its check sum is that of the empty text), and rows that repeat are answered each."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lexical, mixing, neardup, quality, rules, secrets, topk, trie, warc
from .bpe import ByteBPE
from .common import crc_mod, ready, table
from .token_counts import token_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.tiktoken"


def register(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return run
    return add


@register()
def op1_byte_bpe(spark, sf_dir):
    """Every document encoded, and decoded from its ids."""
    bpe = ByteBPE(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text")).alias("e"))
    coded = docs.select("doc_id", F.col("e.n_tokens").alias("n_tokens"), F.col("e.ids").alias("ids"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"))


def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the schema of archive records from the raw pages: each page was
    fetched in full twice, and asked for again three times, under spellings of its URL."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    capture = lambda n, kind, url, hours, etag, **more: F.struct(
        F.concat(F.col("page_id").cast("string"), F.lit(f"-{n}")).alias("record_id"), url.alias("url"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id") * 60 + 3600 * hours).alias("date"), F.lit(kind).alias("kind"),
        F.map_filter(F.create_map(*[x for k, v in {"etag": etag, **more}.items() for x in (F.lit(k.replace("_", "-")), v)]),
                     lambda _, v: v.isNotNull()).alias("headers"),
        (F.col("digest") if kind == "response" else F.lit(None).cast("string")).alias("digest"))
    url, old, tag = F.col("url"), F.substring("digest", 1, 8), F.col("digest")
    html, again = F.lit("text/html"), F.lit("max-age=60")
    return p.select(F.explode(F.array(
        capture(0, "response", url, 1, old, content_type=html, cache_control=F.lit("no-cache")),
        capture(1, "response", F.concat(url, F.lit("#again")), 3, tag, content_type=html, cache_control=F.lit("no-cache")),
        capture(2, "revisit", F.regexp_replace(url, "^http:", "https:"), 2, F.concat(F.lit("W/"), old), content_type=F.lit("text/plain"), cache_control=again),
        capture(3, "revisit", url, 4, old, cache_control=again),
        capture(4, "revisit", url, 0, F.lit(None).cast("string"), cache_control=again))).alias("r")).select("r.*")


@register(r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) digest FROM pages),
rec AS (
  SELECT page_id || '-0' record_id, url, page_id * 60 + 3600 t, 'response' kind, substr(digest, 1, 8) etag, 'text/html' ct, 'no-cache' cc FROM p
  UNION ALL SELECT page_id || '-1', url || '#again', page_id * 60 + 10800, 'response', digest, 'text/html', 'no-cache' FROM p
  UNION ALL SELECT page_id || '-2', regexp_replace(url, '^http:', 'https:'), page_id * 60 + 7200, 'revisit', 'W/' || substr(digest, 1, 8), 'text/plain', 'max-age=60' FROM p
  UNION ALL SELECT page_id || '-3', url, page_id * 60 + 14400, 'revisit', substr(digest, 1, 8), NULL, 'max-age=60' FROM p
  UNION ALL SELECT page_id || '-4', url, page_id * 60, 'revisit', NULL, NULL, 'max-age=60' FROM p),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') s FROM rec),
c AS (SELECT *,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(s, '^[^/?]*', 0)), '^[^@]*@', ''), ':(80|443)?$', ''), '^www[.]', '')
  || regexp_replace(regexp_extract(s, '^[^/?]*([^?]*)', 1), '/+$', '') host_path,
  list_sort(list_filter(string_split(regexp_extract(s, '[?](.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)'))) kept FROM u),
k AS (SELECT *, host_path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END canonical_url FROM c),
best AS (SELECT v.record_id, arg_max(r.record_id, (r.t, r.record_id)) refers_to
         FROM k v JOIN k r ON r.canonical_url = v.canonical_url AND r.t < v.t AND r.kind = 'response'
         WHERE v.kind = 'revisit' GROUP BY 1),
j AS (SELECT v.*, b.refers_to, r.etag r_etag, r.ct r_ct,
        coalesce(b.refers_to IS NOT NULL AND (v.etag IS NULL OR regexp_replace(v.etag, '^W/', '') = regexp_replace(r.etag, '^W/', '')), false) ok
      FROM k v LEFT JOIN best b USING (record_id) LEFT JOIN k r ON r.record_id = b.refers_to WHERE v.kind = 'revisit')
SELECT record_id, canonical_url, refers_to,
  CASE WHEN refers_to IS NULL THEN 'no_response' WHEN ok THEN 'resolved' ELSE 'mismatch' END status,
  CASE WHEN ok THEN coalesce(etag, r_etag) ELSE etag END etag, CASE WHEN ok THEN r_ct ELSE ct END content_type, cc cache_control
FROM j""")
def op2_revisits(spark, sf_dir):
    """Every revisit of the archive resolved, with the headers it ends with."""
    r = warc.resolve(archive_records(spark, sf_dir))
    return r.select("record_id", "canonical_url", "refers_to", "status", F.col("headers")["etag"].alias("etag"),
                    F.col("headers")["content-type"].alias("content_type"), F.col("headers")["cache-control"].alias("cache_control"))


def language_model(docs: DataFrame) -> "langid.Model":
    return langid.fit(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))


@register()
def op3_language(spark, sf_dir):
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    p = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
                    langid.predict(spark, language_model(docs), F.col("text")).alias("p"))
    return p.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@register()
def op4_quality(spark, sf_dir):
    """The quality score of every document; labels of one third are never seen."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 3) == 1
    good = table(spark, sf_dir, "labels").filter(~held).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    model = quality.fit(docs.filter(~held).select("doc_id", "text"), good)
    s = docs.select("doc_id", held.alias("held_out"), quality.score(spark, model, F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, gap)) AS n FROM (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8) AS gap FROM dup) GROUP BY 1),
m AS (SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CASE WHEN len(w) > 1 THEN len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i-1])) ELSE 0 END AS n_stutter
      FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 2 * n_dup_lines > n_lines OR 10 * n_stutter > 3 * n_words
       OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))
       OR len(string_split(text, '!!')) - 1 > 0.1 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b""")
def op5_rules(spark, sf_dir):
    """Counts and the cascade's verdict for every document."""
    return rules.judge(table(spark, sf_dir, "documents"))


@register(r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m.b, doc_id)) AS component_id, doc_id <= coalesce(m.b, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY 1) m USING (doc_id)""")
def op6_near_duplicates(spark, sf_dir):
    """The near-duplicate group of every document, on sets of 4-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@register("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op7_top_k(spark, sf_dir):
    """The 20 best rows for every twentieth row."""
    v = topk.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(v, v.filter("id % 20 = 0"), 20)


@register()
def op8_token_counts(spark, sf_dir):
    """Unigram token counts of every document."""
    c = token_counts(spark, F.col("text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.n_tokens", "c.n_pretokens")


@register()
def op9_secrets(spark, sf_dir):
    """The secrets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.train(spark, docs)).drop("text")
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.joined(F.col("_base")), 256).alias("base_sha256"), secrets.joined(F.col("_spans")).alias("spans"))


@register(r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, 3 * CAST(sum(size) AS BIGINT) AS cap,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(z) OVER () - coalesce(sum(cap) OVER before, 0) AS open, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS heavy
      FROM s WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(CAST(open AS DOUBLE) / CAST(heavy AS DOUBLE)) AS share FROM o),
t AS (SELECT source, z, least(CAST(cap AS DOUBLE), share * w) AS target FROM s, l),
j AS (SELECT d.doc_id, d.size, t.z, t.target, CASE WHEN t.z > 0 THEN t.target / t.z ELSE 0.0 END AS rate,
        CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(d.doc_id AS VARCHAR), ''))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j""")
def op10_mix(spark, sf_dir):
    """How much of every document the mix takes."""
    m = mixing.plan(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register(r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
      FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM x) WHERE len(w) >= m)),
h AS (SELECT DISTINCT rid, i, m, s FROM p SEMI JOIN x USING (m, s)),
n AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS place FROM h) GROUP BY 1),
k AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT rid, item_id FROM h JOIN x USING (m, s) WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)""")
def op11_decontaminate(spark, sf_dir):
    """The words of every document that lie in windows of benchmark items."""
    c = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@register(r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS length FROM t WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM f SEMI JOIN i USING (term) GROUP BY term), g),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // length)))) AS BIGINT) AS score
      FROM f JOIN i USING (term) JOIN w USING (term), g GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op12_lexical_search(spark, sf_dir):
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@register(r"""
WITH t AS (SELECT conv_id, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS m FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(m ORDER BY turn NULLS FIRST, sha256(CAST(strlen(m.role) AS VARCHAR) || ':' || m.role || m.text)) AS l FROM t GROUP BY conv_id),
z AS (SELECT conv_id, l, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, n: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 4 AS h FROM o),
c AS (SELECT z.conv_id, list_concat(coalesce(o.l[1:h], []), z.l[h + 1:]) AS l FROM z LEFT JOIN o ON o.conv_id = z.conv_id - z.conv_id % 20),
p AS (SELECT conv_id, len(l) AS n, unnest(generate_series(0, len(l))) AS depth, l FROM c),
v AS (SELECT l[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM v),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY 1),
n AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (path)),
a AS (SELECT x.path, count(*) FILTER (y.n_children = 0) AS n_leaves, CAST(sum(y.saved) AS BIGINT) AS saved_tokens
      FROM n x JOIN (SELECT n_children, saved, path[1:unnest(generate_series(0, depth))] AS up FROM n) y ON y.up = x.path GROUP BY 1)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM n JOIN a USING (path) LEFT JOIN (SELECT path, conv_id FROM n) q ON n.depth > 0 AND q.path = n.path[1:n.depth - 1]""")
def op13_prefix_trie(spark, sf_dir):
    """The nodes of the trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("digest")
