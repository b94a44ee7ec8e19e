"""Secret scans: fixed patterns, and a character Markov model for the rest.

Two first-order Markov models over the characters of ``ALPHABET``, one of random
strings and one of ordinary identifiers, are counted from labelled samples; a
run of at least ``RUN`` such characters is a secret when the log-likelihood
ratio of random to ordinary, per transition, is at least ``THRESHOLD`` and the run has
``DISTINCT`` different characters.  The labelled samples are: for random strings,
encoded digests of several alphabets, and the values the fixed patterns find
in the sampled texts; for identifiers, the other runs of those texts, and their
words joined by capitals, underscores, hyphens and slashes.

Everything is built-in expressions.  Regular expressions give matches but no
places, so a text is split by the pattern as well: the lengths of the pieces and of
the matches, added up, are the places.  All places count code points, the end
exclusive.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sampled
from .rules import let

#: Fixed values of the task.  The group-2 value of an assignment counts from 8
#: characters on; an access key from 16; a hex run from 32.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = 20
RUNS = "[A-Za-z0-9+/_=-]{%d,}"
DISTINCT = 8
THRESHOLD = 0.75
#: Rows of the sample of texts, about, and digests per alphabet.
SAMPLE_ROWS = 1000
RANDOM_STRINGS = 2000
#: Rows of the sample whose words are also joined as in identifiers.
COMPOUND_ROWS = 200

#: Items of a run of a long array, and characters of a page of a long text.
RUN_ITEMS = 500
PAGE = 4096

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _before(values: Column, add) -> Column:
    """For each of ``values`` (whole numbers) the fold of all before it, from 0.  In two levels: within runs of
    ``RUN_ITEMS``, and over the runs, as an array that grows by one copies itself each time."""
    def fold(items: Column, start: Column) -> Column:
        return F.aggregate(items, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
                           lambda acc, v: F.struct(add(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
                           lambda acc: acc["out"])

    cut = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN_ITEMS).cast("int")),
                                            lambda i: F.slice(v, i * RUN_ITEMS + 1, F.lit(RUN_ITEMS))))
    whole = let(cut, lambda runs: let(
        F.transform(runs, lambda r: F.aggregate(r, F.lit(0), add)),
        lambda tops: F.flatten(F.zip_with(runs, fold(tops, F.lit(0)), fold))))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, kind: int, good=None) -> Column:
    """Spans of the matches of ``pattern``; ``good(match number)`` may drop some."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda a: F.transform(a, lambda x: F.char_length(x))
    found = let(F.struct(size(F.split(text, pattern, -1)).alias("gaps"), size(matches).alias("sizes")), lambda x: let(
        _before(F.transform(x["sizes"], lambda n, i: n + F.get(x["gaps"], i)), lambda a, v: a + v),
        lambda at: F.transform(x["sizes"], lambda n, i: F.struct(
            (F.get(at, i) + F.get(x["gaps"], i)).alias("start"), F.lit(kind).alias("kind"), (F.get(at, i) + F.get(x["gaps"], i) + n).alias("end")))))
    if good is not None:
        found = F.filter(found, lambda s, i: good(i))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans, each kind leftmost and non-overlapping."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.when(text.rlike(ASSIGN), let(values, lambda v: _spans(
        text, ASSIGN, 0, lambda i: F.char_length(F.get(v, i)) >= ASSIGN_VALUE))).otherwise(F.array().cast(_SPANS))
    return F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def _transitions(strings: DataFrame) -> np.ndarray:
    """Counts of character pairs of column ``s``; the result is at most one row
    per pair of the alphabet."""
    pairs = strings.filter(F.char_length("s") > 1).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("s") - 1), lambda i: F.col("s").substr(i, F.lit(2)))).alias("pair"))
    out = np.zeros((len(ALPHABET), len(ALPHABET)))
    for row in pairs.groupBy("pair").count().collect():
        out[ALPHABET.index(row["pair"][0]), ALPHABET.index(row["pair"][1])] = row["count"]
    return out


def train(spark: SparkSession, docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[float]:
    """Log ratios of transition probabilities, row by row of the alphabet, the
    diagonal square of ``len(ALPHABET)`` squared numbers.  An empty table leaves the
    identifiers uniform.  The same rows in another order or partitioning give the same ratios."""
    sample = cut(sampled(docs.select("doc_id", "text"), rows).filter("text IS NOT NULL").select("text"))
    digest = spark.range(RANDOM_STRINGS).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    plain = F.regexp_replace(b64, "[^A-Za-z0-9]", "")
    random = digest.select(F.explode(F.array("h", F.upper("h"), b64, F.translate(b64, "+/", "-_"), plain, F.upper(plain))).alias("s"))
    values = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= ASSIGN_VALUE)
    known = sample.select(F.explode(F.concat(values, *(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (ACCESS, HEX)))).alias("s"))
    known = known.select(F.explode(F.regexp_extract_all("s", F.lit(RUNS % 16), F.lit(0))).alias("s"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = sample.select(F.explode(F.regexp_extract_all(bare, F.lit(RUNS % 4), F.lit(0))).alias("s"))
    # words joined the ways identifiers are
    line = F.explode(F.split("text", "\n"))
    lines = sample.orderBy(F.xxhash64("text"), "text").limit(COMPOUND_ROWS).select(line.alias("x"))
    camel = F.regexp_replace(F.initcap(F.regexp_replace("x", "[^A-Za-z]+", " ")), " ", "")
    snake = F.regexp_replace(F.lower("x"), "[^a-z]+", "_")
    compound = lines.select(F.explode(F.array(camel, snake, F.upper(snake), F.translate(snake, "_", "-"),
                                              F.translate(snake, "_", "/"))).alias("s"))
    log = []
    for strings in (random.unionByName(known), ordinary.unionByName(compound)):
        n = _transitions(strings) + 0.5
        log.append(np.log(n / n.sum(1, keepdims=True)))
    return (log[0] - log[1]).ravel().tolist()


def model_spans(text: Column, ratios: list[float]) -> Column:
    """Runs that the models call random."""
    table, a = F.lit(np.array(ratios)), len(ALPHABET)

    def is_random(run: Column) -> Column:
        codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        return let(codes, lambda c: (F.size(F.array_distinct(c)) >= DISTINCT) & (F.aggregate(
            F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0),
            lambda s, i: s + F.get(table, F.get(c, i) * a + F.get(c, i + 1))) >= THRESHOLD * (F.size(c) - 1)))

    runs = F.regexp_extract_all(text, F.lit(RUNS % RUN), F.lit(0))
    return F.when(text.rlike(RUNS % RUN), let(runs, lambda r: _spans(
        text, RUNS % RUN, 3, lambda i: is_random(F.get(r, i))))).otherwise(F.array().cast(_SPANS))


def _rebuilt(text: Column, spans: Column, instead) -> Column:
    """``text`` with every span replaced: ``instead(start, end, done)`` stands for a span from ``start``
    to ``end`` whose characters before ``done`` earlier spans have replaced.  The text is cut into pages
    once, so that a place is found without reading the text from its start."""
    def part(pages: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PAGE).cast("int"), F.floor(b / PAGE).cast("int")
        page = lambda i: F.coalesce(F.get(pages, i), F.lit(""))
        return F.when(first == last, page(first).substr(a % PAGE + 1, b - a)).otherwise(F.concat(
            page(first).substr(a % PAGE + 1, F.lit(PAGE)), F.array_join(F.slice(pages, first + 2, last - first - 1), ""),
            page(last).substr(F.lit(1), b % PAGE)))

    def put(x: Column) -> Column:
        done = _before(F.transform(x["spans"], lambda s: s["end"]), lambda a, v: F.greatest(a, v))
        pieces = let(done, lambda at: F.transform(x["spans"], lambda s, i: F.concat(
            F.when(s["start"] > F.get(at, i), part(x["pages"], F.get(at, i), s["start"])).otherwise(F.lit("")), instead(s["start"], s["end"], F.get(at, i)))))
        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), part(x["pages"], end, x["length"]))

    pages = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PAGE), F.lit(0))
    made = let(F.struct(pages.alias("pages"), spans.alias("spans"), F.char_length(text).alias("length")), put)
    return F.when(F.size(spans) > 0, made).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks at all places of ``spans`` (by start): places stay."""
    return _rebuilt(text, spans, lambda start, end, done: F.repeat(F.lit(" "), F.greatest(F.lit(0), end - F.greatest(start, done))))


def find(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``, arrays of (start, kind, end) by start,
    then kind; kinds number ``KINDS``.  A null text has none.  The
    models judge what the fixed spans leave: a run is cut at them, and each piece of
    ``RUN`` characters or more is a run of its own.  Row by row; other columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_base", F.sort_array(base_spans(text)))
    more = let(blanked(text, F.col("_base")), lambda t: model_spans(t, ratios))
    return d.withColumn("_spans", F.sort_array(F.concat("_base", more)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    return _rebuilt(text, spans, lambda start, end, done: F.when(start >= done, F.lit(mark)).otherwise(F.lit("")))
