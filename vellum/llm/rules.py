"""Quality rules in a short-circuit cascade, all in built-in expressions.

A rule is a named boolean column that is true for rows to reject.  The order
of evaluation is planned, not fixed: every rule is timed from the raw text on a
bounded sample drawn by a hash, and the rule of most rejections per second of cost comes first; rejections
of the next are counted among the rows that the earlier ones pass.  The verdict is one CASE chain, so a row stops at the first rule that rejects
it.  The order changes the cost only, never the verdict.
"""

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sampled, words

#: Rows of the sample on which rules are timed, about.
SAMPLE_ROWS = 2000
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words covered by windows found twice or more; ``hashes``: one per window."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = let(placed, lambda p: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(p) - 1),
                 lambda j: F.coalesce(F.get(p, j)["h"] == F.get(p, j - 1)["h"], F.lit(False))
                 | F.coalesce(F.get(p, j)["h"] == F.get(p, j + 1)["h"], F.lit(False))),
        lambda j: F.get(p, j)["i"]))
    # each such window covers the words up to the next one, WINDOW at most
    covered = let(F.sort_array(again), lambda a: F.aggregate(
        F.transform(a, lambda x, k: F.coalesce(F.least(F.get(a, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda s, x: s + x))
    return F.when((n > WINDOW) & (F.size(F.array_distinct(hashes)) < F.size(hashes)), covered).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``text`` (null as empty) and the counts the rules use:

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a
    word), n_dup_lines (lines with a word equal to an earlier line), n_stutter
    (words equal to the word before) and n_repeat_words (words in 8-word windows found twice or more; windows are
    compared by 64-bit hash).  An empty or null text has zeros everywhere.
    Row by row: repeated rows and empty tables need no care; other columns of
    ``docs`` are left behind."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(*keep, t.alias("text")).select(*keep, "text", words(F.col("text")).alias("_w"), lines.alias("_l"))
    n = F.size("_w")
    d = d.select(*keep, "text", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"), n.cast("long").alias("n_words"),
                 F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                 F.char_length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                 F.size("_l").cast("long").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    stutter = F.when(F.size("_h") > 1, F.size(F.filter(F.zip_with(F.slice("_h", 2, F.size("_h")), "_h", lambda a, b: a == b),
                                                       lambda x: x))).otherwise(F.lit(0))
    windows = F.when(F.size("_h") > WINDOW, let(F.col("_h"), lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))) \
        .otherwise(F.array().cast("array<bigint>"))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    d = d.select(*keep, "text", *counts, stutter.cast("long").alias("n_stutter"), windows.alias("_win"))
    return d.select(*keep, "text", *counts, "n_stutter", _repeat_words(F.col("_win"), F.col("n_words")).alias("n_repeat_words"))


#: The base rules every document is held to, over the columns of :func:`measure`.
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def default_rules() -> dict[str, Column]:
    """Rules beyond the base, over the columns of :func:`measure`; each is true
    for a text to reject."""
    letters = lambda cls: F.char_length(F.regexp_replace("text", cls, ""))
    return {
        "symbols": F.expr("10 * n_symbols > 2 * n_words"),
        "shouting": 2 * letters("[^A-Z]+") > letters("[^A-Za-z]+"),
        "exclaiming": F.size(F.split("text", "!!")) - 1 > 0.1 * F.col("n_words"),
        "duplicate_lines": F.expr("2 * n_dup_lines > n_lines"),
        "stutter": F.expr("10 * n_stutter > 3 * n_words"),
        "word_length": F.expr("word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    }


@dataclass
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def plan(sample: DataFrame, rules: dict[str, Column]) -> list[Estimate]:
    """The order of the rules, from a bounded ``sample`` of (doc_id, text), already written.

    A rule costs what it adds to the counts that every row needs anyway, from the raw text on.  Rejections are those
    among rows that the base rules and the rules before pass.  With an empty sample the given order stands."""
    every = measure(sample)
    base = [F.sum(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    rejects = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}

    def cost(*more: Column) -> float:
        best = float("inf")
        for _ in range(2):                     # the second run finds the code compiled
            began = time.perf_counter()
            every.agg(*base, *more).collect()
            best = min(best, time.perf_counter() - began)
        return best

    idle = cost()
    seconds = {name: max(cost(F.count_if(r)) - idle, 1e-4) for name, r in rejects.items()}
    left = cut(every.filter(f"NOT ({BASE_FAILED})").select(*[r.alias(f"_{i}") for i, r in enumerate(rejects.values())]))
    total, order, names = max(left.count(), 1), [], list(rules)
    while names:
        hits = left.agg(*[F.count_if(f"_{list(rules).index(n)}") for n in names]).first()
        found = [Estimate(n, seconds[n] / total, h / total) for n, h in zip(names, hits)]
        order.append(max(found, key=lambda e: e.worth))
        names.remove(order[-1].name)
        left = left.filter(~F.col(f"_{list(rules).index(order[-1].name)}"))
    return order


def cascade(rules: dict[str, Column], order: list[Estimate]) -> Column:
    """True for rows that no rule rejects; a rule that yields null rejects nothing."""
    verdict = F
    for e in order:
        verdict = verdict.when(rules[e.name], F.lit(False))
    return verdict.otherwise(F.lit(True)) if order else F.lit(True)


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """:func:`measure` of (doc_id, text) with ``base_failed`` and ``kept``.  Rows are judged one by one, ones that repeat
    or have no id like any other."""
    rules = default_rules() if rules is None else rules
    sample = cut(sampled(docs.select("doc_id", "text"), sample_rows))
    failed = F.expr(BASE_FAILED)
    return measure(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(cascade(rules, plan(sample, rules))).alias("kept"))
