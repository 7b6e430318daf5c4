"""Quality rules as a short-circuit cascade.

Each rule rejects a text by a few of its statistics. `order_rules` estimates every rule's cost and what it rejects on a
bounded sample and sorts the rules by rejections per second; `cascade` then evaluates them in that order and stops at
the first that rejects, so that the statistics of later rules aren't computed. The order changes the cost alone: a text
is kept if no rule rejects it. `reasons` names all rules that reject a text, whatever the order.

A rule's cost is the time of a job that evaluates it REPEATS times over the sample, less that of the same job without a
rule, so that a job's start and the splitting into words don't count.

Edge cases: a null text is the empty text, which has no words and is rejected by `few_words`; ties and repeated rows
are judged each on its own; an empty table gives no rows and keeps the rules in the order given; other columns stay as
they are, but for a column `rejected`, which is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let, words

#: Rows of the sample on which costs and rejections are estimated; nothing else is taken from a sample.
SAMPLE_ROWS = 400
#: Longer texts aren't taken into the sample, which goes through the driver; a rule's cost grows with a text's length as any other's.
SAMPLE_CHARS = 1_000_000
#: Characters that a job evaluates for a rule's cost, by repeating the sample.
COST_CHARS = 4_000_000
REPORTED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(w: Column, width: int = 3) -> Column:
    """Words that lie in a window of `width` words found twice or more."""

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h))
        starts = F.sort_array(F.transform(again, lambda x: x.i))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x))

    def from_hashes(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))

    at = F.sequence(F.lit(0), F.size(w) - width)
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
    return F.when(F.size(w) > width, let(hashes, from_hashes)).otherwise(F.lit(0))


def stat_columns(text: Column, w: Column) -> dict[str, Column]:
    """The statistics of a text and of its words, each an expression of its own."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit("\x20\t\n\x0b\x0c\r"))) > 0)
    kept = lambda chars: F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": kept("#*$%&|<>"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w).cast("long"),
        "n_upper": kept("A-Z"),
        "n_lower": kept("a-z"),
    }


@dataclass(frozen=True)
class Rule:
    """A condition over a struct of the statistics it names; a text for which it is true is rejected."""

    name: str
    stats: tuple[str, ...]
    rejects: Callable[[Column], Column]

    def over(self, stats: Mapping[str, Column]) -> Column:
        return let(F.struct(*(stats[x].alias(x) for x in self.stats)), self.rejects)


#: Thresholds are production parameters.
RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda s: s.n_words < 50),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
    Rule("symbols", ("n_symbols", "n_words"), lambda s: 10 * s.n_symbols > s.n_words),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda s: 2 * s.n_dup_lines > s.n_lines),
    Rule("capitals", ("n_upper", "n_lower"), lambda s: s.n_upper > s.n_lower),
    Rule("word_length", ("word_chars", "n_words"), lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 20 * s.n_words)),
)
BASE_RULES = ("few_words", "repeated_windows")


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by rejections per second, both estimated on the first `sample_rows` texts that Spark delivers."""
    # collect() on a limit reads partitions one after another until it has its rows; any other use would gather that many of every partition
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.length("t") <= SAMPLE_CHARS).limit(sample_rows).collect()
    if not texts:
        return list(rules)
    repeats = max(1, COST_CHARS // max(1, sum(len(r.t) for r in texts)))
    rows = docs.sparkSession.createDataFrame(pa.table({"t": [r.t for r in texts]})).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    # The text depends on the repeat, or Spark would evaluate a rule once and then repeat its result.
    sample = rows.select("t", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("k")).select(F.when(F.col("k") > 0, F.col("t")).alias("t"))

    def timed(condition: Callable[[Column], Column]) -> tuple[int, float]:
        began = time.perf_counter()
        n = sample.filter(let(words(F.col("t")), condition)).count()
        return n, time.perf_counter() - began

    def alone(rule: Rule) -> Callable[[Column], Column]:
        return lambda w: rule.over(stat_columns(F.col("t"), w))

    timed(lambda w: F.size(w) >= 0)  # warms up
    empty, gain = timed(lambda w: F.size(w) >= 0)[1], {}
    for rule in rules:
        rejected, took = timed(alone(rule))
        gain[rule.name] = rejected / repeats / len(texts) / max(took - empty, 0.01)
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(rules: Sequence[Rule], stats: Mapping[str, Column]) -> Column:
    """Whether any rule rejects; rules after the first that does aren't evaluated."""
    verdict = None
    for rule in rules:
        verdict = F.when(rule.over(stats), True) if verdict is None else verdict.when(rule.over(stats), True)
    return verdict.otherwise(False) if verdict is not None else F.lit(False)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with rejected: whether any rule rejects the text."""
    ordered = order_rules(docs, rules, text, sample_rows)
    whole = F.coalesce(F.col(text), F.lit(""))
    # One expression, its words bound once: a filter pushed below it must not split the text anew for every word.
    return docs.withColumn("rejected", let(words(whole), lambda w: cascade(ordered, stat_columns(whole, w))))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with their columns as they are."""
    ordered = order_rules(docs, rules, text, sample_rows)
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.filter(~let(words(whole), lambda w: cascade(ordered, stat_columns(whole, w))))


def reasons(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with rejected_by: the names of all rules that reject the text, in the order given."""
    whole = F.coalesce(F.col(text), F.lit(""))
    named = lambda w: F.array_compact(F.array(*(F.when(r.over(stat_columns(whole, w)), r.name) for r in rules)))
    return docs.withColumn("rejected_by", let(words(whole), named))


def report(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the statistics of REPORTED, and rejected, from the cascade over them; what else a rule reads is computed when its turn comes."""
    ordered = order_rules(docs, rules, "text", sample_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    split = texts.select("doc_id", "t", words(F.col("t")).alias("w"))
    every = stat_columns(F.col("t"), F.col("w"))
    counted = split.select("doc_id", "t", *(every[n].alias(n) for n in REPORTED))
    stats = {n: F.col(n) if n in REPORTED else c for n, c in stat_columns(F.col("t"), F.lit(None)).items()}
    return counted.select("doc_id", *REPORTED, cascade(ordered, stats).alias("rejected"))
