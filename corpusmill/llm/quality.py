"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A bounded sample gives each rule's cost (time of a pass over the sample, less that of a
pass without rules) and rejection rate. Rules are then nested into one CASE in the
order of rejections per cost. `keep` takes the counts inside the branches, so a text
that one rule rejects is not counted for the rules after it; in particular its windows are
neither hashed nor sorted. `judge` returns all counts, so there the order saves nothing but
comparisons. The order changes the time, never the verdict: a text is kept when no rule rejects it.

Words are maximal runs without white space. Repeated three-word windows are found
inside the row: each window becomes a long (hash bits above, position bits below),
the longs are sorted, neighbours of equal hash are compared word by word, and the
sorted positions of repeated windows give the number of words that they cover.

Words and lines are split under a condition that the optimiser cannot move, so that no
filter on a count or a verdict is pushed below them, where it would split the text for every window.

Defined results: a null text has no words, so it is rejected and its counts are 0;
the same holds for empty texts. Texts of any length are read whole. Repeated rows
give equal results. Other columns stay; result columns replace those of their name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import unused

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample that orders the rules.
SAMPLE_ROWS = 200
#: How often the sample is read when a rule is timed, so that scheduling is a small part.
REPEATS = 5
#: Rules beyond the base ones; a text breaks one when the condition holds.
MAX_MEAN_WORD, MIN_MEAN_WORD = 14, 3
MAX_SYMBOLS_PER_100_WORDS = 10
MAX_DUP_LINES_PER_100_LINES = 50
MIN_LETTER_WORDS_PER_100 = 70

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column


def rules(n_lines: str = "n_lines", n_letters: str = "n_letters", count: Callable[[str], Column] = F.col) -> list[Rule]:
    """Rules over the counts, which `count` gives by name; two of the names may differ."""
    return [
        Rule("few_words", count("n_words") < 50),
        Rule("repeated_words", 100 * count("n_repeat_words") > 50 * count("n_words")),
        Rule(
            "word_length",
            (count("word_chars") > MAX_MEAN_WORD * count("n_words")) | (count("word_chars") < MIN_MEAN_WORD * count("n_words")),
        ),
        Rule("symbols", 100 * count("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * count("n_words")),
        Rule("repeated_lines", 100 * count("n_dup_lines") > MAX_DUP_LINES_PER_100_LINES * count(n_lines)),
        Rule("letters", 100 * count(n_letters) < MIN_LETTER_WORDS_PER_100 * count("n_words")),
    ]


def _shifted(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(f"shift{way}", value, bits)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows whose neighbour in hash order is the same window."""
    bits = F.ceil(F.log2(F.size(words) + 2)).cast("int")
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    # what is sorted: upper bits of a window's hash, and its place in the bits below
    windows = lambda bits: F.sort_array(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: _shifted("left", hashed(i), bits).bitwiseOR(i.cast("long")))
    )

    def covered(bits: Column, packed: Column) -> Column:
        place = lambda x: x.bitwiseAND(_shifted("left", F.lit(1).cast("long"), bits) - 1).cast("int")
        window = lambda x: F.slice(words, place(x) + 1, 3)
        same = lambda a, b: (_shifted("right", a, bits) == _shifted("right", b, bits)) & (window(a) == window(b))
        last = F.size(packed) - 1
        repeated = F.filter(
            packed,
            lambda x, k: ((k > 0) & same(x, F.get(packed, k - 1))) | ((k < last) & same(x, F.get(packed, k + 1))),
        )
        sums = F.aggregate(
            F.sort_array(F.transform(repeated, place)),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p + 3 - s["end"])).alias("n"), (p + 3).alias("end")),
        )
        return sums["n"]

    found = _let(bits, lambda b: _let(windows(b), lambda packed: covered(b, packed)))
    return F.when(F.size(words) >= 3, found).otherwise(F.lit(0)).cast("long")


def _counts(body: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Every count as an expression over the text, its words, and its lines that have a word."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.char_length(w)),
        "n_symbols": (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_letters": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long"),
    }


def _split(df: DataFrame, text: str, kept: list[str]) -> tuple[DataFrame, Column, Column, Column]:
    """`df` with the words and lines of the text, and the text, its words and lines as columns."""
    body, words, lines = unused(df, "q_body", "q_words", "q_lines")
    value = F.coalesce(F.col(text), F.lit(""))
    # true for every row; the optimiser moves no filter through it
    here = F.monotonically_increasing_id() >= 0
    split = df.select(
        *kept,
        value.alias(body),
        F.when(here, F.regexp_extract_all(value, F.lit(WORD), F.lit(0))).alias(words),
        F.when(here, F.filter(F.split(value, "\n", -1), lambda x: x.rlike(WORD))).alias(lines),
    )
    return split, F.col(body), F.col(words), F.col(lines)


def measure(df: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """`df` with the counts, and the names of the helper columns (lines and words with letters)."""
    kept = [c for c in df.columns if c.lower() not in COUNTS]
    split, body, words, lines = _split(df, text, kept)
    helpers = unused(df, "q_n_lines", "q_letters")
    counts = _counts(body, words, lines)
    names = zip((*COUNTS, "n_lines", "n_letters"), (*COUNTS, *helpers))
    return split.select(*kept, *[counts[c].alias(name) for c, name in names]), helpers


def ordered(df: DataFrame, text: str) -> list[str]:
    """Names of the rules by rejections per second on at most SAMPLE_ROWS texts, best first.

    `limit` before `collect` reads only as many partitions as it takes. Each rule is
    timed with the counts that it needs, and with no others.
    """
    rows = [(r[0],) for r in df.select(F.col(text)).limit(SAMPLE_ROWS).collect()]
    sample = df.sparkSession.createDataFrame(rows * REPEATS, f"`{text}` string")
    measured, helpers = measure(sample, text)

    def timed(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        # not a filter: an aggregate takes the counts that the condition names, and no others
        rejected = measured.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - began, rejected

    idle = min(timed(F.lit(False))[0] for _ in range(2))
    worth = []
    for rule in rules(*helpers):
        took, rejected = timed(rule.broken)
        worth.append((-(rejected / max(len(rows) * REPEATS, 1)) / max(took - idle, 1e-3), rule.name))
    return [name for _, name in sorted(worth)]


def cascade(in_order: list[Rule]) -> Column:
    """True when no rule rejects; later rules are not evaluated after a rejection."""
    verdict = None
    for rule in in_order:
        verdict = F.when(rule.broken, F.lit(False)) if verdict is None else verdict.when(rule.broken, F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the counts, `base_failed` and `kept`."""
    kept = df.select([c for c in df.columns if c.lower() not in ("base_failed", "kept")])
    measured, helpers = measure(kept, text)
    by_name = {r.name: r for r in rules(*helpers)}
    in_order = [by_name[name] for name in ordered(kept, text)]
    failed = by_name["few_words"].broken | by_name["repeated_words"].broken
    return measured.withColumns({"base_failed": failed, "kept": cascade(in_order)}).drop(*helpers)


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `df` that no rule rejects, with all their columns; counts are taken as the cascade asks for them."""
    split, body, words, lines = _split(df, text, df.columns)
    counts = _counts(body, words, lines)
    by_name = {r.name: r for r in rules(count=counts.__getitem__)}
    return split.filter(cascade([by_name[name] for name in ordered(df, text)])).select(df.columns)
