"""Column expressions over text. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from corpusmill import fixed_values as fixed
from corpusmill.functions.vectors import let

# White space as Unicode text handling defines it; Java's own class is ASCII only.
SPACE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# One sign, and a run of signs, that are not white space. Plain ASCII is tested
# first: it is one comparison, the full class is a dozen.
SIGN = rf"(?:[!-~]|[^{SPACE}])"
SIGNS = rf"(?:[!-~]++|[^{SPACE}])++"
BLANKS = rf"(?![!-~])[{SPACE}]++"

URL = rf"https?://{SIGNS}|www\.{SIGNS}"
# Takes a whole blank-free run that has an inner "@". Anchored at the start of
# the run and possessive, so that it stays linear on long runs.
EMAIL = rf"(?<![!-~])(?<![^{SPACE}]){SIGN}(?:[!-?A-~]++|[^{SPACE}@])*+@{SIGNS}"
TAG = r"<[^>]+>"
CONTROL = r"[\x00-\x1f\x7f-\x9f]"
WORD = r"(?<![\p{L}\p{N}_])[a-z]{3,}+(?![\p{L}\p{N}_])"


def text_of(col: str | Column) -> Column:
    """The value, or an empty string where it is missing."""
    return F.coalesce(_col(col), F.lit(""))


def is_missing(col: str | Column) -> Column:
    """Null, empty or blank."""
    return ~F.coalesce(_col(col).rlike(f"[^{SPACE}]"), F.lit(False))


def clean_text(col: str | Column) -> Column:
    """Lower-case letters and single spaces only.

    Addresses, tags and digits vanish without a trace, other signs split words.
    The three rare patterns are only tried where one of their marks occurs.
    """
    raw = text_of(col)
    low = F.lower(raw)
    marked = (
        raw.contains("@") | raw.contains("<") | raw.contains("://") | low.contains("www.")
    )
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, URL, ""), EMAIL, ""), TAG, "")
    kept = F.when(marked, bare).otherwise(low)
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\p{Nd}+", ""), "[^a-z]+", " "))


def normalize_text(col: str | Column) -> Column:
    """Collapse white space, strip, then drop control characters."""
    one_line = F.trim(F.regexp_replace(text_of(col), BLANKS, " "))
    return F.regexp_replace(one_line, CONTROL, "")


def word_count(col: str | Column) -> Column:
    """Number of words between white space; 0 for a missing value.

    Counts the gaps of the collapsed text, which makes no array of words.
    """

    def gaps(line: Column) -> Column:
        spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
        return F.when(line == "", 0).otherwise(spaces + 1)

    return let(F.trim(F.regexp_replace(text_of(col), BLANKS, " ")), gaps)


def words_after_cleanup(col: str | Column) -> Column:
    """`word_count` of the normalized text, counted on the text as it is.

    Control characters vanish in the normalized text, so where there are any a
    word needs one other sign.
    """
    start = rf"(?:[!-~]|[^{SPACE}\x00-\x1f\x7f-\x9f])"
    careful = F.regexp_count(text_of(col), F.lit(rf"{start}(?:[!-~]++|[^{SPACE}])*+"))
    has_controls = text_of(col).rlike(r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]")
    return F.when(has_controls, careful).otherwise(word_count(col))


def char_length(col: str | Column) -> Column:
    return F.length(text_of(col))


def simple_tokens(col: str | Column) -> Column:
    """Words of three or more plain letters, for frequency profiles."""
    return F.regexp_extract_all(F.lower(text_of(col)), F.lit(WORD), F.lit(0))


def tokens_of(
    col: str | Column,
    stopwords: Sequence[str] = (),
    min_length: int = 3,
    max_length: int | None = 50,
) -> Column:
    """Clean, split, drop stopwords and words outside the length bounds (None: no upper bound).

    `isin` over literals becomes a hash-set lookup, so no join is needed.
    """
    words = F.split(clean_text(col), " ")
    stop = sorted(set(stopwords))

    def keep(word: Column) -> Column:
        fits = F.length(word) >= max(min_length, 1)
        fits = fits if max_length is None else fits & (F.length(word) <= max_length)
        return fits & ~word.isin(stop) if stop else fits

    return F.filter(words, keep)


def drop_stopwords(tokens: str | Column, stopwords: Sequence[str]) -> Column:
    stop = sorted(set(stopwords))
    return F.filter(_col(tokens), lambda word: ~word.isin(stop)) if stop else _col(tokens)


def keep_lengths(tokens: str | Column, low: int = 3, high: int = 50) -> Column:
    return F.filter(_col(tokens), lambda word: F.length(word).between(low, high))


def _by_indicators(
    col: str | Column, first: Sequence[str], second: Sequence[str], decide: Callable
) -> Column:
    """Count the indicator words of each list that occur between single spaces.

    One split and one hashed intersection per text, whatever the list lengths.
    """
    words = F.split(F.lower(text_of(col)), " ")
    listed = F.array(*[F.lit(w) for w in dict.fromkeys([*first, *second])])

    def count(hits: Column) -> Column:
        a = F.size(F.array_intersect(hits, F.array(*[F.lit(w) for w in first])))
        b = F.size(F.array_intersect(hits, F.array(*[F.lit(w) for w in second])))
        return decide(a, b)

    return F.when(text_of(col) == "", "unknown").otherwise(
        let(F.array_intersect(words, listed), count)
    )


def quick_language(
    col: str | Column,
    first: Sequence[str] = fixed.QUICK_INDONESIAN,
    second: Sequence[str] = fixed.QUICK_ENGLISH,
) -> Column:
    """Language with more indicator words present; ties are undecided."""

    def decide(a: Column, b: Column) -> Column:
        return F.when(a > b, "indonesian").when(b > a, "english").otherwise("mixed/unknown")

    return _by_indicators(col, first, second, decide)


def margin_language(
    col: str | Column,
    first: Sequence[str] = fixed.MARGIN_INDONESIAN,
    second: Sequence[str] = fixed.MARGIN_ENGLISH,
    margin: int = fixed.LANGUAGE_MARGIN,
) -> Column:
    """Like `quick_language`, but the lead must exceed a margin."""

    def decide(a: Column, b: Column) -> Column:
        return (
            F.when(a > b + margin, "Indonesian")
            .when(b > a + margin, "English")
            .otherwise("Mixed/Unknown")
        )

    return _by_indicators(col, first, second, decide)


def split_list(col: str | Column, sep: str = ";", keep_empty: bool = False) -> Column:
    """Trimmed pieces of a joined field; an empty array for a missing one."""
    pieces = F.transform(F.split(text_of(col), sep), lambda piece: F.trim(piece))
    if keep_empty:
        return F.when(text_of(col) == "", F.array().cast("array<string>")).otherwise(pieces)
    return F.filter(pieces, lambda piece: piece != "")


def shorten(col: str | Column, limit: int = 100) -> Column:
    """At most `limit` characters, with an ellipsis when cut."""
    c = _col(col)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def contains_text(columns: Sequence[str], query: str) -> Column:
    """Literal, case-insensitive search in any of the columns."""
    needle = query.lower()
    found = F.lit(False)
    for name in columns:
        found = found | F.lower(text_of(name)).contains(needle)
    return found


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
