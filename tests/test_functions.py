"""Edge cases of the column expressions, with hand-computed results."""

import math
import re
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import dates, labels, text, vectors


def values(spark, expression, rows, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(expression).collect()]


CLEAN = [
    ("Lihat https://x.org/a?b=1 dan www.y.id.", "lihat dan"),
    ("Surat: a.b@c.id, terima", "surat terima"),
    ("<p>Satu</p><p>Dua</p>", "satudua"),
    ("K3LL 2015-2016", "kll"),
    ("kinerja-karyawan & motivasi", "kinerja karyawan motivasi"),
    ("Réeau été", "r eau t"),
    (None, ""),
    ("", ""),
    ("  \t ", ""),
    ("a@b c", "c"),
    ("@a b@ c@d", "a b"),
    ("x@@y z", "z"),
    ("foohttp://x y", "foo y"),
    ("WWW.A.ID b", "b"),
    ("a < b and c > d", "a d"),
]


def test_clean_text(spark):
    assert values(spark, text.clean_text("x"), [c[0] for c in CLEAN]) == [c[1] for c in CLEAN]


def reference_clean(value: str) -> str:
    """The rule of the operator, step by step."""
    out = value.lower()
    for pattern, by in (
        (r"https?://\S+|www\.\S+", ""), (r"\S+@\S+", ""), (r"<[^>]+>", ""),
        (r"\d+", ""), (r"[^a-zA-Z\s]", " "), (r"\s+", " "),
    ):
        out = re.sub(pattern, by, out)
    return out.strip()


ALPHABET = st.sampled_from(list("ab@@  .<>/:19\t\n  é_-\x1c\x07") + [chr(0xA0), chr(0x2003), chr(0x85), "http://", "www.", "https:"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=50, max_size=200))
def test_text_functions_follow_their_rule(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string").coalesce(1)
    got = df.select(
        text.clean_text("x"), text.word_count("x"), text.normalize_text("x"), text.words_after_cleanup("x")
    ).collect()
    for row, (cleaned, words, normal, after) in zip(rows, got):
        assert cleaned == reference_clean(row), repr(row)
        assert words == len(row.split()), repr(row)
        want = re.sub(r"[\x00-\x1f\x7f-\x9f]", "", re.sub(r"\s+", " ", row).strip())
        assert normal == want, repr(row)
        assert after == len(want.split()), repr(row)


def test_normalize_text(spark):
    rows = ["  a\t\nb  ", "a\x07b", "\x07 a", None]
    assert values(spark, text.normalize_text("x"), rows) == ["a b", "ab", " a", ""]


def test_simple_tokens(spark):
    assert values(spark, text.simple_tokens("x"), ["réeau the ärab abc a_the", None]) == [["the", "abc"], []]


def test_word_count_of_nothing(spark):
    assert values(spark, text.word_count("x"), ["", None, "  "]) == [0, 0, 0]


def test_missing(spark):
    rows = [None, "", "  ", " ", "a"]
    assert values(spark, text.is_missing("x"), rows) == [True, True, True, True, False]


DATES = [
    ("2022-01-05T05:10:37Z", date(2022, 1, 5)),
    ("2015", date(2015, 1, 1)),
    ("2015-03", date(2015, 3, 1)),
    ("5 March 2014", date(2014, 3, 5)),
    ("March 5, 2014", date(2014, 3, 5)),
    ("c2015", date(2015, 1, 1)),
    ("2015/2016", date(2015, 1, 1)),
    (" 2011-02-03 ", date(2011, 2, 3)),
    ("n.d.", None),
    ("", None),
    (None, None),
]


def test_parse_date(spark):
    got = values(spark, dates.parse_date("x").cast("date"), [d[0] for d in DATES])
    assert got == [d[1] for d in DATES]


ODD_DATES = ["10:30", "T10:30:00", "2015-03-08 02:30:00", "2018-11-04", "2022-01-05T23:10:37+09:00", "5 March 2014", "10:30 in 2011", "1/2/1999"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "America/Sao_Paulo", "Asia/Tokyo"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = values(spark, dates.parse_date("x").cast("string"), ODD_DATES)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [
        None, None, "2015-03-08 02:30:00", "2018-11-04 00:00:00", "2022-01-05 23:10:37", "2014-03-05 00:00:00",
        "2011-01-01 00:00:00", "1999-01-02 00:00:00",
    ]


def test_languages(spark):
    rows = ["yang dan dengan untuk the", "the and with for yang", "xyz", "", None]
    assert values(spark, text.quick_language("x"), rows) == [
        "indonesian", "english", "mixed/unknown", "unknown", "unknown"
    ]
    assert values(spark, text.margin_language("x"), rows) == [
        "Indonesian", "English", "Mixed/Unknown", "unknown", "unknown"
    ]
    # a repeated indicator counts once, and only between spaces
    assert values(spark, text.quick_language("x"), ["the the yang dan", "the, and"]) == [
        "indonesian", "english"
    ]


def test_shorten_and_lists(spark):
    assert values(spark, text.shorten("x", 3), ["abc", "abcd", None]) == ["abc", "abc...", None]
    assert values(spark, text.split_list("x"), ["a; ; b", None]) == [["a", "b"], []]
    assert values(spark, text.split_list("x", keep_empty=True), ["a; ; b", ""]) == [["a", "", "b"], []]


def test_vectors(spark):
    a, b = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    row = spark.range(1).select(
        vectors.js_distance(vectors.literal_vector(a), vectors.literal_vector(b)).alias("d"),
        vectors.js_similarity(vectors.literal_vector(a), vectors.literal_vector(b)).alias("s"),
        vectors.js_similarity(vectors.literal_vector([1, 0]), vectors.literal_vector([0, 3])).alias("far"),
        vectors.cosine(vectors.literal_vector(a), vectors.literal_vector([0, 0, 0])).alias("zero"),
        vectors.argmax(vectors.literal_vector([0.2, 0.4, 0.4])).alias("arg"),
    ).first()
    assert row["d"] == pytest.approx(0.464501, abs=1e-6)
    assert row["s"] == pytest.approx(0.535499, abs=1e-6)
    assert row["far"] == pytest.approx(1 - math.sqrt(math.log(2)))
    assert row["zero"] == 0.0 and row["arg"] == 1


def test_bands(spark):
    scores = [0.39, 0.4, 0.5, 0.6, 0.7, 0.71]
    assert values(spark, labels.coherence_band(F.col("x")), scores, "x double") == [
        "low", "medium", "good", "very good", "very good", "excellent"
    ]
    assert values(spark, labels.similarity_band(F.col("x")), [0.4, 0.41, 0.7, 0.71], "x double") == [
        "low", "medium", "medium", "high"
    ]
