import fnmatch
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import globs
from tidemark.functions import text as tx
from tidemark.operators.common import keep_or_fail, unique_or_fail


def one(spark, *columns, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return tuple(frame.select(*columns).first())


# name, pattern -> simple, simple_name, fnmatch, find_iname, ps_like
GLOBS = [
    ("abc", "*", (1, 1, 1, 1, 1)),
    ("x", "x", (1, 1, 1, 1, 1)),
    ("axb", "*x*", (1, 1, 1, 1, 1)),
    ("xab", "x*", (1, 1, 1, 1, 1)),
    ("abx", "*x", (1, 1, 1, 1, 1)),
    ("acb", "a*b", (0, 0, 1, 1, 1)),
    ("a*b", "a*b", (1, 1, 1, 1, 1)),
    ("*a", "**", (1, 0, 1, 1, 1)),
    ("a*", "**", (1, 1, 1, 1, 1)),
    ("ab", "**", (0, 0, 1, 1, 1)),
    ("b1", "[ab]*", (0, 0, 1, 1, 1)),
    ("c1", "[!ab]*", (0, 0, 1, 1, 0)),
    ("B1", "[ab]*", (0, 0, 0, 1, 1)),
    ("z", "?", (0, 0, 1, 1, 1)),
    ("A.LOG", "*.log", (0, 0, 0, 1, 1)),
    ("a+b", "a+b", (1, 1, 1, 1, 1)),
    ("a[", "a[", (1, 1, 1, 1, 1)),
    ("aXb", "a.b", (0, 0, 0, 0, 0)),
    ("a\nb", "a*", (1, 1, 1, 1, 1)),
]


def test_glob_dialects(spark):
    frame = spark.createDataFrame([(n, p) for n, p, _ in GLOBS], "n string, p string")
    got = frame.select("n", "p", *[globs.glob_match(F.col("n"), F.col("p"), d).alias(d) for d in globs.DIALECTS]).collect()
    assert [tuple(int(x) for x in r[2:]) for r in got] == [want for _, _, want in GLOBS]


def test_empty_pattern_list_matches_nothing(spark):
    none = F.array().cast("array<string>")
    assert one(spark, globs.glob_any(F.lit("a"), none, "simple"))[0] is False


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab*?[]!.^-", max_size=6), st.text("ab.[]!^-", max_size=4)), min_size=30, max_size=60))
def test_fnmatch_dialect_agrees_with_the_library(spark, pairs):
    # A range of three characters or more is left out: the library drops reversed ones, Spark's engine refuses them.
    pairs = [(p, n) for p, n in pairs if "-" not in p and p]
    if not pairs:
        return
    frame = spark.createDataFrame([(n, p, fnmatch.fnmatchcase(n, p)) for p, n in pairs], "n string, p string, want boolean")
    bad = frame.where(globs.glob_match(F.col("n"), F.col("p"), "fnmatch") != F.col("want")).collect()
    assert not bad


@pytest.mark.parametrize(
    "size", [0, 1, 1023, 1024, 1029, 1536, 10752, 1048575, 1048576, 5_000_000, 1073741823, 1099511627775, 1099511627776, 123_456_789_012_345]
)
def test_human_bytes_reads_like_a_two_decimal_format(spark, size):
    units = [(1 << 40, "TB"), (1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    want = next((f"{size / u:.2f} {n}" for u, n in units if size >= u), f"{size} B")
    assert one(spark, tx.human_bytes("b"), b=size)[0] == want


def test_periods(spark):
    january = datetime(2024, 1, 15)
    got = one(
        spark, tx.resolve_month("d", mode="previous"), tx.resolve_month("d", F.lit("202205")), tx.resolve_year("d", mode="previous"), d=january
    )
    assert got == ("202312", "202205", "2023")


def test_local_time_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        instant = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
        assert one(spark, tx.local_ts(instant, "America/Sao_Paulo"))[0] == "31/12/2023 22:00:00 America/Sao_Paulo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_digest_and_names(spark):
    got = one(
        spark,
        tx.digest_of("m", "d", "i"),
        tx.digest_of("m", "d", "i", skip_empty=True),
        tx.repo_full_name("n", "r"),
        tx.repo_full_name("n", F.lit("org/x")),
        tx.repo_short_name(F.lit("org/x")),
        tx.trim_url(F.lit("https://h/x//")),
        tx.url_host(F.lit("https://h/x")),
        m="",
        d="sha",
        i="img",
        n="ns",
        r="repo",
    )
    assert got == ("", "sha", "ns/repo", "org/x", "x", "https://h/x", "h")


def test_status_words(spark):
    got = one(
        spark,
        tx.run_status(F.lit(True), F.lit(True)),
        tx.run_status(F.lit(False), F.lit(True)),
        tx.run_status(F.lit(None).cast("boolean"), F.lit(False)),
        tx.error_or_warning(F.lit(1), True),
        tx.error_or_warning(F.lit(1), False),
        tx.error_or_warning(F.lit(0), True),
        tx.disk_band(F.lit(90)),
        tx.disk_band(F.lit(75)),
        tx.disk_band(F.lit(20), 19, 20),
        tx.percent_digits(F.lit("87%")),
        tx.is_month_key(F.lit("202401")),
        tx.is_identifier(F.lit("a b")),
        tx.hms(F.lit(360_005)),
    )
    assert got == ("FALHA", "SUCESSO COM AVISO", "SUCESSO", "failure", "warning", "ok", "crit", "warn", "crit", 87, True, False, "100:00:05")


def test_failing_checks_fail_the_job(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    with pytest.raises(Exception, match="too large"):
        keep_or_fail(frame, F.col("v") < 3, "too large").collect()
    with pytest.raises(Exception, match="duplicate key: a"):
        unique_or_fail(frame, ["k"]).collect()
    assert unique_or_fail(frame.where("v > 1"), ["k"]).count() == 2


def test_long_numbers_keep_every_digit(spark):
    texts = ["1234567890123456789", "-1234567890123456789", "1234567890123456789.9", "12e3", "000000000000000000000007", "1.5e2", "x"]
    got = one(spark, *[tx.safe_int(F.lit(t)) for t in texts])
    assert got == (1234567890123456789, -1234567890123456789, 1234567890123456789, 12000, 7, 150, 0)
    with pytest.raises(Exception, match="64 bits"):
        one(spark, tx.safe_int(F.lit("12345678901234567890")))
