import pytest
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.functions import validators as V


def one(spark, f, *values):
    df = spark.createDataFrame([(*values,)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [("  a\n\t b c ", "a b c"), ("«x» — y–z", '"x" - y-z'), (None, ""), ("", ""), ("a\x00b\x7f", "ab"), ("\x1ca　", "a")],
)
def test_clean_text(spark, raw, want):
    assert one(spark, X.clean_text, raw) == want


def test_worth_reading(spark):
    assert not one(spark, X.worth_reading, None)
    assert not one(spark, X.worth_reading, "1234 5678 9012 3456 7890 1234")
    assert one(spark, X.worth_reading, "достаточно длинный текст")


@pytest.mark.parametrize("raw, want", [("79161234567", "79*******67"), ("abcd", "****"), ("", ""), ("abcde", "ab*de")])
def test_masked(spark, raw, want):
    assert one(spark, X.masked, raw) == want


def test_snippet(spark):
    t = "x" * 100 + "HIT" + "y\n" * 50
    got = one(spark, lambda c: X.snippet(c, F.lit(100), F.lit(3)), t)
    assert got == "…" + "x" * 60 + "HIT" + "y " * 30 + "…"
    assert one(spark, lambda c: X.snippet(c, F.lit(0), F.lit(3)), "HIT") == "HIT"


@pytest.mark.parametrize("path, want", [("/a/B.PDF", "pdf"), ("/a.b/c", ""), ("/a/.hidden", ""), ("x.tar.gz", "gz")])
def test_suffix(spark, path, want):
    assert one(spark, X.suffix, path) == want


def test_words_and_subtitles(spark):
    assert one(spark, X.word_count, " a  b\nc ") == 3
    assert one(spark, X.word_count, None) == 0
    srt = "1\n00:00:01,000 --> 00:00:02,000\n<b>Hello</b>\n\n2\n00:00:03,000 --> 00:00:04,000\nworld\n"
    assert one(spark, X.clean_subtitles, srt) == "Hello\nworld"


@pytest.mark.parametrize("n, ok", [("4111 1111 1111 1111", True), ("5555 5555 5555 4444", True), ("1234 5678 9012 3456", False), ("0", False), (None, False), ("", False)])
def test_card(spark, n, ok):
    assert one(spark, V.card_ok, n) is ok


@pytest.mark.parametrize("n, ok", [("112-233-445 95", True), ("123-456-789 01", False), ("000-000-000 00", False), ("", False), (None, False)])
def test_snils(spark, n, ok):
    assert one(spark, V.snils_ok, n) is ok


@pytest.mark.parametrize("n, ok", [("7707083893", True), ("500100732259", True), ("123456789012", False), ("1", False), (None, False)])
def test_inn(spark, n, ok):
    assert one(spark, V.inn_ok, n) is ok


@pytest.mark.parametrize("s, n, ok", [("4510", "123456", True), ("4510", "000000", False), ("0010", "123456", False), (None, "123456", False)])
def test_passport(spark, s, n, ok):
    assert one(spark, V.passport_ok, s, n) is ok


@pytest.mark.parametrize("f, d, ok", [("520727", "3", True), ("D231458907<<<<<<<<<<<<<<<", "6", False), ("D23145890<", "7", True), ("ABC123", "9", False), ("a-b", "0", False), (None, "0", False)])
def test_mrz(spark, f, d, ok):
    def brute():
        if f is None or "-" in f:
            return False
        v = [0 if c == "<" else int(c, 36) for c in f]
        return str(sum(x * (7, 3, 1)[k % 3] for k, x in enumerate(v)) % 10) == d

    assert one(spark, V.mrz_digit_ok, f, d) is brute()
