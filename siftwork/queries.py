"""Queries of the core operators and their SQL; __spark_entry__ collects them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.functions import validators as V
from siftwork.operators import badrows, classify, detect, registry
from siftwork.plans import report
from siftwork.sources import documents, files, html, tabular
from siftwork.streaming import detect as streaming
from siftwork.util import shared_folder, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# ---------------------------------------------------------------- text functions

_WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_CLEAN = f"trim(translate(regexp_replace(regexp_replace(coalesce({{0}}, ''), '{_WS}+', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '«»–—', '\"\"--'))"
_STRIP = f"regexp_replace({{0}}, '^{_WS}+|{_WS}+$', '', 'g')"



def _clean(c: str) -> str:
    return _CLEAN.replace("{0}", c)


def _strip(c: str) -> str:
    return _STRIP.replace("{0}", c)


@query("clean_text", f"SELECT result_id, length(t) AS cleaned_length, md5(t) AS cleaned_md5 FROM (SELECT result_id, {_clean('text')} AS t FROM extraction_results)")
def clean_text_q(spark, d):
    t = X.clean_text(F.col("text"))
    return table(spark, d, "extraction_results").select("result_id", F.length(t).cast("bigint").alias("cleaned_length"), F.md5(t).alias("cleaned_md5"))


@query("quick_skip", f"SELECT doc_id, (length(s) >= 30 AND length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) >= 5) AS worth FROM (SELECT doc_id, {_strip(_clean('text'))} AS s FROM documents)")
def quick_skip(spark, d):
    return table(spark, d, "documents").select("doc_id", X.worth_reading(X.clean_text(F.col("text")), 30).alias("worth"))


@query(
    "text_measures",
    f"""SELECT result_id, length(coalesce(text, '')) AS char_count, CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '{_WS}+')) END AS word_count, s = '' AS is_empty
        FROM (SELECT result_id, text, {_strip("coalesce(text, '')")} AS s FROM extraction_results)""",
)
def text_measures(spark, d):
    c = F.col("text")
    return table(spark, d, "extraction_results").select("result_id", X.char_count(F.coalesce(c, F.lit(""))).cast("bigint").alias("char_count"), X.word_count(c).cast("bigint").alias("word_count"), X.is_empty(c).alias("is_empty"))


@query(
    "normalized_columns",
    f"""SELECT row_id, regexp_replace(телефон, '[^\\p{{Nd}}]', '', 'g') AS phone_digits, regexp_replace(телефон, '{_WS}|[-()+]', '', 'g') AS phone_plain,
        lower(regexp_replace(снилс, '({_WS}|-)+', '', 'g')) AS snils_norm FROM person_rows""",
)
def normalized_columns(spark, d):
    return table(spark, d, "person_rows").select("row_id", X.digits_only(F.col("телефон")).alias("phone_digits"), X.normalize_phone(F.col("телефон")).alias("phone_plain"), X.normalize_value(F.col("снилс")).alias("snils_norm"))


@query("masked_values", "SELECT finding_id, CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 2) || repeat('*', length(value) - 4) || right(value, 2) END AS masked FROM pii_findings")
def masked_values(spark, d):
    return table(spark, d, "pii_findings").select("finding_id", X.masked(F.col("value")).alias("masked"))


@query("stripped_tags", "SELECT doc_id, regexp_replace('<p class=\"x\">' || coalesce(source, '') || '</p><br/>' || doc_id, '<[^>]+>', ' ', 'g') AS plain FROM documents")
def stripped_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", X.strip_tags(F.concat(F.lit('<p class="x">'), F.coalesce("source", F.lit("")), F.lit("</p><br/>"), F.col("doc_id"))).alias("plain"))


@query("subtitles", "SELECT doc_id, coalesce(source, 'none') || chr(10) || 'second ' || doc_id AS spoken FROM documents")
def subtitles(spark, d):
    t = F.concat(F.lit("WEBVTT\n\n1\n00:00:01,000 --> 00:00:02,500\n<i>"), F.coalesce("source", F.lit("none")), F.lit("</i>\n\n2\n00:00:03.000 --> 00:00:04.000\n  second "), F.col("doc_id"), F.lit("  \n\n"))
    return table(spark, d, "documents").select("doc_id", X.clean_subtitles(t).alias("spoken"))


# ---------------------------------------------------------------- validators


def _sum(col: str, weights: list[int]) -> str:
    return " + ".join(f"CAST(substr({col}, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(weights))


_SNILS_OK = f"CASE WHEN length(d) <> 11 OR d = '00000000000' THEN false ELSE (CASE WHEN ({_sum('d', V.SNILS)}) % 101 = 100 THEN 0 ELSE ({_sum('d', V.SNILS)}) % 101 END) = CAST(substr(d, 10, 2) AS INT) END"
_INN_OK = f"""CASE WHEN length(d) = 10 THEN ({_sum('d', V.INN_10)}) % 11 % 10 = CAST(substr(d, 10, 1) AS INT)
    WHEN length(d) = 12 THEN ({_sum('d', V.INN_11)}) % 11 % 10 = CAST(substr(d, 11, 1) AS INT) AND ({_sum('d', V.INN_12)}) % 11 % 10 = CAST(substr(d, 12, 1) AS INT) ELSE false END"""
_LUHN = "(SELECT sum(CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INT) ELSE (2 * CAST(substr(d, i, 1) AS INT)) // 10 + (2 * CAST(substr(d, i, 1) AS INT)) % 10 END) FROM range(1, length(d) + 1) r(i)) % 10 = 0"


@query("valid_snils", f"SELECT row_id, coalesce({_SNILS_OK}, false) AS ok FROM (SELECT row_id, regexp_replace(снилс, '[^0-9]', '', 'g') AS d FROM person_rows)")
def valid_snils(spark, d):
    return table(spark, d, "person_rows").select("row_id", V.snils_ok(F.col("снилс")).alias("ok"))


@query("valid_inn", f"SELECT row_id, coalesce({_INN_OK}, false) AS ok FROM (SELECT row_id, regexp_replace(инн, '[^0-9]', '', 'g') AS d FROM person_rows)")
def valid_inn(spark, d):
    return table(spark, d, "person_rows").select("row_id", V.inn_ok(F.col("инн")).alias("ok"))


@query("valid_card", f"SELECT o_orderkey, length(d) BETWEEN 13 AND 19 AND {_LUHN} AS ok FROM (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey * 7 AS STRING), 15, '0') AS d FROM orders)")
def valid_card(spark, d):
    n = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7).cast("string"), 15, "0"))
    spaced = F.concat_ws(" ", F.substring(n, 1, 4), F.substring(n, 5, 4), F.substring(n, 9, 4), F.substring(n, 13, 4))
    return table(spark, d, "orders").select("o_orderkey", V.card_ok(spaced).alias("ok"))


@query("valid_passport", "SELECT c_custkey, c_custkey % 100 <> 0 AND c_custkey % 7 <> 0 AS ok FROM customer")
def valid_passport(spark, d):
    k = F.col("c_custkey")
    series = F.concat(F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" 15"))
    number = F.when(k % 7 == 0, "000000").otherwise(F.lpad(k.cast("string"), 6, "1"))
    return table(spark, d, "customer").select("c_custkey", V.passport_ok(series, number).alias("ok"))


@query(
    "valid_mrz",
    """SELECT c_custkey, (SELECT sum(CASE WHEN substr(f, i, 1) = '<' THEN 0 ELSE strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(f, i, 1)) - 1 END * CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END)
       FROM range(1, length(f) + 1) r(i)) % 10 = c_custkey % 10 AS ok FROM (SELECT c_custkey, 'D' || c_custkey || 'RZ<<' AS f FROM customer)""",
)
def valid_mrz(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", V.mrz_digit_ok(F.concat(F.lit("d"), k, F.lit("rz<<")), (k % 10).cast("string")).alias("ok"))


# ---------------------------------------------------------------- broken records (problem 5)


def _records_sql() -> str:
    """Records cut by one pattern per separator: quoting is right if the whole record is fields and separators."""
    field = lambda c: f'"(?:[^"]|"")*"|[^"{c}]*'
    seps = {",": ",", ";": ";", "\t": "\\t", "|": "\\|"}
    by_sep = lambda f: "CASE sep " + " ".join(f"WHEN '{s}' THEN {f(c)}" for s, c in seps.items()) + " END"
    quoted = by_sep(lambda c: f"regexp_full_match(r, '(?:{field(c)})(?:{c}(?:{field(c)}))*')")
    three = by_sep(lambda c: f"regexp_full_match(r, '(?:{field(c)}){c}(?:{field(c)}){c}(?:{field(c)})')")
    part = lambda k: by_sep(lambda c: f"regexp_extract(r, '^({field(c)}){c}({field(c)}){c}({field(c)})$', {k})")
    plain = lambda e: _strip(f"CASE WHEN starts_with({e}, '\"') THEN replace(substr({e}, 2, length({e}) - 2), '\"\"', '\"') ELSE {e} END")
    missing = "('', 'NA', 'null', 'None')"
    return f"""h AS (SELECT path, min(raw_line) AS hd FROM large_test_lines WHERE line_no = 1 GROUP BY path),
        l AS (SELECT line_id, path, line_no, coalesce(raw_line, '') AS r, CASE WHEN contains(hd, ';') THEN ';' WHEN contains(hd, '\t') THEN '\t' WHEN contains(hd, '|') THEN '|' ELSE ',' END AS sep FROM large_test_lines LEFT JOIN h USING (path) WHERE line_no <> 1 OR line_no IS NULL),
        c AS (SELECT line_id, path, line_no, {quoted} AS q, {three} AS t, {part(1)} AS f1, {part(2)} AS f2, {part(3)} AS f3 FROM l),
        v AS (SELECT line_id, path, line_no, q, t, {plain('f1')} AS name, {plain('f2')} AS phone, {plain('f3')} AS snils FROM c),
        w AS (SELECT *, regexp_replace(phone, '{_WS}|[-()+]', '', 'g') AS p, regexp_replace(snils, '{_WS}|-', '', 'g') AS d FROM v),
        records AS (SELECT *, CASE WHEN NOT q THEN 'quoting' WHEN NOT t THEN 'columns' WHEN NOT regexp_matches(name, '\\p{{L}}') THEN 'bad_name' WHEN phone NOT IN {missing} AND NOT regexp_full_match(p, '[78][0-9]{{10}}') THEN 'bad_phone'
            WHEN snils NOT IN {missing} AND NOT CASE WHEN regexp_full_match(d, '[0-9]{{11}}') THEN {_SNILS_OK} ELSE false END THEN 'bad_snils' END AS reason FROM w)"""


@query("p5_found", f"WITH {_records_sql()} SELECT line_id, reason FROM records WHERE reason IS NOT NULL")
def p5_found(spark, d):
    return badrows.bad_rows(table(spark, d, "large_test_lines")).select("line_id", "reason")


@query(
    "p5_loaded",
    f"""WITH {_records_sql()} SELECT line_id, path, line_no, name AS fio, CASE WHEN phone NOT IN ('', 'NA', 'null', 'None') THEN '7' || substr(p, 2) END AS phone,
        CASE WHEN snils NOT IN ('', 'NA', 'null', 'None') THEN d END AS snils FROM records WHERE reason IS NULL""",
)
def p5_loaded(spark, d):
    return badrows.valid_rows(table(spark, d, "large_test_lines"))


@query("p5_recovered")
def p5_recovered(spark, d):
    """Valid records found behind a broken quote, loaded with the line they stood in."""
    return badrows.recovered_rows(table(spark, d, "large_test_lines"))


@query("p5_rejected")
def p5_rejected(spark, d):
    return badrows.bad_rows(table(spark, d, "large_test_lines"))


# ---------------------------------------------------------------- detectors: a text for each customer, every fifth without a match

_K = "c_custkey"
_S = f"CASE {_K} % 3 WHEN 0 THEN 'Иванов' WHEN 1 THEN 'Петровская' ELSE 'Лунин' END"


def _pad(e: str, n: int, c: str = "0") -> str:
    return f"lpad(CAST({e} AS STRING), {n}, '{c}')"


_N9 = f"('1' || {_pad(f'({_K} * 7919) % 100000000', 8)})"
_SNC = f"(CASE WHEN ({_sum(_N9, V.SNILS)}) % 101 = 100 THEN 0 ELSE ({_sum(_N9, V.SNILS)}) % 101 END)"
_INC = f"(({_sum(_N9, V.INN_10)}) % 11 % 10)"
_C15 = f"('5' || {_pad(f'({_K} * 104729) % 100000000', 14)})"
_LUHN_SUM = " + ".join(f"CASE WHEN {k % 2} = 0 THEN (2 * CAST(substr({_C15}, {k + 1}, 1) AS INT)) % 10 + CASE WHEN CAST(substr({_C15}, {k + 1}, 1) AS INT) > 4 THEN 1 ELSE 0 END ELSE CAST(substr({_C15}, {k + 1}, 1) AS INT) END" for k in range(15))
_CC = f"((10 - ({_LUHN_SUM}) % 10) % 10)"
_DAY, _MON, _YR = _pad(f"{_K} % 28 + 1", 2), _pad(f"{_K} % 12 + 1", 2), f"(1950 + {_K} % 50)"


def _dashed(n9: str) -> str:
    return f"substr({n9}, 1, 3) || '-' || substr({n9}, 4, 3) || '-' || substr({n9}, 7, 3)"


#: detector: (text, expected value)
_CASES = {
    "full_name_context": (f"'Дело {{k}}. Заявитель: ' || {_S} || ' Пётр, ждёт'", f"'заявитель:' || lower({_S}) || 'пётр'"),
    "full_name": (f"'Дело {{k}}: ' || {_S} || ' Пётр Иванович.'", f"lower({_S}) || 'пётриванович'"),
    "initials_name": (f"'Дело {{k}}: ' || {_S} || ' П.И. ушёл'", f"lower({_S}) || 'п.и.'"),
    "phone": (f"'тел. +7 (' || {_pad(f'{_K} % 1000', 3)} || ') 123-45-67, звонить'", f"'+7(' || {_pad(f'{_K} % 1000', 3)} || ')1234567'"),
    "email": ("'mail: u{k}@example.org, ok'", "'u{k}@example.org'"),
    "date_of_birth": (f"'Дата рождения: ' || {_DAY} || '.' || {_MON} || '.' || {_YR} || ', место'", f"'датарождения:' || {_DAY} || '.' || {_MON} || '.' || {_YR}"),
    "date_verbal": (f"'выдан ' || {_DAY} || ' мая ' || {_YR} || ' года отделом'", f"{_DAY} || 'мая' || {_YR} || 'года'"),
    "address": (f"'адрес: ул. Лесная, дом ' || ({_K} % 200 + 1) || ', кв. 5. Ждём'", f"'ул.лесная,дом' || ({_K} % 200 + 1) || ',кв.5'"),
    "postal_code": (f"'индекс: ' || (100000 + {_K} % 500000) || ' почта'", f"'индекс:' || (100000 + {_K} % 500000)"),
    "passport_rf": (f"'паспорт ' || {_pad(f'{_K} % 99 + 1', 2)} || '05 ' || {_pad(_K, 6)} || ' выдан'", f"'паспорт' || {_pad(f'{_K} % 99 + 1', 2)} || '05' || {_pad(_K, 6)}"),
    "snils": (f"'номер ' || {_dashed(_N9)} || ' ' || {_pad(_SNC, 2)} || ' есть'", f"{_N9} || {_pad(_SNC, 2)}"),
    "inn": (f"'ИНН: ' || {_N9} || {_INC} || ' есть'", f"'инн:' || {_N9} || {_INC}"),
    "driver_license": (f"'driver licence ' || {_pad(f'{_K} % 10000', 4)} || ' ' || {_pad(_K, 6)} || ' b'", f"'driverlicence' || {_pad(f'{_K} % 10000', 4)} || {_pad(_K, 6)}"),
    "mrz": (f"'mrz P<RUS' || repeat('<', 20) || {_pad(_K, 10)} || ' end'", f"'p<rus' || repeat('<', 20) || {_pad(_K, 10)}"),
    "card_number": (f"'карта ' || substr({_C15}, 1, 4) || ' ' || substr({_C15}, 5, 4) || ' ' || substr({_C15}, 9, 4) || ' ' || substr({_C15}, 13, 3) || {_CC} || ' есть'", f"{_C15} || {_CC}"),
    "cvv": (f"'код cvv: ' || {_pad(f'{_K} % 1000', 3)} || ' есть'", f"'cvv:' || {_pad(f'{_K} % 1000', 3)}"),
    "card_expiry": (f"'card valid thru ' || {_MON} || '/' || (25 + {_K} % 10) || ' ok'", f"'validthru' || {_MON} || '/' || (25 + {_K} % 10)"),
    "bank_account": (f"'счёт р/с ' || {_pad(_K, 20, '4')} || ' банк'", f"'р/с' || {_pad(_K, 20, '4')}"),
    "bic": (f"'банк БИК 04' || {_pad(_K, 7)} || ' есть'", f"'бик04' || {_pad(_K, 7)}"),
    "iban": (f"'to DE' || {_pad(f'{_K} % 100', 2)} || 'ABCD' || {_pad(_K, 10)} || ' now'", f"'de' || {_pad(f'{_K} % 100', 2)} || 'abcd' || {_pad(_K, 10)}"),
    "biometric": (f"'{{k}}: ' || CASE {_K} % 2 WHEN 0 THEN 'Face  recognition' ELSE 'отпечатки пальцев' END", f"CASE {_K} % 2 WHEN 0 THEN 'facerecognition' ELSE 'отпечаткипальц' END"),
    "health": (f"'{{k}}: ' || CASE {_K} % 2 WHEN 0 THEN 'Диагноз ясен' ELSE 'история болезни тут' END", f"CASE {_K} % 2 WHEN 0 THEN 'диагноз' ELSE 'историяболезни' END"),
    "religion": (f"'{{k}}: ' || CASE {_K} % 2 WHEN 0 THEN 'Faith tested' ELSE 'вероисповедание есть' END", f"CASE {_K} % 2 WHEN 0 THEN 'faith' ELSE 'вероисповедание' END"),
    "political": (f"'{{k}}: ' || CASE {_K} % 2 WHEN 0 THEN 'Член партии ушёл' ELSE 'политические взгляды' END", f"CASE {_K} % 2 WHEN 0 THEN 'членпартии' ELSE 'политическиевзгляд' END"),
    "race_ethnicity": (f"'{{k}}: ' || CASE {_K} % 2 WHEN 0 THEN 'Этнос малый' ELSE 'национальность иная' END", f"CASE {_K} % 2 WHEN 0 THEN 'этнос' ELSE 'национальность' END"),
    "criminal": (f"'{{k}}: ' || CASE {_K} % 2 WHEN 0 THEN 'Судимости нет' ELSE 'уголовное дело' END", f"CASE {_K} % 2 WHEN 0 THEN 'судимости' ELSE 'уголовноедело' END"),
}


def _with_key(e: str) -> str:
    return e.replace("'{k}", f"CAST({_K} AS STRING) || '").replace("{k}", f"' || CAST({_K} AS STRING) || '")


def _detector(name: str):
    text, value = map(_with_key, _CASES[name])

    @query(f"pattern_{name}", f"SELECT {_K}, {value} AS value, CAST(1 AS BIGINT) AS count FROM customer WHERE {_K} % 5 <> 0")
    def q(spark, d):
        docs = table(spark, d, "customer").select(_K, F.expr(f"CASE WHEN {_K} % 5 = 0 THEN concat('ничего нет, row ', {_K}) ELSE {text} END").alias("text"))
        return detect.findings(docs, [_K], detectors=[name]).select(_K, "value", "count")

    return q


for _name in _CASES:
    _detector(_name)



def _tokens(key: str, text: str, table: str) -> str:
    return f"SELECT {key}, unnest(regexp_split_to_array({text}, '[^A-Za-z0-9._%+\\-@]+')) AS t FROM {table}"


_EMAIL = "regexp_full_match(t, '[A-Za-z0-9._%+\\-]{1,64}@[A-Za-z0-9.\\-]{1,253}\\.[A-Za-z]{2,10}')"


@query("email_findings", f"SELECT result_id, lower(replace(t, '-', '')) AS value, count(*) AS count FROM ({_tokens(key='result_id', text=_clean('text'), table='extraction_results')}) WHERE {_EMAIL} GROUP BY ALL")
def email_findings(spark, d):
    return detect.findings(texts(spark, d), ["result_id"], detectors=["email"], clean=True).select("result_id", "value", "count")


def texts(spark, d):
    # texts differ much in work, so there are several tasks for each core
    return spread(table(spark, d, "extraction_results").select("result_id", "text"), 4)


@query(
    "email_context",
    f"""WITH c AS (SELECT result_id, {_clean('text')} AS x FROM extraction_results), m AS (SELECT result_id, min(t) AS t FROM (SELECT result_id, unnest(regexp_split_to_array(x, '[^A-Za-z0-9._%+\\-@]+')) AS t FROM c) WHERE {_EMAIL} GROUP BY 1 HAVING count(*) = 1),
        p AS (SELECT result_id, x, length(t) AS n, strpos(x, t) - 1 AS a FROM c JOIN m USING (result_id) WHERE len(string_split(x, t)) = 2)
        SELECT result_id, (CASE WHEN a > 60 THEN '…' ELSE '' END) || substr(x, greatest(a - 60, 0) + 1, least(length(x), a + n + 60) - greatest(a - 60, 0)) || (CASE WHEN a + n + 60 < length(x) THEN '…' ELSE '' END) AS context_snippet FROM p""",
)
def email_context(spark, d):
    f = detect.findings(texts(spark, d), ["result_id"], detectors=["email"], clean=True)
    one = f.groupBy("result_id").agg(F.sum("count").alias("n"), F.first("context_snippet").alias("context_snippet")).filter("n = 1")
    return one.select("result_id", "context_snippet")


@query("email_contexts")
def email_contexts(spark, d):
    """The context of every finding, that of the value's first occurrence; email_context is the part that its SQL describes."""
    return detect.findings(texts(spark, d), ["result_id"], detectors=["email"], clean=True).select("result_id", "value", "context_snippet")


@query("chunk_findings", f"SELECT result_id, lower(replace(t, '-', '')) AS value, count(*) AS count FROM ({_tokens(key='result_id', text='c', table='(SELECT result_id, unnest(chunks) AS c FROM extraction_results)')}) WHERE {_EMAIL} GROUP BY ALL")
def chunk_findings(spark, d):
    chunks = spread(table(spark, d, "extraction_results").select("result_id", "chunks")).select("result_id", F.posexplode("chunks").alias("chunk_no", "text"))
    return detect.findings(chunks, ["result_id"], detectors=["email"], chunk="chunk_no").select("result_id", "value", "count")


@query("all_findings")
def all_findings(spark, d):
    """All 26 detectors over every extracted text, as a file scan runs them."""
    f = detect.findings(texts(spark, d).filter(X.worth_reading(X.clean_text(F.col("text")), 30)), ["result_id"], clean=True)
    return f.select("result_id", "pattern_name", "category", "value", "count", "validated", "is_special_category", "is_biometric", "context_snippet")


@query("all_levels")
def all_levels(spark, d):
    """The whole scan: texts to findings, counts by pattern and protection level."""
    r = detect.rollup(detect.findings(texts(spark, d).filter(X.worth_reading(X.clean_text(F.col("text")), 30)), ["result_id"], clean=True), ["result_id"])
    return r.select("result_id", "total_findings", "total_matches", X.category_text(F.col("pii_categories")).alias("categories"), classify.level(F.col("pii_categories")).alias("uz_level"))


@query(
    "alias_merge",
    """WITH n AS (SELECT c_nationkey, count(*) FILTER (c_custkey % 3 = 0) AS n0, count(*) FILTER (c_custkey % 3 = 1) AS n1, count(*) FILTER (c_custkey % 3 = 2) AS n2 FROM customer GROUP BY 1)
       SELECT c_nationkey, 'full_name_context' AS pattern_name, 'заявитель:ивановпётриванович' AS value, 2 * n0 + n1 AS count FROM n WHERE n0 > 0
       UNION ALL SELECT c_nationkey, 'full_name', 'ивановпётриванович', n1 FROM n WHERE n0 = 0 AND n1 > 0
       UNION ALL SELECT c_nationkey, 'full_name', 'сидороволегпетрович', n2 FROM n WHERE n2 > 0""",
)
def alias_merge(spark, d):
    k = F.col("c_custkey") % 3
    t = F.when(k == 0, "Заявитель: Иванов Пётр Иванович").when(k == 1, "Тут был Иванов Пётр Иванович.").otherwise("Тут был Сидоров Олег Петрович.")
    docs = table(spark, d, "customer").select("c_nationkey", "c_custkey", t.alias("text"))
    return detect.findings(docs, ["c_nationkey"], detectors=["full_name_context", "full_name"], chunk="c_custkey").select("c_nationkey", "pattern_name", "value", "count")


@query("registry")
def registry_q(spark, d):
    return registry.dimension(spark)


# ---------------------------------------------------------------- roll-ups of the findings table


def known_findings(spark, d):
    dims = F.broadcast(registry.dimension(spark).select("pattern_no", "pattern_name"))
    return table(spark, d, "pii_findings").drop("path").join(dims, "pattern_name")


_NO = "CASE pattern_name " + " ".join(f"WHEN '{x.name}' THEN {x.number}" for x in registry.DETECTORS) + " END"


@query(
    "result_rollup",
    f"""WITH p AS (SELECT result_id, {_NO} AS no, pattern_name, count(*) AS n, sum(count) AS m FROM pii_findings WHERE {_NO} IS NOT NULL GROUP BY ALL),
        c AS (SELECT result_id, string_agg(category, ',' ORDER BY category) AS categories FROM (SELECT DISTINCT result_id, category FROM pii_findings) GROUP BY 1),
        b AS (SELECT result_id, max(is_special_category) AS has_special_categories, max(is_biometric) AS has_biometrics FROM pii_findings GROUP BY 1)
        SELECT result_id, categories, has_special_categories, has_biometrics, CAST(sum(m) AS BIGINT) AS total_matches, CAST(sum(n) AS BIGINT) AS total_findings, string_agg(pattern_name || '(' || n || ')', ', ' ORDER BY no) AS patterns
        FROM p JOIN c USING (result_id) JOIN b USING (result_id) GROUP BY ALL""",
)
def result_rollup(spark, d):
    r = detect.rollup(known_findings(spark, d), ["result_id"])
    return r.select("result_id", F.array_join("categories_found", ",").alias("categories"), "has_special_categories", "has_biometrics", "total_matches", "total_findings", X.category_text(F.col("pii_categories")).alias("patterns"))


@query("findings_by_category", "SELECT result_id, category, string_agg(DISTINCT value, '|' ORDER BY value) AS values_found, count(*) AS findings FROM pii_findings GROUP BY ALL")
def findings_by_category(spark, d):
    return detect.by_category(table(spark, d, "pii_findings"), ["result_id"]).withColumn("values_found", F.array_join("values_found", "|"))


@query("findings_json")
def findings_json(spark, d):
    return detect.as_json(known_findings(spark, d), ["result_id"])


# ---------------------------------------------------------------- classification and summaries


def _level_sql(n: str) -> str:
    group = lambda names: "sum(CASE WHEN k IN (" + ", ".join(f"'{x}'" for x in names) + ") THEN n ELSE 0 END)"
    return f"CASE WHEN {group(classify.SPECIAL)} > 0 THEN 'УЗ-1' WHEN {group(classify.PAYMENT)} > 0 OR {group(classify.STATE)} >= 5 THEN 'УЗ-2' WHEN {group(classify.STATE)} > 0 OR {group(classify.ORDINARY)} >= 20 THEN 'УЗ-3' ELSE 'УЗ-4' END AS {n}"


@query(
    "levels",
    f"""WITH r AS (SELECT row_number() OVER () AS i, result_id, pii_categories AS m FROM scan_results), e AS (SELECT i, upper(trim(x.key)) AS k, x.value AS n FROM (SELECT i, unnest(map_entries(m)) AS x FROM r)),
        l AS (SELECT i, {_level_sql('lv')} FROM e WHERE n > 0 GROUP BY i) SELECT result_id, coalesce(lv, 'УЗ-4') AS computed_level FROM r LEFT JOIN l USING (i)""",
)
def levels(spark, d):
    return table(spark, d, "scan_results").select("result_id", classify.level(F.col("pii_categories")).alias("computed_level"))


@query(
    "level_thresholds",
    """SELECT o_custkey, CASE WHEN f > 0 THEN 'УЗ-1' WHEN p > 0 OR s >= 5 THEN 'УЗ-2' WHEN s > 0 OR n >= 20 THEN 'УЗ-3' ELSE 'УЗ-4' END AS computed_level FROM (SELECT o_custkey,
       count(*) FILTER (o_orderkey % 97 = 0) AS f, count(*) FILTER (o_orderkey % 31 = 0) AS p, count(*) FILTER (o_orderkey % 3 = 0) AS s, count(*) * 3 AS n FROM orders GROUP BY 1)""",
)
def level_thresholds(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(k % 97 == 0).alias("f"), F.count_if(k % 31 == 0).alias("p"), F.count_if(k % 3 == 0).alias("s"), (F.count("*") * 3).alias("n"))
    m = F.create_map(F.lit(" health "), "f", F.lit("iban"), "p", F.lit("snils"), "s", F.lit("Phone"), "n")
    return c.select("o_custkey", classify.level(m).alias("computed_level"))


@query("ci_gate", "SELECT w AS worst, CASE WHEN w >= 2 THEN w ELSE 0 END AS exit_code FROM (SELECT coalesce(max(CASE uz_level WHEN 'УЗ-1' THEN 3 WHEN 'УЗ-2' THEN 2 WHEN 'УЗ-3' THEN 1 ELSE 0 END), 0) AS w FROM scan_results)")
def ci_gate(spark, d):
    return classify.gate(table(spark, d, "scan_results"), "УЗ-2")


@query("level_distribution", "SELECT l AS uz_level, count(r.uz_level) AS files FROM (VALUES ('УЗ-1'), ('УЗ-2'), ('УЗ-3'), ('УЗ-4')) v(l) LEFT JOIN scan_results r ON r.uz_level = l GROUP BY l")
def level_distribution(spark, d):
    return report.level_distribution(table(spark, d, "scan_results"))


@query("scan_totals", "SELECT count(*) AS total_files, count(*) FILTER (total_findings > 0) AS files_with_pii, count(*) FILTER (length(error) > 0) AS files_with_errors, count(*) FILTER (error IS NULL OR error = '') AS files_ok, count(*) FILTER (ocr_failed) AS ocr_failed FROM scan_results")
def scan_totals(spark, d):
    return report.totals(table(spark, d, "scan_results"))


@query("error_summary", "SELECT error, count(*) AS files FROM scan_results WHERE length(error) > 0 GROUP BY 1")
def error_summary(spark, d):
    return report.error_summary(table(spark, d, "scan_results"))


@query("category_totals", "SELECT x.key AS pattern_name, CAST(sum(x.value) AS BIGINT) AS findings FROM (SELECT unnest(map_entries(pii_categories)) AS x FROM scan_results) GROUP BY 1")
def category_totals(spark, d):
    return report.category_totals(table(spark, d, "scan_results"))


@query("top_errors", "SELECT path, CASE WHEN length(error) > 80 THEN left(error, 80) || '…' ELSE error END AS error FROM scan_results WHERE length(error) > 0 ORDER BY path, scan_results.error LIMIT 20")
def top_errors(spark, d):
    return report.top_errors(table(spark, d, "scan_results"))


@query(
    "csv_rows",
    """SELECT path, CASE WHEN len(list_filter(map_entries(pii_categories), lambda e: e.value > 0)) > 0 THEN array_to_string(list_transform(list_filter(map_entries(pii_categories), lambda e: e.value > 0), lambda e: e.key || '(' || e.value || ')'), ', ') ELSE '—' END AS categories,
       total_findings AS findings, uz_level AS level, file_format AS format, coalesce(error, '') AS error FROM scan_results""",
)
def csv_rows(spark, d):
    return report.csv_rows(table(spark, d, "scan_results"))


@query(
    "result_csv",
    "SELECT coalesce(max(size), 0) AS size, lower(strftime(max(mtime), '%b %d %H:%M')) AS time, string_split(path, '/')[-1] AS name FROM file_listing WHERE path IN (SELECT path FROM scan_results WHERE total_findings > 0) GROUP BY path",
)
def result_csv(spark, d):
    return report.result_csv(table(spark, d, "scan_results"), table(spark, d, "file_listing"))


@query("significant_files", "SELECT result_id, path FROM scan_results WHERE total_findings > 0 OR length(error) > 0")
def significant_files(spark, d):
    return report.significant(table(spark, d, "scan_results")).select("result_id", "path")


@query("filtered_files", "SELECT result_id, path FROM scan_results WHERE uz_level = 'УЗ-1' AND file_format = 'pdf' AND total_findings > 0 AND contains(lower(string_split(path, '/')[-1]), '0')")
def filtered_files(spark, d):
    return report.filtered(table(spark, d, "scan_results"), "УЗ-1", "pdf", "with", "0").select("result_id", "path")


# ---------------------------------------------------------------- sources

_EXT = "lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]+)$', 1))"
_IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_PRUNED = "len(list_filter(string_split(path, '/')[1:-2], lambda x: x <> '' AND (starts_with(x, '.') OR x IN " + _IN(files.IGNORED_DIRS) + "))) > 0"


@query("listed_files", f"SELECT path, min(size) AS size FROM file_listing WHERE size > 0 AND {_EXT} IN {_IN(files.LISTED)} AND NOT ({_PRUNED}) GROUP BY path")
def listed_files(spark, d):
    return files.scan_filter(table(spark, d, "file_listing")).groupBy("path").agg(F.min("size").alias("size")).drop("size").join(
        table(spark, d, "file_listing").filter("size > 0").groupBy("path").agg(F.min("size").alias("size")), "path"
    )


@query(
    "path_kinds",
    f"""SELECT listing_id, {_EXT} AS suffix, {_EXT} IN {_IN(files.EXTRACTABLE)} AS supported, {_EXT} IN {_IN(files.CONFIGURED)} AS configured, {_PRUNED} AS pruned,
        CASE {" ".join(f"WHEN {_EXT} IN {_IN(v.split())} THEN '{k}'" for k, v in files.EXTRACTORS.items())} END AS extractor FROM file_listing WHERE path IS NOT NULL""",
)
def path_kinds(spark, d):
    p = F.col("path")
    return table(spark, d, "file_listing").filter(p.isNotNull()).select("listing_id", X.suffix(p).alias("suffix"), files.supported(p).alias("supported"), files.configured(p).alias("configured"), files.pruned(p).alias("pruned"), files.extractor(p).alias("extractor"))


@query("mime_types", f"SELECT listing_id, CASE {_EXT} WHEN 'pdf' THEN 'application/pdf' WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'csv' THEN 'text/csv' WHEN 'png' THEN 'image/png' WHEN 'mp4' THEN 'video/mp4' ELSE 'other' END AS mime FROM file_listing WHERE path IS NOT NULL")
def mime_types(spark, d):
    m = files.mime(F.col("path"))
    return table(spark, d, "file_listing").filter("path is not null").select("listing_id", F.when(m.isin("application/pdf", "text/html", "text/csv", "image/png", "video/mp4"), m).otherwise("other").alias("mime"))


@query("tabular_lines", "SELECT c_custkey, trim(c_name) || ' ' || trim(c_mktsegment) AS line FROM customer")
def tabular_lines(spark, d):
    return tabular.lines(table(spark, d, "customer"), ["c_custkey"])


@query("tabular_person_lines", f"""SELECT row_id, line FROM (SELECT row_id, array_to_string(list_filter([{', '.join('(' + _strip(c) + ')' for c in ('фио', 'телефон', 'снилс', 'инн'))}], lambda x: x <> ''), ' ') AS line FROM person_rows) WHERE line <> ''""")
def tabular_person_lines(spark, d):
    return tabular.lines(table(spark, d, "person_rows"), ["row_id"], columns=["фио", "телефон", "снилс", "инн"])


@query("tabular_chunks", "SELECT c_nationkey, c_custkey // 500 AS chunk_no, string_agg(trim(c_name) || ' ' || trim(c_mktsegment), chr(10) ORDER BY c_custkey) AS text, count(*) AS rows FROM customer GROUP BY ALL")
def tabular_chunks(spark, d):
    return tabular.chunks(table(spark, d, "customer"), ["c_nationkey"], "c_custkey", 500, ["c_name", "c_mktsegment"]).withColumn("rows", F.col("rows").cast("bigint"))


@query("html_text", "SELECT doc_id, 'Doc & ' || doc_id AS title, 'from ' || coalesce(source, '') AS description, 'Head' || chr(10) || 'body <' || coalesce(lang, '') || '> end' AS visible, 'Doc & ' || doc_id || chr(10) || chr(10) || 'from ' || coalesce(source, '') || chr(10) || chr(10) || 'Head' || chr(10) || 'body <' || coalesce(lang, '') || '> end' || chr(10) || chr(10) || 'pic' AS text FROM documents")
def html_text(spark, d):
    page = F.concat(
        F.lit("<!doctype html><html><head><title> Doc &amp; "), F.col("doc_id"), F.lit(" </title><meta name=description content='from "), F.coalesce("source", F.lit("")),
        F.lit("'><style>p{}</style></head><body><script>var p = '</p>';</script><!-- no --><h1>Head</h1>\n<p>body &lt;"), F.coalesce("lang", F.lit("")), F.lit("&gt; end</p><img alt=' pic '><noscript>x</noscript></body></html>"),
    )
    return table(spark, d, "documents").select("doc_id", html.extract(page).alias("h")).select("doc_id", "h.title", "h.description", "h.visible", "h.text")


@query("subtitle_files", "SELECT listing_id, 'v' || listing_id || '.mp4' AS path, CASE WHEN listing_id % 3 = 0 THEN 'v' || listing_id || '.srt' WHEN listing_id % 3 = 1 THEN 'v' || listing_id || '.ass' END AS subtitle FROM file_listing")
def subtitle_files(spark, d):
    ids = table(spark, d, "file_listing").select("listing_id")
    name = lambda e: F.concat(F.lit("v"), F.col("listing_id"), F.lit(e)).alias("path")
    listing = ids.filter("listing_id % 3 = 0").select(name(".vtt")).union(ids.filter("listing_id % 3 = 0").select(name(".srt"))).union(ids.filter("listing_id % 3 = 1").select(name(".ass")))
    return documents.subtitles_of(ids.select("listing_id", name(".mp4")), listing).select("listing_id", "path", "subtitle")


@query(
    "video_probe",
    "SELECT listing_id, CAST(listing_id + 0.5 AS DOUBLE) AS duration, listing_id * 1000 AS bit_rate, 'mp4' AS format, CASE WHEN listing_id % 2 = 0 THEN 640 ELSE 0 END AS width, CAST(CASE WHEN listing_id % 2 = 0 THEN 25.0 ELSE 0 END AS DOUBLE) AS fps, 'aac' AS audio_codec, listing_id % 3 = 0 AS has_embedded_subtitles FROM file_listing",
)
def video_probe(spark, d):
    i = F.col("listing_id").cast("string")
    video = F.when(F.col("listing_id") % 2 == 0, '{"codec_type":"video","codec_name":"h264","width":640,"height":360,"r_frame_rate":"25/1"},').otherwise("")
    subs = F.when(F.col("listing_id") % 3 == 0, ',{"codec_type":"subtitle","codec_name":"mov_text"}').otherwise("")
    probe = F.concat(F.lit('{"format":{"duration":"'), i, F.lit('.5","bit_rate":"'), i, F.lit('000","format_name":"mp4"},"streams":['), video, F.lit('{"codec_type":"audio","codec_name":"aac","channels":2,"sample_rate":"44100"}'), subs, F.lit("]}"))
    p = table(spark, d, "file_listing").select("listing_id", documents.video_probe(probe).alias("v"))
    return p.select("listing_id", "v.duration", "v.bit_rate", "v.format", F.coalesce("v.width", F.lit(0)).alias("width"), F.coalesce("v.fps", F.lit(0.0)).alias("fps"), "v.audio_codec", "v.has_embedded_subtitles")


# ---------------------------------------------------------------- streaming


@query("stream_email_counts", f"SELECT doc_id, lower(replace(t, '-', '')) AS value, count(*) AS count FROM ({_tokens(key='doc_id', text=_clean('text'), table='documents')}) WHERE {_EMAIL} GROUP BY ALL")
def stream_email_counts(spark, d):
    path = f"{d}/documents.parquet"
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path):
        s = streaming.documents_stream(spark, path, schema)
    else:
        s = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(d)
    counts = streaming.counts_stream(s, ["doc_id"], detectors=["email"])
    name = f"stream_{uuid.uuid4().hex}"
    return streaming.run_once(counts, name, shared_folder(spark, name)).select("doc_id", "value", "count")
