import re

import pytest
from pyspark.sql import functions as F

from siftwork.functions.text import clean_text
from siftwork.operators import classify, detect, registry

TEXT = "Сотрудник: Иванов Иван Иванович, тел. +7 (916) 123-45-67, почта ivanov@mail.ru, СНИЛС 112-233-445 95, ИНН 7707083893, паспорт 4510 123456, карта 4111 1111 1111 1111."


def found(spark, *texts, **more):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "path int, text string")
    return detect.findings(docs, ["path"], **more)


def test_whole_text(spark):
    rows = {(r.pattern_name, r.value): r for r in found(spark, TEXT).collect()}
    names = {k for k, _ in rows}
    assert {"full_name_context", "phone", "email", "snils", "inn", "passport_rf", "card_number"} <= names
    assert "full_name" not in names  # the same person, merged into the name near the role
    assert rows["full_name_context", "сотрудник:ивановиваниванович"]["count"] == 2
    assert rows["snils", "11223344595"].validated and rows["phone", "+7(916)1234567"].validated is None


def test_duplicates_chunks_and_limits(spark):
    docs = spark.createDataFrame([(1, 0, "СНИЛС 112-233-445 95"), (1, 1, "и 112-233-445 95 опять"), (1, 2, None), (1, 3, ""), (2, 0, "коротко")], "path int, part int, text string")
    rows = detect.findings(docs, ["path"], chunk="part", detectors=["snils"]).collect()
    assert [(r.path, r.value, r["count"]) for r in rows] == [(1, "11223344595", 2)]
    assert rows[0].context_snippet == "СНИЛС 112-233-445 95"
    assert found(spark).count() == 0
    assert found(spark, None, "", "x" * 5).count() == 0


def test_plain_merge_keeps_aliases(spark):
    assert found(spark, "Заявитель: Иванов Пётр Иванович", deduplicate=False, detectors=["full_name", "full_name_context"]).count() == 2


def test_lines_joined_only_when_cleaned(spark):
    t = "почта a@b.ru, карта 4111 1111\n1111 1111 конец"
    assert {r.pattern_name for r in found(spark, t, clean=True).collect()} == {"email", "card_number"}
    assert found(spark, "x@y.org. Стоп", detectors=["email"]).count() == 0  # a stop behind the address


# independent expectations, by hand
SAMPLES = [
    ("full_name", "Иванова Мария Петровна тут", ["Иванова Мария Петровна"]),
    ("initials_name", "пришёл Петров И.И. и А.А. Сидоров", ["Петров И.И.", "А.А. Сидоров"]),
    ("phone", "8(495)123-45-67 или +7 916 1234567, но не 123456789012345", ["8(495)123-45-67", "+7 916 1234567"]),
    ("date_of_birth", "Дата рождения: 01.02.1990; DOB 1985-12-31", ["Дата рождения: 01.02.1990", "DOB 1985-12-3"]),
    ("date_verbal", "5 мая 1999 года и 31 декабря 2001", ["5 мая 1999 года", "31 декабря 2001"]),
    ("postal_code", "индекс 101000, г. Москва, 123456", ["индекс 101000", " г. Москва, 123456"]),
    ("inn", "İNN 7707083893 и ИНН: 500100732259", ["İNN 7707083893", "ИНН: 500100732259"]),
    ("driver_license", "В.У. 77 АА 123456, ву 7712 654321", ["В.У. 77 АА 123456", "ву 7712 654321"]),
    ("cvv", "CVV2: 123, cvc 4567", ["CVV2: 123", "cvc 4567"]),
    ("card_expiry", "Valid thru 12/27, exp. 01/2030", ["Valid thru 12/27", "exp. 01/2030"]),
    ("bank_account", "р/с 40702810900000000001", ["р/с 40702810900000000001"]),
    ("bic", "БИК 044525225", ["БИК 044525225"]),
    ("iban", "DE89370400440532013000 xDE", ["DE89370400440532013000"]),
    ("health", "Диагноз и история болезни; Иванович", ["Диагноз", "история болезни", "вич"]),
    ("religion", "ПРАВОСЛАВНЫЙ, faiſh faith", ["ПРАВОСЛАВ", "faith"]),
    ("race_ethnicity", "этнос, этносы", ["этнос"]),
    ("criminal", "нет судимости", ["судимости"]),
    ("address", "живёт: ул. Ленина, дом 5, кв. 7", ["ул. Ленина, дом 5, кв. 7"]),
]


@pytest.mark.parametrize("name, text, want", SAMPLES, ids=[s[0] for s in SAMPLES])
def test_samples(spark, name, text, want):
    docs = spark.createDataFrame([(text,)], "text string")
    d = registry.BY_NAME[name]
    got = docs.select(detect.located(detect.cut(F.col("text"), detect.fold(F.col("text")), d)).alias("m")).first().m
    assert [m.raw for m in got] == want
    assert [text[m.start : m.start + len(m.raw)] for m in got] == want


def test_registry():
    assert len(registry.DETECTORS) == 26 and registry.CHECKED == {"passport_rf", "snils", "inn", "card_number"}
    assert all(d.stems or d.gate or d.name in ("address",) for d in registry.DETECTORS)


def test_rollup_and_json(spark):
    f = found(spark, TEXT, "ничего личного тут нет вовсе")
    r = detect.rollup(f, ["path"]).collect()
    assert len(r) == 1 and r[0].total_findings == sum(r[0].pii_categories.values()) and not r[0].has_biometrics
    j = detect.as_json(f, ["path"]).first().findings_json
    assert "7707083893" not in j and re.search(r"\*{3}", j)
    assert {x.category for x in detect.by_category(f, ["path"]).collect()} >= {"contact", "government_id"}


LEVELS = [
    ({}, "УЗ-4"), (None, "УЗ-4"), ({"FIO": 3, "EMAIL": 2}, "УЗ-4"), ({"FIO": 19}, "УЗ-4"), ({"FIO": 20}, "УЗ-3"), ({"PASSPORT": 3}, "УЗ-3"), ({"snils ": 4}, "УЗ-3"), ({"SNILS": 5}, "УЗ-2"),
    ({"CREDIT_CARD": 1}, "УЗ-2"), ({"health": 1, "FIO": 100}, "УЗ-1"), ({"health": 0}, "УЗ-4"), ({"passport_rf": 9, "criminal": 4}, "УЗ-4")
]


@pytest.mark.parametrize("counts, want", LEVELS)
def test_levels(spark, counts, want):
    df = spark.createDataFrame([(counts,)], "m map<string,bigint>")
    assert df.select(classify.level(F.col("m")).alias("x")).first().x == want


def test_last_of_equal_keys_wins(spark):
    m = F.create_map(F.lit("fio"), F.lit(30), F.lit("FIO"), F.lit(1))
    assert spark.range(1).select(classify.level(m).alias("x")).first().x == "УЗ-4"


def test_mapped_profile_and_gate(spark):
    df = spark.createDataFrame([({"passport_rf": 9},), ({"criminal": 1},)], "m map<string,bigint>").select(classify.level(F.col("m"), mapped=True).alias("uz_level"))
    assert sorted(r.uz_level for r in df.collect()) == ["УЗ-1", "УЗ-2"]
    assert classify.gate(df).first().exit_code == 3
    assert classify.gate(df.filter("uz_level = 'УЗ-2'")).first().exit_code == 0
    assert tuple(classify.gate(df.limit(0)).first()) == (0, 0)


def test_clean_is_stable(spark):
    df = spark.createDataFrame([("« a» b\r\n",)], "t string")
    once = df.select(clean_text(F.col("t")).alias("t"))
    assert once.select(clean_text(F.col("t")).alias("t")).collect() == once.collect()


def test_email_contexts_of_every_finding(spark, tmp_path):
    from siftwork.queries import QUERIES

    pad = "много слов о делах архива и его сотрудниках " * 3
    texts = {
        1: f"{pad}первый a.b@mail.ru {pad}второй C.D@mail.ru {pad}снова A.B@mail.ru конец",
        2: "пишите x@y.com и z@y.com",
        3: f"один e-mail: only-one@firma.de {pad.strip()}",
        4: "без адреса здесь ничего",
    }
    spark.createDataFrame(list(texts.items()), "result_id long, text string").write.parquet(str(tmp_path / "extraction_results.parquet"))
    want = set()
    for k, t in texts.items():
        seen = set()
        for m in re.finditer(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,10}", t):
            value = m[0].lower().replace("-", "")
            if value not in seen:
                a, b = max(m.start() - 60, 0), min(m.end() + 60, len(t))
                want.add((k, value, "…" * (a > 0) + t[a:b] + "…" * (b < len(t))))
            seen.add(value)
    rows = QUERIES["email_contexts"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) == 5
