"""Protection level of a file from its counts by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that the rules know, upper-cased, and the thresholds.
SPECIAL = "БИОМЕТРИЯ BIOMETRIC BIOMETRY ЗДОРОВЬЕ HEALTH MEDICAL РЕЛИГИЯ RELIGION ПОЛИТИКА POLITICAL РАСА RACE ETHNICITY SPECIAL SPECIAL_CATEGORY".split()
PAYMENT = "НОМЕР_КАРТЫ CREDIT_CARD CARD_NUMBER БАНКОВСКИЙ_СЧЕТ BANK_ACCOUNT IBAN ПЛАТЕЖНЫЕ_ДАННЫЕ PAYMENT".split()
STATE = "ПАСПОРТ PASSPORT СНИЛС SNILS ИНН INN ВОДИТЕЛЬСКОЕ_УДОСТОВЕРЕНИЕ DRIVERS_LICENSE MRZ ГОСУДАРСТВЕННЫЕ_ИДЕНТИФИКАТОРЫ".split()
ORDINARY = "ФИО FIO FULL_NAME NAME ТЕЛЕФОН PHONE EMAIL ДАТА_РОЖДЕНИЯ BIRTHDATE АДРЕС ADDRESS МЕСТО_РОЖДЕНИЯ".split()
MANY_STATE, MANY_ORDINARY = 5, 20
LEVELS = ("УЗ-1", "УЗ-2", "УЗ-3", "УЗ-4")
EXIT_CODES = {"УЗ-1": 3, "УЗ-2": 2, "УЗ-3": 1, "УЗ-4": 0}
#: Detector names that the default rules don't know, with the names they would count as in the mapped profile.
MAPPED = {"PASSPORT_RF": "PASSPORT", "DRIVER_LICENSE": "DRIVERS_LICENSE", "FULL_NAME_CONTEXT": "FULL_NAME", "INITIALS_NAME": "FULL_NAME", "DATE_OF_BIRTH": "BIRTHDATE", "RACE_ETHNICITY": "RACE", "CRIMINAL": "SPECIAL"}


def normal_key(c: Column) -> Column:
    return F.upper(F.trim(c))


def level(counts: Column, mapped: bool = False) -> Column:
    """The level of a map of counts; null and empty maps are УЗ-4, counts of 0 or less don't count, of keys that become equal the last wins."""
    entries = F.filter(F.map_entries(F.coalesce(counts, F.create_map().cast("map<string,bigint>"))), lambda e: e["value"] > 0)
    known = F.create_map(*[F.lit(x) for kv in MAPPED.items() for x in kv])
    name = (lambda k: F.coalesce(known[normal_key(k)], normal_key(k))) if mapped else normal_key
    named = F.transform(entries, lambda e: F.struct(name(e["key"]).alias("k"), e["value"].cast("bigint").alias("n")))
    if not mapped:  # mapped names add up instead
        named = F.filter(F.transform(named, lambda x, i: F.struct(x["k"].alias("k"), x["n"].alias("n"), F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda y: y["k"] == x["k"]).alias("later"))), lambda x: ~x["later"])
    total = lambda keys: F.aggregate(F.filter(named, lambda x: x["k"].isin(keys)), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return (
        F.when(F.exists(named, lambda x: x["k"].isin(SPECIAL)), LEVELS[0])
        .when((total(PAYMENT) > 0) | (total(STATE) >= MANY_STATE), LEVELS[1])
        .when((total(STATE) > 0) | (total(ORDINARY) >= MANY_ORDINARY), LEVELS[2])
        .otherwise(LEVELS[3])
    )


def severity(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in EXIT_CODES.items() for x in kv])[level]


def gate(results: DataFrame, fail_on: str = "УЗ-1") -> DataFrame:
    """One row: the worst level, and the exit code of a check that fails from fail_on upwards."""
    worst = results.agg(F.coalesce(F.max(severity(F.col("uz_level"))), F.lit(0)).alias("worst"))
    return worst.select("worst", F.when(F.col("worst") >= EXIT_CODES[fail_on], F.col("worst")).otherwise(0).alias("exit_code"))
