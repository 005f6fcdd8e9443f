"""Detection: texts to matches, matches to findings, findings to one result per file.

All detectors run in one projection, so a text is read once; each cuts it at its matches, and only these, with their places and contexts, are
exploded, not the text. A detector is skipped where none of its stems, or not its gate, is in the text. Equal values of a file are counted before
the shuffle that brings them together; names and passports are folded after that, over their distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.functions.validators import valid
from siftwork.operators.registry import BY_NAME, DETECTORS, Detector
from siftwork.util import map_rows


#: A noncharacter, which texts don't hold, marks where matches begin and end.
MARK = "\ufdd0"


def cut(text: Column, folded: Column, d: Detector) -> Column:
    """The text cut at both ends of a detector's matches: gaps and matches alternate. Null where no stem is in the folded text or the gate fails."""
    tests = [folded.contains(x) for x in d.stems] + ([text.rlike(d.gate)] if d.gate else [])
    parts = F.split(F.regexp_replace(text, d.pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(reduce(lambda a, b: a | b, tests), parts) if tests else parts


def located(parts: Column) -> Column:
    """array<struct<start, raw>> of the matches of a cut text."""
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.array().cast("array<struct<start:int,raw:string>>").alias("out"))
    walked = F.aggregate(
        parts,
        begin,
        lambda s, x: F.struct(
            (s["at"] + F.length(x)).alias("at"),
            (~s["match"]).alias("match"),
            F.when(s["match"], F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), x.alias("raw"))))).otherwise(s["out"]).alias("out"),
        ),
    )
    return walked["out"]


def fold(text: Column) -> Column:
    """Lower case, with the letters that case folding takes for i, s and k."""
    return F.lower(F.translate(text, "İıſK", "iisk"))


def matches(docs: DataFrame, text: str = "text", detectors: list[str] | None = None, clean: bool = False, min_text_length: int = 10) -> DataFrame:
    """docs' columns but text, with (pattern_no, pattern_name, start, raw, context) for every accepted match.

    Empty and too short matches and failed checksums are dropped. clean: collapse white space first, as file scans do.
    """
    chosen = [BY_NAME[n] for n in detectors] if detectors else DETECTORS
    keep = [c for c in docs.columns if c != text]
    t = docs.withColumn(text, X.clean_text(F.col(text)) if clean else F.col(text)).filter(F.length(text) >= min_text_length)
    c = F.col(text)
    t = t.select(*keep, text, fold(c).alias("_f"))

    def found(d: Detector) -> Column:
        parts = cut(c, F.col("_f"), d)
        item = lambda x: F.struct(F.lit(d.number).alias("pattern_no"), x["start"].alias("start"), X.stripped(x["raw"]).alias("raw"), X.snippet(c, x["start"], F.length(x["raw"])).alias("context"))
        # named once only: a pattern in two branches would run twice
        return F.coalesce(F.transform(located(parts), item), F.array())

    m = t.select(*keep, F.explode(F.flatten(F.array(*map(found, chosen)))).alias("_x")).select(*keep, "_x.*")
    name = F.create_map(*[F.lit(v) for d in chosen for v in (d.number, d.name)])[F.col("pattern_no")]
    shortest = F.create_map(*[F.lit(v) for d in chosen for v in (d.number, d.min_length)])[F.col("pattern_no")]
    m = m.withColumn("pattern_name", name).filter((F.length("raw") > 0) & (F.length("raw") >= shortest))
    return m.filter(valid(F.col("pattern_name"), F.col("raw"))).withColumn("value", X.normalize_value(F.col("raw")))


def merged(m: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per (keys, pattern, value): how often, and the context of the first in `order`."""
    return m.groupBy(*keys, "pattern_no", "pattern_name", "value").agg(
        F.count("*").alias("count"),
        F.min_by("context", F.struct(*order)).alias("context_snippet"),
        F.min(F.struct(*order)).alias("first"),
    )


MERGED = "pattern_no int, pattern_name string, value string, count bigint, context_snippet string"


def alias_folded(rows: list[tuple]) -> list[tuple]:
    """Rows (pattern_no, first place, pattern_name, value, probe, count, context) of one group to MERGED's columns.

    In order, a value whose probe stands in the value of an earlier finding adds to the first such one. Earlier findings are looked up by
    the rarest three letters of the probe.
    """
    if len(rows) == 1:
        no, _, name, value, _, count, context = rows[0]
        return [(no, name, value, count, context)]
    out: list[list] = []
    holders: dict[str, list[int]] = {}
    for no, _, name, value, probe, count, context in sorted(rows, key=lambda r: (r[0], tuple(r[1]), r[3])):
        probe = probe or ""
        grams = [probe[k : k + 3] for k in range(len(probe) - 2)]
        where = min((holders.get(g, []) for g in grams), key=len) if grams else range(len(out))
        hit = next((k for k in where if probe in out[k][2]), None)
        if hit is not None:
            out[hit][3] += count
            continue
        for g in {value[k : k + 3] for k in range(len(value) - 2)}:
            holders.setdefault(g, []).append(len(out))
        out.append([no, name, value, count, context])
    return [tuple(r) for r in out]


def alias_merged(m: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """merged(), but a match of a detector with a probe whose probe stands in the value of a finding of its group adds to that finding.

    Names near role words come first, then full names, each in text order; this fixes the order that decides which finding is credited. A
    group is the distinct names, or passports, of one file; findings of other detectors are groups of one.
    """
    surname = reduce(lambda a, d: F.when(F.col("pattern_name") == d, F.regexp_extract("raw", BY_NAME[d].pattern, 1)).otherwise(a), ["full_name_context", "full_name"], F.lit(None))
    probe = F.when(F.col("pattern_name") == "passport_rf", F.col("value")).otherwise(X.normalize_value(surname))
    distinct = m.withColumn("probe", probe).groupBy(*keys, "pattern_no", "pattern_name", "value", "probe").agg(
        F.count("*").alias("count"), F.min_by("context", F.struct(*order)).alias("context_snippet"), F.min(F.struct(*order)).alias("first")
    )
    group = reduce(lambda a, d: F.when(F.col("pattern_name") == d.name, d.probe).otherwise(a), [d for d in DETECTORS if d.probe], F.concat_ws("=", "pattern_no", "value"))
    first = F.array(*[F.col(f"first.{o}").cast("bigint") for o in order])
    item = F.struct("pattern_no", first.alias("first"), "pattern_name", "value", "probe", "count", "context_snippet")
    grouped = distinct.groupBy(*keys, group.alias("_g")).agg(F.collect_list(item).alias("_l")).drop("_g")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.select(*keys).schema)
    # one plan for all groups: two branches would read the texts twice
    return map_rows(grouped, lambda: lambda *row: [(*row[:-1], *r) for r in alias_folded([tuple(x.values()) for x in row[-1]])], f"{kinds}, {MERGED}")


def findings(docs: DataFrame, keys: list[str], text: str = "text", detectors: list[str] | None = None, clean: bool = False, deduplicate: bool = True, min_text_length: int = 10, chunk: str | None = None) -> DataFrame:
    """keys + (pattern_no, pattern_name, category, description, value, count, validated, is_special_category, is_biometric, context_snippet).

    chunk: a column that numbers the parts of one key's text; patterns don't span parts. Without deduplicate only equal values merge.
    """
    order = ([chunk] if chunk else []) + ["start"]
    docs = docs.select(*keys, *([chunk] if chunk else []), text)
    m = matches(docs, text, detectors, clean, min_text_length)
    probed = [d for d in DETECTORS if d.probe and (not detectors or d.name in detectors)]
    out = alias_merged(m, keys, order) if probed and deduplicate else merged(m, keys, order).drop("first")
    return described(out, keys)


def described(f: DataFrame, keys: list[str]) -> DataFrame:
    """Adds what the registry says; `validated` is true for checked detectors, else null."""
    look = lambda get: F.create_map(*[F.lit(v) for d in DETECTORS for v in (d.number, get(d))])[F.col("pattern_no")]
    return f.select(
        *keys, "pattern_no", "pattern_name", look(lambda d: d.category).alias("category"), look(lambda d: d.description).alias("description"), "value", "count",
        F.when(look(lambda d: d.checked), True).alias("validated"), look(lambda d: d.special).alias("is_special_category"), look(lambda d: d.biometric).alias("is_biometric"), "context_snippet",
    )


def rollup(f: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: categories, flags, matches, distinct findings and their number by pattern."""
    per = f.groupBy(*keys, "pattern_no", "pattern_name", "category").agg(F.count("*").alias("n"), F.sum("count").alias("matches"), F.max("is_special_category").alias("s"), F.max("is_biometric").alias("b"))
    return per.groupBy(*keys).agg(
        F.array_sort(F.collect_set("category")).alias("categories_found"),
        F.max("s").alias("has_special_categories"),
        F.max("b").alias("has_biometrics"),
        F.sum("matches").alias("total_matches"),
        F.sum("n").alias("total_findings"),
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("pattern_no", "pattern_name", "n"))), lambda x: F.struct(x["pattern_name"], x["n"]))).alias("pii_categories"),
    )


def by_category(f: DataFrame, keys: list[str]) -> DataFrame:
    """Findings grouped by category: their values in order."""
    return f.groupBy(*keys, "category").agg(F.array_sort(F.collect_set("value")).alias("values_found"), F.count("*").alias("findings"))


def as_json(f: DataFrame, keys: list[str], mask: bool = True) -> DataFrame:
    """One JSON text per key, values masked by default."""
    value = X.masked(F.col("value")) if mask else F.col("value")
    item = F.struct("pattern_no", value.alias("value"), "pattern_name", "category", "description", "count", "validated", "is_special_category", "is_biometric")
    return f.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("findings_json"))
