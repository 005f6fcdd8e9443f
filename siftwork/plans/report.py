"""Summaries of results and their sinks. Rows of files stay distributed; only summaries come to the driver."""

from __future__ import annotations

import html
import json
import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.operators.classify import LEVELS

#: Headers of the CSV report (fixed values).
CSV_COLUMNS = ["Путь", "Категории ПДн", "Количество", "УЗ", "Формат", "Ошибка"]


def totals(results: DataFrame) -> DataFrame:
    """One row of totals."""
    return results.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("total_findings") > 0).alias("files_with_pii"),
        F.count_if(F.length("error") > 0).alias("files_with_errors"),
        F.count_if(F.col("error").isNull() | (F.length("error") == 0)).alias("files_ok"),
        F.count_if(F.col("ocr_failed")).alias("ocr_failed"),
    )


def level_distribution(results: DataFrame) -> DataFrame:
    """Files per level, all four levels."""
    levels = results.sparkSession.createDataFrame([(x,) for x in LEVELS], "uz_level string")
    return levels.join(results.groupBy("uz_level").agg(F.count("*").alias("files")), "uz_level", "left").fillna(0, ["files"])


def error_summary(results: DataFrame) -> DataFrame:
    return results.filter(F.length("error") > 0).groupBy("error").agg(F.count("*").alias("files"))


def category_totals(results: DataFrame) -> DataFrame:
    """Findings by pattern over all files."""
    return results.select(F.explode("pii_categories").alias("pattern_name", "n")).groupBy("pattern_name").agg(F.sum("n").alias("findings"))


def top_errors(results: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` rows with an error, by path; texts over 80 characters are cut."""
    return results.filter(F.length("error") > 0).orderBy("path", "error").limit(most).select("path", X.shortened(F.col("error"), 80).alias("error"))


def significant(results: DataFrame) -> DataFrame:
    return results.filter((F.col("total_findings") > 0) | (F.length("error") > 0))


def csv_rows(results: DataFrame) -> DataFrame:
    """Rows of the CSV report."""
    return results.select(
        F.col("path").alias("path"), X.category_text(F.col("pii_categories")).alias("categories"), F.col("total_findings").alias("findings"), F.col("uz_level").alias("level"),
        F.col("file_format").alias("format"), F.coalesce("error", F.lit("")).alias("error"),
    )


def result_csv(results: DataFrame, listing: DataFrame) -> DataFrame:
    """size, time, name of the files with findings that a fresh listing still has."""
    fresh = listing.groupBy("path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    found = results.filter("total_findings > 0").select("path").distinct()
    return fresh.join(found, "path", "left_semi").select(F.coalesce("size", F.lit(0)).alias("size"), X.listing_time(F.col("mtime")).alias("time"), X.file_name(F.col("path")).alias("name"))


def filtered(results: DataFrame, level: str | None = None, file_format: str | None = None, pii: str | None = None, name: str | None = None) -> DataFrame:
    """The report page's filters: level, format, pii in with/without/errors, part of the name."""
    out = results
    if level:
        out = out.filter(F.col("uz_level") == level)
    if file_format:
        out = out.filter(F.col("file_format") == file_format)
    if pii:
        has_error = F.coalesce(F.length("error") > 0, F.lit(False))
        out = out.filter({"with": F.col("total_findings") > 0, "without": (F.col("total_findings") == 0) & ~has_error, "errors": has_error}[pii])
    if name:
        out = out.filter(F.contains(F.lower(X.file_name(F.col("path"))), F.lit(name.lower())))
    return out


def summary(results: DataFrame, first_errors: int = 20) -> dict:
    """The small numbers that every report needs."""
    t = totals(results).first().asDict()
    return t | {
        "uz_distribution": {r.uz_level: r.files for r in level_distribution(results).orderBy("uz_level").collect()},
        "error_summary": {r.error: r.files for r in error_summary(results).orderBy(F.desc("files"), "error").limit(1000).collect()},
        "category_totals": {r.pattern_name: r.findings for r in category_totals(results).orderBy("pattern_name").collect()},
        "errors": [(r.path, r.error) for r in top_errors(results, first_errors).collect()],
    }


def write(results: DataFrame, out_dir: str, name: str = "report", formats: tuple[str, ...] = ("csv", "json", "md", "html"), listing: DataFrame | None = None) -> dict[str, str]:
    """Writes the reports under out_dir; rows go out in parallel as folders of parts, summaries as single files."""
    stamp = datetime.now().strftime("%Y%m%d_%H%M%S")
    base = os.path.join(out_dir, f"{name}_{stamp}")
    os.makedirs(out_dir, exist_ok=True)
    results = results.persist()
    s, out = summary(results), {}
    if "csv" in formats:
        csv_rows(results).toDF(*CSV_COLUMNS).write.csv(f"{base}_csv", sep=";", header=True, mode="overwrite")
        out["csv"] = f"{base}_csv"
    if "json" in formats:
        results.write.json(f"{base}_rows", mode="overwrite")
        with open(f"{base}.json", "w", encoding="utf-8") as f:
            json.dump({"generated_at": datetime.now().isoformat(), **s, "rows": f"{base}_rows"}, f, ensure_ascii=False, indent=2)
        out["json"] = f"{base}.json"
    if "md" in formats:
        with open(f"{base}.md", "w", encoding="utf-8") as f:
            f.write(markdown(s))
        out["md"] = f"{base}.md"
    if "html" in formats:
        with open(f"{base}.html", "w", encoding="utf-8") as f:
            f.write(page(s))
        out["html"] = f"{base}.html"
    if listing is not None:
        rows = result_csv(results, listing)
        if not rows.isEmpty():
            rows.write.csv(f"{base}_result_csv", header=True, mode="overwrite")
            out["result_csv"] = f"{base}_result_csv"
    results.unpersist()
    return out


def markdown(s: dict) -> str:
    lines = ["# Personal data report", "", f"Files: {s['total_files']}", f"With personal data: {s['files_with_pii']}", f"With errors: {s['files_with_errors']}", "", "| level | files |", "|---|---|"]
    lines += [f"| {k} | {v} |" for k, v in s["uz_distribution"].items()]
    if s["category_totals"]:
        lines += ["", "| pattern | findings |", "|---|---|", *[f"| `{k}` | {v} |" for k, v in s["category_totals"].items()]]
    if s["errors"]:
        lines += ["", "## Errors", "", *[f"- `{p}`: {e}" for p, e in s["errors"]]]
    return "\n".join(lines) + "\n"


def page(s: dict) -> str:
    cards = "".join(f"<div class=card><b>{html.escape(str(s[k]))}</b><span>{k.replace('_', ' ')}</span></div>" for k in ("total_files", "files_with_pii", "files_with_errors"))
    most = max([1, *s["category_totals"].values()])
    bars = "".join(f"<tr><td>{html.escape(k)}<td><meter max={most} value={v}></meter> {v}" for k, v in list(s["category_totals"].items())[:10])
    levels = "".join(f"<tr><td>{k}<td>{v}" for k, v in s["uz_distribution"].items())
    errors = "".join(f"<tr><td>{html.escape(p)}<td>{html.escape(e)}" for p, e in s["errors"])
    return f"<!doctype html><meta charset=utf-8><title>Personal data report</title><style>body{{font:15px sans-serif}}.card{{display:inline-block;padding:1em}}.card b{{display:block;font-size:2em}}</style>{cards}<table>{levels}</table><table>{bars}</table><table>{errors}</table>\n"
