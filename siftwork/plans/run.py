"""A whole run: a directory's files to texts, findings, levels, reports and an exit code.

Files are listed, read and searched on the executors, which must see the same paths. Tables come in chunks of rows, other files as one text;
matches don't span chunks. Files that no reader takes, and files with too little text, are left out of the results; a file that can't be read is a row with its
error. Two passes over the texts are avoided by a checkpoint of the findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.operators import classify, detect
from siftwork.plans import report
from siftwork.sources import documents, files, tabular
from siftwork.util import map_rows


def texts_of(listing: DataFrame) -> DataFrame:
    """(path, chunk_no, text, error) of the files of a listing that some extractor takes."""
    kind = files.extractor(F.col("path"))
    cores = listing.sparkSession.sparkContext.defaultParallelism
    paths = listing.select("path", kind.alias("kind")).filter("kind is not null").repartition(4 * cores)

    def content(path):
        try:
            with open(path, "rb") as f:
                return [(path, f.read())]
        except OSError:
            return [(path, None)]

    read = documents.extract(map_rows(paths.filter("kind <> 'tabular'").select("path"), lambda: content, "path string, content binary"))
    return tabular.read_files(paths.filter("kind = 'tabular'")).unionByName(read.select("path", F.lit(0).alias("chunk_no"), "text", "error"))


def results_of(texts: DataFrame, skip: bool = True) -> DataFrame:
    """One row per file: path, file_format, pii_categories, total_findings, uz_level, ocr_failed, error."""
    texts = texts.persist()
    worth = X.worth_reading(X.clean_text(F.col("text")), 30) if skip else F.length(F.coalesce("text", F.lit(""))) > 0
    state = texts.groupBy("path").agg(F.max("error").alias("error"), F.max(worth).alias("worth")).filter("worth or error is not null").select("path", "error")
    counts = detect.rollup(detect.findings(texts.filter("error is null"), ["path"], clean=True, chunk="chunk_no"), ["path"])
    rows = state.join(counts, "path", "left")
    found = F.when(F.col("error").isNull(), F.coalesce("total_findings", F.lit(0))).otherwise(0)
    return rows.select(
        "path", X.suffix(F.col("path")).alias("file_format"), F.coalesce("pii_categories", F.create_map().cast("map<string,bigint>")).alias("pii_categories"), found.alias("total_findings"),
        classify.level(F.col("pii_categories")).alias("uz_level"), F.lit(None).cast("boolean").alias("ocr_failed"), "error",
    )


def run(spark: SparkSession, root: str | None, out_dir: str, formats: tuple[str, ...] = ("csv", "json", "md", "html"), fail_on: str = "УЗ-1", skip: bool = True) -> tuple[dict[str, str], int]:
    """(report files, exit code) of a scan of all files below root."""
    listing = files.list_files(spark, root).persist()
    results = results_of(texts_of(listing), skip).persist()
    written = report.write(results, out_dir, formats=formats, listing=listing)
    return written, classify.gate(results, fail_on).first().exit_code
