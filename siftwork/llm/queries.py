"""Queries of the training-data operators and their SQL; __spark_entry__ adds them if this package can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import encoding, leakage, mixing, pii, scans, sentences, split, uniform
from siftwork.util import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query(
    "p4_found",
    """SELECT 'text' AS item_kind, r.result_id, -1 AS chunk_no FROM extraction_results r
       JOIN split_limits l ON l.item_kind = 'text' AND l.file_format = r.file_format WHERE length(r.text) > l.max_chars
       UNION ALL
       SELECT 'chunk', c.result_id, CAST(c.n - 1 AS INT) FROM (SELECT result_id, file_format, unnest(chunks) AS item, generate_subscripts(chunks, 1) AS n FROM extraction_results) c
       JOIN split_limits l ON l.item_kind = 'chunk' AND l.file_format = c.file_format WHERE length(c.item) > l.max_chars""",
)
def p4_found(spark, d):
    r = spread(table(spark, d, "extraction_results").select("result_id", "file_format", "text", "chunks"))
    return split.oversized(r, table(spark, d, "split_limits")).select("item_kind", "result_id", "chunk_no")


@query("p4_pieces")
def p4_pieces(spark, d):
    r = spread(table(spark, d, "extraction_results").select("result_id", "file_format", "text", "chunks"))
    return split.split_items(r, table(spark, d, "split_limits")).select("item_kind", "result_id", "chunk_no", F.posexplode("pieces").alias("piece_no", "piece"))


def documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


@query("p9_found")
def p9_found(spark, d):
    return sentences.split_sentences(documents(spark, d), with_text=False)


@query("p9_sentences")
def p9_sentences(spark, d):
    return sentences.split_sentences(documents(spark, d))


@query("p7_found")
def p7_found(spark, d):
    return leakage.leaks(documents(spark, d), table(spark, d, "eval_items"))


@query("p7_items")
def p7_items(spark, d):
    """Which items leaked, and into how many documents."""
    return leakage.leaks(documents(spark, d), table(spark, d, "eval_items")).groupBy("item_id").agg(F.count("*").alias("documents"))


def results(spark, d, *columns):
    return spread(table(spark, d, "extraction_results").select("result_id", *columns))


def garbled(spark, d):
    """(table_name, row_id, restored) of both tables; the mappings are learned from the extracted texts."""
    texts = results(spark, d, "text")
    fitted = encoding.fit(texts)
    people = table(spark, d, "person_rows").select("row_id", F.col("фио").alias("text"))
    a = encoding.affected(texts, "result_id", "text", fitted).select(F.lit("extraction_results").alias("table_name"), F.col("result_id").alias("row_id"), "restored")
    b = encoding.affected(people, "row_id", "text", fitted).select(F.lit("person_rows").alias("table_name"), "row_id", "restored")
    return a.unionByName(b)


@query("p6_found")
def p6_found(spark, d):
    return garbled(spark, d).select("table_name", "row_id")


@query("p6_restored")
def p6_restored(spark, d):
    return garbled(spark, d)


def uniform_rows(spark, d):
    """(field, row_id, uniform) of texts and finding values with look-alikes; rows of a wrong encoding belong to p6."""
    texts = results(spark, d, "text")
    fitted = encoding.fit(texts)

    def unless():
        r = encoding.Restorer(*fitted)
        return lambda t: r.restore(t)[1]

    a = uniform.unify(texts, "result_id", "text", unless=unless).select(F.lit("text").alias("field"), F.col("result_id").alias("row_id"), "uniform")
    values = spread(table(spark, d, "pii_findings").select("finding_id", "value"))
    b = uniform.unify(values, "finding_id", "value", lowered=True).select(F.lit("value").alias("field"), F.col("finding_id").alias("row_id"), "uniform")
    return a.unionByName(b)


@query("p2_found")
def p2_found(spark, d):
    return uniform_rows(spark, d).select("field", "row_id")


@query("p2_uniform")
def p2_uniform(spark, d):
    return uniform_rows(spark, d)


def scanned(spark, d):
    return scans.repair(results(spark, d, "file_format", "text", "chunks", "metadata"))


@query("p3_found")
def p3_found(spark, d):
    return scanned(spark, d).select("result_id", F.explode("found").alias("f")).select("result_id", "f.line_no", "f.kind")


@query("p3_paragraphs")
def p3_paragraphs(spark, d):
    return scanned(spark, d).select("result_id", F.posexplode("paragraphs").alias("paragraph_no", "paragraph"))


def mix_inputs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets")


@query("p8_found")
def p8_found(spark, d):
    return mixing.unreachable(*mix_inputs(spark, d))


@query("p8_shares")
def p8_shares(spark, d):
    return mixing.mixture(*mix_inputs(spark, d))[1]


@query("p8_mixture")
def p8_mixture(spark, d):
    return mixing.mixture(*mix_inputs(spark, d))[0]


def personal(spark, d):
    """The texts and the findings of problem 1."""
    f = table(spark, d, "pii_findings").select("finding_id", "result_id", "pattern_name", "value", "context_snippet")
    return results(spark, d, "text"), spread(f)


@query("p1_found")
def p1_found(spark, d):
    return pii.occurrences(*personal(spark, d))


@query("p1_replaced")
def p1_replaced(spark, d):
    """Fields with typed placeholders, where anything was replaced."""
    return pii.findings_in(*personal(spark, d)).select("field", "row_id", "replaced")
