"""Splitting oversized items at natural boundaries (problem 4).

One regular expression per limit, anchored at the end of the previous match, whose alternatives are ordered by the strength of
the boundary and consume up to the limit; a lookback offset gives the overlap. All of it runs inside the JVM.

Defined cases: null items give null pieces; empty items and those within the limit give themselves as the only piece; an
item without any boundary is cut by characters; a limit of null leaves the item whole; the overlap is cut down to half the limit
so that every piece moves on. Repeated rows give repeated results; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A noncharacter; items that hold it are cut in three passes instead.
MARK = "\ufdd0"


def pattern(fresh: Column, over: Column) -> Column:
    """The extraction pattern for pieces that take at most `fresh` new characters each, looking back on `over`.

    In order: all that is left; a paragraph's end; a sentence's end at a line's end or elsewhere; a line's end; a clause's end; a word's end;
    characters. A boundary before the middle of the limit isn't used while a later alternative finds one beyond it. Group 1 or, near
    the beginning, group 2 is the text looked back on.
    """
    low = F.greatest(F.lit(1), F.floor(fresh / 2).cast("int"))
    q = F.concat(F.lit("{"), low.cast("string"), F.lit(","), fresh.cast("string"), F.lit("}"))
    up = F.concat(F.lit("{1,"), fresh.cast("string"), F.lit("}"))
    alternatives = [
        (up, "\\z"),
        (q, "(?<=\\n[ \\t]{0,3}\\n)"),
        (q, "(?<=[.!?…][\"'»”’)\\]]{0,2}\\n)"),
        (q, "(?<=[\\p{L}\\p{N}]{3}[.!?…][\"'»”’)\\]]{0,2}\\s)"),
        (q, "(?<=\\n)"),
        (q, "(?<=[。！？।॥؟][\"'»”’)\\]）」』】〉》]{0,2})"),
        (q, "(?<=[,;:،、，；：—–]\\s?)"),
        (q, "(?<=\\s)(?=\\S)"),
        (up, ""),
    ]
    parts: list[Column] = [F.lit("(?s)\\G(?:(?<=(.{"), over.cast("string"), F.lit("}))|(?<=(\\A.{0,"), over.cast("string"), F.lit("})))(?:")]
    for k, (n, tail) in enumerate(alternatives):
        parts += [F.lit("|." if k else "."), n, F.lit(tail)]
    return F.concat(*parts, F.lit(")"))


def pieces(item: Column, max_chars: Column, overlap_chars: Column) -> Column:
    """array<string>: pieces of at most max_chars, each beginning with the last overlap_chars of the one before."""
    over = F.least(F.greatest(F.coalesce(overlap_chars, F.lit(0)), F.lit(0)), (max_chars - 1).cast("int"))
    p = pattern(max_chars - over, over)
    # one pass: every piece with what it looks back on, and a mark behind it
    marked = F.split(F.regexp_replace(item, p, F.lit(f"$1$2$0{MARK}")), MARK, -1)
    cut = F.slice(marked, 1, F.size(marked) - 1)
    core, back, first = (F.regexp_extract_all(item, p, F.lit(k)) for k in (0, 1, 2))
    with_mark = F.zip_with(F.zip_with(first, back, lambda x, y: F.concat(x, y)), core, lambda x, y: F.concat(x, y))
    whole = max_chars.isNull() | (max_chars < 1) | (F.length(item) <= max_chars)
    return F.when(item.isNull(), F.lit(None)).when(whole, F.array(item)).when(F.contains(item, F.lit(MARK)), with_mark).otherwise(cut)


def split_items(results: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, result_id, chunk_no, pieces) for the text (chunk_no -1) and every chunk of every result.

    limits has one row per kind and file format and is a fixed table of formats, hence broadcast.
    """
    by_kind = limits.groupBy("item_kind", "file_format").agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars"))
    items = results.select(
        "result_id",
        "file_format",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("text").alias("item_kind"), F.lit(-1).alias("chunk_no"), F.col("text").alias("item"))),
                F.coalesce(
                    F.transform("chunks", lambda x, i: F.struct(F.lit("chunk").alias("item_kind"), i.cast("int").alias("chunk_no"), x.alias("item"))),
                    F.array().cast("array<struct<item_kind:string,chunk_no:int,item:string>>"),
                ),
            )
        ).alias("i"),
    ).select("result_id", "file_format", "i.*")
    return items.join(F.broadcast(by_kind), ["item_kind", "file_format"], "left").select(
        "item_kind", "result_id", "chunk_no", "max_chars", "overlap_chars", pieces(F.col("item"), F.col("max_chars"), F.col("overlap_chars")).alias("pieces")
    )


def oversized(results: DataFrame, limits: DataFrame) -> DataFrame:
    """The items that had to be cut."""
    return split_items(results, limits).filter(F.size("pieces") > 1)
