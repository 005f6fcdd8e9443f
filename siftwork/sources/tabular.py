"""CSV and Parquet tables as text: which columns, and rows to lines."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions.text import stripped
from siftwork.util import map_rows

# Parts of column names that may hold personal data, encodings tried, and texts that mean a missing value.
KEYWORDS = "inn инн snils снилс phone телефон passport паспорт card карта account счет счёт zip postal индекс ogrn огрн kpp кпп".split()
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "latin-1")
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CHUNK, CAP = 5_000, 50_000


def text_columns(df: DataFrame) -> list[str]:
    """Columns that hold text, or whose name holds a keyword; all where there are none."""
    text = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.DecimalType, T.DateType)
    chosen = [f.name for f in df.schema if isinstance(f.dataType, text) or any(k in f.name.lower() for k in KEYWORDS)]
    return chosen or df.columns


def row_text(columns: list[str], missing: bool = False) -> Column:
    """Values stripped, empty ones left out, joined by a space; missing: texts that readers take for missing vanish as well."""
    parts = []
    for c in columns:
        v = stripped(F.col(f"`{c}`").cast("string"))
        parts.append(F.when((F.length(v) > 0) & (~v.isin(MISSING) if missing else F.lit(True)), v))
    return F.concat_ws(" ", *parts)


def lines(df: DataFrame, keys: list[str] = [], order: list[str] = [], columns: list[str] | None = None, missing: bool = False) -> DataFrame:  # noqa: B006
    """keys + order + `line`: one line of text per row that has any."""
    chosen = columns or [c for c in text_columns(df) if c not in keys + order]
    return df.select(*keys, *order, row_text(chosen, missing).alias("line")).filter(F.length("line") > 0)


def chunks(df: DataFrame, keys: list[str], order: str, size: int = CHUNK, columns: list[str] | None = None) -> DataFrame:
    """keys + (chunk_no, text, rows): lines in the order of a row number column, `size` rows a chunk; a chunk bounds what a task holds."""
    numbered = lines(df, keys, [order], columns).withColumn("chunk_no", F.floor(F.col(order) / size))
    parts = numbered.groupBy(*keys, "chunk_no").agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("_l"))
    return parts.select(*keys, "chunk_no", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"), F.size("_l").alias("rows"))


def sniff(path: str) -> dict:
    """{'encoding', 'sep'} of a CSV file from its first characters."""
    with open(path, "rb") as f:
        raw = f.read(16_384)
    for enc in ENCODINGS:
        try:
            head = raw.decode(enc) if enc == "latin-1" or len(raw) < 16_384 else raw[: raw.rfind(b"\n") + 1].decode(enc)
            break
        except UnicodeDecodeError:
            continue
    try:
        sep = csv.Sniffer().sniff(head[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        sep = ","
    return {"encoding": enc, "sep": sep}


def read_csv(spark: SparkSession, path: str, cap: int | None = None) -> tuple[DataFrame, dict]:
    """(all-string rows, metadata). Rows with too many fields are left out, those with too few filled up with nulls."""
    s = sniff(path)
    java = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1251": "windows-1251", "latin-1": "ISO-8859-1"}[s["encoding"]]
    if java.startswith("windows"):  # Spark 4 reads other character sets only when told to
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    options = dict(sep=s["sep"], encoding=java, header=True, quote='"', escape='"', multiLine=True)
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_bad"]])
    df = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True).schema(schema).csv(path)
    wide = F.size(F.split(F.regexp_replace("_bad", '"[^"]*"', ""), "[" + ("\\t" if s["sep"] == "\t" else s["sep"]) + "]", -1)) > len(names)
    df = df.filter(F.col("_bad").isNull() | ~wide).drop("_bad")
    meta = {**s, "columns": names, "column_count": len(names), "truncated": False}
    if cap is not None:
        # the count must read a column: the reader refuses to give the broken records alone
        rows = df.limit(cap + 1).agg(F.count("*").alias("n"), F.max(F.col(f"`{names[0]}`"))).first().n
        meta["truncated"] = rows >= cap
        df = df.limit(cap)
    return df, meta


def read_parquet(spark: SparkSession, path: str, cap: int | None = None) -> tuple[DataFrame, dict]:
    df = spark.read.parquet(path)
    n = df.count()
    meta = {"row_count": n, "columns": df.columns, "column_count": len(df.columns), "truncated": cap is not None and n > cap}
    return (df.limit(cap) if meta["truncated"] else df), meta


def extract(spark: SparkSession, path: str, cap: int | None = None) -> tuple[DataFrame, dict]:
    """Lines of a CSV or Parquet file; cap: at most so many rows (CAP is the customary number), all by default."""
    df, meta = (read_parquet if os.path.splitext(path)[1].lower() == ".parquet" else read_csv)(spark, path, cap)
    return lines(df, missing=path.lower().endswith(".csv")), meta


def read_rows(path: str) -> Iterator[list[str]]:
    """Rows of one CSV or Parquet file as texts, for use inside a task: one row, or one batch of rows, in memory at a time."""
    if path.lower().endswith(".parquet"):
        import pyarrow as pa
        import pyarrow.parquet as pq

        f = pq.ParquetFile(path)
        plain = lambda t: pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_timestamp(t) or pa.types.is_boolean(t)
        names = [x.name for x in f.schema_arrow if not plain(x.type) or any(k in x.name.lower() for k in KEYWORDS)] or f.schema_arrow.names
        for batch in f.iter_batches(CHUNK, columns=names):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield ["" if v is None else str(v) for v in row]
        return
    s = sniff(path)
    with open(path, encoding=s["encoding"], errors="replace", newline="") as f:
        rows = csv.reader(f, delimiter=s["sep"])
        width = len(next(rows, []))
        for row in rows:
            if len(row) <= width:  # rows with too many fields are left out
                yield ["" if v in MISSING else v for v in row]


def read_files(paths: DataFrame) -> DataFrame:
    """(path, chunk_no, text, error) of many files (column path), each read in a task with its own encoding and separator, CHUNK rows a chunk."""

    def read(path):
        try:
            part, n = io.StringIO(), 0
            for row in read_rows(path):
                line = " ".join(v.strip() for v in row if v.strip())
                if line:
                    part.write(line + "\n")
                    n += 1
                    if n % CHUNK == 0:
                        yield path, n // CHUNK - 1, part.getvalue(), None
                        part = io.StringIO()
            if n % CHUNK or not n:
                yield path, n // CHUNK, part.getvalue(), None
        except Exception as e:  # a broken file is a row's error
            yield path, -1, None, f"{type(e).__name__}: {e}"[:200]

    return map_rows(paths.select("path"), lambda: read, "path string, chunk_no int, text string, error string")
