"""File listings: walking directories in parallel, predicates on paths, dispatch by extension, bytes to text."""

from __future__ import annotations

import mimetypes
import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.util import map_rows

# Extensions that a scan lists, that text can be taken from, and directories that are skipped.
LISTED = "csv json parquet pdf doc docx rtf xls xlsx html htm tif tiff jpg jpeg png gif bmp mp4".split()
EXTRACTABLE = "csv parquet pdf doc docx html htm tif tiff jpg jpeg png gif mp4".split()
CONFIGURED = "txt csv parquet pdf doc docx html htm tif tiff jpg jpeg png gif mp4".split()
IGNORED_DIRS = "__pycache__ .git .svn .hg node_modules .idea .vscode venv env .env build dist".split()
DEFAULT_ROOT = "./test_dataset"
EXTRACTORS = {"tabular": "csv parquet", "document": "doc docx", "html": "html htm", "pdf": "pdf", "image": "tif tiff jpg jpeg png gif", "video": "mp4"}

SCHEMA = "path string, name string, ext string, size bigint, mtime timestamp"


def check_root(root: str | None) -> str:
    root = os.path.abspath(root or DEFAULT_ROOT)
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    return root


def _kept(name: str) -> bool:
    return not name.startswith(".") and name not in IGNORED_DIRS


def _file(path: str) -> tuple | None:
    try:
        st = os.stat(path)
    except OSError:
        return None
    name = os.path.basename(path)
    ext = os.path.splitext(name)[1][1:].lower()
    return (path, name, ext, st.st_size, datetime.fromtimestamp(st.st_mtime, timezone.utc)) if st.st_size > 0 and ext in LISTED else None


def walk(top: str, deep: bool = True):
    """(directories, files) below top; links to directories aren't followed, ignored and hidden directories are left out."""
    try:
        entries = sorted(os.scandir(top), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            if _kept(e.name):
                if deep:
                    yield from walk(e.path)
                else:
                    yield "dir", e.path
        elif not (e.is_symlink() and e.is_dir()):
            yield "file", e.path


def list_files(spark: SparkSession, root: str | None = None, levels: int = 2) -> DataFrame:
    """Files below root: those with a listed extension and content. Unlike Spark's own listing it keeps hidden and _named files.

    The driver reads `levels` levels of directories; the trees below them are walked on the executors, which must see the same paths.
    """
    dirs, rows = [check_root(root)], []
    for _ in range(levels):
        below = []
        for d in dirs:
            for kind, p in walk(d, deep=False):
                if kind == "dir":
                    below.append(p)
                elif f := _file(p):
                    rows.append(f)
        dirs = below
    top = spark.createDataFrame(rows, SCHEMA)
    if not dirs:
        return top
    trees = spark.createDataFrame([(d,) for d in dirs], "dir string").repartition(max(1, min(len(dirs), 1000)))
    below = map_rows(trees, lambda: lambda d: [f for kind, p in walk(d) if kind == "file" for f in [_file(p)] if f], SCHEMA)
    return top.unionByName(below)


def pruned(path: Column, root: Column | None = None) -> Column:
    """Is a directory on the way (below root) hidden or ignored?"""
    relative = F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path) if root is not None else path
    dirs = F.filter(F.slice(F.split(relative, "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0))), lambda d: d != "")
    return F.exists(dirs, lambda d: F.startswith(d, F.lit(".")) | d.isin(IGNORED_DIRS))


def listed(path: Column) -> Column:
    return X.suffix(path).isin(LISTED)


def supported(path: Column) -> Column:
    return X.suffix(path).isin(EXTRACTABLE)


def configured(path: Column) -> Column:
    return X.suffix(path).isin(CONFIGURED)


def extractor(path: Column) -> Column:
    """Which kind of extractor reads the file; null for none."""
    out = F.lit(None).cast("string")
    for kind, exts in EXTRACTORS.items():
        out = F.when(X.suffix(path).isin(exts.split()), kind).otherwise(out)
    return out


def mime(path: Column) -> Column:
    known = {e: mimetypes.guess_type(f"x.{e}")[0] for e in {*LISTED, *CONFIGURED} if mimetypes.guess_type(f"x.{e}")[0]}
    return F.coalesce(F.create_map(*[F.lit(v) for kv in sorted(known.items()) for v in kv])[X.suffix(path)], F.lit("application/octet-stream"))


def scan_filter(listing: DataFrame) -> DataFrame:
    """The files of a listing that a scan would read: one row per path, content, listed extension, no pruned directory."""
    return listing.filter((F.col("size") > 0) & listed(F.col("path")) & ~pruned(F.col("path"))).select("path", "name", "ext", "size", "mtime").dropDuplicates(["path"])


def decoded(content: Column) -> Column:
    """Bytes to text: UTF-8 (without its mark) where valid, else Windows Cyrillic."""
    utf8 = F.try_validate_utf8(content)
    return F.when(utf8.isNotNull(), F.regexp_replace(utf8, "\\A\\ufeff", "")).otherwise(F.decode(content, "windows-1251"))


def read_texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, text) of files read as a whole."""
    return spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:", "").alias("path"), decoded(F.col("content")).alias("text"))
