"""Documents, images and video: what the standard library can read, and plug-ins for the rest.

A plug-in is a function bytes -> (chunks, metadata) registered under a file format. A format without one gives error 'backend unavailable';
a plug-in's failure becomes the row's error. No task fails for a file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.sources import html as H
from siftwork.util import map_rows

Plugin = Callable[[bytes], tuple[list[str], dict]]
PLUGINS: dict[str, Plugin] = {}
SCHEMA = "path string, file_format string, text string, chunks array<string>, metadata map<string,string>, error string"
PAGE_BREAK = "\n--- PAGE BREAK ---\n"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def plugin(*formats: str):
    """Registers a reader of file formats, such as a PDF or OCR backend."""

    def put(f: Plugin) -> Plugin:
        for x in formats:
            PLUGINS[x] = f
        return f

    return put


def _paragraph(p) -> str:
    out = []
    for e in p.iter():
        if e.tag == _W + "t":
            out.append(e.text or "")
        elif e.tag == _W + "tab":
            out.append("\t")
        elif e.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out).strip()


@plugin("docx")
def docx(raw: bytes) -> tuple[list[str], dict]:
    """Paragraphs, then tables (cells by tabs, rows by line feeds), then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        chunks = [t for p in body.findall(_W + "p") if (t := _paragraph(p))]
        tables = body.findall(_W + "tbl")
        for t in tables:
            rows = ["\t".join(" ".join(filter(None, map(_paragraph, c.iter(_W + "p")))) for c in r.findall(_W + "tc")) for r in t.findall(_W + "tr")]
            if any(r.strip() for r in rows):
                chunks.append("\n".join(rows))
        for n in sorted(z.namelist()):
            if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"):
                chunks += [t for p in ElementTree.fromstring(z.read(n)).iter(_W + "p") if (t := _paragraph(p))]
    return chunks, {"backend": "docx", "tables": str(len(tables))}


@plugin("html", "htm")
def html(raw: bytes) -> tuple[list[str], dict]:
    enc = H.encoding_of(raw)
    d = H.parse(raw.decode(enc, "replace"))
    return [d["text"]] if d["text"] else [], {"backend": "html", "encoding": enc, "title": d["title"]}


@plugin("srt", "vtt", "txt")
def plain(raw: bytes) -> tuple[list[str], dict]:
    for enc in ("utf-8-sig", "cp1251"):
        try:
            return [raw.decode(enc)], {"backend": "text", "encoding": enc}
        except UnicodeDecodeError:
            pass
    return [raw.decode("latin-1")], {"backend": "text", "encoding": "latin-1"}


def pdf_ok(raw: bytes) -> bool:
    return len(raw) >= 100 and raw[:5] == b"%PDF-"


def extract(files: DataFrame) -> DataFrame:
    """Extraction results of (path, content) rows."""
    plugins = dict(PLUGINS)

    def make():
        def f(path, content):
            ext = path.rpartition("/")[2].rpartition(".")[2].lower()
            if content is None:
                return [(path, ext, None, None, None, "no content")]
            if ext == "pdf" and not pdf_ok(content):
                return [(path, ext, "", [], {}, "not a PDF")]
            if ext not in plugins:
                return [(path, ext, "", [], {}, "backend unavailable")]
            try:
                chunks, meta = plugins[ext](content)
            except Exception as e:  # a broken file is a row's error
                return [(path, ext, "", [], {}, f"{type(e).__name__}: {e}"[:200])]
            return [(path, ext, "\n\n".join(chunks), chunks, {**meta, "chunk_count": str(len(chunks))}, None)]

        return f

    return map_rows(files.select("path", "content"), make, SCHEMA)


def chunk_rows(results: DataFrame) -> DataFrame:
    """One row per chunk."""
    return results.select("path", "file_format", F.posexplode("chunks").alias("chunk_no", "text"))


def subtitles_of(videos: DataFrame, listing: DataFrame) -> DataFrame:
    """Each video's subtitle file beside it: same directory and stem, srt before vtt, ass and ssa; null without one."""
    rank = F.create_map(*[F.lit(v) for kv in {"srt": 1, "vtt": 2, "ass": 3, "ssa": 4}.items() for v in kv])
    stem = lambda c: F.regexp_replace(c, "\\.[^./]*$", "")
    subs = listing.filter(X.suffix(F.col("path")).isin("srt", "vtt", "ass", "ssa")).groupBy(stem(F.col("path")).alias("stem")).agg(F.min_by("path", rank[X.suffix(F.col("path"))]).alias("subtitle"))
    return videos.withColumn("stem", stem(F.col("path"))).join(subs, "stem", "left").drop("stem")


def video_probe(c):
    """Fields of a media probe's JSON: duration, bit rate, format, first video and audio stream, whether subtitles are embedded."""
    stream = "codec_type string, codec_name string, width int, height int, r_frame_rate string, channels int, sample_rate string"
    j = F.from_json(c, f"format struct<duration:string, bit_rate:string, format_name:string>, streams array<struct<{stream.replace(' string', ':string').replace(' int', ':int')}>>")
    streams = F.coalesce(j["streams"], F.array().cast(f"array<struct<{stream.replace(' string', ':string').replace(' int', ':int')}>>"))
    of = lambda kind: F.get(F.filter(streams, lambda x: x["codec_type"] == kind), F.lit(0))
    rate = F.split(of("video")["r_frame_rate"], "/")
    fps = F.try_divide(F.get(rate, F.lit(0)).cast("double"), F.get(rate, F.lit(1)).cast("double"))
    return F.struct(
        j["format"]["duration"].cast("double").alias("duration"), j["format"]["bit_rate"].cast("bigint").alias("bit_rate"), j["format"]["format_name"].alias("format"),
        of("video")["width"].alias("width"), of("video")["height"].alias("height"), of("video")["codec_name"].alias("video_codec"), fps.alias("fps"),
        of("audio")["codec_name"].alias("audio_codec"), of("audio")["channels"].alias("channels"), of("audio")["sample_rate"].cast("int").alias("sample_rate"),
        F.exists(streams, lambda x: x["codec_type"] == "subtitle").alias("has_embedded_subtitles"),
    )
