import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwork.plans import report, run
from siftwork.sources import documents, files, html, tabular
from siftwork.streaming import detect as streaming


def test_listing(spark, tmp_path):
    for p in ("docs/report.pdf", "docs/notes.txt", "docs/.hidden.pdf", "data/_u.csv", "data/empty.csv", "media/photo.JPG", "__pycache__/m.csv", ".git/c.csv", "nested/deep/down/файл.docx", "a b & (c).html"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"" if "empty" in p else b"x")
    os.symlink(tmp_path / "docs", tmp_path / "linked")
    got = {os.path.relpath(r.path, tmp_path) for r in files.list_files(spark, str(tmp_path)).collect()}
    assert got == {"docs/report.pdf", "docs/.hidden.pdf", "data/_u.csv", "media/photo.JPG", "nested/deep/down/файл.docx", "a b & (c).html"}
    with pytest.raises(FileNotFoundError):
        files.check_root(str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        files.check_root(str(tmp_path / "docs/report.pdf"))


def test_texts_and_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(("имя;телефон\n" + "Иван;1\n" * 20 + "Пётр;2;3\nОля\nNA;4\n").encode("cp1251"))
    df, meta = tabular.read_csv(spark, str(tmp_path / "a.csv"))
    assert (meta["sep"], meta["encoding"], meta["columns"]) == (";", "cp1251", ["имя", "телефон"])
    assert [tuple(r) for r in df.collect()] == [("Иван", "1")] * 20 + [("Оля", None), ("NA", "4")]
    assert [r.line for r in tabular.extract(spark, str(tmp_path / "a.csv"))[0].collect()] == ["Иван 1"] * 20 + ["Оля", "4"]
    (tmp_path / "b.txt").write_bytes("﻿да".encode())
    (tmp_path / "c.txt").write_bytes("да".encode("cp1251"))
    assert {r.text for r in files.read_texts(spark, [str(tmp_path / "b.txt"), str(tmp_path / "c.txt")]).collect()} == {"да"}


def test_tabular_columns(spark):
    df = spark.createDataFrame([(1, " a ", 2.0, None)], "id int, name string, score double, phone_no long")
    assert tabular.text_columns(df) == ["name", "phone_no"]
    assert tabular.text_columns(df.select("id", "score")) == ["id", "score"]
    assert tabular.lines(df).first().line == "a"


def test_html():
    p = html.parse("<title>T</title><p>a<br>b<script>x</p></script><img alt='i'><p>unclosed")
    assert p["text"] == "T\n\na\nb\nunclosed\n\ni"
    assert html.parse(None) is None and html.parse("")["text"] == ""


def test_documents(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>один</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>верх</w:t></w:r></w:p></w:hdr>")
    rows = [("a.docx", b.getvalue()), ("b.docx", b"broken"), ("c.pdf", b"%PDF-" + b"x" * 200), ("d.pdf", b"no"), ("e.html", "<p>да".encode("cp1251")), ("f.mp4", b"dummy"), ("g.txt", None)]
    got = {r.path: r for r in documents.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"].chunks == ["один", "x\ty", "верх"]
    assert got["b.docx"].error.startswith("BadZipFile") and got["c.pdf"].error == got["f.mp4"].error == "backend unavailable"
    assert got["d.pdf"].error == "not a PDF" and got["e.html"].text == "да" and got["g.txt"].error == "no content"


RESULTS = [
    ("/d/a.pdf", "pdf", {"phone": 2, "email": 0}, 2, "УЗ-4", None, None), ("/d/b.csv", "csv", {"health": 1}, 1, "УЗ-1", False, None),
    ("/d/c.jpg", "jpg", {}, 0, "УЗ-4", True, "E" * 90), ("/d/d.html", "html", None, 0, "УЗ-4", None, ""),
]
SCHEMA = "path string, file_format string, pii_categories map<string,bigint>, total_findings bigint, uz_level string, ocr_failed boolean, error string"


def test_reports(spark, tmp_path):
    r = spark.createDataFrame(RESULTS, SCHEMA)
    assert report.totals(r).first().asDict() == {"total_files": 4, "files_with_pii": 2, "files_with_errors": 1, "files_ok": 3, "ocr_failed": 1}
    assert {x.uz_level: x.files for x in report.level_distribution(r).collect()} == {"УЗ-1": 1, "УЗ-2": 0, "УЗ-3": 0, "УЗ-4": 3}
    assert {x.path: x.categories for x in report.csv_rows(r).collect()} == {"/d/a.pdf": "phone(2)", "/d/b.csv": "health(1)", "/d/c.jpg": "—", "/d/d.html": "—"}
    assert report.top_errors(r).first().error == "E" * 80 + "…"
    assert report.filtered(r, pii="errors").count() == 1 and report.filtered(r, "УЗ-1", "csv", "with", "B").count() == 1
    listing = spark.createDataFrame([("/d/a.pdf", 5, None)], "path string, size bigint, mtime timestamp")
    out = report.write(r, str(tmp_path), listing=listing)
    assert json.load(open(out["json"]))["total_files"] == 4 and "УЗ-1" in open(out["md"]).read() and "<meter" in open(out["html"]).read()
    assert spark.read.csv(out["csv"], sep=";", header=True).columns == report.CSV_COLUMNS
    assert spark.read.csv(out["result_csv"], header=True).count() == 1


def test_empty_reports(spark, tmp_path):
    r = spark.createDataFrame([], SCHEMA)
    assert report.totals(r).first().total_files == 0
    assert "result_csv" not in report.write(r, str(tmp_path), listing=spark.createDataFrame([], "path string, size bigint, mtime timestamp"))


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "пишите на a@b.org сюда"), (1, "и снова a@b.org тут"), (2, None)], "path int, text string").write.parquet(str(src))
    s = streaming.documents_stream(spark, str(src), "path int, text string")
    got = streaming.run_once(streaming.counts_stream(s, ["path"], detectors=["email"]), "t_stream", str(tmp_path / "cp")).collect()
    assert [(r.path, r.pattern_name, r.value, r["count"]) for r in got] == [(1, "email", "a@b.org", 2)]
    timed = spark.createDataFrame([("2025-01-01 10:00:00", "пишите на a@b.org сюда")], "at string, text string").withColumn("at", F.to_timestamp("at"))
    timed.write.parquet(str(tmp_path / "timed"))
    s = streaming.windowed_counts(streaming.documents_stream(spark, str(tmp_path / "timed"), timed.schema), "at", detectors=["email"])
    assert streaming.run_once(s, "t_timed", str(tmp_path / "cp2")).first()["count"] == 1


def test_whole_run(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "root"
    (root / "deep").mkdir(parents=True)
    (root / "people.csv").write_bytes(("ФИО;Телефон;СНИЛС\n" + "Иванов Пётр Иванович;+7 (495) 123-45-67;112-233-445 95\n" * 3 + "лишнее;поле;тут;да\n").encode("cp1251"))
    pq.write_table(pa.table({"mail": ["u1@example.org пишет нам", None], "n": [1, 2]}), root / "deep" / "t.parquet")
    (root / "page.html").write_text("<title>Лист без данных</title><p>Ничего личного в этом тексте нет совсем</p>")
    (root / "short.html").write_text("<p>мало</p>")
    (root / "bad.docx").write_bytes(b"broken")
    (root / "notes.xlsx").write_bytes(b"x")
    (root / "none.csv").write_bytes(b"")
    got = {os.path.basename(r.path): r for r in run.results_of(run.texts_of(files.list_files(spark, str(root)))).collect()}
    assert set(got) == {"people.csv", "page.html", "bad.docx"}
    assert got["people.csv"].pii_categories == {"full_name": 1, "phone": 1, "snils": 1, "health": 1} and got["people.csv"].uz_level == "УЗ-1"
    assert got["page.html"].total_findings == 0 and got["page.html"].uz_level == "УЗ-4" and got["bad.docx"].error
    every = {os.path.basename(r.path): r for r in run.results_of(run.texts_of(files.list_files(spark, str(root))), skip=False).collect()}
    assert every["t.parquet"].pii_categories == {"email": 1} and every["short.html"].total_findings == 0
    written, code = run.run(spark, str(root), str(tmp_path / "out"), ("json", "md"))
    assert code == 3 and json.load(open(written["json"]))["total_files"] == len(got)
    assert run.run(spark, str(root / "deep"), str(tmp_path / "out2"), ("md",), skip=False)[1] == 0
