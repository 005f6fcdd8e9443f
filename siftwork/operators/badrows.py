"""Raw delimited records that may be broken: a recursive-descent grammar with error recovery (problem 5).

    file    = { record (NEWLINE | END) }
    record  = field { SEP field }
    field   = quoted | bare
    quoted  = '"' { any but '"' | '""' } '"' , then SEP, NEWLINE or END
    bare    = { any but '"', SEP, NEWLINE }

A quote inside a bare field, text after a closing quote and a quoted field without an end are located syntax errors. After
one the parser looks for the next *validated record-start anchor*: the start of a line from which a whole record with the right
number of fields and valid values can be read; everything before it belongs to the broken record.

Null and empty records have one empty field, hence the reason `columns`. Repeated records give repeated results. A path
without a header line takes a comma.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.util import hot_join, map_rows

SEPARATORS = ",;\t|"
#: Values that count as missing (fixed values).
MISSING = {"", "NA", "null", "None"}
FIELDS = ("фио", "телефон", "снилс")

SCHEMA = (
    "line_id bigint, path string, line_no bigint, fio string, phone string, snils string, reason string,"
    " error_pos int, error_text string, recovered array<struct<raw:string,fio:string,phone:string,snils:string>>"
)


class SyntaxFault(Exception):
    """A place where the quoting breaks the grammar."""

    def __init__(self, pos: int, what: str):
        super().__init__(what)
        self.pos, self.what = pos, what


@dataclass
class Record:
    start: int
    end: int
    fields: list[str]
    reason: str | None = None
    error_pos: int | None = None
    error_text: str | None = None


class Parser:
    """Reads one text with a separator; records() never fails."""

    def __init__(self, text: str, sep: str, one_record: bool = False):
        self.s, self.sep, self.p, self.one = text, sep, 0, one_record
        stop = re.escape(sep) + '"' + ("" if one_record else "\r\n")
        self.bare_run = re.compile(f"[^{stop}]*")
        self.quoted_run = re.compile('[^"]*(?:""[^"]*)*')

    def at_end_of_record(self) -> bool:
        return self.p >= len(self.s) or (not self.one and self.s[self.p] in "\r\n")

    def record(self) -> list[str]:
        fields = [self.field()]
        while self.p < len(self.s) and self.s[self.p] == self.sep:
            self.p += 1
            fields.append(self.field())
        return fields

    def field(self) -> str:
        return self.quoted() if self.s.startswith('"', self.p) else self.bare()

    def bare(self) -> str:
        m = self.bare_run.match(self.s, self.p)
        self.p = m.end()
        if self.s.startswith('"', self.p):
            raise SyntaxFault(self.p, "quote inside an unquoted field")
        return m[0]

    def quoted(self) -> str:
        start = self.p
        m = self.quoted_run.match(self.s, start + 1)
        if m.end() >= len(self.s):
            raise SyntaxFault(start, "unclosed quote")
        self.p = m.end() + 1
        if not self.at_end_of_record() and self.s[self.p] != self.sep:
            raise SyntaxFault(self.p, "text after the closing quote")
        return m[0].replace('""', '"')

    def newline(self) -> None:
        if self.s.startswith("\r\n", self.p):
            self.p += 2
        elif self.p < len(self.s):
            self.p += 1

    def anchor(self, start: int) -> int:
        """The next line start from which a valid record can be read, else the end."""
        at = self.s.find("\n", start)
        while at >= 0:
            sub = Parser(self.s, self.sep)
            sub.p = at + 1
            try:
                if at + 1 < len(self.s) and fault_of(sub.record()) is None:
                    return at + 1
            except SyntaxFault:
                pass
            at = self.s.find("\n", at + 1)
        return len(self.s)

    def records(self) -> list[Record]:
        out = []
        while self.p < len(self.s) or not out:
            start = self.p
            try:
                fields = self.record()
                out.append(Record(start, self.p, fields, fault_of(fields)))
                self.newline()
            except SyntaxFault as e:
                self.p = self.anchor(start)
                if e.pos >= self.p:  # the quote ran on over records behind it: the fault lies in this record alone
                    try:
                        Parser(self.s[start : self.p].rstrip("\r\n"), self.sep).record()
                    except SyntaxFault as own:
                        e = SyntaxFault(start + own.pos, own.what)
                out.append(Record(start, self.p, [], "quoting", e.pos, e.what))
        return out


def snils_ok(d: str) -> bool:
    """Check V2: 11 digits, not all zero, weighted sum of the first nine against the last two."""
    if len(d) != 11 or not d.isascii() or not d.isdigit() or not d.strip("0"):
        return False
    total = sum(int(x) * w for x, w in zip(d, range(9, 0, -1)))
    return (0 if (r := total % 101) == 100 else r) == int(d[9:])


def fault_of(fields: list[str]) -> str | None:
    """The first reason against a record that parsed."""
    if len(fields) != 3:
        return "columns"
    name, phone, snils = (x.strip() for x in fields)
    if not any(c.isalpha() for c in name):
        return "bad_name"
    if phone not in MISSING and not re.fullmatch("[78][0-9]{10}", re.sub(r"[\s\-()+]", "", phone)):
        return "bad_phone"
    if snils not in MISSING and not snils_ok(re.sub(r"[\s\-]", "", snils)):
        return "bad_snils"
    return None


def parse_one(raw: str | None, sep: str) -> Record:
    """One raw record whose bounds are known; a line break in it is data, and only a quoted one is allowed by the grammar."""
    p = Parser(raw or "", sep)
    try:
        fields = p.record()
        if p.p < len(p.s):  # an unquoted line break: the rest belongs to the last field
            p = Parser(raw or "", sep, one_record=True)
            fields = p.record()
        return Record(0, len(p.s), fields, fault_of(fields))
    except SyntaxFault as e:
        return Record(0, len(p.s), [], "quoting", e.pos, e.what)


def separator(header: str) -> str:
    """The separator that splits a header line into most fields; a comma when none does."""
    return max(SEPARATORS, key=lambda s: (header.count(s), -SEPARATORS.index(s)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Table of raw records (line_id, path, line_no, raw_line) -> one typed row each, with `reason` null where valid.

    `recovered` holds the valid records that begin at anchors inside a record with broken quotes. The header table has one
    row per path; rows of a hot path are never brought together.
    """
    headers = lines.filter("line_no = 1").groupBy("path").agg(F.min("raw_line").alias("_header"))
    joined = hot_join(lines.filter("line_no <> 1 or line_no is null").select("line_id", "path", "line_no", "raw_line"), headers, "path", salt="line_id")

    def make():
        def f(path, line_id, line_no, raw, header):
            sep = separator(header or "")
            r = parse_one(raw, sep)
            if r.reason is None:
                return [(line_id, path, line_no, *typed(r.fields), None, None, None, None)]
            found = None
            if r.reason == "quoting" and "\n" in raw:
                found = [{"raw": raw[x.start : x.end].rstrip("\r\n"), **dict(zip(("fio", "phone", "snils"), typed(x.fields)))} for x in Parser(raw, sep).records() if x.reason is None]
            return [(line_id, path, line_no, None, None, None, r.reason, r.error_pos, r.error_text, found)]

        return f

    return map_rows(joined.select("path", "line_id", "line_no", "raw_line", "_header"), make, SCHEMA)


def typed(fields: list[str]) -> tuple[str | None, str | None, str | None]:
    """(name, phone, insurance number) of a valid record's fields; null where missing."""
    name, phone, snils = (None if (x := v.strip()) in MISSING else x for v in fields)
    return name, phone and _phone(phone), snils and re.sub(r"[\s\-]", "", snils)


def _phone(p: str) -> str:
    d = re.sub("[^0-9]", "", p)
    return "7" + d[1:]


def valid_rows(lines: DataFrame) -> DataFrame:
    """The loaded rows."""
    return parse_lines(lines).filter("reason is null").select("line_id", "path", "line_no", "fio", "phone", "snils")


def bad_rows(lines: DataFrame) -> DataFrame:
    """The rows set apart, with the first reason and the place of a syntax error."""
    return parse_lines(lines).filter("reason is not null").select("line_id", "path", "line_no", "reason", "error_pos", "error_text", "recovered")


def recovered_rows(lines: DataFrame) -> DataFrame:
    """(line_id, path, line_no, record_no, fio, phone, snils): the valid records at which parsing resumed inside a broken one."""
    found = bad_rows(lines).select("line_id", "path", "line_no", F.posexplode("recovered").alias("record_no", "r"))
    return found.select("line_id", "path", "line_no", "record_no", "r.fio", "r.phone", "r.snils")
