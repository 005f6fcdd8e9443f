"""HTML to text by the standard library's parser, in Arrow batches.

Null gives null; broken markup gives what the parser can read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content isn't text (fixed values).
DROPPED = frozenset("script style noscript meta link head svg canvas iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.alts, self.texts = [], "", [], []
        self.stack: list[str] = []
        self.titled = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("name") or "").lower() == "description" and not self.description:
            self.description = (a.get("content") or "").strip()
        if tag == "img" and not self.inside() and (a.get("alt") or "").strip():
            self.alts.append(a["alt"].strip())
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag == "title":
            self.titled = True

    def inside(self) -> bool:
        return any(t in DROPPED for t in self.stack)

    def handle_data(self, data):
        if "title" in self.stack and not self.titled:
            self.title.append(data)
        elif not self.inside() and "title" not in self.stack and data.strip():
            self.texts.append(data.strip())


def parse(page: str | None) -> dict | None:
    if page is None:
        return None
    r = _Reader()
    r.feed(page)
    r.close()
    visible = "\n".join(x for t in r.texts for x in t.split("\n") if x.strip())
    title = "".join(r.title).strip()
    parts = [title, r.description, visible, "\n".join(r.alts)]
    return {"title": title, "description": r.description, "visible": visible, "alts": r.alts, "text": "\n\n".join(p for p in parts if p)}


_TYPE = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "alts" else T.StringType()) for n in ("title", "description", "visible", "alts", "text")])


@F.pandas_udf(_TYPE)
def extract(pages: pd.Series) -> pd.DataFrame:
    """Title, description, visible text, image texts, and all of them joined by blank lines."""
    none = dict.fromkeys(("title", "description", "visible", "alts", "text"))
    return pd.DataFrame([parse(p) or none for p in pages], columns=list(none))


def encoding_of(raw: bytes) -> str:
    """The encoding of a page's bytes: its mark, what it declares, UTF-8 if valid, else Windows Cyrillic or Latin-1."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if raw.startswith(b"\xff\xfe"):
        return "utf-16le"
    for enc in ("utf-8", "cp1251"):
        try:
            raw.decode(enc)
            return enc
        except UnicodeDecodeError:
            pass
    m = re.search(rb"charset=[\"']?([\w-]+)", raw[:2048])
    return m[1].decode() if m else "latin-1"
