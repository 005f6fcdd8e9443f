"""Noise in text from scanned pages (problem 3): broken words, misread characters, running headers and page numbers.

* Word counts cover every text. Misread words are found in SQL by anagram hashes: the hash of a word is the sum of its characters' fifth
  powers (modulo a prime), so replacing a character changes it by a difference that depends on nothing else. Words that stand (almost) in scans
  alone are joined with frequent words at the differences of one or two confusable pairs, then compared place by place; corrections are
  ranked by the number of replaced characters and by frequency. No word is misread without such a frequent variant.
* Running headers are edge lines of at most HEADER characters whose shape (numbers as #) stands at page edges throughout the corpus and hardly
  inside pages, or at the same edge of several pages of a document. Headers with misread characters are found by the same join.
* A word broken at a line's end is joined if the corpus knows the joined word better than the hyphenated one.

Corrections, compounds and header shapes are broadcast up to MAX_FIXES rows each; beyond that they are joined to the words, broken words
and edge lines of the scans. Least counts don't depend on the corpus's size.

Defined cases: rows with null or empty text or pages give nothing; results that were recognised and images count as scans,
PDFs if their pages have headers or numbers; repeated rows give repeated results; `text` that isn't the pages joined by a blank line is one page.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.util import checkpoint, map_batches, map_rows

#: (right, wrong) pairs that optical recognition confuses (fixed values).
CONFUSABLE = [
    ("о", "0"), ("О", "0"), ("н", "п"), ("и", "н"), ("Н", "П"), ("И", "Н"), ("т", "|"), ("Т", "|"), ("л", "^"), ("Л", "^"), ("б", "6"), ("Б", "6"), ("ы", "ьі"), ("ы", "ьi"), ("Ы", "ЬІ"), ("ч", "4"), ("Ч", "4"),
    ("г", "~"), ("Г", "~"), ("з", "3"), ("З", "3"), ("ш", "щ"), ("e", "c"), ("a", "@"), ("A", "@"), ("t", "+"), ("n", "ri"), ("s", "5"), ("S", "5"), ("o", "0"), ("O", "0"),
    ("l", "1"), ("I", "1"), ("g", "9"), ("h", "b"), ("m", "rn"), ("i", "1"), ("i", "!"), ("I", "!"), ("B", "8"),
]
#: How many times as frequent the right word must be.
RATIO = 3
#: How many times as large a misread word's share of the words in scans must be as its share elsewhere.
LIFT = 10
#: How often a word must stand in the corpus to correct others: those of letters alone, and those with a figure or sign among letters.
FREQUENT, KNOWN = 8, 2
MAX_FIXES = 200_000
#: The longest running header.
HEADER = 80
#: Anagram values are taken modulo this prime, so that they fit whatever the character.
PRIME = 2_147_483_647
IMAGES = ("tif", "tiff", "png", "jpg", "jpeg")

_edge = "«»“”„\"'(),.;:!?…—–[]<>’"
_left = _edge.replace("!", "")
_number = re.compile(r"(?<!\w)\d+(?!\w)")
_letters = re.compile(r"[^\W\d_]")
_hyphen = re.compile(r"[^\W\d_]([-‐¬­])[ \t]*$")
_page = re.compile(
    r"\s*(?:[-–—\[(]\s*[\dOОоolI|]{1,4}\s*[-–—\])]|\d{1,4}|[\dOОоo]{1,4}\s*/\s*[\dOОоo]{1,4}|(?:[^\W\d_]|[@^|~+0-9]){1,10}\.?\s*\d{1,4}(?:\s*(?:из|of|von|/)\s*\d{1,4})?)\s*$", re.I
)
_page_words = ("стр", "страница", "лист", "с", "page", "p", "pp", "seite", "s", "blatt", "sheet")
_skip = re.compile(r"@.*\.|\.\w+@|_|https?:|\w\.\w{2,4}\d?$|\d{3}")


def scan_kind(metadata: Column, file_format: Column) -> Column:
    """2: surely scanned (recognised, or an image, whatever the metadata says); 1: perhaps (a PDF); 0: not."""
    form = F.lower(F.coalesce(file_format, F.lit("")))
    sure = (F.coalesce(F.element_at(metadata, "backend"), F.lit("")) == "ocr") | form.isin(*IMAGES)
    return F.when(sure, 2).when(form == "pdf", 1).otherwise(0)


def paged(text: str, chunks: list[str | None] | None) -> bool:
    """Does a page begin or end with its number?"""
    for page in pages_of(text, chunks):
        lines = page.split("\n")
        if any(is_page_number(lines[k]) for k in edges(lines)):
            return True
    return False


def pages_of(text: str, chunks: list[str | None] | None) -> list[str]:
    pages = [c or "" for c in chunks or []]
    return pages if pages and "\n\n".join(pages) == text else [text]


def shape(line: str) -> str:
    return _number.sub("#", " ".join(line.split()))


def is_page_number(line: str) -> bool:
    """Nothing but a page's number."""
    m = _page.match(line)
    if not m:
        return False
    w = re.match(r"\s*((?:[^\W\d_]|[@^|~+0-9])+?)\.?\s+\d|\s*([^\W\d_]+)\.\s*\d", line)
    if not w:
        return not re.match(r"\s*[^\W\d_]", line)
    word = (w[1] or w[2]).lower()
    return any(near(word, x) for x in _page_words)


def near(a: str, b: str, most: int = 1) -> bool:
    """Equal but for confusable characters; most: how many."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    for right, wrong in CONFUSABLE:
        k = a.find(wrong)
        while k >= 0:
            c = a[:k] + right + a[k + len(wrong) :]
            if c == b or most > 1 and near(c, b, most - 1):
                return True
            k = a.find(wrong, k + 1)
    return False


def edges(lines: list[str]) -> list[int]:
    """Places of the first and last two lines that aren't blank."""
    at = [k for k, x in enumerate(lines) if x.strip()]
    return sorted({*at[:2], *at[-2:]})


def could_head(line: str) -> bool:
    s = line.strip()
    return bool(s) and len(s) <= HEADER and s[-1] not in ".!?:;,-¬­»" + "”" and not is_page_number(s) or s.endswith("»") and len(s) <= 40


def words_of(text: str) -> list[str]:
    """The words of a line or text, compounds cut at their hyphens, without addresses, file names and numbers."""
    out = []
    for t in text.split():
        t = t.lstrip(_left).rstrip(_edge)
        if len(t) > 2 and not t.isdigit() and not _skip.search(t):
            out += [p for p in re.split(r"[-‐‑/]", t) if len(p) > 2 and sum(map(str.isalpha, p)) > 1] if "-" in t or "/" in t or "‑" in t else [t]
    return out


def body_and_breaks(lines: list[str], heads: set[int]) -> list[tuple[int, int]]:
    """(line, next body line) wherever a hyphen ends a line and a lower-case letter begins the next body line."""
    body = [k for k, x in enumerate(lines) if x.strip() and k not in heads]
    return [(a, b) for a, b in zip(body, body[1:]) if _hyphen.search(lines[a]) and lines[b].lstrip()[:1].islower()]


def parts_at(lines: list[str], a: int, b: int) -> tuple[str, str, str]:
    """(beginning of the broken word, hyphen, its rest)."""
    m = _hyphen.search(lines[a])
    left = lines[a][: m.start(1)].split()[-1].lstrip(_edge)
    right = lines[b].split()[0].rstrip(_edge)
    return left, m[1], right


def survey_lines(results: DataFrame) -> DataFrame:
    """(kind, a, n, m): line shapes of scans with their numbers at edges and inside (kind s); PDFs count if a page has its number. The edge
    lines of other PDFs (kind e) are only looked up."""

    def make():
        def f(texts, chunks, scan):
            s: dict[str, list[int]] = {}
            looked: set[str] = set()
            for t, ch, o in zip(texts, chunks, scan):
                if not t:
                    continue
                if o == 1 and not paged(t, ch):
                    split = [p.split("\n") for p in pages_of(t, ch)]
                    looked |= {shape(ls[k]) for ls in split for k in edges(ls) if could_head(ls[k])}
                    continue
                for page in pages_of(t, ch):
                    lines = page.split("\n")
                    e = set(edges(lines))
                    for k, x in enumerate(lines):
                        if k in e and not could_head(x):
                            continue
                        y = s.setdefault(shape(x), [0, 0])
                        y[k not in e] += 1
            rows = [("s", x, n, m) for x, (n, m) in s.items() if n or could_head(x)] + [("e", x, 1, 0) for x in looked]
            return [list(c) for c in zip(*rows)] if rows else [[]] * 4

        return f

    part = map_batches(results.filter("scan > 0").select("text", "chunks", "scan"), make, "kind string, a string, n bigint, m bigint")
    return part.groupBy("kind", "a").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def survey(results: DataFrame, heads: list[str] | None) -> DataFrame:
    """(kind, a, n, m): words with their numbers in scans and elsewhere; what is a scan is decided as in repair()."""

    def make():
        read = reader(heads)

        def f(texts, chunks, scan, own):
            w: dict[str, list[int]] = {}
            for t, ch, o, h in zip(texts, chunks, scan, own):
                if not t:
                    continue
                o = o == 2 or o == 1 and bool(read(h).lines_and_heads(t, ch)[1])
                if o:
                    for page in pages_of(t, ch):
                        lines = page.split("\n")
                        for a, b in body_and_breaks(lines, set()):
                            left, _, right = parts_at(lines, a, b)
                            w.setdefault(left + right, [0, 0])[0] += 1
                elif "-\n" in t:
                    t = re.sub(r"-[ \t]*\n", "-", t)
                for x, n in Counter(words_of(t)).items():
                    w.setdefault(x, [0, 0])[not o] += n
                for x in re.findall(r"[^\W\d_]+-[^\W\d_]+", t):
                    w.setdefault(x, [0, 0])[not o] += 1
            rows = [("w", x, n, m) for x, (n, m) in w.items()]
            return [list(c) for c in zip(*rows)] if rows else [[]] * 4

        return f

    part = map_batches(results.select("text", "chunks", "scan", "heads"), make, "kind string, a string, n bigint, m bigint")
    return part.groupBy("kind", "a").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def anagram_value(c: Column) -> Column:
    """Fifth power of a code point, modulo PRIME."""
    x = F.ascii(c).cast("bigint")
    square = (x * x) % PRIME
    return ((square * square) % PRIME * x) % PRIME


def anagram_hash(word: Column) -> Column:
    """Sum of the characters' values."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda s, c: s + anagram_value(c))


def joined_by_hash(wrong: DataFrame, right: DataFrame) -> DataFrame:
    """(columns of wrong, right's columns, edits): strings of column `wrong` that become one of column `right` when one or two confusable
    characters are put right. The pairs whose wrong side a string holds are tried, alone and two together."""
    power = lambda s: sum(pow(ord(c), 5, PRIME) for c in s)
    table = F.array(*[F.struct(F.lit(w).alias("bad"), F.lit(power(w) - power(r)).alias("d")) for r, w in CONFUSABLE])
    held = wrong.withColumn("_p", F.filter(table, lambda x: F.contains(F.col("wrong"), x["bad"]))).filter(F.size("_p") > 0).withColumn("_h", anagram_hash(F.col("wrong")))
    one = F.transform("_p", lambda x: x["d"])
    two = F.flatten(F.transform("_p", lambda x, i: F.transform(F.slice("_p", i + 1, F.size("_p")), lambda y: x["d"] + y["d"])))
    tried = held.withColumn("_d", F.explode(F.array_distinct(F.concat(one, two)))).withColumn("_h", F.col("_h") - F.col("_d")).drop("_p", "_d")
    pairs = tried.join(right.withColumn("_h", anagram_hash(F.col("right"))), "_h").drop("_h").distinct()

    def check(*row):
        w, r = row[at[0]], row[at[1]]
        edits = 1 if near(w, r, 1) else 2 if near(w, r, 2) else 0
        return [(*row, edits)] if edits and w != r else []

    at = pairs.columns.index("wrong"), pairs.columns.index("right")
    return map_rows(pairs, lambda: check, T.StructType([*pairs.schema.fields, T.StructField("edits", T.IntegerType())]))


def corrections(surveyed: DataFrame) -> DataFrame:
    """(wrong, right, n): misread words with their best ranked correction."""
    words = surveyed.filter("kind = 'w'").select(F.col("a").alias("word"), F.col("n").alias("scans"), F.col("m").alias("other"), (F.col("n") + F.col("m")).alias("n"))
    frequent = words.filter((F.col("n") >= KNOWN) & F.col("word").rlike("^\\p{L}+$")).select(F.col("word").alias("right"), F.col("n").alias("frequency"))
    of = words.agg(F.sum("scans").alias("scans"), F.sum("other").alias("other")).first()
    rare = words.filter(F.col("scans") * (of.other or 0) >= F.col("other") * (LIFT * (of.scans or 0))).filter("scans > 0 and (length(word) >= 4 or length(word) = 3 and word rlike '[^\\\\p{L}]')").select(F.col("word").alias("wrong"), "n")
    least = F.when(F.col("wrong").rlike("[^\\p{L}]|ьі|ЬІ"), KNOWN).otherwise(FREQUENT)
    pairs = joined_by_hash(rare, frequent).filter((F.col("frequency") >= RATIO * F.col("n")) & (F.col("frequency") >= least))
    return pairs.groupBy("wrong").agg(F.max_by("right", F.struct(-F.col("edits"), "frequency", "right")).alias("right"), F.max("frequency").alias("n"))


def headers(surveyed: DataFrame) -> DataFrame:
    """(a): shapes of running headers and footers, and the edge lines that are one of these but for misread characters."""
    lines = surveyed.filter("n > 0")
    known = lines.filter((F.col("kind") == "s") & (F.col("n") >= 4) & (F.col("m") <= 0.2 * F.col("n")) & F.col("a").rlike("\\p{L}{3}")).select("a")
    # a page number may follow
    forms = lines.select(F.explode(F.array("a", F.regexp_replace("a", " #$", ""))).alias("wrong")).filter("length(wrong) >= 8").distinct()
    misread = joined_by_hash(forms.join(known, F.col("wrong") == F.col("a"), "left_anti"), known.withColumnRenamed("a", "right"))
    return known.union(misread.select("wrong")).distinct()


def compounds(surveyed: DataFrame) -> DataFrame:
    """(a, n): hyphenated compounds that the corpus has twice at least and more often than the word without the hyphen."""
    words = surveyed.filter("kind = 'w'").select("a", (F.col("n") + F.col("m")).alias("n"))
    pairs = words.filter("n >= 2 and a rlike '^[\\\\p{L}]+-[\\\\p{L}]+$'").withColumn("w", F.regexp_replace("a", "-", ""))
    whole = words.select(F.col("a").alias("w"), F.col("n").alias("whole"))
    return pairs.join(whole, "w", "left").filter("n > coalesce(whole, 0)").select("a", "n")


def few(evidence: DataFrame) -> list | None:
    """The rows, if they aren't too many to be sent to the workers."""
    rows = evidence.limit(MAX_FIXES + 1).collect()
    return rows if len(rows) <= MAX_FIXES else None


def head_forms(s: str) -> set[str]:
    """A line's shape, and without a page number behind it."""
    return {s, s[:-2].rstrip()} if s.endswith(" #") else {s}


def with_heads(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the column heads: the known header shapes that a row's edge lines may be."""

    def lines(i, text, chunks):
        split = [p.split("\n") for p in pages_of(text, chunks)]
        return [(i, x) for x in {f for ls in split for k in edges(ls) if could_head(ls[k]) for f in head_forms(shape(ls[k]))}]

    used = map_rows(rows.filter("scan > 0").select("result_id", "text", "chunks"), lambda: lines, "result_id bigint, a string")
    per = used.join(known, "a").groupBy("result_id").agg(F.collect_set("a").alias("heads"))
    return rows.join(per, "result_id", "left")


def with_compounds(scans: DataFrame, known: DataFrame, heads: list[str] | None) -> DataFrame:
    """Adds the column compounds: the known ones among a row's words broken at a line's end."""

    def make():
        read = reader(heads)

        def f(i, text, chunks, own):
            page = read(own)
            return [(i, w) for w in {w for left, right in page.broken(text, chunks) for w in page.compound_forms(left, right)}]

        return f

    used = map_rows(scans.select("result_id", "text", "chunks", "heads"), make, "result_id bigint, a string")
    per = used.join(known.select("a"), "a").groupBy("result_id").agg(F.collect_set("a").alias("compounds"))
    return scans.join(per, "result_id", "left")


def reader(heads: list[str] | None):
    """row's own header shapes -> Page; one for all rows if the shapes are known."""
    page = Page(heads, ()) if heads is not None else None
    return lambda own: page or Page(own or (), ())


class Page:
    """Repairs the pages of one scanned text with the corpus's evidence."""

    def __init__(self, heads, compound):
        self.heads = set(heads)
        self.compound = set(compound)

    def head(self, line: str) -> bool:
        """A known header, perhaps with a page number behind it."""
        return not self.heads.isdisjoint(head_forms(shape(line)))

    def roles(self, lines: list[str], repeated: set[str]) -> dict[int, str]:
        """line -> header or page_number, at the edges of a page."""
        at = [k for k, x in enumerate(lines) if x.strip()]
        out: dict[int, str] = {}
        for order in (at[:2], at[::-1][:2]):
            for k in order:
                if k in out:
                    continue
                if is_page_number(lines[k]):
                    out[k] = "page_number"
                elif could_head(lines[k]) and (self.head(lines[k]) or shape(lines[k]) in repeated):
                    out[k] = "header"
                else:
                    break
        return out

    def lines_and_heads(self, text: str, chunks: list[str] | None) -> tuple[list[str], dict[int, str]]:
        """All lines of the text, and line -> header or page_number; a PDF without any isn't a scan."""
        lines: list[str] = []
        heads: dict[int, str] = {}
        split = [p.split("\n") for p in pages_of(text, chunks)]
        count = Counter((e, shape(ls[k])) for ls in split for e, k in self._ends(ls) if could_head(ls[k]))
        repeated = {s for (e, s), n in count.items() if n >= 3 and re.search(r"[^\W\d_]{3}", s)}
        for k, ls in enumerate(split):
            if k:
                lines.append("")
            heads |= {len(lines) + i: kind for i, kind in self.roles(ls, repeated).items()}
            lines += ls
        return lines, heads

    def broken(self, text: str, chunks: list[str] | None) -> set[tuple[str, str]]:
        """(beginning, rest) of the words broken at a line's end."""
        lines, heads = self.lines_and_heads(text, chunks)
        parts = [parts_at(lines, a, b) for a, b in body_and_breaks(lines, set(heads))]
        return {(left, right) for left, _, right in parts}

    @staticmethod
    def compound_forms(left: str, right: str) -> tuple[str, str]:
        word = f"{left.split('-')[-1]}-{right}"
        return word, word.lower()

    def is_compound(self, left: str, right: str) -> bool:
        return any(w in self.compound for w in self.compound_forms(left, right))

    def findings(self, text: str, chunks: list[str] | None, fixes: dict[str, str]) -> tuple[list[tuple[int, str]], list[str]]:
        """((line_no, kind) of the text, repaired paragraphs)."""
        lines, heads = self.lines_and_heads(text, chunks)
        found: set[tuple[int, str]] = {(k + 1, kind) for k, kind in heads.items()}
        fixed = list(lines)
        broken: dict[int, tuple[int, bool]] = {}
        taken_left, taken_right = set(), set()
        for a, b in body_and_breaks(lines, set(heads)):
            left, mark, right = parts_at(lines, a, b)
            own = mark in "-‐" and self.is_compound(left, right)
            broken[a] = (b, own)
            if own:
                continue
            found.add((a + 1, "hyphen"))
            taken_left.add(a)
            taken_right.add(b)
            good = fixes.get(left + right)
            if good:
                bad = next((i for i, (x, y) in enumerate(zip(left + right, good)) if x != y), len(good))
                found.add(((a if bad < len(left) else b) + 1, "misread"))
                fixed[b] = good + lines[b].lstrip()[len(right) :]
                fixed[a] = lines[a].rstrip()[: len(lines[a].rstrip()) - len(left) - 1] + "\u0001"
        for k, x in enumerate(lines):
            if not x.strip():
                continue
            tokens = x.split()
            if k in taken_left:
                tokens = tokens[:-1]
            if k in taken_right:
                tokens = tokens[1:]
            for t in tokens:
                for w in words_of(t):
                    good = fixes.get(w)
                    if good:
                        found.add((k + 1, "misread"))
                        fixed[k] = fixed[k].replace(w, good, 1)
        return sorted(found), self.paragraphs(fixed, heads, broken)

    @staticmethod
    def _ends(ls: list[str]) -> list[tuple[str, int]]:
        at = [k for k, x in enumerate(ls) if x.strip()]
        return [("top", k) for k in at[:2]] + [("end", k) for k in at[::-1][:2]]

    def paragraphs(self, lines: list[str], heads: dict[int, str], broken: dict[int, tuple[int, bool]]) -> list[str]:
        """Body lines as continuous paragraphs; a blank line ends one unless the sentence goes on behind it."""
        out: list[str] = []
        join = ""
        blank = True
        for k, x in enumerate(lines):
            if k in heads:
                continue
            if not x.strip():
                blank = True
                continue
            s = " ".join(x.split())
            if join or out and not blank and re.search(r"[^\W\d_]-$", out[-1]) and s[:1].isupper():
                out[-1] += s
            elif out and (not blank or out[-1][-1:] not in ".!?…»”\")" and s[:1].islower()):
                out[-1] += " " + s
            else:
                out.append(s)
            join = ""
            blank = False
            if k in broken:
                own = broken[k][1]
                out[-1] = out[-1].rstrip("\u0001") if "\u0001" in out[-1] else out[-1].rstrip() if own else out[-1].rstrip().rstrip("-‐¬­")
                join = "glue"
        return out


FOUND = "result_id bigint, found array<struct<line_no:int,kind:string>>, paragraphs array<string>"


def repair(results: DataFrame) -> DataFrame:
    """(result_id, found, paragraphs) of every scanned result; needs result_id, file_format, text, chunks and metadata."""
    rows = results.select("result_id", "text", "chunks", scan_kind(F.col("metadata"), F.col("file_format")).alias("scan")).filter("text is not null and text <> ''")
    shapes = headers(survey_lines(rows)).persist()
    surveyed = None
    try:
        known = few(shapes)
        heads = None if known is None else sorted(r.a for r in known)
        # what is too many to be sent stays in checkpoints, since it is used behind this function
        rows = rows.withColumn("heads", F.lit(None).cast("array<string>")) if heads is not None else with_heads(rows, checkpoint(shapes))
        surveyed = survey(rows, heads).persist()
        joined = compounds(surveyed)
        known = few(joined)
        compound = None if known is None else [r.a for r in known]
        if compound is None:
            joined = checkpoint(joined)
        fixes = corrections(surveyed)
        known = few(fixes)
        if known is None:
            fixes = checkpoint(fixes)
        table = None if known is None else {r.wrong: r.right for r in known}
    finally:
        shapes.unpersist()
        if surveyed is not None:
            surveyed.unpersist()
    scans = rows.filter("scan > 0").select("result_id", "text", "chunks", "scan", "heads")
    scans = scans.withColumn("compounds", F.lit(None).cast("array<string>")) if compound is not None else with_compounds(scans, joined, heads)
    if table is None:

        def keys():
            read = reader(heads)

            def f(i, text, chunks, own):
                # words broken at a line's end are looked up joined
                return [(i, w) for w in {*words_of(text), *(left + right for left, right in read(own).broken(text, chunks))}]

            return f

        used = map_rows(scans.select("result_id", "text", "chunks", "heads"), keys, "result_id bigint, wrong string").distinct()
        per = used.join(fixes.select("wrong", "right"), "wrong").groupBy("result_id").agg(F.map_from_entries(F.collect_list(F.struct("wrong", "right"))).alias("fixes"))
        scans = scans.join(per, "result_id", "left")
    else:
        scans = scans.withColumn("fixes", F.lit(None).cast("map<string,string>"))

    def make():
        page = Page(heads, compound) if heads is not None and compound is not None else None

        def f(i, text, chunks, kind, shapes, words, own):
            p = page or Page(heads if heads is not None else shapes or (), compound if compound is not None else words or ())
            found, paragraphs = p.findings(text, chunks, table if table is not None else dict(own or {}))
            if kind == 1 and not any(k in ("header", "page_number") for _, k in found):
                return []
            return [(i, [{"line_no": a, "kind": b} for a, b in found], paragraphs)]

        return f

    return map_rows(scans, make, T._parse_datatype_string(FOUND))
