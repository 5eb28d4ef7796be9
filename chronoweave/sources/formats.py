"""What kind of file some bytes are, and the tables in them."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.grid import html_cells

# What files of each kind begin with.
_MAGIC = ((b"%PDF", "pdf"), (b"{\\rtf", "rtf"), (b"\x89PNG", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image"))
_OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_MEMBERS = (("xl/", "xlsx"), ("word/", "docx"), ("ppt/", "pptx"))
_HTML = re.compile(rb"<\s*(?:!doctype\s+html|html\b|table\b|tr\b|td\b|th\b)", re.IGNORECASE)


# One-byte encodings of Russian texts, and the letters that are most frequent in them.
_ONE_BYTE, _FREQUENT = ("cp1251", "koi8-r", "cp866"), set("оеаинтсрвл")


def decoded(data: bytes) -> str | None:
    """The text of some bytes: by a byte order mark, as UTF-8, or in the one-byte encoding in which most frequent Russian letters
    come out; None if it is no text (control characters, or no such letters)."""
    try:
        if data.startswith((b"\xff\xfe", b"\xfe\xff")):
            return data.decode("utf-16")
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        if any(b < 32 and b not in (9, 10, 12, 13, 27) for b in data) or data.startswith((b"\xff\xfe", b"\xfe\xff")):
            return None
    found = [data.decode(e, errors="replace") for e in _ONE_BYTE]
    text = max(found, key=lambda t: sum(c in _FREQUENT for c in t))
    high = sum(b >= 128 for b in data)
    return text if sum(c in _FREQUENT for c in text) * 4 >= high else None


def sniff(data: bytes | None, name: str = "") -> str:
    """The format of a file by its whole content, and by its name only where the content says nothing. Null and empty are ``empty``."""
    if not data:
        return "empty"
    for mark, kind in _MAGIC:
        if data.startswith(mark):
            return kind
    if data.startswith(_OLE):
        return "doc" if name.lower().endswith(".doc") else "xls"
    if data.startswith(b"PK"):
        try:
            inside = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return "binary"
        if "mimetype" in inside and "content.xml" in inside:
            return "ods"
        return next((kind for start, kind in _MEMBERS if any(n.startswith(start) for n in inside)), "zip")
    if _HTML.search(data):
        return "html"
    suffix = name.lower().rpartition(".")[2] if "." in name else ""
    if suffix in ("csv", "tsv", "txt", "json"):
        return suffix
    text = decoded(data)
    if text is None:
        return suffix or "binary"
    return "json" if text.lstrip("\ufeff \r\n\t")[:1] in ("{", "[") else "csv" if any(text.count(s) >= 2 for s in ",;\t") else "txt"


def candidates(data: bytes | None, name: str = "") -> list[str]:
    """The formats to try, in order: what the content shows, what the name says, then the others."""
    first = [sniff(data, name), name.lower().rpartition(".")[2] if "." in name else ""]
    return list(dict.fromkeys([k for k in first if k in _READERS] + list(_READERS)))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _bare(x.tag) == name)


def _words(node: ElementTree.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in _all(node, name))


def _xlsx_sheets(data: bytes) -> list[dict[tuple[int, int], str]]:
    """All sheets, merged ranges filled from their first cell where cells are empty."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = [_words(x) for x in _all(ElementTree.fromstring(book.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    out: list[dict[tuple[int, int], str]] = []
    for sheet in sorted((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
        root, cells = ElementTree.fromstring(book.read(sheet)), {}
        for c in _all(root, "c"):
            value = next((x.text or "" for x in _all(c, "v")), "")
            text = shared[int(value)] if c.get("t") == "s" and value else _words(c) if c.get("t") == "inlineStr" else value
            ref = c.get("r", "")
            if text and ref:
                cells[int(re.search(r"\d+", ref).group()) - 1, _column(ref)] = text
        for m in _all(root, "mergeCell"):
            a, _, z = m.get("ref", "").partition(":")
            rows = [int(re.search(r"\d+", x).group()) - 1 for x in (a, z or a)]
            for r in range(rows[0], rows[1] + 1):
                for c in range(_column(a), _column(z or a) + 1):
                    if (rows[0], _column(a)) in cells:
                        cells.setdefault((r, c), cells[rows[0], _column(a)])
        out.append(cells)
    return out


def _xlsx(data: bytes) -> list[tuple[int, int, str]]:
    """The sheet with most cells, the first of equals."""
    return sorted((r, c, t) for (r, c), t in max(_xlsx_sheets(data), key=len, default={}).items())


def _ods(data: bytes) -> list[tuple[int, int, str]]:
    """The first sheet; repeated rows and columns are written out, blank ones skipped."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    times = lambda node, what: next((int(v) for k, v in node.attrib.items() if _bare(k) == what), 1)
    out, r = [], 0
    for row in _all(next(_all(root, "table"), root), "table-row"):
        c, cells = 0, []
        for cell in row:
            n = times(cell, "number-columns-repeated")
            text = " ".join("".join(p.itertext()) for p in _all(cell, "p"))
            if text:
                cells += [(c + k, text) for k in range(n)]
            c += n
        n = times(row, "number-rows-repeated")
        if cells:
            out += [(r + k, at, text) for k in range(n) for at, text in cells]
        r += n
    return out


def _office_rows(data: bytes, part: str) -> list[tuple[int, int, str]]:
    """Tables and paragraphs of a text or slide document in their order: a row for each table row and for each paragraph that
    stands in no table."""
    book, rows = zipfile.ZipFile(io.BytesIO(data)), []

    def walk(node: ElementTree.Element) -> None:
        for x in node:
            kind = _bare(x.tag)
            if kind == "tbl":
                rows.extend([[" ".join(_words(p) for p in _all(cell, "p")) for cell in row if _bare(cell.tag) == "tc"] for row in x if _bare(row.tag) == "tr"])
            elif kind == "p":
                rows.append([_words(x)])
            else:
                walk(x)

    for name in sorted((n for n in book.namelist() if re.fullmatch(part, n)), key=lambda n: (len(n), n)):
        walk(ElementTree.fromstring(book.read(name)))
    return [(r, c, text) for r, row in enumerate(x for x in rows if any(x)) for c, text in enumerate(row) if text]


def _csv(data: bytes) -> list[tuple[int, int, str]]:
    """Comma, semicolon or tab: the sign by which most rows have one and the same number of cells, more than one. A byte order
    mark is no text."""
    text, best, most = decoded(data) or "", [], (-1, 0)
    for sign in ",;\t":
        rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sign))
        width, n = max(Counter(map(len, rows)).items(), key=lambda x: (x[0] > 1, x[1], x[0]), default=(0, 0))
        score = (n if width > 1 else 0, width)
        if score > most:
            best, most = rows, score
    return [(r, c, x) for r, row in enumerate(best) for c, x in enumerate(row) if x]


_READERS: dict[str, Callable[[bytes], list[tuple[int, int, str]]]] = {
    "xlsx": _xlsx,
    "ods": _ods,
    "csv": _csv,
    "tsv": _csv,
    "html": lambda b: html_cells(decoded(b) or ""),
    "docx": lambda b: _office_rows(b, r"word/document\.xml"),
    "pptx": lambda b: _office_rows(b, r"ppt/slides/slide\d+\.xml"),
}


_BROKEN = (ValueError, KeyError, AttributeError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error)


def _grid_of(data: bytes, kind: str, every_sheet: bool) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The grids of a file with the ending of their names."""
    if kind == "xlsx" and every_sheet:
        return [(f"#{n}", sorted((r, c, t) for (r, c), t in cells.items())) for n, cells in enumerate(_xlsx_sheets(data), 1)]
    return [("", _READERS[kind](data))]


def file_grids(files: DataFrame, every_sheet: bool = False) -> DataFrame:
    """The grids of files (``path``, ``content`` as ``spark.read.format("binaryFile")`` gives them): ``doc``, ``format``,
    ``row``, ``col``, ``text``. A file that can't be read, or of a format without tables, gives one row with null ``row``
    and the reason as text. Of a workbook the sheet with most cells is taken, or every one, as ``path#number``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[str, str, int | None, int | None, str]] = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                kind = sniff(data, path)
                if kind not in _READERS:
                    out.append((path, kind, None, None, f"unsupported format {kind}"))
                    continue
                try:
                    out += [(path + ending, kind, *cell) for ending, cells in _grid_of(data, kind, every_sheet) for cell in cells]
                except _BROKEN as error:
                    out.append((path, kind, None, None, f"unreadable: {type(error).__name__}"))
            frame = pd.DataFrame(out, columns=["doc", "format", "row", "col", "text"])
            yield frame.astype({"row": "Int32", "col": "Int32"})

    return files.select("path", "content").mapInPandas(run, "doc string, format string, row int, col int, text string")


def attempts(files: DataFrame) -> DataFrame:
    """What every reader makes of every file, in the order of ``candidates``: ``doc``, ``attempt_no``, ``parser``, ``cells`` (an
    array of row, col, text) and ``warnings`` (1 if it failed). A reader whose kind the content shows comes first (S7, S8)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                for n, kind in enumerate(candidates(data, path), 1):
                    try:
                        cells, bad = _READERS[kind](data or b""), 0
                    except _BROKEN:
                        cells, bad = [], 1
                    out.append((path, n, kind, [{"row": r, "col": c, "text": t} for r, c, t in cells], bad))
            yield pd.DataFrame(out, columns=["doc", "attempt_no", "parser", "cells", "warnings"])

    return files.select("path", "content").mapInPandas(run, "doc string, attempt_no int, parser string, cells array<struct<row:int,col:int,text:string>>, warnings int")


@F.pandas_udf(T.StringType())
def _sniffed(content: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([sniff(c, n or "") for c, n in zip(content, name, strict=True)])


def sniffed(content: F.Column, name: F.Column) -> F.Column:
    """The format of files as a column."""
    return _sniffed(content, name)
