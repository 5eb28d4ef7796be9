"""The words of PDF files with their places on pages, for the readers of ``operators.geometry``.

A small reader of its own: objects are found by scanning the file, compressed objects and streams are unpacked, and the text
operators of page contents are followed. Codes become text by the font's ToUnicode map, or as cp1252 without one. Drawn lines,
pictures, encryption and forms inside pages are passed over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_SPACE = b"\x00\t\n\x0c\r "
_ENDS = _SPACE + b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name such as /Type."""


class Word(str):
    """An operator or keyword."""


class Ref(tuple):
    """A reference to an object by its number."""


class _Parser:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def _skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 0x25:
                end = re.compile(rb"[\r\n]").search(data, self.at)
                self.at = end.start() if end else n
            else:
                return

    def next(self):  # noqa: ANN201
        """The next value, or None at the end. A number, a generation and R make a reference."""
        self._skip()
        data, at = self.data, self.at
        if at >= len(data):
            return None
        two, c = data[at : at + 2], data[at : at + 1]
        if two == b"<<":
            self.at += 2
            items = self._until(">>")
            return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        if c == b"[":
            self.at += 1
            return self._until("]")
        if two == b">>" or c in b"]{})":
            self.at += 2 if two == b">>" else 1
            return Word((two if two == b">>" else c).decode())
        if c == b"(":
            return self._text()
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            end = at + 1
            while end < len(data) and data[end] not in _ENDS:
                end += 1
            self.at = end
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m.group(1), 16)]), data[at + 1 : end]).decode("latin-1"))
        if m := re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z])").match(data, at):
            self.at = m.end()
            return Ref((int(m.group(1)),))
        if (m := _NUMBER.match(data, at)) and (m.end() >= len(data) or data[m.end()] in _ENDS):
            self.at = m.end()
            return float(m.group()) if b"." in m.group() else int(m.group())
        end = at + 1
        while end < len(data) and data[end] not in _ENDS:
            end += 1
        self.at = end
        return Word(data[at:end].decode("latin-1"))

    def _until(self, mark: str) -> list:
        out = []
        while (v := self.next()) is not None and not (isinstance(v, Word) and v == mark):
            out.append(v)
        return out

    def _text(self) -> bytes:
        out, depth, data = bytearray(), 1, self.data
        k = self.at + 1
        while k < len(data):
            c = data[k : k + 1]
            if c == b"\\":
                nxt = data[k + 1 : k + 2]
                if m := re.compile(rb"[0-7]{1,3}").match(data, k + 1):
                    out.append(int(m.group(), 8) & 255)
                    k = m.end()
                    continue
                if nxt in b"\r\n":
                    k += 3 if data[k + 1 : k + 3] == b"\r\n" else 2
                    continue
                out += _ESCAPES.get(nxt, nxt)
                k += 2
                continue
            depth += (c == b"(") - (c == b")")
            k += 1
            if not depth:
                break
            out += c
        self.at = k
        return bytes(out)


class _File:
    """The objects of a file by number; a later definition replaces an earlier one."""

    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            p = _Parser(data, m.end())
            value, number = p.next(), int(m.group(1))
            self.objects[number] = value
            if isinstance(value, dict) and (s := re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(data, p.at)):
                end = data.find(b"endstream", s.end())
                self.streams[number] = data[s.end() : end if end >= 0 else len(data)]
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                body, first = self.stream(number), int(self.get(value.get("First"), 0))
                heads = _Parser(body[:first])
                pairs = [(heads.next(), heads.next()) for _ in range(int(self.get(value.get("N"), 0)))]
                for n, at in pairs:
                    if isinstance(n, int) and isinstance(at, int):
                        self.objects.setdefault(n, _Parser(body, first + at).next())

    def get(self, value, default=None):  # noqa: ANN001, ANN201
        for _ in range(20):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(value[0])
        return default if value is None else value

    def stream(self, number: int) -> bytes:
        """The unpacked bytes of a stream; what can't be unpacked is empty."""
        head, body = self.objects.get(number), self.streams.get(number, b"")
        kinds = self.get(head.get("Filter"), []) if isinstance(head, dict) else []
        length = self.get(head.get("Length")) if isinstance(head, dict) else None
        if isinstance(length, int) and 0 < length <= len(body):
            body = body[:length]
        for kind in kinds if isinstance(kinds, list) else [kinds]:
            if kind == "FlateDecode":
                try:
                    body = zlib.decompressobj().decompress(body)
                except zlib.error:
                    return b""
            elif kind == "ASCIIHexDecode":
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", body.split(b">")[0])
                body = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                return b""
        return body

    def pages(self) -> list[tuple[dict, dict]]:
        """The pages in order with their resources, which a page may have from those above it."""
        out: list[tuple[dict, dict]] = []
        seen: set[int] = set()

        def walk(value, above: dict) -> None:  # noqa: ANN001
            if isinstance(value, Ref):
                if value[0] in seen:
                    return
                seen.add(value[0])
            node = self.get(value)
            if not isinstance(node, dict):
                return
            now = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if node.get("Type") == "Pages" or "Kids" in node:
                for kid in self.get(node.get("Kids"), []):
                    walk(kid, now)
            else:
                out.append((node, now))

        roots = [v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        for root in roots[-1:]:
            walk(root.get("Pages"), {})
        return out


class _Font:
    """How the codes of a font become text, and how wide they are in thousandths."""

    def __init__(self, file: _File, font: dict) -> None:
        self.wide = font.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        if isinstance(ref := font.get("ToUnicode"), Ref):
            self._read_map(file.stream(ref[0]))
        kids = file.get(font.get("DescendantFonts"), [])
        below = file.get(kids[0], {}) if self.wide and kids else {}
        self.first, self.widths = int(file.get(font.get("FirstChar"), 0)), [file.get(w, 0) for w in file.get(font.get("Widths"), [])]
        self.usual = float(file.get(below.get("DW"), 1000)) if self.wide else 500.0

    def _read_map(self, text: bytes) -> None:
        p, held = _Parser(text), []
        number = lambda b: int.from_bytes(b, "big")
        say = lambda b: b.decode("utf-16-be", errors="replace")
        while (v := p.next()) is not None:
            if isinstance(v, Word):
                if v == "endbfchar":
                    self.map |= {number(a): say(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(b, bytes)}
                elif v == "endbfrange":
                    for a, z, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                        for k in range(min(number(z) - number(a) + 1, 65536)):
                            if isinstance(to, list):
                                if k < len(to):
                                    self.map[number(a) + k] = say(to[k])
                            else:
                                self.map[number(a) + k] = say(to[:-2] + ((number(to[-2:]) + k) & 0xFFFF).to_bytes(2, "big"))
                held = []
            else:
                held.append(v)

    def show(self, data: bytes) -> tuple[str, float]:
        """The text of some codes, and its width in thousandths of the size."""
        codes = [int.from_bytes(data[k : k + 2], "big") for k in range(0, len(data), 2)] if self.wide else list(data)
        text = "".join(self.map.get(c) or ("" if self.wide else bytes([c]).decode("cp1252", errors="replace")) for c in codes)
        width = sum(float(self.widths[c - self.first]) if 0 <= c - self.first < len(self.widths) else self.usual for c in codes)
        return text, width


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _page_texts(content: bytes, fonts: dict[str, _Font], height: float) -> Iterator[tuple[float, float, float, str]]:
    """Every shown text: (x, y from the top, width, text)."""
    p, held, stack, now = _Parser(content), [], [], _ONE
    text = line = _ONE
    font, size, leading = None, 0.0, 0.0
    while (v := p.next()) is not None:
        if not isinstance(v, Word):
            held.append(v)
            continue
        nums = [float(x) for x in held if isinstance(x, (int, float))]
        if v == "q":
            stack.append(now)
        elif v == "Q":
            now = stack.pop() if stack else _ONE
        elif v == "cm" and len(nums) == 6:
            now = _times(tuple(nums), now)
        elif v == "BT":
            text = line = _ONE
        elif v == "Tf" and held and nums:
            font, size = fonts.get(str(held[0])), nums[-1]
        elif v == "TL" and nums:
            leading = nums[0]
        elif v == "Tm" and len(nums) == 6:
            text = line = tuple(nums)
        elif v in ("Td", "TD") and len(nums) == 2:
            leading = -nums[1] if v == "TD" else leading
            text = line = _times((1, 0, 0, 1, nums[0], nums[1]), line)
        elif v == "T*":
            text = line = _times((1, 0, 0, 1, 0, -leading), line)
        elif v in ("Tj", "'", '"', "TJ") and held and font:
            if v in "'\"":
                text = line = _times((1, 0, 0, 1, 0, -leading), line)
            shown, width = "", 0.0
            for x in held[-1] if isinstance(held[-1], list) else [held[-1]]:
                if isinstance(x, bytes):
                    more, wide = font.show(x)
                    shown, width = shown + more, width + wide
                elif isinstance(x, (int, float)):
                    shown, width = shown + (" " if x < -200 else ""), width - x
            place = _times(text, now)
            if shown.strip():
                yield place[4], height - place[5], width / 1000 * size * place[0], shown.strip()
            text = _times((1, 0, 0, 1, width / 1000 * size, 0), text)
        held = []


def pdf_texts(data: bytes) -> list[tuple[int, float, float, float, str]]:
    """The shown texts of a file: (page from 1, x, y from the page's top, width, text)."""
    file, out, known = _File(data), [], {}
    for number, (page, above) in enumerate(file.pages(), 1):
        resources = file.get(above.get("Resources"), {})
        fonts = {}
        for name, ref in file.get(resources.get("Font"), {}).items():
            key = ref[0] if isinstance(ref, Ref) else id(ref)
            if key not in known:
                known[key] = _Font(file, file.get(ref, {}))
            fonts[str(name)] = known[key]
        box = [float(file.get(x, 0)) for x in file.get(above.get("MediaBox"), [0, 0, 612, 792])]
        parts = page.get("Contents")
        parts = parts if isinstance(parts, Ref) and parts[0] in file.streams else file.get(parts, [])
        content = b"\n".join(file.stream(r[0]) for r in ([parts] if isinstance(parts, Ref) else parts) if isinstance(r, Ref))
        out += [(number, *t) for t in _page_texts(content, fonts, box[3])]
    return out


def pdf_tokens(files: DataFrame) -> DataFrame:
    """The shown texts of PDF files (``path``, ``content``): ``doc``, ``page``, ``x``, ``y`` (from the top), ``w``, ``text`` (S16, S17). A
    file without readable text gives none."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, *t) for t in pdf_texts(bytes(data or b""))]
                except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=["doc", "page", "x", "y", "w", "text"])

    return files.select("path", "content").mapInPandas(run, "doc string, page int, x double, y double, w double, text string")
