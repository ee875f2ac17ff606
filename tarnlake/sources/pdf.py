"""Text of PDF files, read by Spark's binaryFile source or held in a column."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most pages that are read where no other number, or None for all, is asked for.
PAGES = 50
#: Bytes that one stream may unpack to: a bound on what a damaged or hostile file can ask of a task.
MOST_BYTES = 64 << 20
RESULT = "status string, n_pages int, text string"
#: Fixed values of the format: escapes in literal strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_SPACE = rb"[\x00\t\n\f\r ]"
_OBJECT = re.compile(rb"obj\b")
_BLANKS, _DIGITS = b"\x00\t\n\f\r ", b"0123456789"
_TOKEN = re.compile(
    rb"%[^\r\n]*|(?P<open>\()|<<|>>|(?P<hex><[0-9A-Fa-f\x00\t\n\f\r ]*>)|(?P<list>[\[\]])|/(?P<name>[^\x00\t\n\f\r ()<>\[\]{}/%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?![^\x00\t\n\f\r ()<>\[\]{}/%])|(?P<word>[^\x00\t\n\f\r ()<>\[\]{}/%]+)"
)


class Unreadable(Exception):
    """A file whose text can't be told; the message is its status."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string in brackets that starts before `at`, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            c = data[at + 1 : at + 2]
            if c not in (b"\n", b"\r"):
                out += _ESCAPES.get(c, c)
            at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def _numbers(data: bytes) -> Iterator[tuple[int, int]]:
    """Number and end of each object's head. Heads are read backwards from their last word: hex strings are full of digits that might begin one."""
    for m in _OBJECT.finditer(data):
        at, parts = m.start(), []
        for kind in (_BLANKS, _DIGITS, _BLANKS, _DIGITS):
            end = at
            while at and data[at - 1] in kind:
                at -= 1
            parts.append(data[at:end])
        if all(parts):
            yield int(parts[3]), m.end()


def _unhex(token: bytes) -> bytes:
    try:
        return bytes.fromhex(token.strip(b"<>").decode())
    except ValueError:  # odd, or with blanks that Python doesn't know
        pass
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class _File:
    """Objects of a file by number, found by their heads: damaged tables of places don't matter."""

    def __init__(self, data: bytes):
        self.data, self.at, self.inner = data, {}, {}
        if b"%PDF-" not in data[:1024]:
            raise Unreadable("not_pdf")
        for n, end in _numbers(data):
            self.at[n] = end  # of several versions the last holds
        if re.search(rb"/Encrypt\b", data):
            raise Unreadable("encrypted")
        for n in list(self.at):
            head = self.head(n)
            if re.search(rb"/Type\s*/ObjStm\b", head):
                body, first = self.stream(n), int(self.value(head, b"First") or 0)
                numbers = [int(x) for x in body[:first].split()]
                for i, (k, place) in enumerate(zip(numbers[::2], numbers[1::2])):
                    end = first + numbers[2 * i + 3] if 2 * i + 3 < len(numbers) else len(body)
                    self.inner[k] = body[first + place : end]

    def head(self, n: int) -> bytes:
        """An object without its stream."""
        if n in self.inner:
            return self.inner[n]
        if n not in self.at:
            return b""
        ends = re.compile(rb"\bstream\r?\n|\bendobj\b").search(self.data, self.at[n])
        return self.data[self.at[n] : ends.start() if ends else len(self.data)]

    def value(self, head: bytes, key: bytes) -> bytes | None:
        """The plain value of a key; references to numbers are followed."""
        m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R\b|([^\s/<>\[\]()]+))", head)
        return None if not m else self.head(int(m[1])).strip() if m[1] else m[2]

    def references(self, head: bytes, key: bytes) -> list[int]:
        """Object numbers of a key: a reference, a list of them, or a reference to such a list."""
        m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R\b|\[([^\]]*)\])", head)
        if not m:
            return []
        if m[1]:
            listed = re.fullmatch(rb"\s*\[([^\]]*)\]\s*", self.head(int(m[1])))
            return [int(m[1])] if not listed else [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R\b", listed[1])]
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R\b", m[2])]

    def dictionary(self, head: bytes, key: bytes) -> bytes:
        """The dictionary under a key, itself or by reference."""
        m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R\b|<<)", head)
        if not m:
            return b""
        if m[1]:
            return self.head(int(m[1]))
        depth, at = 1, m.end()
        for t in re.compile(rb"<<|>>").finditer(head, at):
            depth += 1 if t[0] == b"<<" else -1
            if not depth:
                return head[at : t.start()]
        return head[at:]

    def stream(self, n: int) -> bytes:
        if n not in self.at:
            return b""
        head = self.head(n)
        begin = re.compile(rb"stream\r?\n").match(self.data, self.at[n] + len(head))
        if not begin:
            return b""
        length = self.value(head, b"Length")
        end = begin.end() + int(length) if length and length.isdigit() else -1
        if end < 0 or not self.data[end : end + 20].lstrip().startswith(b"endstream"):
            end = self.data.find(b"endstream", begin.end())
        body = self.data[begin.end() : end if end >= 0 else len(self.data)]
        m = re.search(rb"/Filter\s*(?:\[([^\]]*)\]|(/\w+))", head)
        for name in re.findall(rb"/(\w+)", (m[1] or m[2] or b"") if m else b""):
            if name in (b"FlateDecode", b"Fl"):
                body = self._unpacked(body)
            elif name in (b"ASCIIHexDecode", b"AHx"):
                body = _unhex(body.split(b">")[0])
            else:
                raise Unreadable("unsupported_filter")
        if re.search(rb"/Predictor\s*(?:[2-9]|1\d)", head):
            raise Unreadable("unsupported_filter")
        return body

    @staticmethod
    def _unpacked(body: bytes) -> bytes:
        unpack = zlib.decompressobj()
        try:
            out = unpack.decompress(body, MOST_BYTES)
        except zlib.error:
            raise Unreadable("damaged") from None
        if unpack.unconsumed_tail:
            raise Unreadable("too_large")
        return out

    def pages(self) -> list[tuple[bytes, bytes]]:
        """Pages in order with their resources, which may stand with a node above."""
        roots = [n for n in [*self.at, *self.inner] if re.search(rb"/Type\s*/Catalog\b", self.head(n))]
        out, seen = [], set()
        stack = [(n, b"") for n in reversed(self.references(self.head(roots[-1]), b"Pages"))] if roots else []
        while stack:
            n, above = stack.pop()
            if n in seen:
                continue
            seen.add(n)
            head = self.head(n)
            own = self.dictionary(head, b"Resources") or above
            kids = self.references(head, b"Kids")
            if kids:
                stack += [(k, own) for k in reversed(kids)]
            elif re.search(rb"/Type\s*/Page\b", head):
                out.append((head, own))
        return out


class _Font:
    """Codes of a font to text: by its ToUnicode map, else single bytes as WinAnsi."""

    def __init__(self, file: _File, head: bytes):
        self.codes: dict[bytes, str] = {}
        self.ranges: list[tuple[int, int, int, int]] = []
        self.wide = bool(re.search(rb"/Subtype\s*/Type0\b", head))
        to = file.references(head, b"ToUnicode")
        self.mapped = bool(to)
        if not to:
            return
        text = file.stream(to[0])
        units = lambda h: _unhex(h).decode("utf-16-be", "surrogatepass")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
            for a, b in re.findall(rb"<([^>]*)>\s*<([^>]*)>", block):
                self.codes[_unhex(a)] = units(b)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
            for a, b, c, many in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[([^\]]*)\])", block):
                low, high = int(a, 16), int(b, 16)
                if many:
                    for i, x in enumerate(re.findall(rb"<([^>]*)>", many)[: high - low + 1]):
                        self.codes[(low + i).to_bytes(len(_unhex(a)), "big")] = units(x)
                elif len(_unhex(c)) == 2:
                    self.ranges.append((len(_unhex(a)), low, high, int(c, 16)))
                else:
                    for i in range(min(high - low, 255) + 1):
                        raw = _unhex(c)
                        self.codes[(low + i).to_bytes(len(_unhex(a)), "big")] = (raw[:-1] + bytes([(raw[-1] + i) & 255])).decode("utf-16-be", "surrogatepass")

    def text(self, codes: bytes) -> str:
        if not self.mapped:
            if self.wide:
                raise Unreadable("unsupported_encoding")
            return codes.decode("cp1252", "replace")
        size = 2 if self.wide else 1
        if size == 2 and not self.codes and self.ranges and self.ranges[0] == (2, 0, 0xFFFF, 0):  # codes are UTF-16 as they are
            odd = len(codes) % 2
            return codes[: len(codes) - odd].decode("utf-16-be", "surrogatepass") + (chr(codes[-1]) if odd else "")
        out = []
        for i in range(0, len(codes), size):
            code = codes[i : i + size]
            known = self.codes.get(code)
            if known is None:
                x = int.from_bytes(code, "big")
                known = self.codes[code] = next((chr(to + x - low) for n, low, high, to in self.ranges if n == size and low <= x <= high), "" if self.wide else code.decode("cp1252", "replace"))
            out.append(known)
        return "".join(out)


def _shown(content: bytes, fonts: dict[bytes, _Font]) -> str:
    """Text that a page's content shows: moves to another line start a new one, wide gaps within a line are a space."""
    lines, args, gap = [[]], [], False
    font = _Font(_File.__new__(_File), b"")

    def show(items):
        for x in items:
            if isinstance(x, bytes):
                lines[-1].append(font.text(x))
            elif isinstance(x, float) and x < -200:
                lines[-1].append(" ")

    at = 0
    while m := _TOKEN.search(content, at):
        at = m.end()
        if m["open"]:
            text, at = _literal(content, at)
            args.append(text)
        elif m["hex"]:
            args.append(_unhex(m["hex"]))
        elif m["number"]:
            args.append(float(m["number"]))
        elif m["name"] is not None:
            args.append("/" + m["name"].decode("latin-1"))
        elif m["word"]:
            word = m["word"]
            if word == b"Tf" and len(args) >= 2:
                font = fonts.get(str(args[-2])[1:].encode("latin-1"), font)
            elif word in (b"T*", b"'", b'"') or (word in (b"Td", b"TD") and args and args[-1] != 0) or word in (b"Tm", b"ET"):
                lines.append([])
            if word in (b"Tj", b"TJ", b"'", b'"'):
                show(args)
            if word == b"BI":  # an image within the page
                end = re.compile(rb"\sEI\b").search(content, at)
                at = end.end() if end else len(content)
            args = []
    return "\n".join(x for x in ("".join(line) for line in lines) if x)


def text_of(data: bytes | None, pages: int | None = PAGES) -> tuple[str, int, str]:
    """(status, n_pages, text) of a file's first `pages` pages, of all where that is None, one line break between pages.

    Status is ok, empty (no text on these pages), not_pdf (nulls and empty files too), encrypted, damaged, too_large,
    unsupported_filter or unsupported_encoding; text is empty for all but ok. A page that can't be read is left out if
    another one gives text. n_pages counts all pages of the file, read or not.
    """
    try:
        file = _File(bytes(data or b""))
        found = file.pages()
    except Unreadable as e:
        return str(e), 0, ""
    fonts: dict[bytes, dict[bytes, _Font]] = {}
    texts, wrong = [], None
    for head, resources in found[:pages]:
        try:
            if resources not in fonts:
                named = re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R\b", file.dictionary(resources, b"Font"))
                fonts[resources] = {name: _Font(file, file.head(int(n))) for name, n in named}
            content = b"\n".join(file.stream(n) for n in file.references(head, b"Contents"))
            texts.append(_shown(content, fonts[resources]))
        except Unreadable as e:
            wrong = wrong or str(e)
        except (ValueError, IndexError, UnicodeError):
            wrong = wrong or "damaged"
    text = "\n".join(t for t in texts if t).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return ("ok" if text else wrong or ("empty" if found else "damaged")), len(found), text


def read(content: Column, pages: int | None = PAGES) -> Column:
    """The struct (status, n_pages, text) of a column of files. Files reach Python in batches of spark.sql.execution.arrow.maxBytesPerBatch bytes."""

    @F.pandas_udf(RESULT)
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([text_of(x, pages) for x in part], columns=["status", "n_pages", "text"])

    return texts(content)


def files(spark: SparkSession, path: str, pages: int | None = PAGES) -> DataFrame:
    """Status, n_pages and text of each PDF file below a folder, by path; other files aren't opened."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", read(F.col("content"), pages).alias("p")).select("path", "length", "p.*")
