"""Pages of PDF files, parsed in the tasks.

Only what page texts need is read: objects (plain or in object streams, found by their marks, so that a damaged table of
places does not matter), Flate streams, the page tree in its order, and the text operators of content streams; codes
become letters by a font's ToUnicode map, else as Latin-1. Encrypted files are an error row, as are files without pages;
pages without text are empty texts. Files are read by Spark's own binary file source."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from quillfact.sources.connectors import pages_of
from quillfact.sources.store import binary_documents

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj\b|(?=(?<!\d)\d+\s+\d+\s+obj\b)|\Z)", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
#: Tokens of a content stream: strings, hexadecimal strings, array marks, names, numbers, operators.
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]?", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(raw: bytes, head: bytes) -> bytes:
    if b"FlateDecode" not in head:
        return raw
    out = zlib.decompressobj()
    return out.decompress(raw) + out.flush()


def _objects(content: bytes) -> dict[int, tuple[bytes, bytes]]:
    """(dictionary, stream) of each object; the last of several with one number counts, as in files that were added to."""
    found: dict[int, tuple[bytes, bytes]] = {}
    for m in OBJECT.finditer(content):
        body = m[2]
        stream = STREAM.search(body)
        head = body[: stream.start()] if stream else body
        found[int(m[1])] = (head, _inflated(stream[1], head) if stream else b"")
    for head, data in list(found.values()):
        if b"/ObjStm" in head:
            n, first = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"N", b"First"))
            places = list(map(int, data[:first].split()[: 2 * n]))
            ends = [*places[3::2], len(data) - first]
            for number, a, b in zip(places[::2], places[1::2], ends, strict=True):
                found.setdefault(number, (data[first + a : first + b], b""))
    return found


def _refs(head: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, head)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _unicode_map(data: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the letters of codes, of a ToUnicode map."""
    out, width = {}, 1
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)], width = text(to), max(width, len(code) // 2)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width = max(width, len(low) // 2)
            for i in range(min(int(high, 16) - int(low, 16) + 1, 65536)):
                out[int(low, 16) + i] = text(b"%0*x" % (len(to), int(to, 16) + i))
    return width, out


def _string(token: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\(\r?\n|[0-7]{1,3}|.)", lambda m: b"" if m[1][:1] in b"\r\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if not font or not font[1]:
        return raw.decode("latin-1")
    width, letters = font
    return "".join(letters.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _text(stream: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """The text of a content stream: operators that move to another line end one, wide gaps in an array are blanks."""
    out, held, font = [], [], None
    for token in TOKEN.findall(stream):
        if token[:1] in b"(<[]/+-.0123456789":
            held.append(token)
            continue
        strings = [t for t in held if t[:1] in b"(<"]
        if token == b"Tf" and len(held) > 1:
            font = fonts.get(held[-2][1:])
        elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and held[-1:] not in ([b"0"], [b"0.0"])) or token == b"Tm":
            out.append("\n")
        elif token in (b"Tj", b"'", b'"') and strings:
            out.append(("\n" if token != b"Tj" else "") + _string(strings[-1], font))
        elif token == b"TJ":
            for t in held:
                if t[:1] in b"(<":
                    out.append(_string(t, font))
                elif t[:1] not in b"[]/" and float(t) < -200:
                    out.append(" ")
        held = []
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n")]
    return re.sub(r"\n{2,}", "\n", "\n".join(lines)).strip("\n")


def page_texts(content: bytes) -> list[str]:
    """The texts of a file's pages, in order."""
    if not content.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise ValueError("encrypted")
    objects = _objects(content)
    head = lambda n: objects.get(n, (b"", b""))[0]
    roots = [n for n, (h, _) in objects.items() if re.search(rb"/Type\s*/Catalog\b", h)]
    pages, todo = [], [(n, b"") for r in roots[-1:] for n in _refs(head(r), b"Pages")][::-1]
    seen: set[int] = set()
    while todo:
        n, inherited = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        resources = head(n) if b"/Resources" in head(n) else inherited
        kids = _refs(head(n), b"Kids")
        todo += [(k, resources) for k in kids[::-1]]
        if not kids and re.search(rb"/Type\s*/Page\b", head(n)):
            pages.append((n, resources))
    if not pages:
        raise ValueError("no pages")
    out = []
    for n, resources in pages:
        held = b"".join([resources, *(head(r) for r in _refs(resources, b"Resources"))])
        held += b"".join(head(r) for r in _refs(held, b"Font"))
        fonts = {name: _unicode_map(objects.get(u[0], (b"", b""))[1]) for name, ref in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", held) if (u := _refs(head(int(ref)), b"ToUnicode"))}
        out.append(_text(b"\n".join(objects[c][1] for c in _refs(head(n), b"Contents") if c in objects), fonts))
    return out


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """document_id, filename, page_number, text, error of the PDF files of a folder: pages from 1, or one row with the error."""
    return pages_of(binary_documents(spark, path), page_texts)
