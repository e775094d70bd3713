"""Page texts of PDF files that are made here."""

from __future__ import annotations

import zlib

import pytest

from quillfact.sources.pdf import page_texts, pdf_pages


def pdf(pages, flate=True, packed=False, cmap=None, extra=b""):
    """A file with these content streams; packed: dictionaries in an object stream."""
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica" + (b" /ToUnicode 5 0 R" if cmap else b"") + b" >>"}
    kids = [10 + 2 * i for i in range(len(pages))]
    half = len(kids) // 2  # a tree of two levels
    objects[2] = b"<< /Type /Pages /Kids [3 0 R %s] /Count %d /Resources << /Font << /F1 4 0 R >> >> >>" % (b" ".join(b"%d 0 R" % k for k in kids[half:]), len(kids))
    objects[3] = b"<< /Type /Pages /Parent 2 0 R /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids[:half]), half)
    streams = {5: cmap} if cmap else {}
    for k, content in zip(kids, pages, strict=True):
        objects[k], streams[k + 1] = b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R] >>" % (k + 1), content
    if packed:
        numbers = sorted(objects)
        places, body = [], b""
        for n in numbers:
            places.append(b"%d %d" % (n, len(body)))
            body += objects[n] + b" "
        front = b" ".join(places) + b" "
        streams[90] = front + body
        objects = {}
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    for n, content in streams.items():
        data = zlib.compress(content) if flate else content
        kind = b" /Type /ObjStm /N %d /First %d" % (len(numbers), len(front)) if n == 90 else b""
        out += b"%d 0 obj\n<< /Length %d%s%s >>\nstream\n%s\nendstream\nendobj\n" % (n, len(data), b" /Filter /FlateDecode" if flate else b"", kind, data)
    return out + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [
    rb"BT /F1 12 Tf 72 700 Td (Net profit was ) Tj (\(5\) \044 million) Tj 0 -14 Td (Second \\ line) Tj ET",
    rb"BT /F1 12 Tf 1 0 0 1 72 700 Tm [(Re) -20 (venue) -300 (rose)] TJ T* <48656C6C6F> Tj (next) ' ET",
    b"q 1 0 0 1 0 0 cm Q",
    rb"BT (line (with (deep) marks) \101) Tj ET",
]
TEXTS = ["Net profit was (5) $ million\nSecond \\ line", "Revenue rose\nHello\nnext", "", "line (with (deep) marks) A"]


@pytest.mark.parametrize("flate", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_page_texts(flate, packed):
    wanted = TEXTS[:3] + [page_texts(pdf(PAGES[3:]))[0]]
    assert page_texts(pdf(PAGES, flate, packed)) == wanted


def test_letters_of_a_font():
    cmap = b"beginbfchar <0001> <20B9> endbfchar beginbfrange <0010> <0012> <0041> endbfrange"
    assert page_texts(pdf([b"BT /F1 9 Tf <000100100012> Tj ET"], cmap=cmap)) == ["\u20b9AC"]


@pytest.mark.parametrize("content, error", [(b"no", "not a PDF"), (pdf([]), "no pages"), (pdf(PAGES, extra=b"/Encrypt 9 0 R "), "encrypted"), (pdf(PAGES).replace(b"endstream", b"x", 1)[:300], "")])
def test_damaged_files(content, error):
    with pytest.raises(Exception, match=error):
        page_texts(content)


def test_pages_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(PAGES[:2]))
    (tmp_path / "b.PDF").write_bytes(pdf(PAGES[:1])[:200])
    rows = pdf_pages(spark, str(tmp_path)).collect()
    assert sorted((r.filename, r.page_number, r.text) for r in rows if r.error is None) == [("a.pdf", 1, TEXTS[0]), ("a.pdf", 2, TEXTS[1])]
    assert [r.filename for r in rows if r.error] == ["b.PDF"]
