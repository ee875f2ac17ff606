"""Text of hand-made PDF files."""

import zlib

import pytest

from tarnlake.sources import pdf


def made(*contents, font=b"/Subtype /Type1", more=b"", flate=True, extra=b""):
    """A file of a page for each content, with one font."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    out = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[" + kids + b"]/Count 9>>\nendobj\n3 0 obj\n<</Type/Font " + font + b">>\nendobj\n" + more
    for i, c in enumerate(contents):
        body = zlib.compress(c) if flate else c
        out += b"%d 0 obj\n<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>\nendobj\n" % (10 + 2 * i, 11 + 2 * i)
        out += b"%d 0 obj\n<</Length %d%s>>\nstream\n" % (11 + 2 * i, len(body), b"/Filter/FlateDecode" if flate else b"") + body + b"\nendstream\nendobj\n"
    return out + b"trailer\n<</Root 1 0 R" + extra + b">>\n%%EOF"


def stream(n, body, head=b""):
    return b"%d 0 obj\n<<%s/Length %d>>\nstream\n" % (n, head, len(body)) + body + b"\nendstream\nendobj\n"


@pytest.mark.parametrize("flate", [True, False])
def test_operators_and_strings(flate):
    content = rb"""BT /F1 12 Tf 1 0 0 1 72 700 Tm (Fee 0.5 \(per\) cent \245\n) Tj 0 -14 Td [(Li) -20 (mit) -300 (of (all))] TJ % a remark
T* <4869> Tj (next) ' 3 0 Td ( same) Tj ET BI /W 1 ID (x) Tj EI BT (last\
 one \101) Tj ET"""
    assert pdf.text_of(made(content, flate=flate)) == ("ok", 1, "Fee 0.5 (per) cent ¥\n\nLimit of (all)\nHi\nnext same\nlast one A")


def test_pages_in_order_and_their_limit():
    pages = [b"BT /F1 9 Tf (p%d) Tj ET" % i for i in range(60)]
    assert pdf.text_of(made(*pages)) == ("ok", 60, "\n".join(f"p{i}" for i in range(50)))
    assert pdf.text_of(made(*pages), pages=2) == ("ok", 60, "p0\np1")


def test_maps_to_unicode():
    cmap = b"2 beginbfchar <0001> <AC00> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079007A>] endbfrange"
    content = b"BT /F1 9 Tf <000100020010001200200021> Tj ET"
    assert pdf.text_of(made(content, font=b"/Subtype/Type0/ToUnicode 4 0 R", more=stream(4, cmap))) == ("ok", 1, "가😀ACxyz")
    assert pdf.text_of(made(content, font=b"/Subtype/Type0/Encoding/Identity-H"))[0] == "unsupported_encoding"


def test_objects_within_streams():
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids 5 0 R/Resources 6 0 R>>"), (5, b"[7 0 R]"), (6, b"<</Font<</F1 3 0 R>>>>"), (7, b"<</Type/Page/Contents[8 0 R 9 0 R]>>"), (3, b"<</Type/Font>>")]
    heads, body = b"", b""
    for n, x in inner:
        heads += b"%d %d " % (n, len(body))
        body += x + b" "
    packed = zlib.compress(heads + body)
    data = b"%PDF-1.5\n" + stream(20, packed, b"/Type/ObjStm/N 6/First %d/Filter[/FlateDecode]" % len(heads)) + stream(8, b"BT /F1 9 Tf (one) Tj") + stream(9, b"(two) Tj ET")
    assert pdf.text_of(data) == ("ok", 1, "onetwo")


def test_files_that_cannot_be_read(spark, tmp_path):
    good = made(b"BT (a) Tj ET")
    cases = {
        "not_pdf": [None, b"", b"plain text", b"<html>"], "encrypted": [made(b"BT (a) Tj ET", extra=b"/Encrypt 9 0 R")], "empty": [made(b"q Q"), made(b"")],
        "unsupported_filter": [made(b"BT (a) Tj ET", flate=False).replace(b"/Contents 11", b"/Contents 4").replace(b"trailer", stream(4, b"x", b"/Filter/LZWDecode") + b"trailer")],
        "damaged": [b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 1 0 R>>", good[:-60].replace(b"x\x9c", b"zz")], "ok": [good, good + good, good[: good.index(b"trailer")]],
    }
    for status, files in cases.items():
        for f in files:
            assert pdf.text_of(f)[0] == status, (status, f)
    hostile = made(b"0" * 10)
    hostile = hostile.replace(b"/Contents 11", b"/Contents 4").replace(b"trailer", stream(4, zlib.compress(b" " * (pdf.MOST_BYTES + 1)), b"/Filter/FlateDecode") + b"trailer")
    assert pdf.text_of(hostile)[0] == "too_large"
    for name, data in (("a.pdf", good), ("b.PDF", b"no"), ("c.txt", good)):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/")[-1]: (r["status"], r["n_pages"], r["text"]) for r in pdf.files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("ok", 1, "a"), "b.PDF": ("not_pdf", 0, "")}


def test_heads_of_objects_are_found_from_their_ends():
    import re

    from tarnlake.sources import pdf

    forwards = re.compile(rb"(?<![0-9])(\d+)[\x00\t\n\f\r ]+\d+[\x00\t\n\f\r ]+obj\b")
    for data in (b"", b"obj", b"0 obj", b"1 0 obj", b"5 12 0 obj<<", b"12 0 objx 3 1\r\nobj endobj 4\x00 0\tobj", b"a7 0 obj 1 0 endobj", b"<0041 0 obj>" + b"0123456789 " * 50 + b"0 obj"):
        assert list(pdf._numbers(data)) == [(int(m[1]), m.end()) for m in forwards.finditer(data)]
    assert [pdf._unhex(x) for x in (b"<004>", b"00 4a", b"<0 0\x004>", b"<>", b"0041")] == [b"\x00\x40", b"\x00\x4a", b"\x00\x40", b"", b"\x00A"]


def test_all_pages_of_long_documents(spark, tmp_path):
    from tarnlake.plans import scans

    pages = [b"BT /F1 9 Tf (p%d) Tj ET" % i for i in range(60)]
    assert pdf.text_of(made(*pages), pages=None) == ("ok", 60, "\n".join(f"p{i}" for i in range(60)))
    texts = ["\n".join(f"l{i}" for i in range(4321)), "\n" * 2000 + "last", "\n".join(f"l{i}" for i in range(2000)), "\n" * 2500, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["status"], r["n_pages"], r["text"]) for r in scans.s15_pdf_text(spark, str(tmp_path)).collect()}
    assert got == {0: ("ok", 109, texts[0]), 1: ("ok", 51, "last"), 2: ("ok", 50, texts[2]), 3: ("empty", 63, ""), 4: ("empty", 1, "")}
