"""Searchable PDF without a library: each page a JPEG, its bytes unchanged, under invisible words."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FONT = "W"


def jpeg_size(data: bytes) -> tuple[int, int, int]:
    """Width, height and number of components, from the frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w, n = struct.unpack(">HHB", data[at + 5 : at + 10])
            return w, h, n
        at += 2 + size
    raise ValueError("not a JPEG")


def text_layer(words: DataFrame) -> DataFrame:
    """words.placed(...) -> (page_id, content): the drawing of invisible words (mode 3), each stretched to the next."""
    word = F.concat(F.format_string("%.2f Tf %.2f Tz 1 0 0 1 %.3f %.3f Tm <", "size", "stretch", "x", "base_y"), "hex", F.lit("> Tj"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "left", "word", word.alias("draw")))), lambda x: x["draw"])
    return words.groupBy("page_id").agg(F.concat(F.lit(f"BT 3 Tr /{FONT} "), F.array_join(ordered, f" /{FONT} "), F.lit(" ET")).alias("content"))


def _objects(pages: Iterable[tuple[bytes, int, str]], title: str) -> Iterator[tuple[int, bytes]]:
    """(number, body) of all objects but the page tree; pages are 10, 13, 16, ..."""
    unicode_map = b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U def /CMapType 2 def 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end end"
    yield 1, b"<</Type/Catalog/Pages 2 0 R>>"
    yield 3, b"<</Title<FEFF" + title.encode("utf-16-be").hex().upper().encode() + b">>>"
    yield 4, b"<</Type/Font/Subtype/Type0/BaseFont/GlyphLess/Encoding/Identity-H/DescendantFonts[5 0 R]/ToUnicode 6 0 R>>"
    yield 5, b"<</Type/Font/Subtype/CIDFontType2/BaseFont/GlyphLess/CIDSystemInfo<</Registry(Adobe)/Ordering(Identity)/Supplement 0>>/DW 500/FontDescriptor 7 0 R>>"
    yield 6, b"<</Length %d>>stream\n%s\nendstream" % (len(unicode_map), unicode_map)
    yield 7, b"<</Type/FontDescriptor/FontName/GlyphLess/Flags 4/FontBBox[0 0 500 1000]/Ascent 1000/Descent 0/ItalicAngle 0/StemV 80/CapHeight 1000>>"
    for n, (jpeg, dpi, content) in enumerate(pages):
        k = 10 + 3 * n
        w, h, parts = jpeg_size(jpeg)
        pw, ph = w * 72 / dpi, h * 72 / dpi
        body = zlib.compress(f"q {pw:.3f} 0 0 {ph:.3f} 0 0 cm /I Do Q {content}".encode())
        yield k, b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %.3f %.3f]/Contents %d 0 R/Resources<</XObject<</I %d 0 R>>/Font<</%s 4 0 R>>>>>>" % (pw, ph, k + 1, k + 2, FONT.encode())
        yield k + 1, b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(body), body)
        space = {1: b"DeviceGray", 3: b"DeviceRGB", 4: b"DeviceCMYK"}[parts]
        yield k + 2, b"<</Type/XObject/Subtype/Image/Width %d/Height %d/ColorSpace/%s/BitsPerComponent 8/Filter/DCTDecode/Length %d>>stream\n%s\nendstream" % (w, h, space, len(jpeg), jpeg)


def build(pages: Iterable[tuple[bytes, int, str]], title: str = "") -> bytes:
    """A PDF of (jpeg, dpi, drawing of words) in order; the number of pages is counted again before it is returned."""
    out, at, kids = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}, []
    for k, body in _objects(pages, title):
        at[k] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
        if k >= 10 and (k - 10) % 3 == 0:
            kids.append(k)
    at[2] = len(out)
    out += b"2 0 obj\n<</Type/Pages/Count %d/Kids[%s]>>\nendobj\n" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    start, top = len(out), max(at) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % top
    for k in range(1, top):
        out += b"%010d %05d %s \n" % (at.get(k, 0), 0 if k in at else 65535, b"n" if k in at else b"f")
    out += b"trailer\n<</Size %d/Root 1 0 R/Info 3 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (top, start)
    if page_count(bytes(out)) != len(kids):
        raise ValueError("the page count does not fit")
    return bytes(out)


def page_count(pdf: bytes) -> int:
    return len(re.findall(rb"^<</Type/Page/Parent", pdf, re.MULTILINE))


def documents(pages: DataFrame) -> DataFrame:
    """pages (document, pos, jpeg, dpi, content) -> (document, pages, pdf, error): one document a group, in order of pos.
    A page that is no JPEG makes the document an error row."""
    import pyarrow as pa

    def over(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        try:
            pdf, error = build(((r["jpeg"] or b"", r["dpi"], r["content"] or "") for r in rows), rows[0]["document"] or ""), None
        except (ValueError, KeyError, IndexError, struct.error) as e:
            pdf, error = None, str(e)
        return pa.table({"document": [rows[0]["document"]], "pages": pa.array([len(rows)], pa.int32()), "pdf": pa.array([pdf], pa.binary()), "error": pa.array([error], pa.string())})

    return pages.groupBy("document").applyInArrow(over, "document string, pages int, pdf binary, error string")
