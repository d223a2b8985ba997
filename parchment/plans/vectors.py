"""Fixed vectors: the kernels that read files, run on inputs whose results follow from the format's definition.

Each query maps named inputs through a kernel; its oracle lists the results, worked out by hand.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import ciphers, codecs, fonts, outlines
from ..functions.cluster import ship
from ..operators import content, html, raster
from ..sources import pdf
from .registry import query


def _register(name: str, doc: str, kernel: Callable[[str], str], cases: list[tuple[str, str, str]]) -> None:
    """A query of (name, result) over (name, input, expected result)."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({text(c)}, {text(want)})" for c, _, want in cases)
    inputs = [(c, given) for c, given, _ in cases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kernel(x) for x in b.column(1).to_pylist()], pa.string())], ["name", "result"])

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return spark.createDataFrame(inputs, "name string, given string").mapInArrow(run, "name string, result string")

    f.__name__, f.__doc__ = name, doc
    query(f"select * from (values {rows}) as t(name, result)")(f)


def shown(x: Any) -> str:
    """An object in the notation of the format; strings in hexadecimal."""
    if isinstance(x, pdf.Name):
        return f"/{x}"
    if isinstance(x, pdf.Keyword):
        return str(x)
    if isinstance(x, bool) or x is None:
        return {True: "true", False: "false", None: "null"}[x]
    if isinstance(x, bytes):
        return f"({x.hex()})"
    if isinstance(x, pdf.Ref):
        return f"{x.num} {x.gen} R"
    if isinstance(x, list):
        return f"[{' '.join(map(shown, x))}]"
    if isinstance(x, dict):
        return f"<<{' '.join(f'/{k} {shown(v)}' for k, v in x.items())}>>"
    return html.num(x) if isinstance(x, float) else str(x)


def _tokens(text: str) -> str:
    lex, out = pdf.Lexer(text.encode("latin-1")), []
    while (t := lex.next()) is not pdf._END:
        out.append(shown(t))
    return " ".join(out)


_register("lexer_vectors", "Numbers, names, strings, words and comments.", _tokens, [
    ("reals", ".5 -.25 4. --3 1.2.3 +7", "0.5 -0.25 4 3 1.2 7"),
    ("no exponents", "1e5", "1 e5"),
    ("names", "/A#20B / /C#", "/A B / /C#"),
    ("literal strings", "(a(b)c) (\\101\\102) (x\\\ny) (\\n\\t\\q)", "(6128622963) (4142) (7879) (0a0971)"),
    ("hex strings", "<486> <4 1 4 2>", "(4860) (4142)"),
    ("comments", "1 % two\n3%", "1 3"),
    ("line ends", "(a\r\nb\rc)", "(610a620a63)"),
    ("words", "true obj endobj Tj*", "true obj endobj Tj*"),
    ("brackets", "<</K[1]>>", "<< /K [ 1 ] >>"),
])

_register("object_vectors", "Arrays, dictionaries, references and what is left of damaged ones.", lambda s: shown(pdf.Parser(s.encode("latin-1")).object()), [
    ("array", "[1 0 R 2 [3] /N (x)]", "[1 0 R 2 [3] /N (78)]"),
    ("dictionary", "<</A 1/B<</C null>>/D[true false]>>", "<</A 1 /B <</C null>> /D [true false]>>"),
    ("unclosed array", "[1 2", "[1 2]"),
    ("stray words", "[1 foo 2]", "[1 2]"),
    ("two numbers", "1 0 obj", "1"),
    ("last of a key", "<</A 1/A 2>>", "<</A 2>>"),
])


def _filter(text: str) -> str:
    name, params, data = text.split("|")
    p = {k: int(v) for k, v in (x.split("=") for x in params.split(",") if x)}
    return codecs.decode(name, bytes.fromhex(data), p).hex()


_register("filter_vectors", "Stream filters and predictors.", _filter, [
    ("ASCII85", "A85||396a716f5e7e3e", "4d616e20"),
    ("ASCII85 zeros", "A85||7a7e3e", "00000000"),
    ("ASCIIHex", "AHx||34 31 34 3e".replace(" ", ""), "4140"),
    ("run lengths", "RL||014142fe4380", "4142434343"),
    ("LZW", "LZW||800b6050220c0c8501", "2d2d2d2d2d412d2d2d42"),
    ("Flate", "Fl||78da4b4c4a0600024d0127", "616263"),
    ("Flate cut off", "Fl||78da4b4c4a06", "616263"),
    ("Flate with a wrong checksum", "Fl||78da4b4c4a0600024d0128", "616263"),
    ("TIFF predictor", "Fl|Predictor=2,Columns=4|7801010400fbff0a0505ec01310101", "0a0f1400"),
    ("PNG sub", "Fl|Predictor=11,Columns=3|7801010400fbff01010101000e0005", "010203"),
    ("PNG up", "Fl|Predictor=15,Columns=2|7801010600f9ff0001020203030022000c", "01020405"),
])


def _cipher(text: str) -> str:
    kind, key, data = text.split("|")
    k, d = bytes.fromhex(key), bytes.fromhex(data)
    return (ciphers.rc4(k, d) if kind == "rc4" else ciphers.cbc_decrypt(k, d[:16], d[16:])).hex()


_register("cipher_vectors", "RC4 and AES in chained blocks, as published.", _cipher, [
    ("RC4", "rc4|4b6579|506c61696e74657874", "bbf316e8d940af0ad3"),
    ("AES-128", "aes|2b7e151628aed2a6abf7158809cf4f3c|000102030405060708090a0b0c0d0e0f7649abac8119b246cee98e9b12e9197d", "6bc1bee22e409f96e93d7e117393172a"),
    ("AES-256", "aes|603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4|000102030405060708090a0b0c0d0e0ff58c4c04d6e5f1ba779eabfb5f7bfbd6", "6bc1bee22e409f96e93d7e117393172a"),
])


def square_font(broken_map: bool = False) -> bytes:
    """A TrueType file: glyph 1 is a square of half an em, 2 a round one of off-curve points, 3 glyph 1 at half its size and moved; A, B and C stand for them."""
    points = [(0, 0), (500, 0), (500, 500), (0, 500)]

    def glyph(on: int) -> bytes:
        steps = [(x - a, y - b) for (x, y), (a, b) in zip(points, [(0, 0), *points], strict=False)]
        xs, ys = b"".join(struct.pack(">h", x) for x, _ in steps), b"".join(struct.pack(">h", y) for _, y in steps)
        return struct.pack(">hhhhhHH", 1, 0, 0, 500, 500, 3, 0) + bytes([on] * 4) + xs + ys

    part = struct.pack(">hhhhhHHhhh", -1, 0, 0, 0, 0, 1 | 2 | 8, 1, 100, 200, 8192)
    shapes = [b"", glyph(1), glyph(0), part]
    ends = [0]
    for s in shapes:
        ends.append(ends[-1] + len(s))
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 4, 1, 0) + struct.pack(">HHHHHHHHH", 67, 0xFFFF, 0, 65, 0xFFFF, 65536 - 64, 1, 0, 0)
    head = struct.pack(">IIIIHHQQhhhhHHhhh", 0x10000, 0, 0, 0x5F0F3CF5, 0, 1000, 0, 0, 0, 0, 500, 500, 0, 8, 2, 1, 0)
    hhea = struct.pack(">IhhhHhhhhhhhhhhhH", 0x10000, 800, -200, *[0] * 13, 2)
    tables = {"cmap": b"\0\0\0\1\0" if broken_map else cmap, "glyf": b"".join(shapes), "head": head, "hhea": hhea, "hmtx": struct.pack(">HhHh", 300, 0, 600, 0) + b"\0" * 4, "loca": struct.pack(f">{len(ends)}I", *ends), "maxp": struct.pack(">IH", 0x10000, 4), "post": outlines.empty_post()}
    return outlines.font_file(b"\0\1\0\0", tables)


def square_cff() -> bytes:
    """A bare CFF program: glyph 1, named A, is a square of half an em drawn through a subroutine; glyph 2, named B, has a curve."""
    index = lambda items: struct.pack(">H", len(items)) + (b"\4" + struct.pack(f">{len(items) + 1}I", *(1 + sum(map(len, items[:i])) for i in range(len(items) + 1))) + b"".join(items) if items else b"")
    num = lambda *v: b"".join(b"\x1c" + struct.pack(">h", x) for x in v)
    long = lambda x: b"\x1d" + struct.pack(">i", x)
    side = num(500) + b"\6" + num(500) + b"\7" + num(-500) + b"\6\x0b"
    glyphs = [b"\x0e", num(0, 0) + b"\x15" + num(-107) + b"\x0a\x0e", num(0, 0) + b"\x15" + num(0, 100, 100, 100, 100, 0) + b"\x08\x0e"]
    charset, private = b"\0" + struct.pack(">HH", 34, 35), num(6) + b"\x13"
    begin = b"\1\0\4\1" + index([b"Square"])

    def top(*at: int) -> bytes:
        return long(at[0]) + b"\x0f" + long(at[1]) + b"\x11" + long(len(private)) + long(at[2]) + b"\x12"

    size = len(begin) + len(index([top(0, 0, 0)])) + 2 * len(index([]))
    at = (size, size + len(charset), size + len(charset) + len(index(glyphs)))
    # local subroutines follow the private dictionary
    private = long(5 + 1) + b"\x13"
    return begin + index([top(*at)]) + index([]) + index([]) + charset + index(glyphs) + private + index([side])


def _outline(text: str) -> str:
    kind, what = text.split("|")
    face = {"ttf": lambda: outlines.Sfnt(square_font()), "repaired": lambda: outlines.Sfnt(outlines.repaired(square_font(True))), "cff": lambda: outlines.Cff(square_cff()), "otf": lambda: outlines.Sfnt(outlines.wrapped(square_cff()))}[kind]()
    if what.startswith("advance"):
        return html.num(face.advance(int(what[8:])))
    if what.startswith("char"):
        return str(face.gid_of(ord(what[5:])))
    if what.startswith("code"):
        return str(face.code_gid(int(what[5:])))
    if what.startswith("text"):
        return face.text_of(int(what[5:])) or "null"
    path = face.outline(int(what))
    return "null" if path is None else html.path_data(path)


_SQUARE = "M 0 0 L 0.5 0 L 0.5 0.5 L 0 0.5 L 0 0 Z"
_register("outline_vectors", "Glyph outlines, character maps and advances of TrueType, OpenType and bare CFF programs.", _outline, [
    ("TrueType square", "ttf|1", _SQUARE),
    # the start is in the middle of the last and the first point; each corner is the control point of a curve
    ("off-curve points", "ttf|2", "M 0 0.25 C 0 0.0833 0.0833 0 0.25 0 C 0.4167 0 0.5 0.0833 0.5 0.25 C 0.5 0.4167 0.4167 0.5 0.25 0.5 C 0.0833 0.5 0 0.4167 0 0.25 Z"),
    ("composite", "ttf|3", "M 0.1 0.2 L 0.35 0.2 L 0.35 0.45 L 0.1 0.45 L 0.1 0.2 Z"),
    ("empty glyph", "ttf|0", ""),
    ("no such glyph", "ttf|4", "null"),
    ("advance", "ttf|advance 1", "0.6"),
    ("advance beyond the table", "ttf|advance 3", "0.6"),
    ("character", "ttf|char B", "2"),
    ("missing character", "ttf|char Z", "0"),
    ("character of a glyph", "ttf|text 3", "C"),
    ("repaired map", "repaired|char A", "0"),
    ("repaired outline", "repaired|1", _SQUARE),
    ("CFF square", "cff|1", "M 0 0 L 0.5 0 L 0.5 0.5 L 0 0.5 Z"),
    ("CFF curve", "cff|2", "M 0 0 C 0 0.1 0.1 0.2 0.2 0.2 Z"),
    ("CFF character", "cff|char A", "1"),
    ("CFF code", "cff|code 66", "2"),
    ("CFF advance", "cff|advance 2", "0.5"),
    ("wrapped outline", "otf|1", "M 0 0 L 0.5 0 L 0.5 0.5 L 0 0.5 Z"),
    ("wrapped map", "otf|char A", "0"),
])


def _font(text: str) -> str:
    kind, what = text.split("|", 1)
    if kind == "name":
        return fonts.name_unicode(what) or "null"
    if kind == "table":
        name, code = what.split()
        return fonts.encoding_table(name)[int(code, 16)] or "null"
    if kind == "cmap":
        return " ".join(f"{k}={v}" for k, v in sorted(fonts.parse_cmap(what.encode()).items()))
    if kind == "sum":
        return str(outlines.checksum(bytes.fromhex(what)))
    if kind == "face":
        f = outlines.substitute(*(lambda n, k: (n, int(k)))(*what.split()))
        return f"{f.mono} {f.weight > 0.1} {f.slant > 0}"
    w = pdf.Parser(what.encode()).object()
    return " ".join(f"{k}={html.num(v)}" for k, v in sorted(fonts.cid_widths(w).items()))


_register("font_vectors", "Glyph names, encodings, Unicode maps, widths, checksums and substitutes.", _font, [
    ("accented name", "name|Eacute", "É"), ("hexadecimal name", "name|uni0041", "A"), ("long hexadecimal name", "name|u1F600", "😀"), ("letter", "name|q", "q"), ("unknown name", "name|nothing", "null"),
    ("Windows", "table|WinAnsiEncoding 80", "€"), ("Macintosh", "table|MacRomanEncoding 8e", "é"), ("standard quote", "table|StandardEncoding 27", "’"), ("standard ligature", "table|StandardEncoding ae", "ﬁ"), ("other", "table|Other e9", "é"),
    ("range", "cmap|1 beginbfrange <21> <23> <0041> endbfrange", "33=A 34=B 35=C"),
    ("list", "cmap|1 beginbfrange <01> <02> [<0061> <00620063>] endbfrange", "1=a 2=bc"),
    ("single", "cmap|2 beginbfchar <05> <D83DDE00> <06> <0041> endbfchar", "5=😀 6=A"),
    ("too wide a range", "cmap|1 beginbfrange <000000> <010000> <0041> endbfrange 1 beginbfchar <07> <0042> endbfchar", "7=B"),
    ("widths", "widths|[1 [600 400] 3 5 550 4 [10]]", "1=600 2=400 3=550 4=10 5=550"),
    ("checksum", "sum|000000010000000203", "50331651"),
    ("fixed pitch by name", "face|Courier-BoldOblique 0", "True True True"), ("italic by flag", "face|Foo 64", "False False True"), ("plain", "face|Times 34", "False False False"),
])

_DOCUMENT = b"""1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj
2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj
3 0 obj <</Type/Page/Parent 2 0 R/MediaBox[0 0 20 20]/Contents 9 0 R/Resources<</Font<</F1 4 0 R/F2 11 0 R>>/ExtGState<</G1<</LW 4/CA .5/ca .25/LC 2/D[[2]1]>>>>
/ColorSpace<</Sep[/Separation/Spot/DeviceRGB<</FunctionType 2/Domain[0 1]/C0[1 1 1]/C1[1 0 0]/N 1>>]/Ix[/Indexed/DeviceRGB 1<00FF000000FF>]>>/XObject<</Fm 6 0 R/Im 7 0 R>>>>>> endobj
4 0 obj <</Type/Font/Subtype/Type1/BaseFont/Helvetica/FontDescriptor 5 0 R>> endobj
5 0 obj <</Type/FontDescriptor/FontName/Helvetica/Flags 32/MissingWidth 500>> endobj
6 0 obj <</Type/XObject/Subtype/Form/BBox[0 0 5 5]/Matrix[1 0 0 1 10 0]/Length 14>> stream
0 0 1 1 re f Q
endstream endobj
7 0 obj <</Type/XObject/Subtype/Image/Width 2/Height 1/BitsPerComponent 8/ColorSpace/DeviceGray/Filter/ASCIIHexDecode/Length 5>> stream
00FF>
endstream endobj
11 0 obj <</Type/Font/Subtype/TrueType/BaseFont/ABCDEF+Square/FirstChar 65/Widths[700]/Encoding/WinAnsiEncoding/FontDescriptor 12 0 R>> endobj
12 0 obj <</Type/FontDescriptor/Flags 32/FontFile2 13 0 R>> endobj
13 0 obj <</Filter/ASCIIHexDecode/Length1 %d>> stream
%s>
endstream endobj
9 0 obj <<>> stream
%s
endstream endobj
"""


def _document(ops: str) -> pdf.Document:
    font = square_font()
    return pdf.Document(_DOCUMENT % (len(font), font.hex().encode(), ops.encode("latin-1")))


def _calls(ops: str) -> str:
    doc = _document(ops)
    it = content.Interpreter(doc, doc.page(0)).run(doc.contents(0))
    out = []
    for c in it.calls:
        s, words = c.state, [c.kind]
        if c.path is not None:
            words.append(html.path_data(c.path))
        if c.kind in ("image", "mask"):
            words.append(f"{c.image.shape[0]}x{c.image.shape[1]}")
        if c.kind == "text":
            words += [f"{(g['unicode'] or '?').replace(' ', '_')} {html.num(g['x'])} {html.num(g['y'])}" for g in c.glyphs]
        if c.kind in ("fill", "stroke", "text"):
            words.append(html.css(c.color))
        if c.kind == "stroke":
            words.append(f"w{html.num(s.width)}")
            words += [f"{k}{html.num(v)}" for k, v, usual in (("c", s.cap, 0), ("j", s.join, 0), ("m", s.miter, 10)) if v != usual]
            words += [f"d{','.join(map(html.num, s.dash[0]))}:{html.num(s.dash[1])}"] if s.dash[0] else []
        words += ["eo"] * c.even_odd + ["stroked"] * c.stroked
        words += [f"a{html.num(c.alpha)}"] if c.alpha < 1 else []
        if c.ctm != content.IDENTITY and c.kind != "unclip":
            words.append(f"@{html.matrix(c.ctm)}")
        out.append(" ".join(words))
    return "; ".join(out)


_BOX, _LINE, _FM = "M 0 0 L 1 0 L 1 1 L 0 1 Z", "M 0 0 L 1 0", "@matrix(1 0 0 1 10 0)"
_T = "BT /F1 10 Tf "
_register("operator_vectors", "Draw calls of content instructions, each in its smallest use.", _calls, [
    ("m l S", "1 2 m 3 4 l S", "stroke M 1 2 L 3 4 #000000 w1"),
    ("c", "0 0 m 1 2 3 4 5 6 c S", "stroke M 0 0 C 1 2 3 4 5 6 #000000 w1"),
    ("v", "1 1 m 3 4 5 6 v S", "stroke M 1 1 C 1 1 3 4 5 6 #000000 w1"),
    ("y", "1 1 m 3 4 5 6 y S", "stroke M 1 1 C 3 4 5 6 5 6 #000000 w1"),
    ("h", "0 0 m 1 0 l 1 1 l h S", "stroke M 0 0 L 1 0 L 1 1 Z #000000 w1"),
    ("s", "0 0 m 1 0 l 1 1 l s", "stroke M 0 0 L 1 0 L 1 1 Z #000000 w1"),
    ("re f", "1 2 3 4 re f", "fill M 1 2 L 4 2 L 4 6 L 1 6 Z #000000"),
    ("F", "0 0 1 1 re F", f"fill {_BOX} #000000"),
    ("f*", "0 0 1 1 re f*", f"fill {_BOX} #000000 eo"),
    ("B", "0 0 1 1 re B", f"fill {_BOX} #000000; stroke {_BOX} #000000 w1"),
    ("B*", "0 0 1 1 re B*", f"fill {_BOX} #000000 eo; stroke {_BOX} #000000 w1"),
    ("b", "0 0 m 1 0 l b", "fill M 0 0 L 1 0 Z #000000; stroke M 0 0 L 1 0 Z #000000 w1"),
    ("b*", "0 0 m 1 0 l b*", "fill M 0 0 L 1 0 Z #000000 eo; stroke M 0 0 L 1 0 Z #000000 w1"),
    ("n", "0 0 1 1 re n", ""),
    ("W Q", "q 0 0 1 1 re W n Q", f"clip {_BOX}; unclip"),
    ("W*", "0 0 1 1 re W* n", f"clip {_BOX} eo"),
    ("cm", "2 0 0 3 1 1 cm 0 0 1 1 re f", f"fill {_BOX} #000000 @matrix(2 0 0 3 1 1)"),
    ("cm twice", "2 0 0 2 0 0 cm 1 0 0 1 5 0 cm 0 0 1 1 re f", f"fill {_BOX} #000000 @matrix(2 0 0 2 10 0)"),
    ("q Q", "q 1 0 0 rg Q 0 0 1 1 re f", f"fill {_BOX} #000000"),
    ("Q alone", "Q 0 0 1 1 re f", f"fill {_BOX} #000000"),
    ("w J j M d", "2 w 1 J 2 j 5 M [3 1] 2 d 0 0 m 1 0 l S", f"stroke {_LINE} #000000 w2 c1 j2 m5 d3,1:2"),
    ("ri i", "/Perceptual ri 0.5 i 0 0 1 1 re f", f"fill {_BOX} #000000"),
    ("gs", "/G1 gs 0 0 m 1 0 l S 0 0 1 1 re f", f"stroke {_LINE} #000000 w4 c2 d2:1 a0.5; fill {_BOX} #000000 a0.25"),
    ("g G", "0.5 g 1 G 0 0 1 1 re B", f"fill {_BOX} #808080; stroke {_BOX} #ffffff w1"),
    ("rg RG", "1 0 0 rg 0 1 0 RG 0 0 1 1 re B", f"fill {_BOX} #ff0000; stroke {_BOX} #00ff00 w1"),
    ("k K", "0 1 0 0 k 1 0 0 0 K 0 0 1 1 re B", f"fill {_BOX} #ff00ff; stroke {_BOX} #00ffff w1"),
    ("cs scn", "/Sep cs 1 scn 0 0 1 1 re f /Ix cs 1 sc 0 0 1 1 re f", f"fill {_BOX} #ff0000; fill {_BOX} #0000ff"),
    ("cs alone", "1 0 0 rg /DeviceRGB cs 0 0 1 1 re f", f"fill {_BOX} #000000"),
    ("CS SC SCN", "/DeviceCMYK CS 0 0 1 0 SC 0 0 m 1 0 l S /Sep CS 1 SCN 0 0 m 1 0 l S", f"stroke {_LINE} #ffff00 w1; stroke {_LINE} #ff0000 w1"),
    ("Do of a form", "/Fm Do 0 0 1 1 re f", f"clip M 0 0 L 5 0 L 5 5 L 0 5 Z {_FM}; fill {_BOX} #000000 {_FM}; unclip; fill {_BOX} #000000"),
    ("Do of an image", "10 0 0 10 0 0 cm /Im Do", "image 1x2 @matrix(10 0 0 10 0 0)"),
    ("Do of nothing", "/No Do 0 0 1 1 re f", f"fill {_BOX} #000000"),
    ("BI ID EI", "BI /W 2 /H 1 /BPC 8 /CS /G ID \x00\xff EI 0 0 1 1 re f", f"image 1x2; fill {_BOX} #000000"),
    ("BI of a stencil", "BI /W 8 /H 1 /IM true ID \xaa EI", "mask 1x8"),
    ("BT Tf Td Tj ET", f"{_T}5 6 Td (AB) Tj ET", "text A 5 6 B 10 6 #000000"),
    ("TD T*", f"{_T}0 -7 TD (A) Tj T* (B) Tj ET", "text A 0 -7 #000000; text B 0 -14 #000000"),
    ("TL", f"{_T}12 TL (A) Tj T* (B) Tj ET", "text A 0 0 #000000; text B 0 -12 #000000"),
    ("Tm", f"{_T}1 0 0 1 3 4 Tm (A) Tj ET", "text A 3 4 #000000"),
    ("Tc", f"{_T}1 Tc (AB) Tj ET", "text A 0 0 B 6 0 #000000"),
    ("Tw", f"{_T}2 Tw (A B) Tj ET", "text A 0 0 _ 5 0 B 12 0 #000000"),
    ("Tz", f"{_T}50 Tz (AB) Tj ET", "text A 0 0 B 2.5 0 #000000"),
    ("Ts", f"{_T}3 Ts (A) Tj ET", "text A 0 3 #000000"),
    ("Tr", f"{_T}1 0 0 RG 1 Tr (A) Tj 2 Tr (B) Tj 3 Tr (C) Tj 7 Tr (D) Tj ET", "text A 0 0 #ff0000 stroked; text B 5 0 #000000; text B 5 0 #ff0000 stroked; text D 15 0 #000000"),
    ("TJ", f"{_T}[(A) -100 (B)] TJ ET", "text A 0 0 B 6 0 #000000"),
    ("single quote", f"{_T}5 TL (A) Tj (B) ' ET", "text A 0 0 #000000; text B 0 -5 #000000"),
    ("double quote", f'{_T}5 TL 1 2 (A B) " ET', "text A 0 -5 _ 7 -5 B 15 -5 #000000"),
    ("widths of a program", "BT /F2 10 Tf (AB) Tj (C) Tj ET", "text A 0 0 B 7 0 #000000; text C 13 0 #000000"),
    ("BMC BDC EMC MP DP BX EX", "/T BMC /T <</A 1>> BDC 0 0 1 1 re f EMC EMC /T MP /T /P DP BX EX", f"fill {_BOX} #000000"),
    ("d0 d1 sh and unknown", "1 0 d0 1 0 0 0 1 1 d1 /S sh 1 2 foo 0 0 1 1 re f", f"fill {_BOX} #000000"),
    ("too few operands", "1 m S 0 0 1 1 re f", f"stroke M 1 0 #000000 w1; fill {_BOX} #000000"),
])


def _ink(ops: str) -> str:
    doc = _document(ops)
    it, w, h = content.run_page(doc, 0)
    p = raster.render(it.calls, w, h)
    black, gray = int((p[..., 0] == 0).sum()), int(((p[..., 0] > 0) & (p[..., 0] < 255)).sum())
    return f"{w}x{h} {black} {gray}"


_register("ink_vectors", "Pixels that are black and gray on a page of 20 by 20.", _ink, [
    ("box", "2 2 5 5 re f", "20x20 25 0"),
    ("half pixels", "2.5 3 5 5 re f", "20x20 20 10"),
    ("ring", "2 2 16 16 re 6 6 8 8 re f*", "20x20 192 0"),
    ("nonzero", "2 2 16 16 re 6 6 8 8 re f", "20x20 256 0"),
    ("straight clip takes whole pixels", "2.2 2.2 5 5 re W n 0 0 20 20 re f", "20x20 36 0"),
    ("clips meet", "2 2 10 10 re W n 6 6 10 10 re W n 0 0 20 20 re f", "20x20 36 0"),
    ("clip ends", "q 2 2 4 4 re W n 0 0 20 20 re f Q 10 10 2 2 re f", "20x20 20 0"),
    ("outside", "30 30 5 5 re f", "20x20 0 0"),
    ("line", "2 w 2 10 m 18 10 l S", "20x20 32 0"),
    ("square cap", "2 w 2 J 2 10 m 18 10 l S", "20x20 36 0"),
    ("dashes", "2 w [4 4] 0 d 2 10 m 18 10 l S", "20x20 16 0"),
    ("negative dash is none", "2 w [-4 4] 0 d 2 10 m 18 10 l S", "20x20 32 0"),
    ("glyph", "BT /F2 10 Tf 4 4 Td (A) Tj ET", "20x20 25 0"),
    ("composite glyph", "BT /F2 20 Tf 4 2 Td (C) Tj ET", "20x20 25 0"),
    ("invisible text", "BT /F2 10 Tf 3 Tr (A) Tj ET", "20x20 0 0"),
    ("stencil", "q 16 0 0 2 2 2 cm BI /W 8 /H 1 /IM true ID \x0f EI Q", "20x20 16 0"),
    ("image", "q 4 0 0 4 2 2 cm /Im Do Q", "20x20 8 0"),
    ("alpha", "/G1 gs 2 2 5 5 re f", "20x20 0 25"),
])
