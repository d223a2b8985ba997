"""Stream filters: decoders that keep what damaged data still gives, and encoders for generated files."""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np

WHITE = b"\x00\t\n\x0c\r "
MOST_BYTES = 1 << 28
#: Names and abbreviations of filters.
NAMES = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}
IMAGE_FILTERS = {"DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode"}


class FilterError(ValueError):
    """A filter that cannot be applied."""


def flate_decode(data: bytes) -> bytes:
    """zlib, else raw deflate; of truncated data what came before its end."""
    for bits in (15, -15):
        d, out = zlib.decompressobj(bits), b""
        try:
            out = d.decompress(data, MOST_BYTES)
            return out
        except zlib.error:
            d, parts = zlib.decompressobj(bits), []
            for i in range(0, len(data), 64):
                before = d.copy()
                try:
                    parts.append(d.decompress(data[i : i + 64]))
                except zlib.error:
                    parts += _byte_by_byte(before, data[i : i + 64])
                    break
            if out := b"".join(parts):
                return out
    raise FilterError("no deflate data")


def _byte_by_byte(d: Any, data: bytes) -> Iterator[bytes]:
    """What a decompressor still gives before the byte at which it fails."""
    for k in range(len(data)):
        try:
            yield d.decompress(data[k : k + 1])
        except zlib.error:
            return


def lzw_decode(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears, 257 ends."""
    out, table = [], [bytes([i]) for i in range(256)] + [b"", b""]
    width, last, acc, have, at, put = 9, b"", 0, 0, 0, out.append
    size, mask = 258, 511
    while True:
        if have < width:
            some = data[at : at + 64]
            at += 64
            acc, have = acc << 8 * len(some) | int.from_bytes(some, "big"), have + 8 * len(some)
            if have < width:
                break
        have -= width
        code = acc >> have & mask
        if have < 16:  # what is used up goes now and then
            acc &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, mask, last, size = 9, 511, b"", 258
            continue
        if code < size:
            entry = table[code]
        elif last and code == size:
            entry = last + last[:1]
        else:
            break
        put(entry)
        if last and size < 4096:
            table.append(last + entry[:1])
            size += 1
        last = entry
        n = size + early
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        mask = (1 << width) - 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes are gathered in one number and written in pieces of whole bytes."""
    first = {bytes([i]): i for i in range(256)}
    table = dict(first)
    acc, have, out, width, size, word = 256, 9, [], 9, 258, b""
    grows = {512: 10, 1024: 11, 2048: 12}
    for at in range(len(data)):
        more = word + data[at : at + 1]
        if more in table:
            word = more
            continue
        acc, have = acc << width | table[word], have + width
        table[more] = size
        size += 1
        width = grows.get(size, width)
        if size >= 4094:
            acc, have = acc << width | 256, have + width
            table = dict(first)
            size, width = 258, 9
        if have >= 512:
            rest = have & 7
            out.append((acc >> rest).to_bytes(have >> 3, "big"))
            acc, have = acc & ((1 << rest) - 1), rest
        word = data[at : at + 1]
    if word:
        acc, have = acc << width | table[word], have + width
        width = grows.get(size + 1, width)
    acc, have = acc << width | 257, have + width
    pad = -have % 8
    out.append((acc << pad).to_bytes((have + pad) >> 3, "big"))
    return b"".join(out)


def hex_decode(data: bytes) -> bytes:
    data = data.split(b">", 1)[0]
    try:
        return binascii.unhexlify(data)
    except ValueError:  # other characters, or an odd digit
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


_POWERS = np.array([85**4, 85**3, 85**2, 85, 1], np.int64)


def ascii85_decode(data: bytes) -> bytes:
    data = data.split(b"~", 1)[0]
    if b"z" not in data and len(data) >= 5:
        digits = np.frombuffer(data.translate(None, WHITE), np.uint8)
        if len(digits) >= 5 and digits.min() >= 33 and digits.max() <= 117:
            whole = len(digits) // 5 * 5
            values = digits[:whole].reshape(-1, 5).astype(np.int64) - 33
            head = (values @ _POWERS & 0xFFFFFFFF).astype(">u4").tobytes()
            return head + (ascii85_decode(digits[whole:].tobytes()) if whole < len(digits) else b"")
    out, group = bytearray(), []
    for c in data:
        if c in WHITE:
            continue
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            break
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def run_length_decode(data: bytes) -> bytes:
    out, i, size = [], 0, len(data)
    put = out.append
    while i < size and (n := data[i]) != 128:
        if n < 128:
            put(data[i + 1 : i + 2 + n])
            i += n + 2
        else:
            put(data[i + 1 : i + 2] * (257 - n))
            i += 2
    return b"".join(out)


#: A byte two to 128 times.
_RUN = re.compile(rb"(.)\1{1,127}", re.DOTALL)
_BYTES = [bytes([i]) for i in range(256)]


def run_length_encode(data: bytes) -> bytes:
    out, at = [], 0

    def plain(start: int, end: int) -> None:
        for i in range(start, end, 128):
            some = data[i : min(i + 128, end)]
            out.append(_BYTES[len(some) - 1] + some)

    for m in _RUN.finditer(data):
        start, end = m.span()
        if start > at:
            plain(at, start)
        out.append(_BYTES[257 - end + start] + data[start : start + 1])
        at = end
    plain(at, len(data))
    return b"".join(out) + b"\x80"


def unpredicted(data: bytes, predictor: int = 1, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """Undo a predictor: none up to 1, TIFF for 2 (8 bits only), PNG from 10; others are errors."""
    if predictor <= 1:
        return data
    if not (1 <= columns <= 1 << 24 and 1 <= colors <= 64 and bits in (1, 2, 4, 8, 16)):
        return data
    row, step = (bits * colors * columns + 7) // 8, max(1, (bits * colors + 7) // 8)
    if predictor == 2:
        if bits != 8:
            return data
        n = len(data) // row
        x = np.frombuffer(data, np.uint8, n * row).reshape(n, columns, colors)
        return np.cumsum(x, axis=1, dtype=np.uint64).astype(np.uint8).tobytes() + data[n * row :]
    if predictor < 10:
        raise FilterError(f"predictor {predictor}")
    n = len(data) // (row + 1)
    x = np.frombuffer(data, np.uint8, n * (row + 1)).reshape(n, row + 1)
    out = np.zeros((n + 1, row + step), np.int64)
    for i in range(n):
        tag, raw, up = x[i, 0], x[i, 1:].astype(np.int64), out[i, step:]
        if tag == 1:
            pad = np.zeros((-row) % step, np.int64)
            out[i + 1, step:] = np.cumsum(np.concatenate([raw, pad]).reshape(-1, step), axis=0).ravel()[:row] & 255
        elif tag == 2:
            out[i + 1, step:] = (raw + up) & 255
        elif tag in (3, 4):
            line, above = out[i + 1], out[i]
            for j in range(row):
                a, b, c = line[j], above[j + step], above[j]
                line[j + step] = (raw[j] + ((a + b) // 2 if tag == 3 else paeth(int(a), int(b), int(c)))) & 255
        else:
            out[i + 1, step:] = raw
    return out[1:, step:].astype(np.uint8).tobytes()


def paeth(left: int, up: int, corner: int) -> int:
    """Of left, up and corner the one nearest to left + up - corner; left before up before corner."""
    p = left + up - corner
    return min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]


def predicted(data: bytes, columns: int, colors: int = 1, tag: int = 2) -> bytes:
    """Rows of bytes with a PNG predictor's tag (0 to 4) before each."""
    row, out = columns * colors, bytearray()
    above = bytes(row + colors)
    for i in range(0, len(data), row):
        line = bytes(colors) + data[i : i + row].ljust(row, b"\0")
        out.append(tag)
        for j in range(row):
            a, b, c = line[j], above[j + colors], above[j]
            guess = (0, a, b, (a + b) // 2, paeth(a, b, c))[tag]
            out.append((line[j + colors] - guess) & 255)
        above = line
    return bytes(out)


def decode(name: str, data: bytes, params: dict | None = None) -> bytes:
    """Apply one filter with its parameters."""
    p = params or {}
    name = NAMES.get(name, name)
    if name in ("FlateDecode", "LZWDecode"):
        out = flate_decode(data) if name == "FlateDecode" else lzw_decode(data, p.get("EarlyChange", 1))
        return unpredicted(out, p.get("Predictor", 1), p.get("Columns", 1), p.get("Colors", 1), p.get("BitsPerComponent", 8))
    if name == "ASCIIHexDecode":
        return hex_decode(data)
    if name == "ASCII85Decode":
        return ascii85_decode(data)
    if name == "RunLengthDecode":
        return run_length_decode(data)
    if name == "Crypt" or name in IMAGE_FILTERS:
        return data
    raise FilterError(f"unknown filter {name}")


def decode_chain(filters: list[tuple[str, dict]], data: bytes) -> tuple[bytes, str | None]:
    """Filters from left to right up to the first image filter, whose name is returned with the data."""
    for name, params in filters:
        full = NAMES.get(name, name)
        if full in IMAGE_FILTERS:
            return data, full
        data = decode(full, data, params)
    return data, None


def encode(name: str, data: bytes) -> bytes:
    name = NAMES.get(name, name)
    if name == "FlateDecode":
        return zlib.compress(data)
    if name == "LZWDecode":
        return lzw_encode(data)
    if name == "ASCIIHexDecode":
        return data.hex().encode() + b">"
    if name == "ASCII85Decode":
        return base64.a85encode(data) + b"~>"
    if name == "RunLengthDecode":
        return run_length_encode(data)
    raise FilterError(f"unknown filter {name}")
