"""Media columns: types by signature, with validation, correction and carving.

One Aho-Corasick automaton finds every magic number of a payload in one pass; at each, the format's
validator walks the structure (chunks with their checksums, blocks, boxes, pages, members, headers and lengths) and
gives the object's end, or refuses.  A walk is a chain of states, and where a state leads to is remembered for
the payload, so walks that meet are not walked twice; marks that lie far behind are looked up in lists made once.  An object at the payload's start gives its type, and corrects a
declared one that differs; objects that begin elsewhere and don't lie within a carved one are carved,
with offset and length.  A payload without an object at its start keeps its declared type if
that isn't one of the known formats, else it becomes application/octet-stream.

Edge cases: a null or empty payload has no type and no object; a cut-off or damaged object is
refused; a null declared type is simply filled in; null ids and repeated rows are rows as any
other; an empty table gives no rows; payloads of any length are taken whole; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

RESULT = "page_id long, declared_type string, media_type string, corrected boolean, part int, part_type string, part_offset long, part_length long"


class Payload:
    """Bytes, the ends of walks through them, and the places of marks."""

    def __init__(self, data: bytes):
        self.data = data
        self.ends: dict[tuple, int] = {}
        self.marks: dict[bytes, list[int]] = {}

    def walk(self, step: Callable[[Payload, tuple], tuple | int], state: tuple) -> int:
        """The end that a chain of states leads to, or -1; step gives a further state or the end."""
        path: list[tuple] = []
        while True:
            key = (step, state)
            if key in self.ends:
                end = self.ends[key]
                break
            path.append(key)
            self.ends[key] = -1  # a chain that comes back to itself has no end
            after = step(self, state)
            if isinstance(after, int):
                end = after
                break
            state = after
        for key in path:
            self.ends[key] = end
        return end

    def places(self, mark: bytes) -> list[int]:
        """Where the mark begins, in order."""
        if mark not in self.marks:
            out, at = [], self.data.find(mark)
            while at >= 0:
                out.append(at)
                at = self.data.find(mark, at + 1)
            self.marks[mark] = out
        return self.marks[mark]

    def big(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at : at + n], "big")

    def little(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at : at + n], "little")


def _png_chunk(p: Payload, state: tuple) -> tuple | int:
    (at,) = state
    end = at + 12 + p.big(at, 4)
    if at + 12 > len(p.data) or end > len(p.data) or zlib.crc32(memoryview(p.data)[at + 4 : end - 4]) != p.big(end - 4, 4):
        return -1
    return end if p.data[at + 4 : at + 8] == b"IEND" else (end,)


def png(p: Payload, i: int) -> int:
    return p.walk(_png_chunk, (i + 8,)) if p.data[i + 8 : i + 16] == b"\0\0\0\x0dIHDR" else -1


def _gif_part(p: Payload, state: tuple) -> tuple | int:
    """A block, or a sub-block of one."""
    at, within = state
    if at >= len(p.data):
        return -1
    first = p.data[at]
    if within:
        return (at + 1 + first, first > 0)
    if first == 0x3B:
        return at + 1
    if first == 0x21:
        return (at + 2, True)
    if first == 0x2C and at + 10 < len(p.data):
        f = p.data[at + 9]
        return (at + 11 + (3 << ((f & 7) + 1) if f & 0x80 else 0), True)
    return -1


def gif(p: Payload, i: int) -> int:
    if i + 13 > len(p.data):
        return -1
    flags = p.data[i + 10]
    return p.walk(_gif_part, (i + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), False))


def _jpeg_part(p: Payload, state: tuple) -> tuple | int:
    """A marker segment, with the entropy-coded data behind a scan's header; a frame comes before the first scan."""
    at, framed, scanned = state
    b = p.data
    if b[at : at + 1] != b"\xff" or at + 2 > len(b):
        return -1
    kind = b[at + 1]
    if kind == 0xFF:
        return (at + 1, framed, scanned)
    if kind == 0xD9:
        return at + 2 if scanned else -1
    n = p.big(at + 2, 2)
    if kind < 0xC0 or 0xD0 <= kind <= 0xD8 or n < 2 or at + 2 + n > len(b):
        return -1
    if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
        if n < 11 or n != 8 + 3 * b[at + 9]:
            return -1
        framed = True
    end = at + 2 + n
    if kind != 0xDA:
        return (end, framed, scanned)
    if not framed:
        return -1
    # The data ends at a marker that isn't stuffing or a restart.
    m = _ENTROPY_END.search(b, end)
    return (m.start(), True, True) if m else -1


_ENTROPY_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)


def jpeg(p: Payload, i: int) -> int:
    return p.walk(_jpeg_part, (i + 2, False, False))


def _pdf_ends(p: Payload) -> dict[int, list[tuple[int, int]]]:
    """Of each offset that stands behind startxref: where it stands and where its %%EOF ends, in order."""
    if (_pdf_ends, ()) not in p.ends:
        out: dict[int, list[tuple[int, int]]] = {}
        marks = p.places(b"startxref")
        for eof in p.places(b"%%EOF"):
            n = bisect_left(marks, eof)
            number = p.data[marks[n - 1] + 9 : eof].strip() if n and eof - marks[n - 1] < 64 else b""
            if number.isdigit():
                out.setdefault(int(number), []).append((marks[n - 1], eof + 5))
        p.ends[_pdf_ends, ()] = out
    return p.ends[_pdf_ends, ()]


_XREF = re.compile(rb"xref|\d+\s+\d+\s+obj\b(?=.{0,400}?/XRef)", re.S)


def pdf(p: Payload, i: int) -> int:
    """Up to the first %%EOF whose startxref points to a cross-reference table or stream."""
    if not p.data[i + 5 : i + 6].isdigit() or p.data[i + 6 : i + 7] != b".":
        return -1
    best = -1
    for offset, ends in _pdf_ends(p).items():
        n = bisect_left(ends, (i + offset + 1,))
        if n < len(ends) and (best < 0 or ends[n][1] < best) and _XREF.match(p.data, i + offset):
            best = ends[n][1]
    return best


def _zip_member(p: Payload, i: int, at: int) -> tuple[int, int, int]:
    """(start, end, next entry) of the member that the central directory's entry at `at` names; raises ValueError if it's damaged."""
    b = p.data
    if b[at : at + 4] != b"PK\x01\x02" or at + 46 > len(b):
        raise ValueError
    flags, method, _, _, crc, packed, size, name, extra, note = struct.unpack("<HHHHIIIHHH", b[at + 8 : at + 34])
    start = i + p.little(at + 42, 4)
    if b[start : start + 4] != b"PK\x03\x04" or start + 30 > at:
        raise ValueError
    begin = start + 30 + p.little(start + 26, 2) + p.little(start + 28, 2)
    data = memoryview(b)[begin : begin + packed]
    if begin + packed > at or p.little(start + 8, 2) != method or b[start + 30 : start + 30 + name] != b[at + 46 : at + 46 + name]:
        raise ValueError
    if not flags & 1 and method in (0, 8):  # neither encrypted nor of another method
        try:
            plain = data if method == 0 else zlib.decompress(data, -15)
        except zlib.error:
            raise ValueError from None
        if len(plain) != size or zlib.crc32(plain) != crc:
            raise ValueError
    return start, begin + packed, at + 46 + name + extra + note


def zip_(p: Payload, i: int) -> int:
    """Up to the first end record whose directory begins with the object at i and whose members are whole."""
    b, ends = p.data, p.places(b"PK\x05\x06")
    for end in ends[bisect_left(ends, i) :]:
        if end + 22 > len(b):
            break
        count, size, start, note = struct.unpack("<HIIH", b[end + 10 : end + 22])
        # One start fits an end record, so its directory is walked once.
        if start + size != end - i or end + 22 + note > len(b) or not count:
            continue
        at, first = i + start, i + start
        try:
            for _ in range(count):
                begin, _, at = _zip_member(p, i, at)
                first = min(first, begin)
        except ValueError:
            continue
        if at == end and first == i:
            return end + 22 + note
    return -1


def _riff_chunk(p: Payload, state: tuple) -> tuple | int:
    at, end = state
    if at + 8 > end:
        return end if at in (end, end + 1) else -1
    n = p.little(at + 4, 4)
    return (at + 8 + n + (n & 1), end)


def riff(p: Payload, i: int) -> int:
    end = i + 8 + p.little(i + 4, 4)
    return p.walk(_riff_chunk, (i + 12, end)) if i + 12 <= end <= len(p.data) else -1


def gzip(p: Payload, i: int) -> int:
    """All members that follow one another."""
    at = -1
    while p.data[i : i + 3] == b"\x1f\x8b\x08" and i + 18 <= len(p.data) and not p.data[i + 3] & 0xE0:
        d = zlib.decompressobj(31)
        to = i
        try:
            while to < len(p.data) and not d.eof:
                d.decompress(p.data[to : to + 65536])
                to += 65536
        except zlib.error:
            break
        if not d.eof:
            break
        at = i = min(to, len(p.data)) - len(d.unused_data)
    return at


def bmp(p: Payload, i: int) -> int:
    b = p.data
    if i + 54 > len(b):
        return -1
    size, reserved, data, header = struct.unpack("<IIII", b[i + 2 : i + 18])
    width, height, planes, depth = struct.unpack("<iiHH", b[i + 18 : i + 30])
    if reserved or header not in (40, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return -1
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    packed = p.little(i + 30, 4) in (1, 2)  # run lengths
    return i + size if data >= 14 + header and (packed or data + rows <= size) and data <= size and i + size <= len(b) else -1


_OGG = [0] * 256
for _i in range(256):
    _r = _i << 24
    for _ in range(8):
        _r = (_r << 1 ^ 0x04C11DB7) if _r & 0x80000000 else _r << 1
    _OGG[_i] = _r & 0xFFFFFFFF
_OGG = tuple(_OGG)


def _ogg_crc(data: bytes) -> int:
    r = 0
    for c in data:
        r = (r << 8 & 0xFFFFFFFF) ^ _OGG[r >> 24 ^ c]
    return r


def _ogg_page(p: Payload, state: tuple) -> tuple | int:
    """A page with its checksum, and the streams that are open behind it: pages of several streams may alternate."""
    at, open_ = state
    b = p.data
    if b[at : at + 5] != b"OggS\0" or at + 27 > len(b):
        return -1
    end = at + 27 + b[at + 26] + sum(b[at + 27 : at + 27 + b[at + 26]])
    stream, kind = p.little(at + 14, 4), b[at + 5]
    if end > len(b) or bool(kind & 2) == (stream in open_):
        return -1
    if ("ogg", at) not in p.ends:
        p.ends["ogg", at] = int(_ogg_crc(b[at : at + 22] + b"\0\0\0\0" + b[at + 26 : end]) == p.little(at + 22, 4))
    if not p.ends["ogg", at]:
        return -1
    open_ = open_ - {stream} if kind & 4 else open_ | {stream}
    return (end, open_) if open_ else end


def ogg(p: Payload, i: int) -> int:
    return p.walk(_ogg_page, (i, frozenset()))


def _mp4_box(p: Payload, state: tuple) -> tuple | int:
    """A box; the object ends before what isn't one, if it has a moov box."""
    at, whole = state
    n, kind = p.big(at, 4), p.data[at + 4 : at + 8]
    if n == 1 and at + 16 <= len(p.data):
        n = p.big(at + 8, 8)
        n = n if n >= 16 else -1
    elif n == 0 and len(kind) == 4:
        n = len(p.data) - at  # up to the end of the payload
    if n < 8 or at + n > len(p.data) or len(kind) < 4 or not all(c in _BOX for c in kind):
        return at if whole else -1
    return (at + n, whole or kind == b"moov")


_BOX = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 \xa9")


def mp4(p: Payload, i: int) -> int:
    """i: the place of ftyp; the object begins four bytes earlier."""
    return p.walk(_mp4_box, (i - 4, False)) if i >= 4 and p.big(i - 4, 4) >= 8 else -1


_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
#: Magic number, bytes of the object before it, type (or a function of payload and start), validator.
FORMATS: tuple[tuple[bytes, int, str, Callable[[Payload, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", png),
    (b"GIF87a", 0, "image/gif", gif),
    (b"GIF89a", 0, "image/gif", gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", jpeg),
    (b"%PDF-", 0, "application/pdf", pdf),
    (b"PK\x03\x04", 0, "application/zip", zip_),
    (b"RIFF", 0, "riff", riff),
    (b"\x1f\x8b\x08", 0, "application/gzip", gzip),
    (b"BM", 0, "image/bmp", bmp),
    (b"OggS\0", 0, "audio/ogg", ogg),
    (b"ftyp", 4, "video/mp4", mp4),
)
KNOWN = frozenset(t for _, _, t, _ in FORMATS if t != "riff") | frozenset(_RIFF.values())


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for n, (magic, *_) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), n)
    a.make_automaton()
    return a


def objects(payload: bytes, magics: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, type) of the outermost valid objects."""
    hits = []
    for last, n in magics.iter(payload.decode("latin-1")):
        magic, before, _, _ = FORMATS[n]
        at = last + 1 - len(magic)
        hits.append((at - before, at, n))
    out, free, whole = [], 0, Payload(payload)
    for start, at, n in sorted(hits):
        if start < free:
            continue
        _, _, kind, check = FORMATS[n]
        if kind == "riff":
            kind = _RIFF.get(payload[at + 8 : at + 12])
        end = check(whole, at) if kind else -1
        if end > start:
            out.append((start, end, kind))
            free = end
    return out


def _sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    magics = automaton()
    for b in batches:
        rows = []
        for page, declared, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
            found = objects(payload, magics) if payload else []
            whole = found[0][2] if found and found[0][0] == 0 else None
            kind = None if not payload else whole or ("application/octet-stream" if declared in KNOWN else declared)
            head = (page, declared, kind, kind is not None and declared is not None and kind != declared)
            rows += [(*head, i, t, s, e - s) for i, (s, e, t) in enumerate(found)] or [(*head, None, None, None, None)]
        types = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        cols = list(zip(*rows)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in RESULT.split(", ")])


def sniff(media: DataFrame) -> DataFrame:
    """One row for each object of each payload, or one without an object: declared type, type, whether it was corrected, and the object."""
    small_batches(media.sparkSession)
    rows = media.select(F.col("page_id").cast("long"), F.col("declared_type").cast("string"), F.col("payload").cast("binary"))
    return rows.mapInArrow(_sniff, RESULT)


def wrap(kind: int, data: bytes) -> tuple[str, bytes]:
    """A valid object around some bytes."""
    if kind == 0:
        chunk = lambda t, d: len(d).to_bytes(4, "big") + t + d + zlib.crc32(t + d).to_bytes(4, "big")
        pixels = zlib.compress(b"".join(b"\0" + data[i : i + 64].ljust(64, b" ") for i in range(0, max(1, len(data)), 64)), 1)
        return "image/png", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, max(1, -(-len(data) // 64)), 8, 0, 0, 0, 0)) + chunk(b"IDAT", pixels) + chunk(b"IEND", b"")
    if kind == 1:
        body = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
        return "image/gif", b"GIF89a\x10\0\x10\0\0\0\0" + b"!\xfe" + body + b"\0" + b",\0\0\0\0\x10\0\x10\0\0\x02\x02\x4c\x01\0;"
    if kind == 2:
        notes = b"".join(b"\xff\xfe" + (len(data[i : i + 60000]) + 2).to_bytes(2, "big") + data[i : i + 60000] for i in range(0, len(data), 60000))
        return "image/jpeg", b"\xff\xd8" + notes + b"\xff\xc0\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0" + b"\x12\xff\0\x34" + b"\xff\xd9"
    if kind == 3:
        body = b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(data)).encode() + b" >>\nstream\n" + data + b"\nendstream\nendobj\n"
        return "application/pdf", body + b"xref\n0 1\ntrailer << /Size 1 >>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"
    if kind == 4:
        crc, name = zlib.crc32(data), b"page.html"
        local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 0, crc, len(data), len(data), len(name), 0) + name + data
        central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 20, 20, 0, 0, 0, 0, crc, len(data), len(data), len(name), 0, 0, 0, 0, 0, 0) + name
        return "application/zip", local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)
    if kind == 5:
        data += b" " * (len(data) & 1)
        body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + len(data).to_bytes(4, "little") + data
        return "audio/wav", b"RIFF" + len(body).to_bytes(4, "little") + body
    if kind == 6:
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        return "application/gzip", c.compress(data) + c.flush()
    return "text/html", data


def _column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrong = ("image/jpeg", "application/pdf", "image/png", None)
    for b in batches:
        kinds, payloads = [], []
        for page, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p = page or 0
            if text is None:
                kinds.append(None)
                payloads.append(None)
                continue
            data = text.encode()
            kind, payload = wrap(p % 8, data)
            if p % 8 == 7:
                _, inner = wrap(p // 8 % 7, data[: len(data) // 2])
                payload = data[: len(data) // 3] + inner + data[len(data) // 3 :]
            if p % 5 == 0:
                payload += b"\0trailing\xff\xd8\xff\xe0" + wrap(p // 5 % 7, data[:500])[1]
            if p % 7 == 0:
                payload = payload[: len(payload) * 2 // 3]
            kinds.append(wrong[p // 3 % 4] if p % 3 == 0 else kind)
            payloads.append(payload)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), pa.array(payloads, pa.binary())], ["page_id", "declared_type", "payload"])


def media_column(pages: DataFrame) -> DataFrame:
    """A media column for `pages`, which has none: every page wrapped by its number as one of seven formats or as HTML with an
    object inside, with wrong and missing declared types, trailing objects and cut-off payloads among them."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"))
    return rows.mapInArrow(_column, "page_id long, declared_type string, payload binary")
