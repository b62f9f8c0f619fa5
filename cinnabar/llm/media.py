"""Media columns: what a payload is, by its bytes, and the media embedded in it.

An Aho-Corasick automaton finds every magic number of a payload in one pass.  A validator of the format then walks the
structure at that place (chunks, boxes, frames, check sums, central directories) and gives the item's exact length, or
refuses.  The item that starts the payload gives its type, which replaces a wrong declared one; every other item that
holds is carved: its place, length, type and SHA-256.  Base64 data URIs in text are decoded and carved by what they hold.

Defined cases
* A null payload has a null type and no parts; an empty one is "application/x-empty".  A payload that starts no known
  item is "text/plain" if it is UTF-8 without NUL, else "application/octet-stream".
* Types are compared without case and parameters ("; charset=..."), by common names ("image/jpg" is "image/jpeg"); a
  null declared type never agrees with anything but a null payload.
* Parts that overlap: the earlier wins, of equal starts the longer; nothing is carved inside a part.  Parts are in order.
* Payloads may be binary or text, are read whole, and at any length.  Repeated rows are judged alike; empty tables work;
  other columns pass through, those named as results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = T.StructType([
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("encoding", T.StringType()), T.StructField("sha256", T.StringType()),
])
PART_ARROW = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("encoding", pa.string()), ("sha256", pa.string())])
RESULT = ["sniffed", "agrees", "parts"]
Found = tuple[int, str] | None
_NAMES = {"image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "audio/mp3": "audio/mpeg", "application/x-gzip": "application/gzip", "application/x-pdf": "application/pdf", "image/x-ms-bmp": "image/bmp", "application/xhtml+xml": "text/html", "audio/x-flac": "audio/flac"}


def _png(d: bytes, at: int) -> Found:
    p, first = at + 8, True
    while p + 12 <= len(d):
        n, kind = int.from_bytes(d[p : p + 4], "big"), d[p + 4 : p + 8]
        end = p + 12 + n
        if end > len(d) or first != (kind == b"IHDR") or (first and n != 13) or zlib.crc32(memoryview(d)[p + 4 : end - 4]) != int.from_bytes(d[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end - at, "image/png"
        p, first = end, False
    return None


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


def _jpeg(d: bytes, at: int) -> Found:
    p, frame = at + 2, False
    while p + 4 <= len(d) and d[p] == 0xFF:
        kind = d[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0xD9 or kind < 0xC0 or 0xD0 <= kind <= 0xD8:
            return None
        n = int.from_bytes(d[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(d):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            hit = _SCAN_END.search(d, p)
            if not frame or not hit:
                return None
            p = hit.start()
            if d[p + 1] == 0xD9:
                return p + 2 - at, "image/jpeg"
    return None


def _gif(d: bytes, at: int) -> Found:
    if at + 13 > len(d):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    p = at + 13 + table(d[at + 10])

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    images = 0
    while p < len(d):
        if d[p] == 0x3B:
            return (p + 1 - at, "image/gif") if images else None
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            p, images = blocks(p + 11 + table(d[p + 9])), images + 1
        else:
            return None
    return None


def _bmp(d: bytes, at: int) -> Found:
    if at + 54 > len(d):
        return None
    size, zero, offset, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", d, at + 2)
    if zero or header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 2, 4, 8, 16, 24, 32) or width <= 0 or not height or at + size > len(d) or not 14 + header <= offset <= size:
        return None
    if packed in (0, 3) and size < offset + (width * bits + 31) // 32 * 4 * abs(height):
        return None
    return size, "image/bmp"


_RIFF = {b"WEBP": "image/webp", b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo"}


def _riff(d: bytes, at: int) -> Found:
    kind = _RIFF.get(d[at + 8 : at + 12])
    end = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    if not kind or end > len(d):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        n = int.from_bytes(d[p + 4 : p + 8], "little")
        seen.add(d[p : p + 4])
        p += 8 + n + (n & 1 if p + 8 + n < end else 0)
    needed = {"audio/wav": {b"fmt ", b"data"}, "video/x-msvideo": {b"LIST"}}.get(kind, set())
    if p != end or not needed <= seen or (kind == "image/webp" and not seen & {b"VP8 ", b"VP8L", b"VP8X"}):
        return None
    return end - at, kind


_TRAILER = re.compile(rb"startxref\s+(\d+)\s+%%EOF")


def _pdf(d: bytes, at: int) -> Found:
    if not re.match(rb"%PDF-\d\.\d", d[at : at + 8]):
        return None
    until = d.find(b"%PDF-", at + 5)
    best = None
    for m in _TRAILER.finditer(d, at, len(d) if until < 0 else until):
        xref = at + int(m[1])
        if xref < m.start() and re.match(rb"xref|\d+\s+\d+\s+obj", d[xref : xref + 32]):
            best = m.end() - at, "application/pdf"
    return best


def _zip(d: bytes, at: int) -> Found:
    p = d.find(b"PK\5\6", at)
    while p >= 0 and p + 22 <= len(d):
        count, size, offset, comment = struct.unpack_from("<HIIH", d, p + 10)
        end = p + 22 + comment
        if offset + size == p - at and end <= len(d) and (d[at + offset : at + offset + 4] == b"PK\1\2") == (count > 0):
            return end - at, "application/zip"
        p = d.find(b"PK\5\6", p + 4)
    return None


def _zip_lengths(d: bytes, ends: list[int]) -> dict[int, int]:
    """Where each archive with an end record begins, and its length: one look at every end record, however many entries there are."""
    out: dict[int, int] = {}
    for p in ends:
        if p + 22 <= len(d):
            count, size, offset, comment = struct.unpack_from("<HIIH", d, p + 10)
            at, end = p - offset - size, p + 22 + comment
            if at >= 0 and end <= len(d) and (d[at + offset : at + offset + 4] == b"PK\1\2") == (count > 0):
                out.setdefault(at, end - at)
    return out


def _gzip(d: bytes, at: int) -> Found:
    inflate = zlib.decompressobj(31)
    data = memoryview(d)
    try:
        for p in range(at, len(d), 1 << 16):
            inflate.decompress(data[p : p + (1 << 16)], 1 << 20)
            while inflate.unconsumed_tail and not inflate.eof:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            if inflate.eof:
                return min(len(d), p + (1 << 16)) - len(inflate.unused_data) - at, "application/gzip"
    except zlib.error:
        pass
    return None


def _ogg(d: bytes, at: int) -> Found:
    p, streams, ended = at, set(), set()
    while p + 27 <= len(d) and d[p : p + 5] == b"OggS\0":
        serial, segments = d[p + 14 : p + 18], d[p + 26]
        end = p + 27 + segments + sum(d[p + 27 : p + 27 + segments])
        if end > len(d) or (bool(d[p + 5] & 2) == (serial in streams)):
            return None
        streams.add(serial)
        if d[p + 5] & 4:
            ended.add(serial)
        p = end
        if streams == ended:
            return p - at, "audio/ogg"
    return None


def _flac(d: bytes, at: int) -> Found:
    p, first = at + 4, True
    while p + 4 <= len(d):
        last, kind, n = d[p] >> 7, d[p] & 127, int.from_bytes(d[p + 1 : p + 4], "big")
        if first != (kind == 0) or (first and n != 34) or kind == 127:
            return None
        p, first = p + 4 + n, False
        if last:  # frames have no length of their own: they run to the end of the payload
            return (len(d) - at, "audio/flac") if d[p : p + 2] in (b"\xff\xf8", b"\xff\xf9") else None
    return None


_RATES = {(3, 1): (44100, 48000, 32000), (2, 1): (22050, 24000, 16000), (0, 1): (11025, 12000, 8000)}
_KBIT = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 0: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}


def _mp3(d: bytes, at: int) -> Found:
    p, frames = at, 0
    if d[at : at + 3] == b"ID3":
        head = d[at : at + 10]
        if len(head) < 10 or any(x & 0x80 for x in head[6:]):
            return None
        p += 10 + sum((x & 0x7F) << s for x, s in zip(head[6:], (21, 14, 7, 0), strict=True))
    while p + 4 <= len(d) and d[p] == 0xFF and d[p + 1] & 0xE6 == 0xE2:
        version, rate, bits = d[p + 1] >> 3 & 3, d[p + 2] >> 2 & 3, d[p + 2] >> 4
        if version == 1 or rate == 3 or not 0 < bits < 15:
            break
        n = (144 if version == 3 else 72) * 1000 * _KBIT[version][bits] // _RATES[version, 1][rate] + (d[p + 2] >> 1 & 1)
        if p + n > len(d):
            break
        p, frames = p + n, frames + 1
    return (p - at, "audio/mpeg") if frames >= 3 else None


def _mp4(d: bytes, at: int) -> Found:
    at -= 4
    if at < 0:
        return None
    brand, p, seen = d[at + 8 : at + 12], at, set()
    while p + 8 <= len(d):
        n, kind = int.from_bytes(d[p : p + 4], "big"), d[p + 4 : p + 8]
        if n == 1:
            n = int.from_bytes(d[p + 8 : p + 16], "big")
        elif n == 0 and kind == b"mdat":
            n = len(d) - p
        if n < 8 or p + n > len(d) or not all(32 <= x < 127 or x == 0xA9 for x in kind):
            break
        seen.add(kind)
        p += n
    if not seen & {b"moov", b"moof", b"mdat", b"meta"}:
        return None
    return p - at, {b"qt  ": "video/quicktime", b"heic": "image/heic", b"avif": "image/avif", b"M4A ": "audio/mp4"}.get(brand, "video/mp4")


_WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def _tiff(d: bytes, at: int) -> Found:
    e = "<" if d[at : at + 2] == b"II" else ">"
    try:
        ifd, last, seen = struct.unpack_from(e + "I", d, at + 4)[0], 8, set()
        while ifd and ifd not in seen:
            seen.add(ifd)
            n = struct.unpack_from(e + "H", d, at + ifd)[0]
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(e + "HHI", d, at + ifd + 2 + 12 * k)
                if kind not in _WIDTH:
                    return None
                size = _WIDTH[kind] * count
                where = at + ifd + 10 + 12 * k if size <= 4 else at + struct.unpack_from(e + "I", d, at + ifd + 10 + 12 * k)[0]
                if where + size > len(d):
                    return None
                if kind in (3, 4) and tag in (256, 257, 273, 279, 324, 325):
                    tags[tag] = struct.unpack_from(f"{e}{count}{'H' if kind == 3 else 'I'}", d, where)
                last = max(last, where + size - at)
            for a, b in ((273, 279), (324, 325)):
                last = max([last, *(x + y for x, y in zip(tags.get(a, ()), tags.get(b, ()), strict=False))])
            if not {256, 257} <= tags.keys():
                return None
            last = max(last, ifd + 6 + 12 * n)
            ifd = struct.unpack_from(e + "I", d, at + ifd + 2 + 12 * n)[0]
    except struct.error:
        return None
    return (last, "image/tiff") if seen and at + last <= len(d) else None


def _vint(d: bytes, p: int, keep: bool = False) -> tuple[int | None, int]:
    """An EBML number and where it ends; None: unknown size."""
    if p >= len(d) or not d[p]:
        raise ValueError
    n = 9 - d[p].bit_length()
    value = int.from_bytes(d[p : p + n], "big")
    if p + n > len(d):
        raise ValueError
    if not keep:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            return None, p + n
    return value, p + n


def _ebml(d: bytes, at: int) -> Found:
    try:
        n, p = _vint(d, at + 4)
        head = d[p : p + (n or 0)]
        kind = {b"webm": "video/webm", b"matroska": "video/x-matroska"}.get((re.search(rb"\x42\x82[\x80-\xff](webm|matroska)", head) or [b"", b""])[1])
        ident, p = _vint(d, p + (n or 0), True)
        size, p = _vint(d, p)
    except ValueError:
        return None
    end = len(d) if size is None else p + size
    return (end - at, kind) if kind and ident == 0x18538067 and end <= len(d) else None


_SVG = re.compile(rb"<(/?)svg(?=[\s>/])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*?(/?)>", re.I)


def _svg(d: bytes, at: int) -> Found:
    depth = 0
    for m in _SVG.finditer(d, at):
        if not depth and (m.start() != at or m[1]):
            return None
        depth += -1 if m[1] else 0 if m[2] else 1
        if not depth:
            return m.end() - at, "image/svg+xml"
    return None


#: Magic bytes, and the format's validator.
SIGNATURES: list[tuple[bytes, Callable[[bytes, int], Found]]] = [
    (b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8\xff", _jpeg), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"BM", _bmp), (b"RIFF", _riff), (b"%PDF-", _pdf),
    (b"PK\3\4", _zip), (b"PK\5\6", _zip), (b"\x1f\x8b\x08", _gzip), (b"OggS", _ogg), (b"fLaC", _flac), (b"ID3", _mp3), (b"\xff\xfb", _mp3), (b"\xff\xf3", _mp3), (b"\xff\xf2", _mp3),
    (b"\xff\xfa", _mp3), (b"ftyp", _mp4), (b"II*\0", _tiff), (b"MM\0*", _tiff), (b"\x1a\x45\xdf\xa3", _ebml), (b"<svg", _svg), (b"<SVG", _svg),
]
_URI = b";base64,"
#: White space in a run of base64, plain or escaped.
_GAP = re.compile(rb"(?:\s|%(?:0[9AaDd]|20))+")
_BASE64 = re.compile(rb"[A-Za-z0-9+/]*(?:(?:\s|%(?:0[9AaDd]|20))+[A-Za-z0-9+/]+)*(?:(?:\s|%(?:0[9AaDd]|20))*=){0,2}")
_HTML = re.compile(rb"(?:\xef\xbb\xbf)?\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<(?:!doctype\s+html|html|head|body)\b", re.I | re.S)
_SVG_START = re.compile(rb"(?:\xef\xbb\xbf)?\s*(?:<\?xml[^>]*>\s*)?(?:<!doctype\s+svg[^>]*>\s*)?(?:<!--.*?-->\s*)*(?=<svg\b)", re.I | re.S)
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for magic, validator in SIGNATURES:
            made.add_word(magic.decode("latin-1"), (len(magic), validator))
        made.add_word(_URI.decode(), (len(_URI), None))
        made.make_automaton()
        _automaton = made
    return _automaton


def _is_text(data: bytes) -> bool:
    if b"\0" in data:
        return False
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _decode(said: bytes) -> bytes:
    """The bytes of base64 that may be wrapped or lack its padding."""
    bare = _GAP.sub(b"", said).rstrip(b"=")
    bare = bare[: len(bare) - (len(bare) % 4 == 1)]
    return base64.b64decode(bare + b"=" * (-len(bare) % 4))


def _end(said: bytes, whole: bytes) -> int:
    """Where wrapped base64 ends, if words of the text around it follow its item; else 0."""
    gaps = list(_GAP.finditer(said))
    size = max((n for at, n, _, how, _ in _items(whole) if at == 0 and how == "none"), default=0) if gaps else 0
    passed = 0
    for gap in gaps if size else []:
        if (gap.start() - passed) * 3 // 4 >= size:
            return gap.start()
        passed += gap.end() - gap.start()
    return 0


def _items(data: bytes) -> Iterator[tuple[int, int, str, str, bytes]]:
    """(offset, length, type, encoding, bytes) of every item that holds; a search goes on after an item's end."""
    hits = []
    for last, (n, validator) in automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        hits.append((at - 4 if validator is _mp4 else at, at, validator))
    archives = _zip_lengths(data, [at for _, at, v in hits if v is _zip and data[at + 2 : at + 4] == b"\5\6"])
    after = 0
    for begin, at, validator in sorted(hits, key=lambda x: x[0]):
        if begin < after:
            continue
        if validator is None:
            run = _BASE64.match(data, at + len(_URI))
            said = run[0] if run and len(run[0]) >= 8 else b""
            whole = _decode(said)
            kind = sniff(whole)[0] if whole else None
            if kind not in (None, "text/plain", "text/html", "application/octet-stream"):
                if cut := _end(said, whole):
                    said = said[:cut]
                    whole = _decode(said)
                yield run.start(), len(said), kind, "base64", whole
                after = run.start() + len(said)
        elif found := ((archives[at], "application/zip") if at in archives else None) if validator is _zip else validator(data, at):
            yield begin, found[0], found[1], "none", data[begin : begin + found[0]]
            if begin:  # nothing is carved inside a part, but within the payload's own item it is
                after = begin + found[0]


def sniff(data: bytes) -> tuple[str, list[tuple[int, int, str, str, bytes]]]:
    """The type of a payload, and the items embedded in it."""
    if not data:
        return "application/x-empty", []
    own, parts = None, []
    svg = _SVG_START.match(data)
    start = svg.end() if svg else 0
    for item in _items(data):
        if item[3] == "none" and (item[0] == 0 or (svg and item[0] == start and item[2] == "image/svg+xml")):
            if own is None or item[1] > own[1]:
                own = item
        else:
            parts.append(item)
    if own:
        return own[2], parts
    if _HTML.match(data):
        return "text/html", parts
    return "text/plain" if _is_text(data) else "application/octet-stream", parts


def same_type(declared: Column, kind: Column) -> Column:
    bare = F.lower(F.btrim(F.split(declared, ";").getItem(0)))
    names = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    return F.coalesce(F.when(kind.isNull(), declared.isNull()).otherwise(F.coalesce(names[bare], bare) == kind), F.lit(False))


def sniff_media(media: DataFrame, payload_col: str, declared_col: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, unless given) with the type by the bytes, whether the declared one agrees, and the parts."""
    names = [c for c in keep or media.columns if c.lower() not in RESULT]
    inner = T.StructType([*[media.schema[c] for c in dict.fromkeys([*names, declared_col])], T.StructField("sniffed", T.StringType()), T.StructField("parts", T.ArrayType(PART))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, parts = [], []
            for x in b.column("__payload"):
                data = x.as_py()
                if data is None:
                    kinds.append(None)
                    parts.append([])
                    continue
                kind, found = sniff(data)
                kinds.append(kind)
                parts.append([{"offset": o, "length": n, "type": t, "encoding": e, "sha256": hashlib.sha256(y).hexdigest()} for o, n, t, e, y in found])
            kept = inner.fieldNames()[:-2]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(kinds, pa.string()), pa.array(parts, pa.list_(PART_ARROW))], names=[*kept, "sniffed", "parts"])

    given = media.select(*[media[f"`{c}`"] for c in inner.fieldNames()[:-2]], media[f"`{payload_col}`"].cast("binary").alias("__payload"))
    judged = given.mapInArrow(run, inner)
    return judged.select(*[f"`{c}`" for c in names], "sniffed", same_type(F.col(f"`{declared_col}`"), F.col("sniffed")).alias("agrees"), "parts")


def carve(media: DataFrame, payload_col: str, id_col: str) -> DataFrame:
    """One row for each embedded item: the id, its place, length, type and encoding, and its bytes."""
    schema = T.StructType([T.StructField(id_col, media.schema[id_col].dataType), *PART.fields[:4], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *p) for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True) for p in (sniff(x.as_py())[1] if x.is_valid else [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(shape)], names=schema.fieldNames())

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    return media.select(media[f"`{id_col}`"], media[f"`{payload_col}`"].cast("binary").alias("__payload")).mapInArrow(run, schema)


#: Declared types by a URL's ending.
ENDINGS = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "pdf": "application/pdf", "mp3": "audio/mpeg", "mp4": "video/mp4", "wav": "audio/wav", "zip": "application/zip", "gz": "application/gzip", "txt": "text/plain"}


def declared_by_url(url: Column, default: str = "text/html") -> Column:
    """The type that the ending of a URL's path declares; null for a null URL."""
    ending = F.lower(F.regexp_extract(url, r"^[^?#]*/[^?#/]*\.([A-Za-z0-9]+)(?:[?#]|$)", 1))
    return F.when(url.isNotNull(), F.coalesce(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])[ending], F.lit(default)))
