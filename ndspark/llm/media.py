"""Media columns: signature sniffing with Aho-Corasick, validators of structure, carving."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

PAD = 64
RATE = 8000


def wav(payload: bytes, cover: bytes = b"") -> bytes:
    """The bytes as unsigned 8-bit mono samples in a WAV file, with a picture in a chunk of its own if there is one."""
    chunk = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    body = b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)) + chunk(b"data", payload)
    body += chunk(b"covr", cover) if cover else b""
    return b"RIFF" + struct.pack("<I", len(body)) + body


def png(payload: bytes, width: int) -> bytes:
    """The bytes as 8-bit grey pixels, `width` a row, in a PNG file; width divides their number."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    plain = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1)  # filter 0 before each row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(plain.tobytes(), 1)) + chunk(b"IEND", b"")


def bmp(payload: bytes, width: int) -> bytes:
    """The bytes as 8-bit pixels of a grey palette, rows from the top, in a BMP file; width is a multiple of 4 and divides their number."""
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 14 + 40 + len(palette)
    head = struct.pack("<IiiHHIIiiII", 40, width, -(len(payload) // width), 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return b"BM" + struct.pack("<IHHI", at + len(payload), 0, 0, at) + head + palette + payload


class Marks:
    """Where the marks of formats are in some bytes: found once, looked up by bisection, so many candidates cost no more scans."""

    def __init__(self, data: bytes):
        self.data, self.at, self._stops, self._zips, self._nul = data, {}, None, None, (0, 0)
        for last, (mark, _) in automaton().iter(data.decode("latin-1")):
            self.at.setdefault(mark, []).append(last + 1 - len(mark))

    def between(self, mark: bytes, a: int, b: int) -> list[int]:
        """The first and the last place of the mark in [a, b), or none."""
        at = self.at.get(mark, ())
        i, j = bisect_left(at, a), bisect_left(at, b)
        return [at[i], at[j - 1]] if i < j else []

    def next(self, mark: bytes, a: int) -> int | None:
        at = self.at.get(mark, ())
        return at[i] if (i := bisect_left(at, a)) < len(at) else None

    def nul(self, a: int) -> int:
        """The next zero byte from a on, the length of the data without one; scans no byte twice for rising a."""
        since, found = self._nul
        if not since < a <= found:
            found = n if (n := self.data.find(b"\0", a)) >= 0 else len(self.data)
            self._nul = a - 1, found
        return found

    def jpeg_stop(self, a: int) -> int | None:
        """The next marker that ends entropy-coded data, from a on."""
        if self._stops is None:
            x = np.frombuffer(self.data, np.uint8)
            y = x[1:]
            self._stops = np.flatnonzero((x[:-1] == 0xFF) & (y != 0) & (y != 0xFF) & ((y < 0xD0) | (y > 0xD7)))
        i = int(np.searchsorted(self._stops, a))
        return int(self._stops[i]) if i < len(self._stops) else None

    def zip_end(self, a: int) -> int | None:
        """The end of the archive that begins at a: each end record says where its archive begins."""
        if self._zips is None:
            self._zips = {}
            for i in self.at.get(b"PK\5\6", ()):
                if i + 22 <= len(self.data):
                    size, start, comment = struct.unpack("<IIH", self.data[i + 12 : i + 22])
                    at = i - start - size
                    if at >= 0 and self.data[at + start : at + start + 4] in (b"PK\1\2", b"PK\5\6") and i + 22 + comment <= len(self.data):
                        self._zips.setdefault(at, i + 22 + comment)
        return self._zips.get(a)


def riff(data: bytes, at: int, form: bytes) -> tuple[int, dict[bytes, tuple[int, int]]] | None:
    """End and chunks (start, length) of a RIFF file of that form; None if its lengths don't fit together."""
    if len(data) < at + 12 or data[at + 8 : at + 12] != form:
        return None
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data):
        return None
    chunks, i = {}, at + 12
    while i + 8 <= end:
        n = int.from_bytes(data[i + 4 : i + 8], "little")
        if i + 8 + n > end:
            return None
        chunks.setdefault(data[i : i + 4], (i + 8, n))
        i += 8 + n + n % 2
    return (end, chunks) if i >= end else None


def wav_end(marks: Marks, at: int) -> int | None:
    data = marks.data
    if found := riff(data, at, b"WAVE"):
        end, chunks = found
        if {b"fmt ", b"data"} <= chunks.keys() and chunks[b"fmt "][1] >= 16:
            start, n = chunks[b"fmt "][0], chunks[b"data"][1]
            channels, rate, _, align, bits = struct.unpack("<HIIHH", data[start + 2 : start + 16])
            if channels and rate and align == channels * -(-bits // 8) and n % max(1, align) == 0:
                return end
    return None


def webp_end(marks: Marks, at: int) -> int | None:
    found = riff(marks.data, at, b"WEBP")
    return found[0] if found and found[1].keys() & {b"VP8 ", b"VP8L", b"VP8X"} else None


def png_end(marks: Marks, at: int) -> int | None:
    data, i, first = marks.data, at + 8, True
    while i + 12 <= len(data):
        n, kind = int.from_bytes(data[i : i + 4], "big"), data[i + 4 : i + 8]
        if i + 12 + n > len(data) or (kind == b"IHDR") != first or first and n != 13:
            return None
        if zlib.crc32(data[i + 4 : i + 8 + n]) != int.from_bytes(data[i + 8 + n : i + 12 + n], "big"):
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i
    return None


def gif_end(marks: Marks, at: int) -> int | None:
    data = marks.data
    if len(data) < at + 13:
        return None
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    i = at + 13 + table(data[at + 10])
    while i < len(data):
        mark, i = data[i], i + 1
        if mark == 0x3B:
            return i
        if mark == 0x2C and i + 9 < len(data):
            i += 10 + table(data[i + 8])
        elif mark == 0x21:
            i += 1
        else:
            return None
        while i < len(data) and data[i]:
            i += 1 + data[i]
        i += 1
    return None


def jpeg_end(marks: Marks, at: int) -> int | None:
    data, i, frame = marks.data, at + 2, False
    while i + 4 <= len(data) and data[i] == 0xFF:
        mark, n = data[i + 1], int.from_bytes(data[i + 2 : i + 4], "big")
        if mark in (0x00, 0xD8, 0xD9) or n < 2 or i + 2 + n > len(data):
            return None
        frame |= mark in (0xC0, 0xC1, 0xC2)
        i += 2 + n
        if mark == 0xDA:
            if (stop := marks.jpeg_stop(i)) is None:
                return None
            i = stop
            if data[i + 1] == 0xD9:
                return i + 2 if frame else None
    return None


def bmp_end(marks: Marks, at: int) -> int | None:
    data = marks.data
    if len(data) < at + 30:
        return None
    n, _, pixels, head, width, height, planes, bits = struct.unpack("<IIIIiiHH", data[at + 2 : at + 30])
    ok = at + n <= len(data) and head in (12, 40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return at + n if ok and 14 + head <= pixels <= n else None


def gzip_end(marks: Marks, at: int) -> int | None:
    """Decompressed a piece at a time and thrown away, so no bomb fills the memory; members that follow each other are one file."""
    data, end = marks.data, None
    while data[at : at + 3] == b"\x1f\x8b\x08" and at + 18 <= len(data):
        flags, i = data[at + 3], at + 10
        if flags & 0xE0:
            break
        if flags & 4:
            i += 2 + int.from_bytes(data[i : i + 2], "little")
        for flag in (8, 16):  # a name, a comment: without their end there is no file
            if flags & flag:
                if (i := marks.nul(i) + 1) > len(data):
                    return end
        left, view = zlib.decompressobj(31), memoryview(data)
        try:
            for a in range(at, len(data), 1 << 16):
                rest = view[a : a + (1 << 16)]
                while rest and not left.eof:
                    left.decompress(rest, 1 << 20)
                    rest = left.unconsumed_tail
                if left.eof:
                    break
        except zlib.error:
            break
        if not left.eof:
            break
        at = end = min(len(data), a + (1 << 16)) - len(left.unused_data)
    return end


def zip_end(marks: Marks, at: int) -> int | None:
    return marks.zip_end(at)


def pdf_end(marks: Marks, at: int) -> int | None:
    """The last end mark before the next PDF begins: a file that was saved again holds several."""
    if not marks.data[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    start = marks.next(b"startxref", at)
    upto = marks.next(b"%PDF-", at + 5)
    ends = marks.between(b"%%EOF", at if start is None else start, len(marks.data) if upto is None else upto)
    return ends[-1] + 5 if start is not None and ends else None


def ogg_end(marks: Marks, at: int) -> int | None:
    data, i, pages = marks.data, at, 0
    while data[i : i + 5] == b"OggS\0" and i + 27 <= len(data):
        n = data[i + 26]
        size = 27 + n + sum(data[i + 27 : i + 27 + n])
        if i + size > len(data) or pages == 0 and not data[i + 5] & 2:
            break
        pages += 1
        i += size
    return i if pages else None


#: Magic bytes, type, validator. Fixed values of the formats.
MAGIC = [
    (b"RIFF", "audio/wav", wav_end),
    (b"RIFF", "image/webp", webp_end),
    (b"\x89PNG\r\n\x1a\n", "image/png", png_end),
    (b"GIF87a", "image/gif", gif_end),
    (b"GIF89a", "image/gif", gif_end),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_end),
    (b"BM", "image/bmp", bmp_end),
    (b"\x1f\x8b\x08", "application/gzip", gzip_end),
    (b"PK\3\4", "application/zip", zip_end),
    (b"%PDF-", "application/pdf", pdf_end),
    (b"OggS", "audio/ogg", ogg_end),
]


#: Marks inside files that validators look up. Fixed values of the formats.
INNER = [b"PK\5\6", b"startxref", b"%%EOF"]


@cache
def automaton() -> ahocorasick.Automaton:
    found: dict[bytes, list] = {mark: [] for mark in INNER}
    for magic, kind, end in MAGIC:
        found.setdefault(magic, []).append((kind, end))
    out = ahocorasick.Automaton()
    for mark, tests in found.items():
        out.add_word(mark.decode("latin-1"), (mark, tests))
    out.make_automaton()
    return out


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of every valid file in data, in order of its start.

    The automaton finds all magic bytes and inner marks in one pass; a place counts if a validator follows
    the structure from there to its end. A file within another is listed too, but not one within the
    compressed bytes of a gzip file, where magic bytes are a chance.
    """
    marks, found, packed = Marks(data), [], 0
    tests = {}
    for magic, kind, end in MAGIC:
        tests.setdefault(magic, []).append((kind, end))
    for at, magic in sorted((at, magic) for magic in tests for at in marks.at.get(magic, ())):
        if at < packed:
            continue
        for kind, end in tests[magic]:
            if (e := end(marks, at)) is not None:
                found.append((kind, at, e))
                packed = e if kind == "application/gzip" else packed
                break
    return sorted(found, key=lambda x: (x[1], x[2]))


def sniffed_type(data: bytes, declared: str | None) -> tuple[str, list[tuple[str, int, int]]]:
    """The true type (the declared one, or application/octet-stream, if nothing valid starts at 0) and what is embedded."""
    found = sniff(data)
    outer = [x for x in found if x[1] == 0]
    return (outer[0][0] if outer else declared or "application/octet-stream"), [x for x in found if x[1] > 0]


def samples(data: bytes, kind: str) -> bytes:
    """The sample bytes of a file: of a WAV file its data, of pictures with 8 bits a pixel their pixels, else the file itself."""
    if kind == "audio/wav":
        start, n = riff(data, 0, b"WAVE")[1][b"data"]
        return data[start : start + n]
    if kind == "image/bmp" and data[28:30] == b"\x08\0" and int.from_bytes(data[22:26], "little", signed=True) < 0 and int.from_bytes(data[18:22], "little") % 4 == 0:
        start, n = int.from_bytes(data[10:14], "little"), -int.from_bytes(data[22:26], "little", signed=True) * int.from_bytes(data[18:22], "little")
        return data[start : start + n]
    if kind == "image/png" and data[24:29] == b"\x08\0\0\0\0":
        width, i, parts = int.from_bytes(data[16:20], "big"), 8, []
        while data[i + 4 : i + 8] != b"IEND":
            n = int.from_bytes(data[i : i + 4], "big")
            if data[i + 4 : i + 8] == b"IDAT":
                parts.append(data[i + 8 : i + 8 + n])
            i += 12 + n
        rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
        return rows[:, 1:].tobytes() if not rows[:, 0].any() else data
    return data


def features(payload: bytes, kind: str, embedded: list) -> str:
    """Length, level and spectrum of the samples, and the types that are embedded."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n = len(x)
    v = np.arange(256) - 128
    mean, power = float((counts * v).sum()) / n, float((counts * v * v).sum()) / n
    p = counts[counts > 0] / n
    steps = np.bincount(np.abs(np.diff(x.astype(np.int16))), minlength=1)
    change = float((steps * np.arange(len(steps))).sum()) / max(1, n - 1)
    inside = "+".join(k for k, _, _ in embedded) or "-"
    return f"{kind};n={n};mean={mean:.4f};rms={power**0.5:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};change={change:.4f};embedded={inside}"


FIELDS = "id {}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, declared string, type string, corrected boolean, embedded int, embedded_sha256 string, feature string"

#: What stored files claim to be; true for some of them only, as in any collection of files.
CLAIMS = ["audio/wav", "image/png", "image/bmp", "application/octet-stream"]


def store(text: bytes) -> tuple[bytes, str]:
    """The text, filled with zero bytes up to a positive multiple of PAD, as a media file, and the type it is declared as.

    A checksum of the payload chooses the format (WAV, PNG or BMP, 8 bits a sample) and the claim. A WAV
    file embeds a picture of its first samples, as music files do with covers.
    """
    payload = text + bytes(-len(text) % PAD if text else PAD)
    pick = zlib.crc32(payload)
    media = (wav(payload, png(payload[:PAD], 8)), png(payload, PAD), bmp(payload, PAD))[pick % 3]
    return media, CLAIMS[pick // 3 % len(CLAIMS)]


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media, declared: each text as a media file under a declared type that may be wrong (see store).

    Null text counts as empty. Null identifiers and repeated rows are rows like others. Other columns
    of the input are not read.
    """
    at = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches):
        for batch in batches:
            for part in bounded(batch):
                texts = [x.as_py() or b"" for x in part.column(1).cast(pa.binary())]
                media, declared = zip(*map(store, texts)) if texts else ((), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(declared, pa.string())], names=["id", "n_bytes", "media", "declared"])

    return at.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary, declared string")


def bounded(batch: pa.RecordBatch, rows: int = 512):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def read_media(df: DataFrame) -> DataFrame:
    """id, n_bytes, media, declared -> FIELDS: the type by signature, the samples read back and their features.

    A media file of another type has its own bytes as payload. Null media is an empty file. corrected
    tells whether the declared type was another than the sniffed one; embedded counts the files inside,
    and embedded_sha256 is the hash of the first one's bytes, null without any.
    """

    def run(batches):
        for batch in batches:
            for part in bounded(batch):
                out = []
                for n, media, declared in zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist()):
                    data = media.as_py() or b""
                    kind, embedded = sniffed_type(data, declared)
                    payload = samples(data, kind)
                    feature = features(payload, kind, embedded) if payload else f"{kind};n=0"
                    inner = hashlib.sha256(data[embedded[0][1] : embedded[0][2]]).hexdigest() if embedded else None
                    out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), declared, kind, kind != declared, len(embedded), inner, feature))
                names = [x.split()[0] for x in FIELDS.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, k) for x, k in zip(zip(*out) if out else ((),) * 12, kinds)]], names=names)

    return df.mapInArrow(run, FIELDS.format(df.schema["id"].dataType.simpleString()))


def carve(df: DataFrame, media_col: str = "media", id_col: str = "id") -> DataFrame:
    """id, type, start, end, content: every valid file that lies in another one, a row each."""
    rows = df.select(df[id_col].alias("id"), df[media_col].alias("media"))

    def run(batches):
        for batch in batches:
            out = [(i, k, a, b, data[a:b]) for i, m in zip(batch.column(0).to_pylist(), batch.column(1)) if (data := m.as_py()) for k, a, b in sniffed_type(data, None)[1]]
            ids, *rest = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *[pa.array(x, t) for x, t in zip(rest, (pa.string(), pa.int64(), pa.int64(), pa.binary()))]], names=["id", "type", "start", "end", "content"])

    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, type string, start bigint, end bigint, content binary")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_media(store_media(documents(spark, sf_dir).select("doc_id", "text")))
    return found.withColumnRenamed("id", "doc_id")
