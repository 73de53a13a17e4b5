"""Media columns: texts kept as progressive JPEG files, read back as coefficients and full-resolution RGB tensors.

Storing. A text's UTF-8 bytes, with zero bytes up to a positive multiple of 64, fill 8x8 blocks of quantised DCT
coefficients, 64 bytes a block in zigzag order: the luma blocks first, then Cb and Cr of a 4:2:0 image; the last
blocks may be filler, and a comment tells the payload's length. A byte v becomes an AC coefficient of eight magnitude
bits (v if v >= 128, else v - 255), or a DC coefficient 256 + v whose sign alternates from block to block, so that all
symbols of a scan have the same length. The scans: DC without its last bit, AC 1-5 and 6-63 (luma) or 1-63 (chroma)
without their last bit, then a refinement of DC and one of AC.

Reading. Scans accumulate into coefficient arrays, whatever file it is: any 8-bit Huffman-coded progressive JPEG of one
or three components whose blocks are scanned component by component, or DC interleaved. Scans whose symbols all have
one length, as those above, are read as arrays after a check that they have; others bit by bit. The inverse transform
runs in numpy, chroma is repeated to full resolution, and the tensor is height x width x 3 bytes.

Scale: one row in, one row out, no shuffle; memory is a few times the longest text, or a piece of 2 MB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, pieces

#: Blocks of chroma in a row of the image at most; a JPEG has 65,535 columns at most.
MOST_COLUMNS = 4095

#: Natural positions of the 64 coefficients in zigzag order: along diagonals, alternately down and up.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def _cosines() -> np.ndarray:
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return (np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)).astype(np.float32)


COSINES = _cosines()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, number: int, codes: list[tuple[int, int]]) -> bytes:
    """A table of (length, symbol) in canonical order."""
    counts = bytes(sum(length == k for length, _ in codes) for k in range(1, 17))
    return bytes([kind << 4 | number]) + counts + bytes(s for _, s in codes)


#: DC: 7 bits for size 9 and 8 for size 8, so that code and magnitude make 16 bits. AC 0: one bit for (0, 7), so that
#: code and magnitude make 8. AC 1, for refinement: one bit for "end of block".
TABLES = _segment(0xC4, _huffman(0, 0, [(7, 9), (8, 8)]) + _huffman(1, 0, [(1, 0x07), (2, 0x00)]) + _huffman(1, 1, [(1, 0x00), (2, 0x01)]))
QUANTISERS = _segment(0xDB, bytes([0]) + bytes([1] * 64))


def _scan(component: int, ss: int, se: int, ah: int, al: int, table: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, table, ss, se, ah << 4 | al])) + data.replace(b"\xff", b"\xff\x00")


def grid(blocks: int) -> tuple[int, int]:
    """Rows and columns of chroma blocks of an image with at least so many blocks."""
    rows = max(1, -(-blocks // (6 * MOST_COLUMNS)))
    return rows, -(-blocks // (6 * rows))


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a progressive JPEG file."""
    rows, columns = grid(len(payload) // 64)
    padded = np.zeros((6 * rows * columns, 64), dtype=np.uint8)
    padded.reshape(-1)[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), QUANTISERS, _segment(0xC2, frame), TABLES]
    last, at = [], 0
    for component, n in ((1, 4 * rows * columns), (2, rows * columns), (3, rows * columns)):
        part = padded[at : at + n]
        at += n
        dc = (part[:, 0].astype(np.int16) + 256) * np.where(np.arange(n) % 2, -1, 1).astype(np.int16)
        high = dc >> 1
        steps = np.diff(high, prepend=np.int16(0))
        words = np.where(steps > 0, steps, steps + 511).astype(">u2")
        words[0] = 0x0200 | int(steps[0])  # the code of size 8
        out.append(_scan(component, 0, 0, 0, 1, 0x00, words.tobytes()))
        for ss, se in ((1, 5), (6, 63)) if component == 1 else ((1, 63),):
            out.append(_scan(component, ss, se, 0, 1, 0x00, (part[:, ss : se + 1] >> 1).tobytes()))
        low = np.packbits(np.concatenate([dc & 1, np.ones(-n % 8, dtype=np.int16)]).astype(np.uint8))
        last.append(_scan(component, 0, 0, 1, 0, 0x00, low.tobytes()))
        bits = (part & 1) ^ (part < 128)
        bits[:, 0] = 0  # the code of "end of block"
        last.append(_scan(component, 1, 63, 1, 0, 0x01, np.packbits(bits, axis=1).tobytes()))
    return b"".join([*out, *last, b"\xff\xd9"])


class _Bits:
    """Bit by bit reading of one scan's data, and Huffman symbols from it."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 0xFF
        self.at += 1
        return byte >> (7 - (self.at - 1 & 7)) & 1

    def bits(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value

    def signed(self, size: int) -> int:
        value = self.bits(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _dc_first(coefs: np.ndarray, data: bytes, codes: dict, al: int, fast: bool) -> None:
    n = len(coefs)
    if fast and codes.get((7, 0)) == 9 and codes.get((8, 2)) == 8 and len(data) == 2 * n:
        words = np.frombuffer(data, dtype=">u2").astype(np.int32)
        if words[0] >> 8 == 2 and (words[1:] < 512).all():
            first = int(words[0] & 255)
            steps = np.where(words < 256, words - 511, words)
            steps[0] = first if first >= 128 else first - 255
            coefs[:, 0] = np.cumsum(steps) << al
            return
    bits, value = _Bits(data), 0
    for block in coefs:
        value += bits.signed(bits.symbol(codes))
        block[0] = value << al


def _dc_refine(coefs: np.ndarray, data: bytes, al: int) -> None:
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))[: len(coefs)]
    coefs[:, 0] |= bits.astype(np.int16) << al


def _ac_first(coefs: np.ndarray, data: bytes, codes: dict, ss: int, se: int, al: int, fast: bool) -> None:
    n, width = len(coefs), se - ss + 1
    if fast and codes.get((1, 0)) == 0x07 and len(data) == n * width:
        values = np.frombuffer(data, dtype=np.uint8).reshape(n, width).astype(np.int16)
        if (values < 128).all():
            coefs[:, ss : se + 1] = np.where(values >= 64, values, values - 127) * (1 << al)
            return
    bits, run = _Bits(data), 0
    for block in coefs:
        k = ss
        while k <= se and not run:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                block[k] = bits.signed(size) * (1 << al)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.bits(zeros)
        run = max(0, run - 1)


def _ac_refine(coefs: np.ndarray, data: bytes, codes: dict, ss: int, se: int, al: int, fast: bool) -> None:
    n, band = len(coefs), coefs[:, ss : se + 1]
    if fast and codes.get((1, 0)) == 0 and (ss, se) == (1, 63) and len(data) == 8 * n and band.all():
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).reshape(n, 64)
        if not bits[:, 0].any():
            band += np.sign(band) * (bits[:, 1:].astype(np.int16) << al)
            return
    bits, run, one = _Bits(data), 0, 1 << al

    def correct(block: np.ndarray, k: int) -> None:
        if bits.bit():
            block[k] += one if block[k] > 0 else -one

    for block in coefs:
        k = ss
        while k <= se and not run:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.bits(zeros)
                break
            new = (one if bits.bit() else -one) if size else 0
            while k <= se:
                if block[k]:
                    correct(block, k)
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            for j in range(k, se + 1):
                if block[j]:
                    correct(block, j)
            run -= 1


def _parts(media: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """marker, segment and, after a start of scan, the scan's data without stuffing."""
    at = 2
    while at < len(media):
        marker = media[at + 1]
        if marker == 0xD9:
            return
        length = int.from_bytes(media[at + 2 : at + 4], "big")
        body, data = media[at + 4 : at + 2 + length], b""
        at += 2 + length
        if marker == 0xDA:
            end = media.find(b"\xff", at)
            while media[end + 1 : end + 2] == b"\x00":
                end = media.find(b"\xff", end + 2)
            data = media[at:end].replace(b"\xff\x00", b"\xff")
            at = end
        yield marker, body, data


class Image:
    """What a file holds: coefficients by component (blocks x 64, zigzag order), geometry, tables, comment."""

    def __init__(self, media: bytes, fast: bool = True):
        self.comment, self.quantisers, self.codes, self.parts = b"", {}, {}, []
        for marker, body, data in _parts(media):
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                for i in range(0, len(body), 65):
                    self.quantisers[body[i]] = np.frombuffer(body[i + 1 : i + 65], dtype=np.uint8).astype(np.float32)
            elif marker == 0xC4:
                while body:
                    total = sum(body[1:17])
                    self.codes[body[0]] = _codes(body[1:17], body[17 : 17 + total])
                    body = body[17 + total :]
            elif marker == 0xC2:
                self.frame(body)
            elif marker == 0xDA:
                self.scan(body, data, fast)

    def frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        specs = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        self.most = max(s[1] for s in specs), max(s[2] for s in specs)
        for name, h, v, q in specs:
            columns = -(-(-(-self.width * h // self.most[0])) // 8)
            rows = -(-(-(-self.height * v // self.most[1])) // 8)
            self.parts.append({"name": name, "h": h, "v": v, "q": q, "rows": rows, "columns": columns, "coefs": np.zeros((rows * columns, 64), dtype=np.int16)})

    def scan(self, body: bytes, data: bytes, fast: bool) -> None:
        n = body[0]
        ss, se, approximation = body[1 + 2 * n : 4 + 2 * n]
        ah, al = approximation >> 4, approximation & 15
        chosen = [(next(p for p in self.parts if p["name"] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        if n > 1:
            return self.interleaved(chosen, data, ah, al)
        part, tables = chosen[0]
        coefs = part["coefs"]
        if ss == 0:
            return _dc_refine(coefs, data, al) if ah else _dc_first(coefs, data, self.codes[tables >> 4], al, fast)
        codes = self.codes[0x10 | tables & 15]
        return (_ac_refine if ah else _ac_first)(coefs, data, codes, ss, se, al, fast)

    def interleaved(self, chosen: list, data: bytes, ah: int, al: int) -> None:
        """A DC scan of several components; padding blocks outside a component are read and dropped."""
        bits, values = _Bits(data), [0] * len(chosen)
        for row in range(-(-self.height // (8 * self.most[1]))):
            for column in range(-(-self.width // (8 * self.most[0]))):
                for i, (part, tables) in enumerate(chosen):
                    for y in range(row * part["v"], (row + 1) * part["v"]):
                        for x in range(column * part["h"], (column + 1) * part["h"]):
                            if ah:
                                value = bits.bit() << al
                            else:
                                values[i] += bits.signed(bits.symbol(self.codes[tables >> 4]))
                                value = values[i] << al
                            if y < part["rows"] and x < part["columns"]:
                                part["coefs"][y * part["columns"] + x, 0] |= value

    def payload(self) -> bytes:
        """The bytes that store() was given."""
        length, out = int(self.comment.removeprefix(b"payload=")), []
        for part in self.parts:
            coefs = part["coefs"]
            block = np.where(coefs < 0, coefs + 255, coefs)
            block[:, 0] = np.abs(coefs[:, 0]) - 256
            out.append(block.astype(np.uint8).tobytes())
        return b"".join(out)[:length]

    def plane(self, part: dict) -> np.ndarray:
        """The inverse transform of a component, as floats around 0."""
        natural = np.empty(part["coefs"].shape, dtype=np.float32)
        natural[:, ZIGZAG] = part["coefs"] * self.quantisers[part["q"]]
        rows = natural.reshape(-1, 8) @ COSINES
        both = rows.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ COSINES
        tiles = both.reshape(part["rows"], part["columns"], 8, 8)
        return tiles.transpose(0, 3, 1, 2).reshape(part["rows"] * 8, part["columns"] * 8)

    def rgb(self) -> np.ndarray:
        """height x width x 3 bytes, chroma repeated to full resolution."""
        planes = []
        for part in self.parts:
            plane = self.plane(part)
            for axis, factor in ((0, self.most[1] // part["v"]), (1, self.most[0] // part["h"])):
                plane = np.repeat(plane, factor, axis=axis) if factor > 1 else plane
            planes.append(plane[: self.height, : self.width])
        y = planes[0] + np.float32(128)
        cb, cr = planes[1:] if len(planes) == 3 else (np.float32(0), np.float32(0))
        out = np.empty((self.height, self.width, 3), dtype=np.uint8)
        for i, channel in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            out[..., i] = np.clip(np.rint(channel), 0, 255)
        return out


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes with zeros up to a positive multiple of 64."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def feature(rgb: np.ndarray) -> str:
    """Size, sum of each channel and checksum of a tensor."""
    sums = ",".join(str(int(s)) for s in rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64))
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{sums}:{zlib.crc32(rgb):08x}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        made = [padded(t) for t in piece["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array([n for n, _ in made], pa.int64()), pa.array([store(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "media"):
        images = [Image(m) for m in piece["media"].to_pylist()]
        columns = [piece["doc_id"], pa.array([i.payload() for i in images], pa.binary()), *(pa.array([getattr(i, side) for i in images], pa.int32()) for side in ("height", "width"))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([i.rgb().tobytes() for i in images], pa.binary())], names=["doc_id", "payload", "height", "width", "rgb"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "media"):
        rows = []
        for media in piece["media"].to_pylist():
            image = Image(media)
            payload = image.payload()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(image.rgb())))
        kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
        found = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["n_bytes"], *found], names=["doc_id", "n_bytes", *kinds])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary), one row for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts are 64 zero bytes. Equal texts give equal files; repeated rows stay; a null doc_id stays
    null; an empty table gives an empty result. A text may be as long as a value of Spark lets its file be, 2 GB.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """doc_id, payload (binary), height, width and rgb (binary, height x width x 3) of a table with doc_id and media."""
    return media.select("doc_id", "media").mapInArrow(_decoded, "doc_id long, payload binary, height int, width int, rgb binary")


def digests(media: DataFrame) -> DataFrame:
    """What from_media() reads back of each file, as lengths, checksums and a feature string."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digested, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written to the shared folder, compressed there as their scans are of one symbol length, and read back."""
    return digests(materialize(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", "zstd"))


ORACLE_SQL = None
