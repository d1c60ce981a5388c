"""Facts about image files from their bytes: format, size, channels, orientation, digest, and a gradient hash of PNG
files. No image library is needed: headers are read, and PNG data is unfiltered with numpy."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path STRING, ok BOOLEAN, format STRING, width INT, height INT, channels INT, orientation INT, sha256 STRING, dhash BIGINT, error STRING"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of an 8-bit PNG without interlacing; palette images give their indices."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, head, body = 8, None, b""
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("8-bit PNG without interlacing expected")
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w, c), np.int32)
    above = np.zeros((w, c), np.int32)
    for y in range(h):
        line, kind = raw[y, 1:].reshape(w, c).astype(np.int32), raw[y, 0]
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind in (3, 4):
            left, corner = np.zeros(c, np.int32), np.zeros(c, np.int32)
            for x in range(w):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
                left = line[x] = (line[x] + guess) & 255
                corner = up
        out[y] = above = line
    return out.astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of grey (height, width) or colour (height, width, 3) pixels."""
    p = np.ascontiguousarray(pixels, np.uint8)
    if p.ndim not in (2, 3) or (p.ndim == 3 and p.shape[2] != 3):
        raise ValueError("grey or three channels expected")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = p.reshape(p.shape[0], -1)
    body = zlib.compress(np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes())
    head = struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, 0 if p.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def encode_lines(lines: DataFrame) -> DataFrame:
    """``(index, content)`` of rows ``(index, height, width, pixels)``: PNG bytes, for ``compaction.write_bundles`` or any sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [encode_png(np.frombuffer(px, np.uint8).reshape(h, w)) for h, w, px in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["index", "content"])

    return lines.select("index", "height", "width", "pixels").mapInArrow(run, "index BIGINT, content BINARY")


def gray(pixels: np.ndarray) -> np.ndarray:
    p = pixels.astype(np.float64)
    return p[..., 0] if p.shape[2] < 3 else p[..., 0] * 0.299 + p[..., 1] * 0.587 + p[..., 2] * 0.114


def shrink(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas."""

    def means(x: np.ndarray, n: int) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        at = np.linspace(0, x.shape[0], n + 1)
        low, part = np.minimum(at.astype(int), x.shape[0] - 1), at - np.minimum(at.astype(int), x.shape[0] - 1)
        upto = sums[low] + part[:, None] * x[low]
        return np.diff(upto, axis=0) / (x.shape[0] / n)

    return means(means(a, height).T, width).T


def gradient_hash(pixels: np.ndarray) -> int:
    """64 bits: cells of an 8 x 9 thumbnail that are brighter than the one to their right, as a signed number."""
    t = shrink(gray(pixels), 8, 9)
    bits = (t[:, :-1] > t[:, 1:]).ravel()
    v = int("".join("1" if b else "0" for b in bits), 2)
    return v - (1 << 64) if v >= 1 << 63 else v


def inspect(data: bytes) -> dict:
    """Facts of one file; what can't be decoded has ``ok`` false and the reason."""
    out: dict = {"ok": True, "sha256": hashlib.sha256(data).hexdigest()}
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h = struct.unpack(">II", data[16:24])
            out |= {"format": "PNG", "width": w, "height": h, "channels": _CHANNELS[data[25]], "dhash": gradient_hash(decode_png(data))}
        elif data[:2] == b"\xff\xd8":
            out |= {"format": "JPEG"} | _jpeg(data)
            if not _whole(data):  # pixels aren't decoded, but a file that was cut off has no end
                out |= {"ok": False, "error": "Truncated"}
        elif data[:2] == b"BM":
            w, h, _, bits = struct.unpack("<iiHH", data[18:30])
            out |= {"format": "BMP", "width": w, "height": abs(h), "channels": bits // 8}
        else:
            raise ValueError("unknown format")
    except Exception as e:
        out |= {"ok": False, "error": type(e).__name__, "width": 0, "height": 0, "dhash": None}
    return out


def _jpeg(data: bytes) -> dict:
    at, orientation = 2, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            orientation = _orientation(data[at + 10 : at + 2 + n])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w, c = struct.unpack(">HHB", data[at + 5 : at + 10])
            return {"width": w, "height": h, "channels": c, "orientation": orientation}
        at += 2 + n
    raise ValueError("no frame")


def _whole(data: bytes) -> bool:
    """Whether a JPEG file has a scan and an end after it."""
    scan = data.find(b"\xff\xda")
    return scan >= 0 and data.rfind(b"\xff\xd9") > scan


def upright(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """Pixels as they are meant to be seen, by the orientation 1 to 8 of the file's tags; others leave them as they are."""
    k = (orientation or 1) - 1
    if not 0 < k < 8:
        return pixels
    if k >= 4:
        pixels = pixels.swapaxes(0, 1)
    down, across = ((0, 0), (0, 1), (1, 1), (1, 0))[k % 4]
    return pixels[:: -1 if down else 1, :: -1 if across else 1]


def as_rgb(pixels: np.ndarray) -> np.ndarray:
    """Three channels of bytes: grey repeated, transparency dropped."""
    a = pixels[..., None] if pixels.ndim == 2 else pixels
    return np.repeat(a[..., :1], 3, axis=2) if a.shape[2] < 3 else a[..., :3]


def _orientation(tiff: bytes) -> int | None:
    e = "<" if tiff[:2] == b"II" else ">"
    at = struct.unpack(e + "I", tiff[4:8])[0]
    for i in range(struct.unpack(e + "H", tiff[at : at + 2])[0]):
        tag, _, _, value = struct.unpack(e + "HHIH", tiff[at + 2 + 12 * i : at + 12 + 12 * i])
        if tag == 0x0112:
            return value
    return None


def inspect_images(files: DataFrame) -> DataFrame:
    """One row of facts per row of ``files (path, content)``, in Arrow batches; failures are rows too."""
    types = {"path": pa.string(), "ok": pa.bool_(), "format": pa.string(), "width": pa.int32(), "height": pa.int32(), "channels": pa.int32(), "orientation": pa.int32(), "sha256": pa.string(), "dhash": pa.int64(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p} | inspect(bytes(d or b"")) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in types.items()], names=list(types))

    return files.select("path", "content").mapInArrow(run, SCHEMA)
