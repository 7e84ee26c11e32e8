"""PNG pictures as grey values: every sample depth and kind of colour, interlaced or not."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: channels and sample depths by kind of colour, and the seven passes as (first column, first row, column step, row step).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class PngError(ValueError):
    """Why a file is no picture."""


def chunks(data: bytes):
    """Names and contents up to the end chunk; damaged ones are an error."""
    if data[:8] != SIGNATURE:
        raise PngError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", data[at + 8 + size : at + 12 + size].ljust(4, b"\0"))[0] != zlib.crc32(name + body):
            raise PngError(f"damaged {name.decode('latin-1')} chunk")
        yield name, body
        if name == b"IEND":
            return
        at += 12 + size
    raise PngError("the file ends early")


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line without its filter: none, left, above, their mean, or whichever of left, above and corner is nearest to left + above - corner."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        padded = np.zeros(-(-len(line) // step) * step, np.uint8)
        padded[: len(line)] = line
        return np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind > 4:
        raise PngError(f"unknown filter {kind}")
    values, upper, out = line.tolist(), above.tolist(), []
    for i, v in enumerate(values):
        a, b, c = (out[i - step], upper[i], upper[i - step]) if i >= step else (0, upper[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((v + guess) & 255)
    return np.array(out, np.uint8)


def samples(line: np.ndarray, depth: int, count: int) -> np.ndarray:
    """The first ``count`` samples of a line's bytes, the high bits first."""
    if depth == 16:
        return line.view(">u2").astype(np.int64)[:count]
    if depth == 8:
        return line.astype(np.int64)[:count]
    bits = np.unpackbits(line).reshape(-1, depth)
    return (bits @ (1 << np.arange(depth)[::-1]))[:count]


def passes(width: int, height: int, interlaced: bool) -> list[tuple[int, int, int, int]]:
    """Those passes of a picture that have pixels."""
    return [p for p in (PASSES if interlaced else ((0, 0, 1, 1),)) if p[0] < width and p[1] < height]


def decode_png(data: bytes) -> np.ndarray:
    """Grey values in [0, 1], (height, width); PngError says why there are none. Transparency is ignored."""
    head, body, palette = None, [], None
    for name, content in chunks(data):
        if name == b"IHDR":
            if len(content) != 13:
                raise PngError("a header of another length")
            head = struct.unpack(">IIBBBBB", content)
        elif name == b"IDAT":
            body.append(content)
        elif name == b"PLTE":
            palette = np.frombuffer(content[: len(content) // 3 * 3], np.uint8).reshape(-1, 3)
    if head is None:
        raise PngError("no header")
    width, height, depth, kind, _, _, interlace = head
    if not width or not height or depth not in DEPTHS.get(kind, ()) or interlace > 1:
        raise PngError(f"no such picture: {width} x {height}, depth {depth}, kind {kind}")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise PngError("damaged data") from e
    channels = CHANNELS[kind]
    step, out, at = max(1, channels * depth // 8), np.zeros((height, width, channels), np.int64), 0
    for x0, y0, dx, dy in passes(width, height, bool(interlace)):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        size = -(-w * channels * depth // 8)
        if at + h * (size + 1) > len(raw):
            raise PngError("the data ends early")
        above = np.zeros(size, np.uint8)
        for y in range(h):
            above = unfiltered(int(raw[at]), raw[at + 1 : at + 1 + size], above, step)
            out[y0 + y * dy, x0::dx] = samples(above, depth, w * channels).reshape(w, channels)
            at += size + 1
    if kind == 3:
        if palette is None or out.max() >= len(palette):
            raise PngError("a colour that the palette hasn't")
        out, depth = palette[out[..., 0]].astype(np.int64), 8
    grey = out[..., 0] if out.shape[2] < 3 else out[..., :3] @ np.array([0.299, 0.587, 0.114])
    return grey / (2.0**depth - 1)


def read_pictures(spark: SparkSession, path: str, m: int, n: int, pattern: str = "*.png") -> DataFrame:
    """path, re and error: the centre of each image file as a grey column-major picture of 2^m x 2^n, or why there is none."""
    h, w = 2**m, 2**n
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("content"))

    def run(batches):
        for b in batches:
            out, why = [], []
            for content in b.column(1):
                try:
                    x = decode_png(content.as_py())
                    if x.shape[0] < h or x.shape[1] < w:
                        raise PngError(f"smaller than {h} x {w}")
                    top, left = (x.shape[0] - h) // 2, (x.shape[1] - w) // 2
                    out.append(x[top : top + h, left : left + w].ravel(order="F"))
                    why.append(None)
                except PngError as e:
                    out.append(None)
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64())), pa.array(why, pa.string())], ["path", "re", "error"])

    return files.mapInArrow(run, "path string, re array<double>, error string")
