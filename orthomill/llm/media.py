"""GIF media columns: read, write, and describe animated images.

The reader decodes LZW code streams (clear and end codes, growing widths, codes defined by
themselves), global and local palettes, interlacing, graphic control blocks (delay,
transparency, disposal) and composes frames on the canvas. Frames come out with their time
and a colour histogram of the composed picture.

Defined results: null texts count as empty; a payload is never empty (64 zero bytes at
least); a damaged or empty stream gives no frames (``media_frames`` returns no row for it)
and a truncated one the frames that are whole; equal bytes give equal values; every row of
the input gives its rows again if repeated; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

WIDTH, ROWS = 64, 1024
#: Colour i has 8 levels of red and green, in its highest and next three bits, and 4 of blue, in its lowest two.
PALETTE = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))


@lru_cache(maxsize=16)
def code_widths(bits: int, n: int = 4200) -> np.ndarray:
    """Width of each code after a clear code; the table starts at 2 ** bits + 2 entries and lags one code."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(entries)).astype(np.int64) + 1))


@lru_cache(maxsize=16)
def code_places(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bit, bit after the last, and mask of each code after a clear code."""
    width = code_widths(bits)
    ends = np.cumsum(width)
    return ends - width, ends, (1 << width).astype(np.uint32) - 1


@lru_cache(maxsize=16)
def written_bits(bits: int) -> np.ndarray:
    """Which of 16 bits are written of each code after a clear code."""
    return np.arange(16) < code_widths(bits)[:, None]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    clear, first = 1 << bits, (1 << bits) + 2
    codes, starts = [clear], [0, 1]
    append, table, free = codes.append, {}, first
    if data:
        cur = data[0]
        for b in data[1:]:
            key = cur << 8 | b
            if key in table:
                cur = table[key]
                continue
            append(cur)
            cur = b
            if free < 4096:
                table[key] = free
                free += 1
            else:
                append(clear)
                starts.append(len(codes))
                table, free = {}, first
        append(cur)
    append(clear + 1)
    ends = [*starts[1:], len(codes)]
    every = written_bits(bits)
    parts = [every[: b - a] for a, b in zip(starts, ends)]
    held = np.unpackbits(np.array(codes, "<u2").view(np.uint8), bitorder="little").reshape(-1, 16)
    return np.packbits(held[np.concatenate(parts)], bitorder="little").tobytes()


def expand(codes: np.ndarray, bits: int) -> np.ndarray:
    """Samples of the codes after one clear code.

    Entry e was defined by code number e - first and the sample that follows it, so its samples
    stand in the output where that code's do, and one further. Lengths and samples are found by
    jumping along these references, halving their depth each time; a code that refers to no
    earlier one is damage, and the samples before it count.
    """
    clear, first = 1 << bits, (1 << bits) + 2
    codes = codes.astype(np.int32)
    number = np.arange(len(codes), dtype=np.int32)
    literal = codes < clear
    back = np.where(literal, number, codes - first)
    bad = np.flatnonzero((back >= number) & ~literal)
    if len(bad):
        codes, number, literal, back = (x[: bad[0]] for x in (codes, number, literal, back))
    length, jump = (~literal).astype(np.int32), back
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        length, jump = length + length[jump], further
    length += 1
    ends = np.cumsum(length)
    start = ends - length
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total, dtype=np.int32) - np.repeat((start - start[back]).astype(np.int32), length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    samples = np.zeros(total, np.uint8)
    samples[start] = np.where(literal, codes, 0)
    return samples[source]


def lzw_decode(data: bytes, bits: int, limit: int) -> bytes:
    """At most ``limit`` samples; a damaged stream gives those before the damage."""
    clear = 1 << bits
    firsts, ends, masks = code_places(bits)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    raw = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, bit, out, size = len(data) * 8, 0, [], 0
    held: list[np.ndarray] = []  # codes since the last clear code, when a stream goes on with a full table
    while size < limit:
        if held:
            n = min(len(ends), (total - bit) // 12)
            at, mask, after = bit + 12 * np.arange(n), np.uint32(4095), bit + 12 * n
        else:
            n = int(np.searchsorted(ends, total - bit, "right"))
            at, mask, after = bit + firsts[:n], masks[:n], bit + (int(ends[n - 1]) if n else 0)
        read = raw[at >> 3] >> (at & 7).astype(np.uint32) & mask
        stop = np.flatnonzero((read == clear) | (read == clear + 1))
        held.append(read[: int(stop[0]) if len(stop) else n])
        if n and not len(stop):
            bit = after
            continue
        samples = expand(np.concatenate(held), bits)
        out.append(samples.tobytes())
        size += len(samples)
        if not n or read[stop[0]] == clear + 1:
            break
        last = int(stop[0])
        bit, held = (int(at[last + 1]) if last + 1 < n else after), []
    return b"".join(out)[:limit]


def write_gif(frames: list[dict], width: int, height: int, palette: bytes = PALETTE) -> bytes:
    """frames: dicts with indices, width, height and optionally left, top, delay, disposal, transparent, palette."""
    bits = max(1, (len(palette) // 3 - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 7 << 4 | bits - 1, 0, 0), palette.ljust(3 << bits, b"\0")]
    for f in frames:
        transparent = f.get("transparent")
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.get("disposal", 1) << 2 | (transparent is not None), f.get("delay", 4), transparent or 0, 0))
        own = f.get("palette")
        own_bits = max(1, (len(own) // 3 - 1).bit_length()) if own else 0
        out.append(b"," + struct.pack("<HHHHB", f.get("left", 0), f.get("top", 0), f["width"], f["height"], 0x80 | own_bits - 1 if own else 0))
        if own:
            out.append(own.ljust(3 << own_bits, b"\0"))
        depth = max(2, own_bits or bits)
        body = lzw_encode(f["indices"], depth)
        out.append(bytes([depth]))
        out += [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)]
        out.append(b"\0")
    return b"".join([*out, b";"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def read_gif(data: bytes) -> tuple[int, int, list[dict]]:
    """Canvas width and height, and the frames in order; ([], 0, 0)-like for what is no GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return 0, 0, []
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, shared, frames = 13, b"", []
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        shared, at = data[at : at + n], at + n
    control = (0, 0, None)
    while at < len(data):
        mark = data[at]
        if mark == 0x21 and at + 2 < len(data):
            block, label = None, data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                packed, delay, clear = struct.unpack("<BHB", block[:4])
                control = (packed >> 2 & 7, delay, clear if packed & 1 else None)
        elif mark == 0x2C and at + 11 <= len(data):
            left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = shared
            if packed & 0x80:
                n = 3 << (packed & 7) + 1
                palette, at = data[at : at + n], at + n
            if at >= len(data) or not 1 <= data[at] <= 11:
                break
            depth = data[at]
            body, at = _blocks(data, at + 1)
            samples = lzw_decode(body, depth, w * h)
            if len(samples) < w * h:
                break
            if packed & 0x40:  # interlaced: rows come in four passes
                rows = np.frombuffer(samples, np.uint8).reshape(h, w)
                order = np.concatenate([np.arange(s, h, step) for s, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(rows)
                straight[order] = rows
                samples = straight.tobytes()
            frames.append({"left": left, "top": top, "width": w, "height": h, "disposal": control[0], "delay": control[1], "transparent": control[2], "palette": palette, "indices": samples})
            control = (0, 0, None)
        else:
            break
    return width, height, frames


@lru_cache(maxsize=64)
def colours_of(palette: bytes) -> np.ndarray:
    """RGBA of each of 256 samples; those that the palette lacks are black."""
    colours = np.zeros((256, 4), np.uint8)
    rgb = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    colours[: len(rgb), :3], colours[:, 3] = rgb, 255
    return colours


def cells_of(rgb: np.ndarray) -> np.ndarray:
    """Colour cells: 4 levels for each of red, green and blue."""
    return (rgb[..., 0] >> 6) * 16 + (rgb[..., 1] >> 6) * 4 + (rgb[..., 2] >> 6)


@lru_cache(maxsize=64)
def shown_cells(palette: bytes) -> np.ndarray:
    """Colour cell of each of 256 samples, from 1; 0 is see-through."""
    return cells_of(colours_of(palette)) + np.uint8(1)


def compose(width: int, height: int, frames: list[dict], values=colours_of):
    """Yields each frame's canvas as it is shown, after palettes, transparency and disposal; ``values`` gives what a palette's samples stand for, RGBA by default."""
    canvas = np.zeros((height, width, *values(b"").shape[1:]), np.uint8)
    for f in frames:
        before = canvas.copy() if f["disposal"] == 3 else None
        x, y = f["left"], f["top"]
        part = canvas[y : y + f["height"], x : x + f["width"]]
        indices = np.frombuffer(f["indices"], np.uint8).reshape(f["height"], f["width"])[: part.shape[0], : part.shape[1]]
        colours = values(f["palette"])
        if f["transparent"] is None:
            part[...] = colours[indices]
        else:
            seen = indices != f["transparent"]
            part[seen] = colours[indices[seen]]
        yield canvas.copy()
        if f["disposal"] == 2:
            part[...] = 0
        elif f["disposal"] == 3:
            canvas = before


def histogram(rgba: np.ndarray) -> list[int]:
    """Pixels shown by colour: 4 levels for each of red, green and blue; see-through ones are left out."""
    return np.bincount(cells_of(rgba[rgba[..., 3] > 0]), minlength=64).tolist()


#: Frames of several files share a batch of about so many bytes.
BATCH_BYTES = 1_000_000


def media_frames(media: DataFrame, id_col="doc_id", media_col="media", pictures: bool = True) -> DataFrame:
    """One row per frame: its number, start and duration in ms, place, composed RGBA and colour histogram; without ``pictures`` no RGBA is made."""
    src = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    kind = src.schema["doc_id"].dataType.simpleString()
    named = {"frame": pa.int32(), "start_ms": pa.int64(), "duration_ms": pa.int64(), "width": pa.int32(), "height": pa.int32(), "rgba": pa.binary(), "histogram": pa.list_(pa.int64())}
    ddl = f"doc_id {kind}, frame int, start_ms long, duration_ms long, width int, height int, rgba binary, histogram array<long>"
    if not pictures:
        del named["rgba"]
        ddl = ddl.replace("rgba binary, ", "")

    def run(batches):
        for b in batches:
            owner, rows, size = [], [], 0

            def made():
                cols = list(zip(*rows)) or [()] * len(named)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int32())), *[pa.array(c, k) for c, k in zip(cols, named.values())]], ["doc_id", *named])

            for i, m in enumerate(b.column(1)):
                for *row, rgba, cells in timed_frames(*read_gif(m.as_py() or b""), pictures):
                    rows.append((*row, rgba.tobytes(), cells) if pictures else (*row, cells))
                    owner.append(i)
                    size += (rgba.nbytes if pictures else 0) + 600
                    if size >= BATCH_BYTES:
                        yield made()
                        owner, rows, size = [], [], 0
            yield made()

    return src.mapInArrow(run, ddl)


def as_gif(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as the samples of 64 pixel wide frames."""
    step = WIDTH * ROWS
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    return write_gif([{"indices": p, "width": WIDTH, "height": len(p) // WIDTH} for p in parts], WIDTH, len(parts[0]) // WIDTH)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled up with zeros to a positive multiple of 64, and how many are the text's."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def timed_frames(width: int, height: int, frames: list[dict], pictures: bool = True):
    """(number, start in ms, duration in ms, width, height, composed RGBA or None, colour histogram) of each frame."""
    at = 0
    for n, (f, shown) in enumerate(zip(frames, compose(width, height, frames, colours_of if pictures else shown_cells))):
        cells = histogram(shown) if pictures else np.bincount(shown.ravel(), minlength=65)[1:].tolist()
        yield n, at, f["delay"] * 10, width, height, shown if pictures else None, cells
        at += f["delay"] * 10


def digest(text: str | None) -> tuple:
    """What the stored form of a text holds; the feature lists its frames: start+duration in ms and pixels by colour cell."""
    payload, n = payload_of(text)
    media = as_gif(payload)
    width, height, frames = read_gif(media)
    back = b"".join(f["indices"] for f in frames)
    shown = [f"{at}+{ms}:" + ",".join(f"{cell}={pixels}" for cell, pixels in enumerate(cells) if pixels) for _, at, ms, _, _, _, cells in timed_frames(width, height, frames, False)]
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{width}x{height};" + ";".join(shown)


def stored_texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            cols = list(zip(*[digest(t.as_py()) for t in b.column(1)])) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string() if i in (2, 5, 6) else pa.int64()) for i, c in enumerate(cols)]], names)

    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_media(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and media: each whole text as a GIF."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_gif(payload_of(t.as_py())[0]) for t in b.column(1)], pa.binary())], ["doc_id", "media"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, media binary")


def gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of every stored text with its time, and the pixels it shows by colour cell (a row per cell that has any)."""
    frames = media_frames(text_media(table(spark, sf_dir, "documents")), pictures=False).select("doc_id", "frame", "start_ms", "duration_ms", "width", "height", F.posexplode("histogram").alias("cell", "pixels"))
    return frames.filter("pixels > 0")


#: A pixel shows its frame's sample, or where the last frame has no row the one before it. Cells follow from the palette's rule.
GIF_FRAMES_SQL = """
WITH p AS (SELECT doc_id, CASE WHEN octet_length(b) = 0 THEN repeat('00', 64) ELSE hex(b) || repeat('00', ((64 - octet_length(b) % 64) % 64)::INT) END AS x
           FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)),
n AS (SELECT doc_id, x, (length(x) // 2)::BIGINT AS n, least(65536, length(x) // 2)::BIGINT AS area FROM p),
f AS (SELECT doc_id, x, n, area, unnest(range(0, (n + 65535) // 65536)) AS frame FROM n),
q AS (SELECT *, unnest(range(0, area // 64)) AS line FROM f),
r AS (SELECT doc_id, frame, area, substr(x, (128 * (CASE WHEN 1024 * frame + line < n // 64 THEN 1024 * frame + line ELSE 1024 * (frame - 1) + line END) + 1)::BIGINT, 128) AS h FROM q),
v AS (SELECT doc_id, frame, area, ('0x' || substr(h, (2 * p + 1)::BIGINT, 2))::INT AS i FROM r, range(0, 64) t(p))
SELECT doc_id, frame::INT AS frame, frame * 40 AS start_ms, 40::BIGINT AS duration_ms, 64 AS width, (area // 64)::INT AS height,
       (((i >> 5) * 255 // 7 >> 6) * 16 + (((i >> 2) & 7) * 255 // 7 >> 6) * 4 + ((i & 3) * 85 >> 6))::INT AS cell, count(*)::BIGINT AS pixels
FROM v GROUP BY doc_id, frame, area, cell
"""


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(table(spark, sf_dir, "documents"))
