"""Operators that are sequential within one image: Arrow-backed functions per image.

Each group is one image (or its histogram of at most 32,768 bins), so its size is
bounded by the image and not by the table.
"""

from __future__ import annotations

import heapq
import struct
import time
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .pixels import OFFSETS

CH = ("r", "g", "b")


def _box(bins: np.ndarray, counts: np.ndarray):
    """(rank, edge lengths) of a box of colours."""
    edge = bins.max(0) - bins.min(0)
    return int(counts.sum()) * int(np.prod(edge)), edge


def median_cut(bins: np.ndarray, counts: np.ndarray, n: int) -> list[tuple[tuple[int, int, int], int]]:
    """Up to n (colour, count), by falling count; ties go by colour.

    The box of the highest rank (count times volume; ties: larger count, then lower
    colour) is sorted by its longest channel, then by bin, and split before the first
    colour that has at least half of the count, rounded down, before it. A box of one
    colour is never split: that would only add an empty box.
    """
    if not len(bins):
        return []
    made = 0

    def entry(b: np.ndarray, c: np.ndarray):
        nonlocal made
        made += 1
        return (-_box(b, c)[0], -int(c.sum()), tuple(b.min(0).tolist()), made, b, c)

    heap, done = [entry(bins, counts)], []
    while heap and len(heap) + len(done) < n:
        *_, b, c = heapq.heappop(heap)
        if len(b) < 2:
            done.append((b, c))
            continue
        axis = int(np.argmax(_box(b, c)[1]))
        order = np.lexsort((b[:, 0], b[:, 1], b[:, 2], b[:, axis]))
        b, c = b[order], c[order]
        before = np.cumsum(c) - c
        at = min(max(int(np.searchsorted(before, c.sum() // 2)), 1), len(b) - 1)
        for part in (slice(None, at), slice(at, None)):
            heapq.heappush(heap, entry(b[part], c[part]))
    boxes = done + [(e[4], e[5]) for e in heap]
    found = [(tuple(int(x) for x in (b * c[:, None]).sum(0) // c.sum()), int(c.sum())) for b, c in boxes]
    return sorted(found, key=lambda f: (-f[1], f[0]))


def extract_palette(hist: DataFrame, n: int = 6) -> DataFrame:
    """img_id, rank, hex, n of each image's palette, from its 15-bit histogram."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = pdf["bin"].to_numpy()
        bins = np.stack([b % 32 * 8, b // 32 % 32 * 8, b // 1024 * 8], 1)
        got = median_cut(bins, pdf["n"].to_numpy(), n)
        return pd.DataFrame([(pdf["img_id"].iloc[0], i + 1, "#%02X%02X%02X" % c, k) for i, (c, k) in enumerate(got)], columns=["img_id", "rank", "hex", "n"])

    return hist.groupBy("img_id").applyInPandas(run, "img_id long, rank int, hex string, n long")


def _raster(pdf: pd.DataFrame, cols=(*CH, "a")) -> np.ndarray:
    img = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, len(cols)))
    img[pdf["y"], pdf["x"]] = pdf[list(cols)].to_numpy()
    return img


def _pixels(img_id, img: np.ndarray) -> pd.DataFrame:
    h, w = img.shape[:2]
    y, x = np.divmod(np.arange(h * w), w)
    flat = np.clip(img, 0, 255).astype(int).reshape(h * w, -1)
    return pd.DataFrame({"img_id": img_id, "x": x, "y": y} | {c: flat[:, k] for k, c in enumerate((*CH, "a"))})


PIXELS = "img_id long, x int, y int, r int, g int, b int, a int"


def diffuse(img: np.ndarray) -> np.ndarray:
    """Floyd-Steinberg error diffusion of (h, w, 3) to multiples of 51.

    A pixel waits for its left neighbour and for three above, so all pixels with equal
    x + 2 y are worked on together.
    """
    h, w = img.shape[:2]
    out = np.zeros((h + 1, w + 2, 3))  # a margin takes what leaves the image
    out[:h, 1:w + 1] = img
    for step in range(w + 2 * (h - 1)):
        y = np.arange(max(0, (step - w + 2) // 2), min(h - 1, step // 2) + 1)
        x = step - 2 * y + 1
        old = out[y, x]
        new = np.clip(np.floor(old / 51 + 0.5), 0, 5) * 51
        err = old - new
        out[y, x] = new
        for dx, dy, share in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
            inside = (x + dx >= 1) & (x + dx <= w) & (y + dy < h)
            out[y[inside] + dy, x[inside] + dx] += err[inside] * share / 16
    return out[:h, 1:w + 1]


def dither(px: DataFrame) -> DataFrame:
    """Floyd-Steinberg error diffusion to the 216 web-safe colours."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = _raster(pdf)
        img[:, :, :3] = diffuse(img[:, :, :3])
        return _pixels(pdf["img_id"].iloc[0], img)

    return px.groupBy("img_id").applyInPandas(run, PIXELS)


def _kernel(method: str):
    if method == "lanczos":
        return 3.0, lambda t: np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
    if method == "catmullrom":
        def cubic(t):
            t = np.abs(t)
            return np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
        return 2.0, cubic
    raise ValueError(f"unknown resize method {method}")


def weights(size: int, new: int, method: str) -> np.ndarray:
    """Row-stochastic resampling matrix (new x size)."""
    support, f = _kernel(method)
    scale = max(size / new, 1.0)
    centre = (np.arange(new) + 0.5) * size / new - 0.5
    m = f((np.arange(size)[None] - centre[:, None]) / scale)
    return m / m.sum(1, keepdims=True)


def resize(px: DataFrame, width: int, height: int, method: str = "lanczos") -> DataFrame:
    """Resample every image; one zero keeps the aspect ratio, two change nothing."""
    if width < 0 or height < 0:
        raise ValueError("sizes must not be negative")
    _kernel(method)
    if not width and not height:
        return px

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = _raster(pdf)
        h, w = img.shape[:2]
        nw, nh = width or max(1, round(w * height / h)), height or max(1, round(h * width / w))
        out = np.einsum("ij,jkc->ikc", weights(h, nh, method), img)
        out = np.einsum("ij,kjc->kic", weights(w, nw, method), out)
        return _pixels(pdf["img_id"].iloc[0], np.floor(out + 0.5))

    return px.groupBy("img_id").applyInPandas(run, PIXELS)


def resize_padded(px: DataFrame, width: int, height: int) -> DataFrame:
    """Every image scaled to fit (Catmull-Rom) and centred on a transparent ground."""
    if width < 1 or height < 1:
        raise ValueError("sizes must be positive")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pixels(pdf["img_id"].iloc[0], padded(_raster(pdf), width, height))

    return px.groupBy("img_id").applyInPandas(run, PIXELS)


def resize_padded_to(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """``resize_padded`` of every image to a size of its own: sizes (img_id, cw, ch)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pixels(pdf["img_id"].iloc[0], padded(_raster(pdf), int(pdf["cw"].iloc[0]), int(pdf["ch"].iloc[0])))

    return px.join(sizes, "img_id").groupBy("img_id").applyInPandas(run, PIXELS)


def covering(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image scaled (Lanczos) to cover a size, its centre cut out."""
    h, w = img.shape[:2]
    ratio = max(width / w, height / h)
    nw, nh = max(width, round(w * ratio)), max(height, round(h * ratio))
    out = np.einsum("ij,jkc->ikc", weights(h, nh, "lanczos"), img.astype(float))
    out = np.clip(np.floor(np.einsum("ij,kjc->kic", weights(w, nw, "lanczos"), out) + 0.5), 0, 255)
    y, x = (nh - height) // 2, (nw - width) // 2
    return out[y:y + height, x:x + width]


def cover(px: DataFrame, width: int, height: int) -> DataFrame:
    """Every image scaled and cut to cover width x height."""
    if width < 1 or height < 1:
        raise ValueError("sizes must be positive")
    return px.groupBy("img_id").applyInPandas(lambda pdf: _pixels(pdf["img_id"].iloc[0], covering(_raster(pdf), width, height)), PIXELS)


def padded(img: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = img.shape[:2]
    ratio = min(width / w, height / h)
    nw, nh = max(1, int(w * ratio)), max(1, int(h * ratio))
    small = np.einsum("ij,jkc->ikc", weights(h, nh, "catmullrom"), img)
    small = np.clip(np.floor(np.einsum("ij,kjc->kic", weights(w, nw, "catmullrom"), small) + 0.5), 0, 255)
    out = np.zeros((height, width, img.shape[2]))
    y, x = (height - nh) // 2, (width - nw) // 2
    out[y:y + nh, x:x + nw] = small
    return out


def bilinear(img: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Samples of (h, w, c) at positions inside the image, transparent elsewhere. The
    four neighbours are weighted in 16 bits and cut to 8."""
    h, w, channels = img.shape
    out = np.zeros((*sx.shape, channels))
    ok = (sx >= 0) & (sx < w - 1) & (sy >= 0) & (sy < h - 1)
    x, y = sx[ok], sy[ok]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[:, None], (y - y0)[:, None]
    wide = img * 257.0
    top = wide[y0, x0] * (1 - fx) + wide[y0, x0 + 1] * fx
    low = wide[y0 + 1, x0] * (1 - fx) + wide[y0 + 1, x0 + 1] * fx
    out[ok] = np.floor((top * (1 - fy) + low * fy) / 256)
    return out


def turned_size(w: int, h: int, degrees: float) -> tuple[int, int]:
    """Size of the canvas that holds an image turned about its centre."""
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    xs = [x * cos - y * sin for x in (-w / 2, w / 2) for y in (-h / 2, h / 2)]
    ys = [x * sin + y * cos for x in (-w / 2, w / 2) for y in (-h / 2, h / 2)]
    return int(max(xs) - min(xs) + 1), int(max(ys) - min(ys) + 1)


def turned(img: np.ndarray, degrees: float) -> np.ndarray:
    h, w = img.shape[:2]
    nw, nh = turned_size(w, h, degrees)
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[0:nh, 0:nw]
    x, y = x - nw / 2, y - nh / 2
    return bilinear(img, x * cos + y * sin + w / 2, -x * sin + y * cos + h / 2)


def rotate(px: DataFrame, degrees: float) -> DataFrame:
    """Every image turned clockwise about its centre, on the whole canvas."""
    return px.groupBy("img_id").applyInPandas(lambda pdf: _pixels(pdf["img_id"].iloc[0], turned(_raster(pdf), degrees)), PIXELS)


FOCAL = 1500.0


def check_tilt(tx: float, ty: float, scale: float, radius: float = 0.0) -> None:
    if not 0 < scale <= 1 or radius < 0 or np.hypot(tx, ty) > 30 - 15 * scale:
        raise ValueError("tilt is too strong for this scale")


def tilted(img: np.ndarray, tx: float, ty: float, scale: float) -> np.ndarray:
    """The image seen tilted, on a canvas 2.5 times its size; only points before the
    camera are drawn."""
    h, w = img.shape[:2]
    nw, nh = int(w * 2.5), int(h * 2.5)
    cx, sx, cy, sy = np.cos(np.radians(tx)), np.sin(np.radians(tx)), np.cos(np.radians(ty)), np.sin(np.radians(ty))
    y, x = np.mgrid[0:nh, 0:nw]
    dx, dy = x - nw / 2, y - nh / 2
    z = dx * sy + dy * -sx * cy + FOCAL * cx * cy
    seen = z > 0
    factor = FOCAL / np.where(seen, z, 1.0) * scale
    at_x = (dx * cy + dy * sx * sy + FOCAL * -sy) / factor + w / 2
    at_y = (dy * cx + FOCAL * sx) / factor + h / 2
    return bilinear(img, np.where(seen, at_x, -1.0), at_y)


def tilt(px: DataFrame, tx: float, ty: float, scale: float = 1.0) -> DataFrame:
    """Perspective tilt of every image, on the whole canvas."""
    check_tilt(tx, ty, scale)
    return px.groupBy("img_id").applyInPandas(lambda pdf: _pixels(pdf["img_id"].iloc[0], tilted(_raster(pdf), tx, ty, scale)), PIXELS)


# The presets of the tilt effect (ground from and to, tilt x, y, turn, scale, radius).
TILTS = {
    "": ((18, 18, 18), (40, 40, 40), 5.0, -8.0, 3.0, 0.65, 40.0),
    "p1": ((0, 0, 0), (40, 40, 40), 5.0, -8.0, 3.0, 0.70, 40.0),
    "p2": ((0, 0, 0), (40, 40, 40), -5.0, 8.0, -4.0, 0.70, 40.0),
    "p3": ((240, 240, 245), (200, 200, 210), 5.0, -8.0, 0.0, 0.60, 40.0),
    "p4": ((240, 240, 245), (200, 200, 210), 10.0, 5.0, 0.0, 0.70, 40.0),
}


def rounded(img: np.ndarray, radius: float) -> np.ndarray:
    """Corners made transparent, with the cover of 4 x 4 samples near the edge; eight
    of the sixteen count as full cover."""
    h, w = img.shape[:2]
    y, x = np.mgrid[0:h, 0:w].astype(float)
    left, top = x < radius, y < radius
    corner = (left | (x > w - radius)) & (top | (y > h - radius))
    dx = np.where(left, x - radius, x - (w - radius))
    dy = np.where(top, y - radius, y - (h - radius))
    d2 = dx * dx + dy * dy
    samples = sum((dx + i) ** 2 + (dy + j) ** 2 <= radius * radius for i in OFFSETS for j in OFFSETS)
    edge = corner & (np.sqrt(d2) > radius - 4)
    gone = corner & (d2 > radius * radius) | edge & (samples == 0)
    out = img.copy()
    out[..., 3] = np.where(edge & (samples < 8), np.floor(out[..., 3] * samples / 8), out[..., 3])
    out[gone] = 0
    return out


def tilt_effect(px: DataFrame, preset: str = "", width: int = 1920, height: int = 1080, background: bytes | None = None) -> DataFrame:
    """Rounded, turned, tilted and trimmed images, centred on a diagonal gradient, or on a
    background image (the bytes of a PNG) that covers the size."""
    if preset not in TILTS:
        raise ValueError(f"unknown preset {preset}")
    start, end, tx, ty, tz, scale, radius = TILTS[preset]
    check_tilt(tx, ty, scale, radius)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = rounded(_raster(pdf), radius)
        img = tilted(turned(img, tz) if tz else img, tx, ty, scale)
        ground = gradient_ground(start, end, width, height) if background is None else covering(read_png(background), width, height)
        return _pixels(pdf["img_id"].iloc[0], centred(trimmed(img), ground))

    return px.groupBy("img_id").applyInPandas(run, PIXELS)


def gradient_ground(start: tuple, end: tuple, width: int, height: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    t = ((x + y) / (width + height))[..., None]
    colours = np.floor(np.array(start) * (1 - t) + np.array(end) * t)
    return np.concatenate([colours, np.full((height, width, 1), 255.0)], axis=2)


def trimmed(img: np.ndarray) -> np.ndarray:
    """The part with alpha; one empty pixel where there is none."""
    ys, xs = np.nonzero(img[..., 3])
    return img[ys.min():ys.max() + 1, xs.min():xs.max() + 1] if len(ys) else np.zeros((1, 1, 4))


def centred(img: np.ndarray, ground: np.ndarray) -> np.ndarray:
    """Source-over of an image with multiplied alpha on the centre of an opaque ground;
    what reaches beyond is cut off."""
    out = ground.copy()
    (h, w), (gh, gw) = img.shape[:2], ground.shape[:2]
    y, x = int((gh - h) / 2), int((gw - w) / 2)
    part = img[max(0, -y):gh - y, max(0, -x):gw - x]
    y, x = max(0, y), max(0, x)
    under = out[y:y + part.shape[0], x:x + part.shape[1]]
    # 16-bit arithmetic on whole numbers: source + ground * (1 - alpha)
    rest = 65535 - part[..., 3:].astype(np.int64) * 257
    under[...] = (part.astype(np.int64) * 257 + under.astype(np.int64) * 257 * rest // 65535) >> 8
    return out


def png_bytes(img: np.ndarray, level: int = 1) -> bytes:
    """A PNG of an RGBA array (h, w, 4)."""
    h, w = img.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in img.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def encode_png(px: DataFrame, level: int = 1) -> DataFrame:
    """img_id, width, height and PNG content of every image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = _raster(pdf)
        return pd.DataFrame([(pdf["img_id"].iloc[0], img.shape[1], img.shape[0], png_bytes(img, level))], columns=["img_id", "width", "height", "content"])

    return px.groupBy("img_id").applyInPandas(run, "img_id long, width int, height int, content binary")


def read_png(data: bytes) -> np.ndarray:
    """(h, w, 4) of a PNG with 8-bit samples, not interlaced: grey, RGB, palette, grey
    or RGB with alpha; any row filter."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or interlaced or kind not in (0, 2, 3, 4, 6):
        raise ValueError("only PNGs of 8 bits a sample, not interlaced, are supported")
    at, parts = 8, {b"IDAT": b"", b"PLTE": b"", b"tRNS": b""}
    while at + 12 <= len(data):
        n, name = struct.unpack(">I4s", data[at:at + 8])
        if zlib.crc32(data[at + 4:at + 8 + n]) != struct.unpack(">I", data[at + 8 + n:at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if name in parts:
            parts[name] += data[at + 8:at + 8 + n]
        at += n + 12
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, w * step + 1)
    rows = np.zeros((h + 1, w * step), np.uint8)
    for y in range(h):
        rows[y + 1] = _unfiltered(int(raw[y, 0]), raw[y, 1:], rows[y], step)
    v = rows[1:].reshape(h, w, step)
    full = np.full((h, w, 1), 255, np.uint8)
    if kind == 3:
        palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[:len(parts[b"tRNS"])] = np.frombuffer(parts[b"tRNS"], np.uint8)
        return np.concatenate([palette[v[..., 0]], alpha[v[..., 0]][..., None]], 2)
    if kind in (0, 4):
        grey = np.repeat(v[..., :1], 3, 2)
        return np.concatenate([grey, v[..., 1:] if kind == 4 else full], 2)
    return v if kind == 6 else np.concatenate([v, full], 2)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).ravel()
    out, up = row.astype(int).tolist(), above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def decode_png(files: DataFrame) -> DataFrame:
    """Pixels of PNG rows (img_id, content)."""

    def run(batches):
        for batch in batches:
            for img_id, data in zip(batch["img_id"], batch["content"]):
                yield _pixels(img_id, read_png(data))

    return files.select("img_id", "content").mapInPandas(run, PIXELS)


def decode_base64(files: DataFrame) -> DataFrame:
    """Pixels of rows (img_id, b64) that hold a PNG as base64 text."""
    return decode_png(files.select("img_id", F.unbase64("b64").alias("content")))


def recognise(pages: DataFrame, recogniser, rate: float = 0.0, burst: int = 3, workers: int = 0) -> DataFrame:
    """Apply a user function text = recogniser(row) to every page; a failing page
    gets its message in ``error`` and no text. With a rate, at most ``workers`` tasks
    share that many calls a second."""
    if workers:
        pages = pages.repartition(workers)
    share = rate / workers if workers else rate

    def run(batches):
        limit = RateLimiter(share, burst)
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                limit.wait()
                try:
                    rows.append((row["original_index"], row["page_index"], recogniser(row), None))
                except Exception as e:  # noqa: BLE001 - the message belongs to the row
                    rows.append((row["original_index"], row["page_index"], None, str(e)))
            yield pd.DataFrame(rows, columns=["original_index", "page_index", "text", "error"])

    return pages.mapInPandas(run, "original_index long, page_index long, text string, error string")


def read_pictures(files: DataFrame) -> DataFrame:
    """Pixels of PNG files (path, content), beside their path; img_id is the path's hash."""

    def run(batches):
        for batch in batches:
            for path, img_id, data in zip(batch["path"], batch["img_id"], batch["content"]):
                yield _pixels(img_id, read_png(data)).assign(path=path)

    return files.select("path", F.xxhash64("path").alias("img_id"), "content").mapInPandas(run, PIXELS + ", path string")


def write_pictures(px: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """Write every image as a PNG below ``folder`` by its name (img_id, path); returns
    (path, length)."""
    return save_files(encode_png(px).join(names, "img_id").select("path", "content"), folder)


def frame_size(px: DataFrame, group: str) -> DataFrame:
    """Largest width and height of the frames of each animation."""
    return px.groupBy(group).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def encode_gif(px: DataFrame, group: str, delay: int = 10, loops: int = 0, resize: bool = True) -> DataFrame:
    """An animated GIF of each group's images in order of img_id: group, frames, width,
    height, content. Frames are padded to the largest width and height (with ``resize``)
    and dithered to the 216 web-safe colours; ``delay`` is in hundredths of a second.

    A group is one animation, whose frames its encoder has to hold.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = [_raster(own) for _, own in pdf.groupby("img_id", sort=True)]
        h, w = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
        if resize:
            frames = [padded(f, w, h) for f in frames]
        data = gif_bytes([diffuse(f[..., :3]) for f in frames], w, h, delay, loops)
        return pd.DataFrame([(pdf[group].iloc[0], len(frames), w, h, data)], columns=["group", "frames", "width", "height", "content"])

    return px.groupBy(group).applyInPandas(run, "group long, frames int, width int, height int, content binary").withColumnRenamed("group", group)


def gif_bytes(frames: list[np.ndarray], w: int, h: int, delay: int, loops: int) -> bytes:
    """A GIF of frames (h, w, 3) of web-safe colours; loops < 0 plays once."""
    levels = range(0, 256, 51)
    palette = b"".join(bytes((r, g, b)) for r in levels for g in levels for b in levels) + bytes(120)
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), palette]
    if loops >= 0:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0")
    for f in frames:
        index = (f // 51).astype(int) @ np.array([36, 6, 1])
        out.append(b"\x21\xf9\x04\0" + struct.pack("<H", delay) + b"\0\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08")
        data = lzw(index.ravel().tolist())
        out += [bytes([len(data[i:i + 255])]) + data[i:i + 255] for i in range(0, len(data), 255)] + [b"\0"]
    return b"".join(out) + b"\x3b"


def lzw(symbols: list[int], bits: int = 8) -> bytes:
    """The variable-width code that GIF prescribes."""
    clear, stop = 1 << bits, (1 << bits) + 1
    acc = held = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc |= code << held
        held += width
        while held >= 8:
            out.append(acc & 255)
            acc, held = acc >> 8, held - 8

    width, table, now = bits + 1, {}, -1
    put(clear, width)
    for s in symbols:
        if now < 0:
            now = s
            continue
        code = table.get((now, s))
        if code is not None:
            now = code
            continue
        put(now, width)
        table[now, s] = stop + 1 + len(table)
        if stop + len(table) == 1 << width and width < 12:
            width += 1
        elif stop + len(table) == 4095:
            put(clear, width)
            width, table = bits + 1, {}
        now = s
    if now >= 0:
        put(now, width)
    put(stop, width)
    if held:
        out.append(acc & 255)
    return bytes(out)


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Write rows (path, content) below ``folder`` and return (path, length) of what was
    written; rows without content write nothing. A file gets its name only when it is
    complete, so retried tasks do no harm."""

    def run(batches):
        from pyarrow import fs as arrow_fs

        fs, root = arrow_fs.FileSystem.from_uri(folder) if ":/" in folder else (arrow_fs.LocalFileSystem(), folder)
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                if data is None:
                    continue
                whole = f"{root}/{path}"
                fs.create_dir(whole.rsplit("/", 1)[0], recursive=True)
                part = f"{whole}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(data)
                fs.move(part, whole)
                rows.append((path, len(data)))
            yield pd.DataFrame(rows, columns=["path", "length"]).astype({"path": object, "length": "int64"})

    return files.select("path", "content").mapInPandas(run, "path string, length long")


def own_palette(img: np.ndarray, n: int) -> np.ndarray:
    """Up to n colours of an image's opaque pixels, by median cut of their 15-bit bins."""
    seen = img[img[..., 3] >= 125][:, :3].astype(int) // 8 * 8
    if not len(seen):
        return np.zeros((1, 3))
    bins, counts = np.unique(seen, axis=0, return_counts=True)
    return np.array([c for c, _ in median_cut(bins, counts, n)], float)


def quantise(px: DataFrame, n: int = 256) -> DataFrame:
    """Every image in at most n colours of its own; alpha stays. Equal distances go to
    the colour that more pixels have."""
    if not 1 <= n <= 256:
        raise ValueError("a palette has 1 to 256 colours")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = _raster(pdf)
        palette = own_palette(img, n)
        colours, back = np.unique(img[..., :3].reshape(-1, 3), axis=0, return_inverse=True)
        nearest = np.concatenate([((c[:, None] - palette[None]) ** 2).sum(2).argmin(1) for c in np.array_split(colours, -(-len(colours) // 4096))])
        img[..., :3] = palette[nearest][back.ravel()].reshape(img.shape[0], img.shape[1], 3)
        return _pixels(pdf["img_id"].iloc[0], img)

    return px.groupBy("img_id").applyInPandas(run, PIXELS)


#: compressions by key; formats without a codec here are absent
COMPRESSION = {
    "losslesspng-png": lambda px, quality, speed: encode_png(px, 9),
    "pngquant-png": lambda px, quality, speed: encode_png(quantise(px, max(2, round(256 * quality / 100))), max(1, 10 - speed)),
}


def compress(px: DataFrame, key: str, quality: int = 80, speed: int = 4) -> DataFrame:
    """img_id, width, height and content of every image by a registered compression."""
    if key not in COMPRESSION:
        raise ValueError(f"no codec for {key} here")
    return COMPRESSION[key](px, quality, speed)


# The usual mean and deviation of segmentation models' inputs.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def segment(px: DataFrame, predict, size: int = 320) -> DataFrame:
    """Masks (img_id, x, y, m) of every image by a user function predict(tensor), which
    takes (3, size, size) floats and gives (size, size). It is resolved once per Python
    worker when given as a function without arguments that returns one (``loads``)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = loaded(predict)
        img = _raster(pdf)[..., :3]
        h, w = img.shape[:2]
        small = np.einsum("ij,jkc->ikc", weights(h, size, "lanczos"), img)
        small = np.clip(np.floor(np.einsum("ij,kjc->kic", weights(w, size, "lanczos"), small) + 0.5), 0, 255)
        tensor = (small / max(small.max(), 255e-6) - np.array(MEAN)) / np.array(DEVIATION)
        mask = np.asarray(model(tensor.transpose(2, 0, 1).astype(np.float32)), float)
        mask = np.floor((mask - mask.min()) / max(mask.max() - mask.min(), 1e-6) * 255)
        mask = weights(size, h, "lanczos") @ mask @ weights(size, w, "lanczos").T
        y, x = np.divmod(np.arange(h * w), w)
        return pd.DataFrame({"img_id": pdf["img_id"].iloc[0], "x": x, "y": y, "m": np.clip(np.floor(mask + 0.5), 0, 255).astype(int).ravel()})

    return px.groupBy("img_id").applyInPandas(run, "img_id long, x int, y int, m int")


def loads(make):
    """Marks a function that makes a model, so that each worker makes one."""
    make.loads = True
    return make


_models: dict[str, object] = {}


def loaded(predict):
    if not getattr(predict, "loads", False):
        return predict
    key = f"{predict.__module__}.{predict.__qualname__}"
    if key not in _models:
        _models[key] = predict()
    return _models[key]


class RateLimiter:
    """A token bucket: ``rate`` calls a second, ``burst`` at once; rate <= 0 never waits."""

    def __init__(self, rate: float, burst: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, max(1, burst), clock, sleep
        self.tokens, self.last = float(self.burst), clock()

    def wait(self) -> None:
        if self.rate <= 0:
            return
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate)
        self.last = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.last, self.tokens = self.clock(), 1.0
        self.tokens -= 1


def nchw(px: DataFrame) -> DataFrame:
    """img_id, height, width and tensor (channel-major floats 0..1, by the largest
    channel value) of every image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = _raster(pdf)[..., :3]
        t = (img / max(img.max(), 255e-6)).transpose(2, 0, 1).astype(np.float32)
        return pd.DataFrame([(pdf["img_id"].iloc[0], img.shape[0], img.shape[1], t.ravel())], columns=["img_id", "height", "width", "tensor"])

    return px.groupBy("img_id").applyInPandas(run, "img_id long, height int, width int, tensor array<float>")


def correct_text(results: DataFrame, corrector, fall_back: bool = True) -> DataFrame:
    """Apply a user function text = corrector(text) to the results (original_index,
    text, metadata); a corrected result says so in its metadata. Where the function
    fails, the text stays (``fall_back``) or the row gets an error."""

    def run(batches):
        for batch in batches:
            texts, errors, done = [], [], []
            for text in batch["text"]:
                try:
                    texts.append(corrector(text))
                    errors.append(None)
                    done.append(True)
                except Exception as e:  # noqa: BLE001 - the message belongs to the row
                    texts.append(text)
                    errors.append(None if fall_back else str(e))
                    done.append(False)
            yield batch.assign(text=texts, error=errors, corrected=done)

    schema = "original_index long, text string, metadata map<string,string>, error string, corrected boolean"
    rows = results.select("original_index", "text", "metadata").mapInPandas(run, schema)
    note = F.create_map(F.lit("TextCorrectionApplied"), F.lit("true"))
    with_note = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "TextCorrectionApplied"), note)
    return rows.select("original_index", "text", F.when(F.col("corrected"), with_note).otherwise(F.col("metadata")).alias("metadata"), "error")
