"""Operators on whole images against plain versions of their definitions."""

import base64
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import gradients as G, pixels as P, rasters as R

PX = "img_id long, x int, y int, r int, g int, b int, a int"


def picture(w, h, seed=0, alpha=True):
    rng = np.random.default_rng(seed)
    img = rng.integers(0, 256, (h, w, 4))
    img[..., 3] = rng.choice([0, 128, 255], (h, w)) if alpha else 255
    return img


def frame(spark, **images):
    rows = [(int(i[1:]), x, y, *map(int, img[y, x])) for i, img in images.items() for y in range(img.shape[0]) for x in range(img.shape[1])]
    return spark.createDataFrame(rows, PX)


def array(df, img_id=0):
    rows = df.filter(F.col("img_id") == img_id).collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1, 4), -1)
    for r in rows:
        out[r["y"], r["x"]] = (r["r"], r["g"], r["b"], r["a"])
    return out


# ---- median cut ----

def plain_median_cut(hist, n):
    """Boxes as lists of (colour, count): split the highest rank at half of its count."""
    edges = lambda box: [max(c[k] for c, _ in box) - min(c[k] for c, _ in box) for k in range(3)]
    size = lambda box: sum(m for _, m in box)
    low = lambda box: tuple(min(c[k] for c, _ in box) for k in range(3))
    boxes, order = [(0, sorted(hist.items()))], 0
    while len(boxes) < n:
        open_ = [b for b in boxes if len(b[1]) > 1]
        if not open_:
            break
        best = min(open_, key=lambda b: (-size(b[1]) * math.prod(edges(b[1])), -size(b[1]), low(b[1]), b[0]))
        boxes.remove(best)
        axis = edges(best[1]).index(max(edges(best[1])))
        box = sorted(best[1], key=lambda e: (e[0][axis], e[0][2], e[0][1], e[0][0]))
        count, at = 0, len(box) - 1
        for i, (_, m) in enumerate(box):
            if count >= size(box) // 2:
                at = i
                break
            count += m
        at = max(at, 1)
        boxes += [(order + 1, box[:at]), (order + 2, box[at:])]
        order += 2
    found = [(tuple(sum(c[k] * m for c, m in box) // size(box) for k in range(3)), size(box)) for _, box in boxes]
    return sorted(found, key=lambda f: (-f[1], f[0]))


def cut(hist, n):
    return R.median_cut(np.array(list(hist)), np.array(list(hist.values())), n)


def test_median_cut_against_a_plain_version():
    rng = random.Random(3)
    for _ in range(200):
        hist = {tuple(8 * rng.randrange(rng.choice([1, 2, 32])) for _ in range(3)): rng.randint(1, 9) for _ in range(rng.randint(1, 40))}
        for n in (1, 2, 6, 16):
            assert cut(hist, n) == plain_median_cut(hist, n)
    assert R.median_cut(np.empty((0, 3), int), np.empty(0, int), 6) == []


def test_median_cut_splits_flat_boxes_and_at_half():
    square = {(8 * x, 8 * y, 0): 10 for x in range(8) for y in range(8)}
    assert len(cut(square, 6)) == 6
    assert [n for _, n in cut({(0, 0, 0): 3, (8, 8, 8): 2, (16, 16, 16): 2}, 2)] == [4, 3]


# ---- sampling ----

def plain_sample(img, x, y):
    h, w = img.shape[:2]
    if not (0 <= x < w - 1 and 0 <= y < h - 1):
        return [0, 0, 0, 0]
    x0, y0 = math.floor(x), math.floor(y)
    wx, wy = x - x0, y - y0
    out = []
    for c in range(4):
        v = lambda i, j: int(img[j, i, c]) * 257
        top = v(x0, y0) * (1 - wx) + v(x0 + 1, y0) * wx
        low = v(x0, y0 + 1) * (1 - wx) + v(x0 + 1, y0 + 1) * wx
        out.append(int((top * (1 - wy) + low * wy) / 256))
    return out


@pytest.mark.parametrize("degrees", [0.0, 30.0, 90.0, -135.0])
def test_rotate(spark, degrees):
    img = picture(9, 6)
    got = array(R.rotate(frame(spark, i0=img, i1=picture(3, 2)), degrees))
    h, w = img.shape[:2]
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    at = [((x - w / 2) * cos - (y - h / 2) * sin, (x - w / 2) * sin + (y - h / 2) * cos) for x in (0, w) for y in (0, h)]
    nw, nh = (int(max(p[k] for p in at) - min(p[k] for p in at) + 1) for k in (0, 1))
    assert got.shape[:2] == (nh, nw)
    for y in range(nh):
        for x in range(nw):
            dx, dy = x - nw / 2, y - nh / 2
            want = plain_sample(img, dx * cos + dy * sin + w / 2, -dx * sin + dy * cos + h / 2)
            assert np.abs(got[y, x] - want).max() <= 1, (x, y)


def test_tilt(spark):
    img, (tx, ty, scale) = picture(12, 10), (0.4, -0.3, 0.7)
    got = array(R.tilt(frame(spark, i0=img), tx, ty, scale))
    h, w = img.shape[:2]
    ax, ay = math.radians(tx), math.radians(ty)
    assert got.shape[:2] == (25, 30)
    drawn = 0
    for y in range(25):
        for x in range(30):
            dx, dy = x - 15, y - 12.5
            z = dx * math.sin(ay) - dy * math.sin(ax) * math.cos(ay) + 1500 * math.cos(ax) * math.cos(ay)
            f = 1500 / z * scale
            sx = (dx * math.cos(ay) + dy * math.sin(ax) * math.sin(ay) - 1500 * math.sin(ay)) / f + w / 2
            sy = (dy * math.cos(ax) + 1500 * math.sin(ax)) / f + h / 2
            want = plain_sample(img, sx, sy)
            drawn += any(want)
            assert np.abs(got[y, x] - want).max() <= 1
    assert drawn > 20


def test_tilt_effect_covers_the_ground(spark):
    img = np.full((40, 60, 4), 200)
    img[..., 3] = 255
    got = array(R.tilt_effect(frame(spark, i0=img), "p3", 160, 90))
    start, end = np.array(R.TILTS["p3"][0]), np.array(R.TILTS["p3"][1])
    assert got.shape == (90, 160, 4) and (got[..., 3] == 255).all()
    for x, y in ((0, 0), (159, 0), (3, 80), (159, 89)):
        t = (x + y) / 250
        assert got[y, x, :3].tolist() == [int(a * (1 - t) + b * t) for a, b in zip(start, end)]
    with pytest.raises(ValueError):
        R.tilt_effect(frame(spark, i0=img), "none")


def test_centred_is_source_over_and_cuts_off():
    ground = R.gradient_ground((10, 20, 30), (10, 20, 30), 5, 5)
    img = np.zeros((1, 1, 4))
    img[0, 0] = (100, 0, 0, 128)
    got = R.centred(img, ground)
    rest = 65535 - 128 * 257
    want = [(257 * s + 257 * d * rest // 65535) >> 8 for s, d in zip((100, 0, 0, 128), (10, 20, 30, 255))]
    assert got[2, 2].tolist() == want and want[3] == 255 and got[0, 0].tolist() == [10, 20, 30, 255]
    big = np.full((9, 11, 4), 255.0)
    assert (R.centred(big, ground) == 255).all()


def test_rounded_image_equals_the_pixel_operator(spark):
    for w, h, radius in ((20, 14, 5.0), (9, 9, 6.0), (30, 30, 12.0)):
        img = picture(w, h, 4)
        got = array(P.round_corners(frame(spark, i0=img), radius=radius))
        assert (got == R.rounded(img.astype(float), radius)).all()


# ---- dither and resize ----

def test_dither_against_a_loop(spark):
    img = picture(7, 5, 2)
    work = img[..., :3].astype(float)
    for y in range(5):
        for x in range(7):
            old = work[y, x].copy()
            work[y, x] = np.clip(np.floor(old / 51 + 0.5), 0, 5) * 51
            err = old - work[y, x]
            for dx, dy, share in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                if 0 <= x + dx < 7 and y + dy < 5:
                    work[y + dy, x + dx] += err * share / 16
    got = array(R.dither(frame(spark, i0=img)))
    assert (got[..., :3] == work).all() and (got[..., 3] == img[..., 3]).all()


def test_resize_padded(spark):
    flat = np.full((10, 20, 4), 90)
    got = array(R.resize_padded(frame(spark, i0=flat), 16, 16))
    assert got.shape == (16, 16, 4) and (got[4:12] == 90).all() and (got[:4] == 0).all() and (got[12:] == 0).all()
    same = picture(6, 4)
    assert (array(R.resize_padded(frame(spark, i0=same), 6, 4)) == same).all()


@pytest.mark.parametrize("method,reach", [("lanczos", 3), ("catmullrom", 2)])
def test_resampling_weights(method, reach):
    for size, new in ((10, 4), (4, 10), (7, 7)):
        m = R.weights(size, new, method)
        scale = max(size / new, 1)
        for i in range(new):
            at = (i + 0.5) * size / new - 0.5
            raw = []
            for j in range(size):
                t = abs(j - at) / scale
                if method == "lanczos":
                    raw.append(0.0 if t >= reach else 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3))
                else:
                    raw.append(1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0)
            assert np.allclose(m[i], np.array(raw) / sum(raw))


def test_pixelate_equals_the_join(spark):
    w, h, k = 23, 17, 0.2
    img = picture(w, h, 8)
    got = {(r["x"], r["y"]): (r["r"], r["a"]) for r in P.pixelate(frame(spark, i0=img), w, h, 20).collect()}
    dw, dh = round(w * k), round(h * k)
    want = {}
    for y in range(h):
        for x in range(w):
            sx, sy = int(x * dw // w / k), int(y * dh // h / k)
            if sx < w and sy < h:
                want[x, y] = (int(img[sy, sx, 0]), int(img[sy, sx, 3]))
    assert got == want


# ---- files ----

def filtered_png(img, kind, filters):
    """A PNG of the channels of a kind with the given row filters."""
    channels = {0: [0], 2: [0, 1, 2], 4: [0, 3], 6: [0, 1, 2, 3]}[kind]
    rows, step = img[..., channels].astype(np.uint8).reshape(img.shape[0], -1), len(channels)
    out, above = b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows.astype(int)):
        left, corner = np.concatenate([np.zeros(step, int), row[:-step]]), np.concatenate([np.zeros(step, int), above[:-step]])
        f = filters[y % len(filters)]
        if f == 4:
            p = left + above - corner
            d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
            guess = np.choose(d.argmin(0), [left, above, corner])
        else:
            guess = (0, left, above, (left + above) // 2)[f]
        out += bytes([f]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, kind, 0, 0, 0)
    packed = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", [0, 2, 4, 6])
def test_png_kinds_and_filters(kind):
    img = picture(6, 10, 9)
    got = R.read_png(filtered_png(img, kind, [0, 1, 2, 3, 4]))
    want = img.copy()
    if kind in (0, 4):
        want[..., 1] = want[..., 2] = want[..., 0]
    if kind in (0, 2):
        want[..., 3] = 255
    assert (got == want).all()
    damaged = bytearray(filtered_png(img, kind, [4]))
    damaged[-20] ^= 1
    for bad in (b"no picture", bytes(damaged)):
        with pytest.raises(ValueError):
            R.read_png(bad)


def read_gif(data):
    """(width, height, loops, [(delay, indices)]) of a GIF with one global palette."""
    w, h, flags = struct.unpack("<HHB", data[6:11])
    at, loops, delay, frames = 13 + 3 * 2 ** ((flags & 7) + 1), None, None, []
    blocks = lambda p: (b"", p + 1) if not data[p] else (lambda rest: (data[p + 1:p + 1 + data[p]] + rest[0], rest[1]))(blocks(p + 1 + data[p]))
    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = blocks(at + 2)
            if data[at + 1] == 0xF9:
                delay = struct.unpack("<H", body[1:3])[0]
            else:
                loops = struct.unpack("<H", body[12:14])[0]
            at = end
            continue
        bits = data[at + 10]
        body, at = blocks(at + 11)
        stream, width, clear = int.from_bytes(body, "little"), bits + 1, 1 << bits
        table, out, last = {}, [], None
        while True:
            code, stream = stream & ((1 << width) - 1), stream >> width
            if code == clear:
                table, width, last = {i: [i] for i in range(clear)} | {clear: None, clear + 1: None}, bits + 1, None
                continue
            if code == clear + 1:
                break
            entry = table[code] if code in table else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table[len(table)] = last + entry[:1]
            if len(table) == 1 << width and width < 12:
                width += 1
            last = entry
        frames.append((delay, out))
    return w, h, loops, frames


def test_gif_frames_are_padded_dithered_and_coded(spark):
    images = {"i0": picture(90, 70, 1, False), "i1": picture(30, 30, 2, False), "i2": np.full((70, 90, 4), 255)}
    px = frame(spark, **images).withColumn("anim", F.lit(5).cast("long"))
    row = R.encode_gif(px, "anim", delay=7, loops=3).first()
    w, h, loops, frames = read_gif(bytes(row["content"]))
    assert (w, h, loops, row["frames"], row["anim"]) == (90, 70, 3, 3, 5) and [d for d, _ in frames] == [7, 7, 7]
    for (_, got), img in zip(frames, images.values()):
        want = R.diffuse(R.padded(img.astype(float), 90, 70)[..., :3]) // 51
        assert got == (want.astype(int) @ np.array([36, 6, 1])).ravel().tolist()
    assert R.frame_size(px, "anim").first()[:] == (5, 90, 70)


def test_save_and_decode(spark, tmp_path):
    img = picture(5, 4, 3)
    files = R.encode_png(frame(spark, i0=img)).select(F.lit("sub/a.png").alias("path"), "content")
    nothing = files.select(F.lit("none.png").alias("path"), F.lit(None).cast("binary").alias("content"))
    saved = R.save_files(files.union(nothing), str(tmp_path)).collect()
    assert [r["path"] for r in saved] == ["sub/a.png"] and not (tmp_path / "none.png").exists()
    data = (tmp_path / "sub" / "a.png").read_bytes()
    assert len(data) == saved[0]["length"] and (R.read_png(data) == img).all()
    coded = spark.createDataFrame([(0, base64.b64encode(data).decode())], "img_id long, b64 string")
    assert (array(R.decode_base64(coded)) == img).all()


def test_tensor(spark):
    img = picture(3, 2, 5)
    row = R.nchw(frame(spark, i0=img)).first()
    want = (img[..., :3] / img[..., :3].max()).transpose(2, 0, 1)
    assert (row["height"], row["width"]) == (2, 3) and np.allclose(np.array(row["tensor"]).reshape(3, 2, 3), want)


# ---- strategies, layouts, gradients ----

def test_layouts():
    assert P.grid_of("horizontal", 3) == (1, 3) and P.grid_of("vertical", 3) == (3, 1) and P.grid_of("grid", 3, 2, 2) == (2, 2)
    for bad in (("grid", 5, 2, 2), ("grid", 1, 0, 2), ("ring", 1)):
        with pytest.raises(ValueError):
            P.grid_of(*bad)


def test_strategies(spark):
    px = frame(spark, i0=picture(4, 4, 6))
    for call in (lambda: P.convert(px, (), "nn"), lambda: P.convert(px, ((1, 2, 3),), "x"), lambda: P.remove_background(px, "x")):
        with pytest.raises(ValueError):
            call()
    mask = px.select("img_id", "x", "y", (F.col("x") * 85).alias("m"))
    assert {r["a"] for r in P.remove_background(px, "mask", mask=mask).collect()} == {0, 85, 170, 255}


def test_border_ring_and_clearing(spark):
    px = frame(spark, i0=np.full((40, 40, 4), 200)).withColumn("a", F.lit(255))
    got = array(P.border(px, 40, 40, (1, 2, 3), 3, 10.0))
    assert got[0, 0, 3] == 0 and got[0, 20].tolist() == [1, 2, 3, 255] and got[20, 20].tolist() == [200, 200, 200, 255]
    ring = [(x, y) for y in range(10) for x in range(10) if 7 < math.hypot(x - 10, y - 10) <= 10]
    assert all(got[y, x].tolist() == [1, 2, 3, 255] for x, y in ring)


@pytest.mark.parametrize("space", G.SPACES)
def test_gradient_ends_and_greys(spark, space):
    ends = [(200, 30, 40), (10, 90, 250)]
    rows = {r["x"]: (r["r"], r["g"], r["b"]) for r in G.gradient(spark, 5000, 1, ends, 0.0, space).collect()}
    assert max(abs(a - b) for a, b in zip(rows[0], ends[0])) <= 1 and max(abs(a - b) for a, b in zip(rows[4999], ends[1])) <= 2
    grey = {r["x"]: (r["r"], r["g"], r["b"]) for r in G.gradient(spark, 20, 1, [(0, 0, 0), (255, 255, 255)], 0.0, space).collect()}
    assert all(max(v) - min(v) <= 1 for v in grey.values()) and grey[0] == (0, 0, 0)
    with pytest.raises(ValueError):
        G.gradient(spark, 5, 5, ends, 0.0, "cmyk")


# ---- quantising, models, limits ----

def test_quantise(spark):
    img = picture(12, 9, 7)
    got = array(R.quantise(frame(spark, i0=img), 8))
    palette = R.own_palette(img.astype(float), 8)
    assert len(np.unique(got[..., :3].reshape(-1, 3), axis=0)) <= 8 and (got[..., 3] == img[..., 3]).all()
    for y in range(9):
        for x in range(12):
            d = ((palette - img[y, x, :3]) ** 2).sum(1)
            assert ((got[y, x, :3] - img[y, x, :3]) ** 2).sum() == d.min()
    few = R.compress(frame(spark, i0=img), "pngquant-png", 10).first()["content"]
    assert len(np.unique(R.read_png(bytes(few))[..., :3].reshape(-1, 3), axis=0)) <= 26
    assert (R.read_png(bytes(R.compress(frame(spark, i0=img), "losslesspng-png").first()["content"])) == img).all()
    with pytest.raises(ValueError):
        R.compress(frame(spark, i0=img), "lossyavif-avif")


def test_segmentation_by_a_user_model(spark):
    img = np.zeros((20, 30, 4), int)
    img[5:15, 10:20, :3] = 250
    img[..., 3] = 255
    px = frame(spark, i0=img)
    mask = R.segment(px, R.loads(lambda: lambda t: t.mean(0)), 64)
    got = {(r["x"], r["y"]): r["m"] for r in mask.collect()}
    assert len(got) == 600 and got[15, 10] > 200 and got[2, 2] < 30
    cut_out = array(P.remove_background(px, "mask", mask=mask))
    assert cut_out[10, 15, 3] > 200 and cut_out[1, 1, 3] < 30


def test_rate_limiter():
    now, slept = [0.0], []

    def sleep(t):
        slept.append(t)
        now[0] += t

    limit = R.RateLimiter(2.0, 3, lambda: now[0], sleep)
    for _ in range(5):
        limit.wait()
    assert slept == [0.5, 0.5]
    now[0] += 10
    for _ in range(3):
        limit.wait()
    assert len(slept) == 2
    free = R.RateLimiter(0, 1, lambda: now[0], sleep)
    for _ in range(9):
        free.wait()
    assert len(slept) == 2


def test_pictures_and_cubes_are_kept(spark, tmp_path):
    img = picture(6, 5, 1, False)
    px = frame(spark, i0=img)
    names = spark.createDataFrame([(0, "a/b.png")], "img_id long, path string")
    R.write_pictures(px, names, str(tmp_path)).collect()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "a")).select("path", "content")
    back = R.read_pictures(files)
    assert back.first()["path"].endswith("a/b.png") and (array(back.withColumn("img_id", F.lit(0))) == img).all()
    palette = ((10, 20, 30), (200, 100, 0), (250, 250, 250))
    cube = P.cached_cube(spark, palette, str(tmp_path / "cubes"))
    again = P.cached_cube(spark, palette, str(tmp_path / "cubes"))
    assert cube.count() == 64**3 and len(list((tmp_path / "cubes").iterdir())) == 1
    assert (array(P.recolour_with(px, again)) == array(P.recolour(px, palette))).all()
