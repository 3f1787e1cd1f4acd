"""PNG decoding, curation in one pass over the bytes, stored downloads, and curation from a listing."""

import datetime as dt
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import dates, decode
from shoebox.plans import curation
from shoebox.sources import library, media
from test_sources import tiff


def png(pixels, filters=(0, 1, 2, 3, 4), colour=2, depth=8, palette=None, text=None, interlaced=0):
    """A PNG of (height, width, samples) as the file stores them; rows take the filters in turn."""
    height, width, samples = pixels.shape
    if depth == 8:
        rows = pixels.reshape(height, -1).astype(np.uint8)
    elif depth == 16:
        rows = pixels.astype(">u2").reshape(height, -1).view(np.uint8)
    else:
        bits = ((pixels.reshape(height, -1, 1) >> np.arange(depth)[::-1]) & 1).astype(np.uint8).reshape(height, -1)
        rows = np.packbits(bits, axis=1)
    unit = max(1, samples * depth // 8)
    body, above = b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows.astype(int)):
        kind = filters[y % len(filters)]
        left, corner = np.concatenate([np.zeros(unit, int), row])[: len(row)], np.concatenate([np.zeros(unit, int), above])[: len(row)]
        guess = []
        for a, b, c in zip(left, above, corner, strict=True):
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            guess.append((0, a, b, (a + b) // 2, nearest)[kind])
        body += bytes([kind]) + bytes(((row - guess) & 255).tolist())
        above = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    extra = (chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b"") + (chunk(b"eXIf", tiff([(306, text)])) if text else b"")
    packed = zlib.compress(body)
    return decode.SIGNATURE + head + extra + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4), (4, 2, 0)])
@pytest.mark.parametrize(("colour", "samples"), [(0, 1), (2, 3), (6, 4), (4, 2)])
def test_png_filters(filters, colour, samples):
    pixels = np.random.default_rng(2).integers(0, 256, (11, 7, samples))
    got = decode.decoded_png(png(pixels, filters, colour))
    wanted = pixels[:, :, {0: [0], 2: [2, 1, 0], 6: [2, 1, 0, 3], 4: [0, 0, 0, 1]}[colour]]
    assert got.dtype == np.uint8 and (got == wanted).all()


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_png_depths_and_palettes(depth):
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 1 << depth, (5, 13, 1))
    wanted = grey >> 8 if depth == 16 else grey * 255 // ((1 << depth) - 1)
    assert (decode.decoded_png(png(grey, colour=0, depth=depth)) == wanted).all()
    if depth <= 8:
        palette = rng.integers(0, 256, (1 << depth, 3))
        assert (decode.decoded_png(png(grey, colour=3, depth=depth, palette=palette)) == palette[grey[:, :, 0]][:, :, ::-1]).all()


def test_broken_pngs():
    good = png(np.zeros((4, 4, 3), int))
    for bad in (b"", b"no picture", good[:40], good[:-30], png(np.zeros((4, 4, 3), int), interlaced=1), png(np.full((2, 2, 1), 3), colour=3, palette=np.zeros((2, 3))), png(np.zeros((2, 2, 1), int), filters=(0,), colour=5), good.replace(b"IDAT", b"IDAX")):
        with pytest.raises(ValueError):
            decode.decoded_png(bad)
    with pytest.raises(ValueError):
        decode.decoded_png(good, most=10)


def test_png_equals_sparks_reader(spark, tmp_path):
    pixels = np.random.default_rng(4).integers(0, 256, (30, 20, 3))
    (tmp_path / "a.png").write_bytes(png(pixels))
    r = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    assert bytes(r.data) == decode.decoded_png((tmp_path / "a.png").read_bytes()).tobytes()


@pytest.mark.parametrize("text", ["2024:06:15 14:30:45", "2024:06:15", "2024:6:15", "rubbish", "2024:13:01", ""])
def test_kernel_dates_are_the_columns_dates(spark, text):
    when = dt.datetime(2020, 1, 2)
    got = spark.range(1).select(dates.photo_datetime(dates.exif_datetime(F.lit(text)), F.lit(when).cast("timestamp_ntz"))).first()[0]
    assert dates.taken(None, text, "2000:01:01", when) == got


@pytest.fixture
def library_of_two_years(tmp_path):
    rng = np.random.default_rng(5)
    for name, text in (("may.png", "2021:05:03 10:00:00"), ("july.png", "2021:07:09"), ("other.png", "2019:01:01"), ("bad.png", "2021:08:01")):
        data = png(rng.integers(0, 256, (40, 30, 3)), text=text)
        (tmp_path / name).write_bytes(data if name != "bad.png" else data.replace(b"IDAT", b"IDAX"))
    (tmp_path / "x.jpg").write_bytes(b"y" * 2000)
    os.utime(tmp_path / "x.jpg", (1620000000, 1620000000))  # in 2021
    return tmp_path


def test_one_scan_of_the_folder(spark, library_of_two_years):
    tried = []

    def decoder(content):
        tried.append(1)
        raise AssertionError("another year's photo was decoded") if b"2019" in content else ValueError("not a picture")

    files = library.photos(library.scan_files(spark, [str(library_of_two_years)], content=True))
    passed = {r.path.rsplit("/", 1)[1]: r for r in curation.one_pass(files, 2021, {".jpg": decoder}).collect()}
    assert set(passed) == {"may.png", "july.png", "bad.png", "x.jpg"}
    assert passed["bad.png"].error and passed["x.jpg"].error == "ValueError: not a picture" and passed["may.png"].error is None
    assert (passed["may.png"].height, passed["may.png"].width, passed["may.png"].taken) == (40, 30, dt.datetime(2021, 5, 3, 10))
    two = curation.curate_folder(spark, [str(library_of_two_years)], 2021)
    one = curation.curate_folder(spark, [str(library_of_two_years)], 2021, decoders={})
    same = lambda df: [tuple(r) for r in df.select("photo_id", "month", F.round("quality", 9), "emotional", "face_count").collect()]
    assert same(one) == same(two) and len(same(one)) == 2
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("binaryfile") + plan.count("Relation") <= 2 and "Join" not in plan


def test_detector_sees_decoded_pictures(spark, library_of_two_years):
    def detector(frame):
        if any("july" in p for p in frame["origin"]):
            raise RuntimeError("no faces today")
        return [[{"x": 1, "y": 2, "w": int(w) // 2, "h": int(h) // 2, "smile": 0.9, "confidence": 1.0}] for w, h in zip(frame["width"], frame["height"], strict=True)]

    files = library.photos(library.scan_files(spark, [str(library_of_two_years)], content=True))
    passed = {r.path.rsplit("/", 1)[1]: r for r in curation.one_pass(files, 2021, detector=detector).collect()}
    assert passed["may.png"].faces[0].w == 15 and "no faces today" in passed["july.png"].error and passed["july.png"].faces is None
    assert not passed["x.jpg"].decoded


def listing(spark, n=6):
    rows = [(str(i), f"p{i}.png", f"http://h/{i}", f"http://show/{i}", f"{2021 if i % 3 else 2020}-0{i % 9 + 1}-05T10:00:00Z") for i in range(n)] + [("u", "undated.png", "http://h/u", None, None)]
    return spark.createDataFrame(rows, "id string, filename string, baseUrl string, productUrl string, creationTime string")


def test_downloads_are_stored_once_and_wait(spark, tmp_path):
    """A service that says twice that it is asked too often, one photo that is gone, and a second run that fetches only what is missing."""
    log, home = tmp_path / "log", tmp_path / "store"

    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        asked = log.read_text().split().count(url)
        if url.endswith("/1") and asked <= 2:
            raise media.RateLimitError("slow down", retry_after=0)
        if url.endswith("/2"):
            raise media.DownloadError("gone")
        return url.encode()

    items = spark.createDataFrame([(str(i), f"http://h/{i}") for i in range(4)] + [("3", "http://h/3")], "id string, url string")
    got = {r.id: r for r in media.stored(items, str(home), fetch, pause=0.0).collect()}
    assert got["2"].error == "gone" and got["2"].length is None and got["1"].error is None
    assert log.read_text().split().count("http://h/1") == 3 and len(got) == 4
    (home / "half.part").write_bytes(b"h")
    (home / os.path.basename(got["3"].path)).unlink()
    again = {r.id: r for r in media.stored(items, str(home), fetch, pause=0.0).collect()}
    assert {i: (r.length, r.sha256) for i, r in again.items()} == {i: (r.length, r.sha256) for i, r in got.items()}
    assert log.read_text().split().count("http://h/0") == 1 and log.read_text().split().count("http://h/3") == 2
    assert {r.path for r in media.stored_files(spark, str(home)).collect()} == {r.path for r in again.values() if r.error is None}

    def refused(url):
        raise media.RateLimitError("never", retry_after=0)

    with pytest.raises(Exception, match="never"):
        media.stored(items, str(tmp_path / "other"), refused, pause=0.0, tries=2).collect()


@pytest.mark.parametrize("clean", [True, False])
def test_curation_from_a_listing(spark, tmp_path, clean):
    pictures = {str(i): png(np.random.default_rng(i).integers(0, 256, (40, 30, 3))) for i in range(6)} | {"u": png(np.zeros((9, 9, 3), int))}
    log = tmp_path / "log"

    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        name = url.rsplit("/", 1)[1].removesuffix("=d")
        if name == "4":
            raise media.DownloadError("gone")
        return pictures[name]

    home = tmp_path / "store"
    chosen = curation.curate_listing(listing(spark), str(home), 2021, fetch, clean=clean)
    assert {r.photo_id: r.productUrl for r in chosen} == {"1/p1.png": "http://show/1", "2/p2.png": "http://show/2", "5/p5.png": "http://show/5", "u/undated.png": None}
    assert sorted(log.read_text().split()) == [f"http://h/{i}=d" for i in ("1", "2", "4", "5", "u")]  # nothing of another year
    assert len(list(home.glob("*"))) == (0 if clean else 4)
