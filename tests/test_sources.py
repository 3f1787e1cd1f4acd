import datetime as dt
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import pixels
from shoebox.operators import cache, diversity
from shoebox.plans import curation
from shoebox.schemas import EMOTIONAL_CACHE
from shoebox.sources import documents, exif, library, media
from shoebox.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    sizes = {"harbour.jpg": 1500, "Dunes.PNG": 1024, "2019/cliff.jpg": 9000, "2019/boat.jpeg": 4096, "old/lamp.heic": 3000, "todo.txt": 5000, "old/icon.jpg": 1023, "x/y.z/pier.jpg": 70_000}
    for name, size in sizes.items():
        path = tmp_path / "lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    return tmp_path / "lib"


def test_scan(spark, tree):
    files = library.scan_files(spark, [str(tree), str(tree / "missing")])
    reasons = {r.path.rsplit("/", 1)[1]: r.skip_reason for r in library.scanned(files).collect()}
    assert {k for k, v in reasons.items() if v is None} == {"harbour.jpg", "Dunes.PNG", "cliff.jpg", "boat.jpeg", "lamp.heic", "pier.jpg"}
    assert reasons["todo.txt"] == "wrong_extension_.txt" and reasons["icon.jpg"] == "too_small"
    assert library.photos(files, 2).count() == 2 and library.photos(files, 0).count() == 6
    assert library.scan_files(spark, [str(tree / "missing")]).count() == 0
    assert library.scan_files(spark, [str(tree)], recursive=False).count() == 3
    assert library.missing_roots(spark, [str(tree), str(tree / "missing")]) == [str(tree / "missing")]


def test_estimate_goes_two_levels_deep(spark):
    """Against a recursion over folders: own photos, plus the mean of the first five subfolders times their number."""
    rng = random.Random(4)
    paths = [("lib", *(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 1, 2, 2, 2, 3])))) for _ in range(400)]

    def estimate(folder, depth):
        here = sum(p == folder for p in paths)
        below = sorted({p[: len(folder) + 1] for p in paths if p[: len(folder)] == folder and len(p) > len(folder)})
        if depth == 0 or not below:
            return here
        return int(here + sum(estimate(s, depth - 1) for s in below[:5]) / len(below[:5]) * len(below))

    rows = spark.createDataFrame([(p + (None,) * 3)[:4] for p in paths], "top string, sub string, inner string, deeper string")
    columns = rows.columns
    assert [tuple(r) for r in library.estimated_count(rows, columns).collect()] == [("lib", estimate(("lib",), 2))]
    assert library.estimated_count(rows, columns, depth=1).first().estimate == estimate(("lib",), 1)
    assert library.estimated_count(rows, columns, depth=0).first().estimate == estimate(("lib",), 0)
    assert library.estimated_count(rows.limit(0), columns).count() == 0


def greedily(names):
    taken, out = set(), []
    for name in names:
        stem, dot, suffix = name[:1] + name[1:].rpartition(".")[0] if "." in name[1:] else name, "." in name[1:], name.rpartition(".")[2]
        free, n = name, 0
        while free in taken:
            n += 1
            free = f"{stem}_{n}.{suffix}" if dot else f"{stem}_{n}"
        taken.add(free)
        out.append(free)
    return out


@pytest.mark.parametrize("span", [10_000, 7])
def test_collision_free(spark, span):
    rng = random.Random(span)
    cases = [["a.jpg", "a_1.jpg", "a.jpg"], ["a.jpg", "a.jpg", "a_1.jpg", "a_1.jpg"], ["b", "b", "b_1", "b_01", "b"], ["solo.png"] * 40, [rng.choice(["c", "c_1", "c_2", "c_1_1", "d"]) + rng.choice([".jpg", ".tar.gz", ""]) for _ in range(150)]]
    for names in cases:
        rows = spark.createDataFrame([(i, n, "kept") for i, n in enumerate(names)], "id long, name string, other string").repartition(3)
        found = library.collision_free(rows, "name", "id", span).orderBy("id").collect()
        assert [r.stored_name for r in found] == greedily(names) and len({r.stored_name for r in found}) == len(names) and {r.other for r in found} == {"kept"}


def test_ignored(spark):
    paths = spark.createDataFrame([("/a/.hidden/p.jpg",), ("/a/__MACOSX/p.jpg",), ("/a/b/p.jpg",), ("/a/.p.jpg",)], "path string")
    assert [r.i for r in paths.select(library.ignored(F.col("path")).alias("i")).collect()] == [True, True, False, True]


def test_stream_of_new_photos(spark, tree, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    q = incremental.new_photos(spark, str(tree)).select("path", "photo_hash").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 6


def test_media(spark, tmp_path):
    item = lambda i, day, base="http://h/x": {"id": str(i), "filename": "a.jpg", "baseUrl": base, "productUrl": "u", "mimeType": "image/png", "mediaMetadata": {"creationTime": f"{day}T10:00:00Z", "width": "40", "height": "30"}}
    pages = tmp_path / "pages.json"
    pages.write_text(json.dumps({"mediaItems": [item(1, "2024-01-05"), item(2, "2024-02-05"), item(3, "2024-02-20", "")]}))
    rows = media.item_metadata(media.read_pages(spark, str(pages))).orderBy("id").collect()
    assert [(r.id, r.month, r.format, r.width, r.url) for r in rows] == [("1", 1, "png", 40, "http://h/x=d"), ("2", 2, "png", 40, "http://h/x=d")]
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps({"mediaItems": x}) for x in ([item(1, "2024-01-05"), item(2, "2024-02-05")], [item(3, "2024-02-20", ""), {"id": "4", "baseUrl": "b"}])))
    ids = lambda **bounds: sorted(r.id for r in media.source(spark, "saved_listing", path=str(lines), **bounds).collect())
    assert ids() == ["1", "2", "4"] and ids(start="2024-01-10", end="2024-12-31") == ["2"]
    with pytest.raises(ValueError):
        media.source(spark, "other")


def test_listing_service_pages_and_errors(spark):
    class Pages(media.ListingReader):
        def page(self, start, end, token, size):
            if "status" in self.options:
                from shoebox.sources import media as m

                m.checked(int(self.options["status"]), retry_after=9)
            days = [None] if start is None else [f"{start[:8]}{d:02}" for d in range(int(start[8:]), int(end[8:]) + 1) if d % 6 == 1]
            first = int(token or 0)
            items = [{"id": f"{d}", "baseUrl": "b", "productUrl": f"p/{d}", "mediaMetadata": {"creationTime": f"{d}T00:00:00Z"} if d else {}} for d in days[first : first + size]]
            return {"mediaItems": items} | ({"nextPageToken": str(first + size)} if first + size < len(days) else {})

    class Listing(media.MediaListing):
        reader_class = Pages

        @classmethod
        def name(cls):
            return "pages_of_days"

    rows = media.source(spark, "listing", Listing, start="2024-01-10", end="2024-02-29", pageSize="2")
    assert sorted(r.id for r in rows.collect()) == ["2024-01-13", "2024-01-19", "2024-01-25", "2024-01-31", "2024-02-01", "2024-02-07", "2024-02-13", "2024-02-19", "2024-02-25"]
    assert sorted(r.id for r in rows.filter(F.col("day") >= F.to_date(F.lit("2024-02-20"))).collect()) == ["2024-02-25"]
    assert [p.start for p in Pages({}).partitions()][-1] is None and media.source(spark, "listing", Listing).filter("day is null").count() == 1
    with pytest.raises(Exception, match="RateLimitError|too many"):
        media.source(spark, "listing", Listing, start="2024-01-10", end="2024-01-11", status="429").collect()
    for status, error in ((401, media.AuthenticationError), (403, media.AuthenticationError), (429, media.RateLimitError), (500, media.SourceError)):
        with pytest.raises(error):
            media.checked(status)
    assert media.checked(200) is None


def test_downloads_skip_what_fails(spark, tmp_path):
    def fetch(url):
        if "bad" in url:
            raise media.DownloadError(f"gone: {url}")
        return url.encode()

    items = spark.createDataFrame([("1", "http://h/a"), ("2", "http://h/bad")], "id string, url string")
    assert [(r.id, bytes(r.content) if r.content else None, r.error) for r in media.fetched(items, fetch).orderBy("id").collect()] == [("1", b"http://h/a", None), ("2", None, "gone: http://h/bad")]
    stored = spark.createDataFrame([("/c/a.jpg", "http://p/1"), ("/c/a.jpg", "http://p/1")], "path string, productUrl string")
    asked = spark.createDataFrame([("/c/a.jpg",), ("/c/z.jpg",)], "path string")
    assert [r.original_url for r in media.original_urls(asked, stored).orderBy("path").collect()] == ["http://p/1", None]
    for name in ("a.jpg", "b.jpg"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path.parent / "outside.jpg").write_bytes(b"x")
    assert media.cleaned(spark, str(tmp_path), [str(tmp_path / "a.jpg"), str(tmp_path.parent / "outside.jpg")]) == 1 and (tmp_path.parent / "outside.jpg").exists()
    (tmp_path / "c.jpg").write_bytes(b"x")
    sly = [f"{tmp_path}/../outside.jpg", f"file:{tmp_path}/../outside.jpg", f"{tmp_path}x/c.jpg", str(tmp_path)]
    assert media.cleaned(spark, str(tmp_path), sly) == 0 and (tmp_path.parent / "outside.jpg").exists()
    assert media.cleaned(spark, str(tmp_path), [f"file:{tmp_path}/x/../c.jpg", f"file://{tmp_path}/c.jpg"]) == 1
    assert media.cleaned(spark, str(tmp_path)) == 1 and media.cleaned(spark, str(tmp_path)) == 0 and media.cleaned(spark, str(tmp_path / "none")) == 0


def tiff(fields, order="<", inner=()):
    """A TIFF block with ASCII fields, and those of inner in a sub-block."""
    def directory(pairs, at, extra=()):
        n, texts, rows = len(pairs) + len(extra), b"", b""
        for tag, text in pairs:
            data = text.encode() + b"\0"
            place = at + 2 + 12 * n + 4 + len(texts)
            rows += struct.pack(order + "HHI", tag, 2, len(data)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", place))
            texts += data if len(data) > 4 else b""
        for tag, value in extra:
            rows += struct.pack(order + "HHII", tag, 4, 1, value)
        return struct.pack(order + "H", n) + rows + struct.pack(order + "I", 0) + texts

    head = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8)
    size = len(directory(fields, 8, [(34665, 0)]))
    return head + directory(fields, 8, [(34665, 8 + size)] if inner else ()) + (directory(inner, 8 + size) if inner else b"")


def with_exif(jpeg, block):
    body = b"Exif\0\0" + block
    return jpeg[:2] + b"\xff\xe0\x00\x04ab" + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + jpeg[2:]


def test_exif_fields(spark):
    plain, both = tiff([(306, "2024:06:15 14:30:45")]), tiff([(306, "2023:01:01"), (271, "maker")], ">", [(36867, "2022:02:02 02:02:02"), (36868, "x")])
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 2) + b"IHDRab" + b"crc4" + struct.pack(">I", len(plain)) + b"eXIf" + plain + b"crc4"
    files = {"a": with_exif(b"\xff\xd8\xff\xd9", plain), "b": with_exif(b"\xff\xd8\xff\xd9", both), "c": png, "d": both, "e": b"no picture", "f": b"", "g": with_exif(b"\xff\xd8\xff\xd9", plain[:30]), "h": with_exif(b"\xff\xd8\xff\xd9", b"??"), "i": b"\xff\xd8\xff\xda\x00\x04ab" + with_exif(b"\xff\xd8", plain)}
    rows = spark.createDataFrame([*((k, bytearray(v)) for k, v in files.items()), ("z", None)], "path string, content binary")
    found = {r.path: (r.original, r.plain, r.digitized, r.exif_error is not None) for r in exif.exif_texts(rows).collect()}
    none = (None, None, None, False)
    assert found == {"a": (None, "2024:06:15 14:30:45", None, False), "b": ("2022:02:02 02:02:02", "2023:01:01", "x", False), "c": (None, "2024:06:15 14:30:45", None, False), "d": ("2022:02:02 02:02:02", "2023:01:01", "x", False), "e": none, "f": none, "g": (None, None, None, found["g"][3]), "h": (None, None, None, True), "i": none, "z": none}


def jpeg_file(spark, path, colour, block=None):
    image = spark._jvm.java.awt.image.BufferedImage(48, 48, 1)
    for y in range(48):
        for x in range(48):
            image.setRGB(x, y, colour if (x // 6 + y // 6) % 2 else 0x101010)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(path)))
    data = path.read_bytes()
    path.write_bytes((with_exif(data, block) if block else data) + b"\0" * 1024)


def test_curate_folder_goes_by_exif_dates(spark, tmp_path):
    for name, colour, text in (("may.jpg", 0xFF0000, "2021:05:03 10:00:00"), ("july.jpg", 0x00FF00, "2021:07:09"), ("other.jpg", 0x0000FF, "2019:01:01"), ("broken.jpg", 0xFFFFFF, None)):
        jpeg_file(spark, tmp_path / name, colour, tiff([(306, text)]) if text else None)
    found = {r.photo_id.rsplit("/", 1)[1]: r.month for r in curation.curate_folder(spark, [str(tmp_path), str(tmp_path / "none")], 2021).collect()}
    assert found == {"may.jpg": 5, "july.jpg": 7}  # the last has no field, and its file is of today
    now = dt.date.today()
    assert [r.photo_id.rsplit("/", 1)[1] for r in curation.curate_folder(spark, [str(tmp_path)], now.year).collect()] == ["broken.jpg"]
    with pytest.raises(FileNotFoundError):
        curation.curate_folder(spark, [str(tmp_path / "none")], 2021)


def test_image_similarity(spark):
    """Pairs of whole images, against a plain computation; equal images are alike, a constant channel counts as 1."""
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (12, 10, 3), dtype=np.uint8), np.full((5, 5, 3), 7, np.uint8), np.zeros((6, 6, 1), np.uint8)]
    images.append(images[0].copy())
    rows = [(1, str(i), i, bytearray(x.tobytes()), *x.shape) for i, x in enumerate(images)]
    found = {(r.first, r.second): r.similarity for r in curation.image_similarity(spark.createDataFrame(rows, "album long, origin string, place long, data binary, height int, width int, nChannels int")).collect()}

    def plain(x, y):
        cuts = [(0, 180), (180, 436), (436, 692)]
        a, b = pixels.hsv_histograms(x), pixels.hsv_histograms(y)
        parts = [1.0 if a[s:e].std() * b[s:e].std() == 0 else np.corrcoef(a[s:e], b[s:e])[0, 1] for s, e in cuts]
        return (np.mean(parts) + 1) / 2

    assert found == {(str(i), str(j)): pytest.approx(plain(images[i], images[j])) for i in range(4) for j in range(i + 1, 4)} and found["0", "3"] == pytest.approx(1)
    unread = spark.createDataFrame([*rows[:2], (1, "x", 8, bytearray(b"1"), 5, 5, 3), (1, "y", 9, bytearray(), 5, 5, 3)], "album long, origin string, place long, data binary, height int, width int, nChannels int")
    assert {(r.first, r.second): r.similarity for r in curation.image_similarity(unread).collect() if r.second in "xy"} == {("0", "x"): 0, ("1", "x"): 0, ("0", "y"): 0, ("1", "y"): 0, ("x", "y"): 0}
    flat = album(spark, [1, 1, 1], [1, 2, 3], [2, 2])
    assert [r.similarity for r in diversity.similarity_pairs(flat).orderBy("first", "second").collect()] == [1.0, 0.0, 0.0]


def test_emotional_cache_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("h1", "a.jpg", 2, 0.4, 30.0, 50.0, 60.0, 71.5, "high", "{}", 9, dt.datetime(2024, 5, 1), "v2.0")], EMOTIONAL_CACHE)
    documents.exported_emotions(rows).write.json(str(tmp_path / "out"))
    schema = documents.exported_emotions(rows).schema
    again = documents.imported_emotions(spark.read.schema(schema).json(str(tmp_path / "out")))
    assert again.schema.simpleString() == rows.schema.simpleString() and again.collect() == rows.withColumn("file_size", F.lit(0).cast("long")).collect()
    bad = spark.createDataFrame([("h", None, 1, 0.1, 1.0, 1.0, 1.0, 1.0, "low", None, None, None), ("h", "p", -1, 0.1, 1.0, 1.0, 1.0, 1.0, "low", None, None, None), ("h", "p", 1, 1.5, 1.0, 1.0, 1.0, 1.0, "low", None, None, None), ("h", "p", 1, 0.5, 1.0, 1.0, 1.0, 1.0, "low", None, None, None)], "photo_hash string, photo_path string, face_count int, face_coverage double, emotion double, intimacy double, engagement double, composite double, tier string, metadata string, analyzed_at string, algorithm_version string")
    assert [(r.photo_path, r.metadata, r.algorithm_version, r.face_count) for r in documents.imported_emotions(bad).collect()] == [("p", "{}", "v1.0", 1)]


def test_listing_partitions_are_months():
    parts = media.ListingReader({"start": "2024-01-10", "end": "2024-03-02"}).partitions()
    assert [(p.start, p.end) for p in parts] == [("2024-01-10", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]


def test_selection_round_trip(spark, tmp_path):
    text = json.dumps({"year": 2024, "strategy": "balanced", "created_at": "2024-12-31T00:00:00", "stats": {"total_candidates": 3}, "photos": [{"photo_path": "/a.jpg", "timestamp": "2024-05-01T10:00:00", "month": 5, "quality_score": 70.5, "metadata": {"face_count": 2}}]})
    (tmp_path / "in.json").write_text(text)
    first = documents.read_selections(spark, str(tmp_path / "in.json"))
    documents.write_selections(first, str(tmp_path / "out"))
    again = documents.read_selections(spark, str(tmp_path / "out"))
    assert first.collect() == again.collect()
    assert documents.selected_photos(again).first().metadata.face_count == 2


def test_upsert_takes_the_latest(spark):
    rows = spark.createDataFrame([("h", "a", 1.0, "2024-01-01"), ("h", "b", 2.0, "2024-03-01"), ("g", "c", 3.0, "2024-01-01")], "photo_hash string, photo_path string, score double, analyzed_at string")
    out = {r.photo_hash: r.score for r in cache.upserted(rows.filter("score <> 2"), rows.filter("score = 2")).collect()}
    assert out == {"h": 2.0, "g": 3.0}


def test_similarity(spark):
    pair = spark.range(1).select(F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0))).alias("a"), F.array(*map(F.lit, (1.0, 3.0, 2.0, 5.0))).alias("b"))
    row = pair.select(diversity.correlation(F.col("a"), F.col("b")).alias("c"), diversity.similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert row.c == pytest.approx(0.8315218406203) and row.s == pytest.approx(0.9157609203101)


def album(spark, *histograms):
    return spark.createDataFrame([(1, i, i, list(map(float, h))) for i, h in enumerate(histograms)], "album long, photo_id long, place long, histogram array<double>")


def greedy(histograms, threshold):
    import numpy as np

    sim = lambda a, b: (np.corrcoef(a, b)[0, 1] + 1) / 2
    kept = []
    for i, h in enumerate(histograms):
        if all(sim(h, histograms[j]) < threshold for j in kept):
            kept.append(i)
    chosen = [0]
    while len(chosen) < 3:
        rest = [i for i in range(len(histograms)) if i not in chosen]
        chosen.append(min(rest, key=lambda i: (min(sim(histograms[i], histograms[j]) for j in chosen), i)))
    return kept, chosen


def test_greedy_filters(spark):
    import numpy as np

    histograms = np.random.default_rng(3).random((7, 6)).tolist()
    kept, chosen = greedy(histograms, 0.6)
    photos = album(spark, *histograms)
    assert [r.photo for r in diversity.without_similar(photos, threshold=0.6).orderBy("position").collect()] == kept
    assert [r.photo for r in diversity.most_diverse(photos, 3).orderBy("position").collect()] == chosen
    assert diversity.most_diverse(photos, 20).count() == 7
