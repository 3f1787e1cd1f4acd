import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoebox.functions import dates, faces, pixels, quality


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def face_array(*items):
    one = lambda x, y, w, h, smile: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(smile).alias("smile"))
    return F.array(*(one(*i) for i in items)) if items else F.array().cast("array<struct<x:int,y:int,w:int,h:int,smile:double>>")


@pytest.mark.parametrize("n, cover, points", [(0, 0.0, 0), (1, 0.1, 11), (1, 0.8, 18), (2, 0.4, 22), (4, 0.5, 26.5), (8, 0.6, 29.5), (20, 1.0, 30)])
def test_face_presence(spark, n, cover, points):
    assert value(spark, faces.face_presence(F.lit(n), F.lit(cover))) == pytest.approx(points)


@pytest.mark.parametrize("smiles, points", [([0.3], 5), ([0.8], 38), ([0.9] * 3, 39), ([0.8, 0.3], 23), ([], 0)])
def test_emotion(spark, smiles, points):
    assert value(spark, faces.emotion(face_array(*((0, 0, 10, 10, s) for s in smiles)))) == pytest.approx(points)


@pytest.mark.parametrize("apart, points", [(150, 90), (890, 31.6)])
def test_intimacy(spark, apart, points):
    pairs = faces.pair_distances(face_array((0, 0, 100, 100, 0.0), (apart, 0, 100, 100, 0.0)))
    assert value(spark, faces.intimacy(pairs)) == pytest.approx(points)


def test_one_face(spark):
    one = spark.range(1).select(face_array((0, 0, 300, 240, 0.8)).alias("faces"), F.lit(800).alias("width"), F.lit(600).alias("height"))
    row = faces.score_significance(one).first()
    assert row.face_coverage == pytest.approx(0.15) and row.composite == pytest.approx(11.5 + 38 + 10) and row.tier == "medium" and row.valid


def test_orientation(spark):
    looks = [value(spark, faces.orientation(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))) for w, h in ((100, 100), (50, 150), (130, 100), (170, 100), (10, 0))]
    assert looks == ["frontal", "profile", "partial", "profile", "profile"]


def test_detector_errors_stay_in_their_row(spark):
    def detector(frame):
        if frame["photo_id"].iloc[0] == 2:
            raise RuntimeError("broken")
        return [[{"x": 1, "y": 2, "w": 3, "h": 4, "confidence": 0.9, "size_ratio": 0.1, "smile": 0.7}]]

    rows = {r.photo_id: r for r in faces.detect_faces(spark.range(4).withColumnRenamed("id", "photo_id"), detector).collect()}
    assert rows[2].faces is None and "broken" in rows[2].error and rows[1].faces[0].w == 3


def test_a_bad_photo_of_a_batch_costs_few_calls():
    calls = []

    def detector(frame):
        calls.append(len(frame))
        if 37 in set(frame["photo_id"]):
            raise RuntimeError("broken")
        return [[] for _ in range(len(frame))]

    found, errors = faces.bisected(detector, pd.DataFrame({"photo_id": range(64)}))
    assert [i for i, e in enumerate(errors) if e] == [37] and found[37] is None and sum(x == [] for x in found) == 63
    assert len(calls) == 13 and calls[0] == 64


@pytest.mark.parametrize("name", ["high_significance", "closest_pairs", "raw_detections"])
def test_filters_compute_no_faces_again(spark, sf_dir, name):
    """A filter on what comes from the faces tests a value that is there; it holds none of the expressions over their array."""
    from shoebox.plans.queries import QUERIES

    frame = QUERIES[name](spark, sf_dir)
    lines = frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [x for x in lines if x.lstrip(" :+-").startswith("Filter")]
    assert len(filters) > 1 and not any("lambda" in x for x in filters)
    if name == "high_significance":
        found = [(r.composite, r.photo_id) for r in frame.collect()]
        assert found == sorted(found, key=lambda r: (-r[0], r[1])) and "hashpartitioning(photo_id" in frame._jdf.queryExecution().executedPlan().toString()


def test_intimacy_is_that_of_the_pairs(spark):
    """Of no, one, two and more faces, negative and odd places, widths of 0 and nulls: the score has what the pairs give, and these what a loop gives."""
    import random
    from itertools import combinations

    rng, rows = random.Random(3), [(0, []), (1, [(5, 5, 0, 9, 0.1), (9, 9, 0, 9, 0.9)]), (2, [(5, 5, None, 9, None), (9, 9, 7, 9, 0.9), (1, None, 7, 9, 0.6)]), (3, None)]
    rows += [(k, [(rng.randint(-50, 300), rng.randint(-50, 300), rng.randint(1, 90), rng.randint(1, 90), rng.random()) for _ in range(k % 6)]) for k in range(4, 40)]
    photos = spark.createDataFrame([(k, f, 800, 600) for k, f in rows], "photo_id long, faces array<struct<x:int,y:int,w:int,h:int,smile:double>>, width int, height int")
    scored = faces.score_significance(photos).select("photo_id", "pairs", "intimacy_score", faces.intimacy(F.col("pairs")).alias("wanted"), faces.closest_pair(F.col("pairs")).alias("closest"))
    found = {r.photo_id: r for r in scored.collect()}
    assert len(found) == len(rows) and all(r.intimacy_score == r.wanted for r in found.values())
    for k, some in rows[4:]:
        middle = [(x + w // 2, y + h // 2) for x, y, w, h, _ in some]
        mean = sum(w for _, _, w, _, _ in some) / max(1, len(some))
        pairs = [(i + 1, j + 1, pytest.approx(((middle[i][0] - middle[j][0]) ** 2 + (middle[i][1] - middle[j][1]) ** 2) ** 0.5 / mean)) for i, j in combinations(range(len(some)), 2)]
        assert [tuple(p) for p in found[k].pairs] == pairs
        assert (found[k].closest is None) == (len(some) < 2)


def test_quality(spark):
    assert value(spark, quality.quality_score(F.lit(80.0), F.lit(60.0))) == pytest.approx(72)
    assert value(spark, quality.quality_tier(F.lit(70.0))) == "high"
    with pytest.raises(Exception, match="between 0 and 100"):
        value(spark, quality.quality_score(F.lit(180.0), F.lit(60.0)))


@pytest.mark.parametrize("f36867, f306, wanted", [("2024:06:15 14:30:45", None, dt.datetime(2024, 6, 15, 14, 30, 45)), (None, "2024:06:15", dt.datetime(2024, 6, 15)), ("junk", "2024:06:15", None), (None, None, None)])
def test_exif(spark, f36867, f306, wanted):
    text = dates.first_present(*(F.lit(x).cast("string") for x in (f36867, f306, None)))
    assert value(spark, dates.exif_datetime(text)) == wanted


def images(spark, *planes):
    return spark.createDataFrame([(str(i), p.tobytes(), p.shape[0], p.shape[1], p.shape[2] if p.ndim == 3 else 1) for i, p in enumerate(planes)], "origin string, data binary, height int, width int, nChannels int")


def test_pixels(spark):
    board = np.kron(np.indices((10, 10)).sum(axis=0) % 2 * 255, np.ones((20, 20))).astype(np.uint8)
    square = np.zeros((100, 100), np.uint8)
    square[40:60, 40:60] = 60
    ramp = np.repeat(np.arange(100, dtype=np.uint8)[None, :], 100, axis=0)
    half = np.concatenate([np.full((50, 100), 128), np.full((25, 100), 255), np.zeros((25, 100))]).astype(np.uint8)
    bgr = np.repeat(square[:, :, None], 3, axis=2)
    constant = [np.full((10, 10), v, np.uint8) for v in (0, 255, 128)]
    rows = pixels.pixel_scores(images(spark, board, square, ramp, half, bgr, *constant)).orderBy("origin").collect()
    assert rows[0].variance == pytest.approx(12757.905, abs=0.001) and rows[0].sharpness == 100 and rows[0].exposure == 0
    assert rows[1].sharpness == pytest.approx(6.048) and rows[2].sharpness == pytest.approx(0.008)
    assert rows[3].exposure == pytest.approx(75) and rows[4].variance == pytest.approx(rows[1].variance)
    assert [r.exposure for r in rows[5:]] == [0, 0, 100] and [r.sharpness for r in rows[5:]] == [0, 0, 0]


def test_broken_and_large_images(spark):
    broken = spark.createDataFrame([("x", b"12", 5, 5, 1)], "origin string, data binary, height int, width int, nChannels int")
    row = pixels.pixel_scores(broken).first()
    assert row.error and row.sharpness is None
    wide = np.tile(np.arange(256, dtype=np.uint8), (40, 8))
    assert pixels.resized(wide[:, :, None], 20, 1024).shape == (20, 1024, 1)
    assert pixels.pixel_scores(images(spark, wide)).first().error is None


def test_measures_leave_by_slices():
    """No output batch follows the rows or bytes of the input batch; every row is there once, in order, broken, empty and null ones too."""
    import pyarrow as pa

    class Images:
        schema = {"origin": type("Key", (), {"dataType": type("Type", (), {"simpleString": staticmethod(lambda: "string")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    data = [b"\0\1" * 50] * 3000 + [None, b"", b"12"] + [bytes(3 << 20)] * 3
    side = [(10, 10)] * 3003 + [(1536, 2048)] * 3
    batch = pa.RecordBatch.from_pydict({"origin": [str(i) for i in range(len(data))], "data": data, "height": [h for h, _ in side], "width": [w for _, w in side], "nChannels": [1] * len(data)})
    out = list(pixels.measure_pixels(Images())(iter([batch])))
    assert [k for b in out for k in b.column("origin").to_pylist()] == [str(i) for i in range(len(data))]
    assert max(b.num_rows for b in out) <= 256 and [b.num_rows for b in out][-2:] == [1, 1]
    assert [i for i, e in enumerate(e for b in out for e in b.column("error").to_pylist()) if e] == [3000, 3001, 3002]


def test_gray_histograms_are_those_of_three_equal_channels():
    image = np.random.default_rng(2).integers(0, 256, (30, 20, 1), dtype=np.uint8)
    assert (pixels.hsv_histograms(image) == pixels.hsv_histograms(np.repeat(image, 3, axis=2))).all()


def test_lanczos_of_a_ramp():
    """Against the sum written out tap by tap; flat pictures stay flat, borders repeat, overshoot is cut."""
    ramp = np.arange(0, 250, 25, dtype=np.uint8)[None, :, None]

    def plain(old, new):
        out = []
        for i in range(new):
            at = (i + 0.5) * len(old) / new - 0.5
            start, kernel = int(np.floor(at)), []
            for k in range(start - 3, start + 5):
                d = np.pi * (at - k)
                kernel.append(1.0 if d == 0 else 4 * np.sin(d) * np.sin(d / 4) / d**2)
            shares = [round(w / sum(kernel) * 2048) for w in kernel]
            total = sum(s * int(old[min(max(k, 0), len(old) - 1)]) for s, k in zip(shares, range(start - 3, start + 5), strict=True))
            out.append(min(255, max(0, (total + 1024) // 2048)))
        return out

    assert pixels.resized(ramp, 1, 4)[0, :, 0].tolist() == plain(ramp[0, :, 0], 4)
    assert pixels.resized(ramp.transpose(1, 0, 2), 5, 1)[:, 0, 0].tolist() == plain(ramp[0, :, 0], 5) == pixels.resized(ramp, 1, 5)[0, :, 0].tolist()
    assert (pixels.resized(np.full((30, 40, 3), 201, np.uint8), 13, 7) == 201).all()
    step = np.repeat([0, 255], 12).astype(np.uint8)[None, :, None]
    assert pixels.resized(step, 1, 16)[0, :, 0].tolist() == plain(step[0, :, 0], 16) and pixels.resized(step, 1, 16)[0, [0, -1], 0].tolist() == [0, 255]
    places, shares = pixels.taps(3000, 1024)
    assert places.shape == shares.shape == (1024, 8) and places.min() == 0 and places.max() <= 2999 and abs(shares.sum(axis=1) - 2048).max() <= 4


def test_hsv_histograms_count_every_pixel():
    image = np.random.default_rng(1).integers(0, 256, (30, 20, 3), dtype=np.uint8)
    found = pixels.hsv_histograms(image)
    assert [found[:180].sum(), found[180:436].sum(), found[436:].sum()] == [600, 600, 600]
    red = np.zeros((1, 1, 3), np.uint8)
    red[0, 0, 2] = 255
    assert pixels.hsv_histograms(red)[[0, 180 + 255, 436 + 255]].tolist() == [1, 1, 1]
