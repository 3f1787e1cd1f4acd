"""Folder walks with a lister that counts, and the cache store's versions."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shoebox.operators.store import CacheStore, Conflict
from shoebox.schemas import QUALITY_CACHE
from shoebox.sources import library, walk


@pytest.fixture
def album(tmp_path):
    """Photos three levels deep, ignored folders with photos in them, and files that are none."""
    for name, size in (("a.jpg", 2000), ("small.jpg", 10), ("notes.txt", 5000), ("y1/b.JPG", 2000), ("y1/m1/c.png", 2000), ("y1/m1/d/e.heic", 4000), ("y2/f.jpeg", 1024),
                       ("node_modules/x.jpg", 2000), ("y1/.git/z.jpg", 2000), ("y1/__MACOSX/deep/z.jpg", 2000)):
        (tmp_path / "lib" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / name).write_bytes(b"x" * size)
    return tmp_path / "lib"


def counting(log):
    """A lister that writes down each folder it lists, from whatever process."""

    def lister(folder):
        with open(log, "a") as f:
            f.write(folder + "\n")
        return walk.listed(folder)

    return lister


def test_walk_prunes_before_it_descends(spark, album, tmp_path):
    found = walk.walked_photos(spark, [str(album)], counting(tmp_path / "log"))
    names = {os.path.relpath(r.path, album) for r in found.collect()}
    assert names == {"a.jpg", "y1/b.JPG", "y1/m1/c.png", "y1/m1/d/e.heic", "y2/f.jpeg"}
    listed = (tmp_path / "log").read_text().split()
    assert sorted(os.path.relpath(p, album) for p in listed) == [".", "y1", "y1/m1", "y1/m1/d", "y2"]
    scanned = library.photos(library.scan_files(spark, [str(album)]))
    assert {r.path.removeprefix("file:") for r in scanned.collect()} <= {r.path for r in found.collect()}


def test_walk_ends_at_the_limit_and_counts_errors(spark, album, tmp_path):
    found = walk.walked_photos(spark, [str(album)], counting(tmp_path / "log"), limit=2)
    assert [os.path.relpath(r.path, album) for r in found.collect()] == ["a.jpg", "y1/b.JPG"]
    assert len((tmp_path / "log").read_text().split()) == 3  # the root and its two folders; nothing below
    assert walk.walked_photos(spark, [str(album)], limit=0).count() == 5

    def failing(folder):
        if folder.endswith("m1"):
            raise PermissionError("no access")
        return walk.listed(folder)

    entries = walk.walked(spark, [str(album), str(album / "gone")], failing)
    errors = {os.path.relpath(r.path, album): r.error.split(":")[0] for r in walk.walk_errors(entries).collect()}
    assert errors == {"y1/m1": "PermissionError", "gone": "FileNotFoundError"}
    assert entries.filter("not is_dir").count() == 5


def test_estimate_lists_few_folders(album, tmp_path):
    """Eight folders of eight folders of eight: 1 + 5 + 25 listings, and the estimate of the same rule over a full scan."""
    tree = {f"/r{''.join(f'/{i}' for i in where)}" for where in [()] + [(i,) for i in range(8)] + [(i, j) for i in range(8) for j in range(8)] + [(i, j, k) for i in range(8) for j in range(8) for k in range(8)]}
    seen = []

    def lister(folder):
        seen.append(folder)
        below = [walk.Entry(p.rsplit("/", 1)[1], True) for p in tree if p.rsplit("/", 1)[0] == folder]
        return below + [walk.Entry(f"{i}.jpg", False, 2000) for i in range(len(folder) % 3 + 1)] + [walk.Entry("no.txt", False, 9999)]

    own = lambda f: len(f) % 3 + 1
    assert walk.quick_estimate("/r", lister) == own("/r") + 8 * (own("/r/0") + 8 * own("/r/0/0"))
    assert len(seen) == 31
    assert walk.quick_estimate(str(album)) == int(1 + (1 + 1 + 1) / 2 * 2)
    assert walk.quick_estimate("/not/there") == 0


def row(key, score=50.0, when=dt.datetime(2024, 1, 1), path="/p", size=9):
    return (key, path, score, score, score, "acceptable", size, when, "v1.0")


def table(spark, rows):
    return spark.createDataFrame(rows, QUALITY_CACHE)


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "c"), QUALITY_CACHE, buckets=16)
    assert store.version() == 0 and store.read().count() == 0
    store.upsert(table(spark, [row(f"k{i}") for i in range(100)]))
    first = store._manifest(1)["folders"]
    store.upsert(table(spark, [row("k5", 77.0, dt.datetime(2024, 2, 1)), row("k5", 66.0, dt.datetime(2023, 2, 1)), row("new")]))
    second = store._manifest(2)["folders"]
    assert 1 <= sum(first[b] != second[b] for b in first) <= 2
    now = {r.photo_hash: r.composite_score for r in store.read().collect()}
    assert len(now) == 101 and now["k5"] == 77.0 and now["k6"] == 50.0
    assert {r.composite_score for r in store.read(1).filter("photo_hash = 'k5'").collect()} == {50.0}
    assert CacheStore(spark, str(tmp_path / "c"), QUALITY_CACHE, buckets=3).buckets == 16  # what the store was made with


def test_store_refuses_bad_rows(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "c"), QUALITY_CACHE, buckets=4)
    bad = [row("a", 101.0), row("b", float("nan")), row(None), row("d", path=None), row("e", size=-1), row("f", when=None), row("g", None)]
    refused = {r.photo_hash: r.reason for r in store.upsert(table(spark, [*bad, row("good", 0.0), row("best", 100.0)])).collect()}
    assert refused == {"a": "sharpness_score is not between 0 and 100", "b": "sharpness_score is not between 0 and 100", None: "photo_hash is missing", "d": "photo_path is missing", "e": "file_size is negative", "f": "analyzed_at is missing", "g": "sharpness_score is not between 0 and 100"}
    assert {r.photo_hash for r in store.read().collect()} == {"good", "best"}


def test_store_survives_a_crash_and_a_rival(spark, tmp_path, monkeypatch):
    store = CacheStore(spark, str(tmp_path / "c"), QUALITY_CACHE, buckets=4)
    store.upsert(table(spark, [row(f"k{i}") for i in range(10)]))
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.upsert(table(spark, [row("k1", 99.0, dt.datetime(2025, 1, 1))]))
    assert store.version() == 1 and {r.composite_score for r in store.read().collect()} == {50.0}
    rival, real, done = CacheStore(spark, str(tmp_path / "c"), QUALITY_CACHE), store.commit, []

    def late(version, manifest):
        if not done:
            done.append(rival.upsert(table(spark, [row("rival")])))
        return real(version, manifest)

    monkeypatch.setattr(store, "commit", late)
    store.upsert(table(spark, [row("mine")]))
    assert {"rival", "mine"} <= {r.photo_hash for r in store.read().collect()} and store.version() == 3
    monkeypatch.setattr(store, "commit", lambda *_: False)
    with pytest.raises(Conflict):
        store.upsert(table(spark, [row("never")]))


def test_store_deletes_and_expires(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "c"), QUALITY_CACHE, buckets=8)
    store.upsert(table(spark, [row(f"k{i}", when=dt.datetime(2020 + i % 2, 1, 1)) for i in range(20)]))
    assert store.delete(spark.createDataFrame([("k0",), ("k0",), ("none",)], "photo_hash string")) == 1
    assert store.delete(spark.createDataFrame([("none",)], "photo_hash string")) == 0
    assert store.delete_expired(F.lit("2021-06-01").cast("timestamp_ntz")) == 9 and store.read().count() == 10
    assert store.clear() == 10 and store.read().count() == 0 and store.clear() == 0
    store.upsert(table(spark, [row("again")]))
    assert store.vacuum(1) >= 2 and store.read().count() == 1
