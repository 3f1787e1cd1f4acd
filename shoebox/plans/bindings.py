"""Photo relations derived from the given tables, in Spark and, as *_SQL, in SQL. Whole tables, by exact arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a photo; one in fifty parts is undated but keeps its year as the group."""
    li = table(spark, sf_dir, "lineitem")
    ts = F.when(F.col("l_partkey") % 50 != 0, F.col("l_shipdate"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("photo_id"), F.year("l_shipdate").cast("long").alias("year"), ts.alias("ts"), F.month(ts).cast("long").alias("month"),
        F.least(F.lit(100.0), F.col("l_quantity") * 2).alias("quality"), (((F.col("l_suppkey") * 37 + F.col("l_partkey") * 11) % 1001) / 10.0).alias("emotional"), (F.col("l_linenumber") % 4).cast("long").alias("face_count"), "l_partkey", "l_suppkey",
    )


CANDIDATES_SQL = """cand AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS photo_id, year(l_shipdate) AS year,
    CASE WHEN l_partkey % 50 <> 0 THEN l_shipdate END AS ts, CASE WHEN l_partkey % 50 <> 0 THEN month(l_shipdate) END AS month, least(CAST(100 AS DOUBLE), l_quantity * 2) AS quality,
    CAST((l_suppkey * 37 + l_partkey * 11) % 1001 AS DOUBLE) / CAST(10 AS DOUBLE) AS emotional, CAST(l_linenumber % 4 AS BIGINT) AS face_count, l_partkey, l_suppkey FROM lineitem),
scored AS (SELECT *, quality * CAST(0.4 AS DOUBLE) + emotional * CAST(0.6 AS DOUBLE) AS combined FROM cand)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a photo of 800 x 600, its line items are the faces, in the order of all their columns."""
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null")
    face = F.struct(
        F.col("l_linenumber").alias("o1"), F.col("l_partkey").alias("o2"), F.col("l_suppkey").alias("o3"), F.col("l_shipdate").alias("o4"), (F.col("l_partkey") % 800).cast("int").alias("x"), (F.col("l_suppkey") % 600).cast("int").alias("y"),
        (20 + F.col("l_linenumber") * 5).cast("int").alias("w"), (20 + F.col("l_partkey") % 60).cast("int").alias("h"), (F.col("l_discount") * 8).alias("smile"),
    )
    photos = li.groupBy(F.col("l_orderkey").alias("photo_id")).agg(F.array_sort(F.collect_list(face)).alias("faces"))
    return photos.withColumn("faces", F.transform("faces", lambda f: f.dropFields("o1", "o2", "o3", "o4"))).withColumns({"width": F.lit(800), "height": F.lit(600)})


FACES_SQL = """face AS (SELECT l_orderkey AS photo_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS i,
    l_partkey % 800 AS x, l_suppkey % 600 AS y, 20 + l_linenumber * 5 AS w, 20 + l_partkey % 60 AS h, l_discount * 8 AS smile FROM lineitem WHERE l_orderkey IS NOT NULL),
width AS (SELECT photo_id, CAST(sum(w) AS DOUBLE) / count(*) AS avg_w FROM face GROUP BY photo_id),
pair AS (SELECT a.photo_id, a.i, b.i AS j, sqrt(CAST(power((a.x + a.w // 2) - (b.x + b.w // 2), 2) + power((a.y + a.h // 2) - (b.y + b.h // 2), 2) AS DOUBLE)) / avg_w AS distance
    FROM face a JOIN face b ON a.photo_id = b.photo_id AND a.i < b.i JOIN width ON width.photo_id = a.photo_id),
near AS (SELECT photo_id, min(distance) AS d, avg(distance) AS mean, count(*) FILTER (WHERE distance < 3) AS close FROM pair GROUP BY photo_id),
intimate AS (SELECT photo_id, CASE WHEN close >= 2 THEN least(100, s + 10) ELSE s END AS intimacy FROM (SELECT *, CASE WHEN d < 1.5 THEN CAST(90 AS DOUBLE) WHEN d < 3 THEN 90 - 15 * (d - 1.5) / 1.5
    WHEN d < 5 THEN 75 - 20 * (d - 3) / 2 ELSE 55 - 30 * (least(d, 10) - 5) / 5 END AS s FROM near)),
look AS (SELECT *, CASE WHEN CAST(w AS DOUBLE) / h BETWEEN 0.75 AND 1.25 THEN 'frontal' WHEN CAST(w AS DOUBLE) / h < 0.6 OR CAST(w AS DOUBLE) / h > 1 / CAST(0.6 AS DOUBLE) THEN 'profile' ELSE 'partial' END AS facing FROM face),
person AS (SELECT photo_id, count(*) AS n, least(1, sum(w * h) / CAST(480000 AS DOUBLE)) AS cover, avg(CASE facing WHEN 'frontal' THEN CAST(100 AS DOUBLE) WHEN 'profile' THEN 20 ELSE 60 END) AS engagement,
    count(*) FILTER (WHERE facing = 'frontal') AS frontal, count(*) FILTER (WHERE facing = 'partial') AS partial, count(*) FILTER (WHERE facing = 'profile') AS profile,
    count(*) FILTER (WHERE smile > 0.5) AS smiling, avg(smile) FILTER (WHERE smile > 0.5) AS smile FROM look GROUP BY photo_id),
parts AS (SELECT person.*, coalesce(intimacy, 0) AS intimacy, least(30, CASE WHEN n = 1 THEN 10 + 10 * cover WHEN n = 2 THEN 20 + 5 * cover WHEN n < 5 THEN 25 + 3 * cover ELSE 28 + least(2, 0.5 * (n - 5)) END) AS presence,
    least(40, CASE WHEN smiling = 0 THEN 5 ELSE CAST(30 AS DOUBLE) * smiling / n + 10 * smile END) AS emotion FROM person LEFT JOIN intimate USING (photo_id)),
human AS (SELECT *, least(100, greatest(0, presence + emotion + intimacy * CAST(0.2 AS DOUBLE) + engagement * CAST(0.1 AS DOUBLE))) AS composite FROM parts),
tiered AS (SELECT *, CASE WHEN round(composite, 9) >= 70 THEN 'high' WHEN round(composite, 9) >= 40 THEN 'medium' ELSE 'low' END AS tier FROM human)"""


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file; its text is the content, and its id sets when it was analysed and how well it scored."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    sharp, expo = ((i * 37) % 1001 / 10.0), ((i * 53) % 1001 / 10.0)
    composite = sharp * 0.6 + expo * 0.4
    return d.select(
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("photo_hash"), F.concat_ws("/", "source", i.cast("string")).alias("photo_path"), "source", "doc_id", sharp.alias("sharpness_score"), expo.alias("exposure_score"),
        composite.alias("composite_score"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("file_size"), F.timestamp_add("DAY", -((i * 7) % 730).cast("int"), F.lit("2024-06-30").cast("timestamp_ntz")).alias("analyzed_at"),
    )


CACHE_SQL = """files AS (SELECT sha256(coalesce(text, '')) AS photo_hash, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS photo_path, source, doc_id, CAST((doc_id * 37) % 1001 AS DOUBLE) / CAST(10 AS DOUBLE) AS sharpness_score,
    CAST((doc_id * 53) % 1001 AS DOUBLE) / CAST(10 AS DOUBLE) AS exposure_score, octet_length(encode(coalesce(text, ''))) AS file_size, TIMESTAMP '2024-06-30' - to_days(CAST((doc_id * 7) % 730 AS INTEGER)) AS analyzed_at FROM documents),
cached AS (SELECT *, sharpness_score * CAST(0.6 AS DOUBLE) + exposure_score * CAST(0.4 AS DOUBLE) AS composite_score FROM files)"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a file: its id chooses extension and folder, its HTML is the content."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".txt", ".jpeg", ".heic", ".gif", ""))), (i % 7 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("albums", ".hidden", "__MACOSX", "trips", "home"))), (i % 5 + 1).cast("int"))
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    return p.select("page_id", "url", F.concat(F.lit("/lib/"), folder, F.lit("/p"), (F.floor(i / 3)).cast("string"), ext).alias("path"), F.concat(folder, F.lit("")).alias("folder"), length.alias("length"), (i % 11 == 0).alias("is_dir"))


PAGES_SQL = """paged AS (SELECT page_id, url, '/lib/' || (['albums', '.hidden', '__MACOSX', 'trips', 'home'])[page_id % 5 + 1] || '/p' || CAST(page_id // 3 AS VARCHAR) || (['.jpg', '.PNG', '.txt', '.jpeg', '.heic', '.gif', ''])[page_id % 7 + 1] AS path,
    (['albums', '.hidden', '__MACOSX', 'trips', 'home'])[page_id % 5 + 1] AS folder, octet_length(encode(coalesce(html, ''))) AS length, page_id % 11 = 0 AS is_dir FROM pages),
typed AS (SELECT *, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext FROM paged),
reasoned AS (SELECT *, CASE WHEN ext NOT IN ('.jpg', '.jpeg', '.png', '.heic', '.heif') THEN 'wrong_extension_' || ext WHEN length < 1024 THEN 'too_small' END AS reason FROM typed)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a photo whose EXIF fields hold its date, some broken, some missing; its file is a day younger."""
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    return o.select(
        i.alias("photo_id"), F.when(i % 5 == 0, None).when(i % 7 == 0, "junk").otherwise(text).alias("f36867"), F.when(i % 3 == 0, F.substring(text, 1, 10)).alias("f306"), F.when(i % 2 == 0, text).alias("f36868"),
        F.when(i % 35 != 0, F.timestamp_add("DAY", F.lit(1), F.col("o_orderdate"))).alias("mtime"),
    )


DATES_SQL = """raw AS (SELECT o_orderkey AS photo_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'junk' ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS f36867,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y:%m:%d') END AS f306, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS f36868,
    CASE WHEN o_orderkey % 35 <> 0 THEN o_orderdate + INTERVAL 1 DAY END AS mtime FROM orders),
parsed AS (SELECT *, coalesce(try_strptime(coalesce(f36867, f306, f36868), '%Y:%m:%d %H:%M:%S'), try_strptime(coalesce(f36867, f306, f36868), '%Y:%m:%d')) AS exif FROM raw),
stamped AS (SELECT *, coalesce(exif, mtime) AS ts FROM parsed)"""


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is a photo's histogram; twelve ids in a row are an album, so albums are small and all photos are in one."""
    e, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    return e.select(i.alias("photo_id"), F.floor(i / 12).alias("album"), (i % 12).alias("place"), F.col("embedding").cast("array<double>").alias("histogram"))


ALBUMS_SQL = """photo AS (SELECT vec_id AS photo_id, vec_id // 12 AS album, vec_id % 12 AS place, embedding FROM embeddings),
bins AS (SELECT photo_id, album, place, unnest(range(1, len(embedding) + 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM photo),
sims AS (SELECT a.album, a.photo_id AS first, b.photo_id AS second, CASE WHEN corr(a.v, b.v) IS NULL THEN 1 ELSE greatest(0, least(1, (corr(a.v, b.v) + 1) / 2)) END AS similarity
    FROM bins a JOIN bins b ON a.album = b.album AND a.place < b.place AND a.k = b.k GROUP BY ALL)"""


def work_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a unit of work of a user's batch; an `error` failed."""
    return table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of a page's HTML as gray pixels, 64 to a row; the last row, or that of an empty page, is filled up with black."""
    data = F.coalesce("html", F.lit("")).cast("binary")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / 64)).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", F.rpad(data, rows * 64, F.lit(b"\0")).alias("data"), rows.alias("height"), F.lit(64).alias("width"), F.lit(1).alias("nChannels"))
