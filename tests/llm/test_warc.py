import base64
import glob
import gzip
import hashlib

from quern.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, keeper long"


def rows():
    out = [(k, f"http://e.org/{k} é", "<p>" + "x" * (k % 7) * 50 + "</p>", "d", 1) for k in range(200)]
    return [*out, (900, None, None, None, None), (901, "", "", None, None), (None, "u", "null key", None, None), (None, "u", "", None, None), (7, "again", "<p></p>", "d", 0), (7, "again", "<p></p>", "d", 0)]


def expected(data):
    by = {}
    for k, _, html, *_ in data:
        by.setdefault(html or "", []).append(k)
    keep = {h: max((k for k in ks if k is not None), default=None) for h, ks in by.items()}
    out = []
    for k, _, html, *_ in data:
        h = html or ""
        revisit = k != keep[h]
        out.append((k, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if revisit else "response", keep[h] if revisit else None))
    return sorted(out, key=str)


def read(df):
    return sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_round_trip_and_files(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    hashes = []
    for n, table in enumerate((df, df.repartition(7).orderBy("html"))):
        folder = f"file://{tmp_path}/w{n}"
        manifest = warc.write_warc(table, folder, file_bytes=1500, min_shards=5)
        assert manifest.agg({"records": "sum"}).first()[0] == len(data)
        assert read(warc.read_warc(spark, folder)) == expected(data)
        files = sorted(glob.glob(f"{tmp_path}/w{n}/*.warc.gz"))
        assert len(files) > 5 and not glob.glob(f"{tmp_path}/w{n}/_temporary/*")
        assert all(gzip.open(f).read().startswith(b"WARC/1.1\r\n") for f in files)
        hashes.append([(f.rsplit("/", 1)[1], hashlib.sha256(open(f, "rb").read()).hexdigest()) for f in files])
    assert hashes[0] == hashes[1]


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "é\r\n\r\nWARC/1.1"), (2, "v", "b" * 3_000_000)], "page_id long, url string, html string")
    warc.write_warc(df, f"{tmp_path}/a")
    got = {r["key"]: bytes(r["payload"]).decode() for r in warc.read_warc(spark, f"{tmp_path}/a").collect()}
    assert got == {1: "é\r\n\r\nWARC/1.1", 2: "b" * 3_000_000}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(df, f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").count() == 0


def test_a_broken_commit_and_lost_attempts(spark, tmp_path):
    """A rename that stopped half way, a commit that runs again, files of attempts that never ended."""
    data = rows()
    folder, root = f"file://{tmp_path}/b", tmp_path / "b"
    warc.write_warc(spark.createDataFrame(data, SCHEMA), folder, file_bytes=1500, min_shards=5)
    assert not (root / "_temporary").exists() and (root / "_SUCCESS").exists()
    manifest = spark.read.parquet(f"{folder}/_manifest")
    moved = manifest.orderBy("name").collect()[::2]
    (root / "_temporary").mkdir()
    for r in moved:
        (root / r["name"]).rename(root / r["temp"])
    (root / "_temporary" / "part-00000-00000.warc.gz.lost").write_bytes(b"half a rec")
    assert read(warc.read_warc(spark, folder)) == expected(data)  # found under their temporary names
    for _ in range(2):
        warc._commit(manifest, folder)
        assert not (root / "_temporary").exists()
        assert read(warc.read_warc(spark, folder)) == expected(data)
    assert len(list(root.glob("*.warc.gz"))) == manifest.count()


def test_each_shard_has_a_task_of_its_own(spark):
    df = spark.range(64).selectExpr("CAST(id AS int) AS shard").repartitionById(64, "shard")
    parts = df.selectExpr("spark_partition_id() AS p", "shard").collect()
    assert all(r["p"] == r["shard"] for r in parts)
