import hashlib

from pyspark.sql import Row

from kgjobs.llm import warc


def expected(rows):
    first = {}
    for p, h in rows:
        if len(h.encode()) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, h in rows:
        f = first.get(h)
        hit = f is not None and f != p
        out.append((p, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if hit else "response", f if hit else None))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(p, "u\nx", h, 1) for p, h in rows], "page_id long, url string, html string, type int")
    back = warc.archive_and_read(spark, df)
    return sorted([tuple(r) for r in back.select("page_id", "n_bytes", "digest", "type", "refers_to").collect()], key=str)


def test_round_trip_with_magic_in_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "<p>é</p>"), (2, "x" * 150), (3, "x" * 150), (4, "WARC/1.1\r\n tail"), (5, "é" + fake + "z" * 9), (6, fake), (7, "y" * 99), (8, "y" * 99), (10, ""), (11, "a\r\n\r\nb" * 40), (2, "x" * 150)]
    assert run(spark, rows) == expected(rows)


def test_splits_within_a_file(spark):
    rows = [(k, f"{k} é " * (k % 37) + ("WARC/1.1\r\n" if k % 5 == 0 else "")) for k in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert run(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_payload_over_many_splits(spark):
    """A payload full of magics that fills several splits, in a file with others: its fragments belong to a record of an earlier split."""
    rows = [(1, "first"), (2, "WARC/1.1\r\n é " * 2000), (3, "last" * 30), (None, "last" * 30), (4, "WARC/1.1\r\n" * 900 + "z")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert run(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_and_null(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([Row(page_id=1, url=None, html=None)], "page_id long, url string, html string")
    assert [tuple(r) for r in warc.archive_and_read(spark, df).select("page_id", "n_bytes", "type").collect()] == [(1, 0, "response")]


def test_payloads_leave_no_shuffle_files(spark, tmp_path):
    """What lies on disk after writing are the archives, not the shuffled payloads as well."""
    import os

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    tops = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()]
    held = lambda: sum(os.path.getsize(os.path.join(d, x)) for t in tops for d, _, names in os.walk(t) for x in names if x.startswith("shuffle_"))
    rows = [(k, "u", "".join(hashlib.sha512(f"{k % 1500} {i}".encode()).hexdigest() for i in range(20))) for k in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    before, off = held(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        warc.write_warc(pages, str(tmp_path / "archives"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", off)
    assert held() - before < 1_000_000
    assert spark.read.option("lineSep", warc.MAGIC).text(str(tmp_path / "archives")).where("value like 'WARC-Type%'").count() == 2000
