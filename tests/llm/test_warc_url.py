import hashlib

import pytest
from pyspark.sql import functions as F

from meshwind.llm import url_filter as U
from meshwind.llm import warc
from meshwind.llm.queries import queries


def test_round_trip_types_and_odd_rows(spark):
    big = "é<p>" * 60
    rows = [(3, "http://a/\r\nx", big), (1, None, big), (2, "u", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (1, "v", big), (8, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], len((r[2] or "").encode()), hashlib.sha256((r[2] or "").encode()).hexdigest(), "revisit" if r[2] == big and r[0] != 1 else "response", 1 if r[2] == big and r[0] != 1 else None) for r in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_shuffled_types_equal_broadcast_types(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * (100 + i % 3)) for i in range(50)], "page_id long, url string, html string")
    first = sorted(map(str, warc.assign_types(pages).select("id", "low").collect()))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert sorted(map(str, warc.assign_types(pages).select("id", "low").collect())) == first


def test_selected_records_by_ranges_and_damage(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(40)], "page_id long, url string, html string")
    folder = warc.shared_dir(spark)
    index = warc.write_archives(warc.assign_types(pages), folder)
    got = {r.id: bytes(r.payload).decode() for r in warc.read_records(index.where("id % 7 = 3"), folder, payloads=True).collect()}
    assert got == {i: f"page {i} " * 20 for i in range(40) if i % 7 == 3}
    with pytest.raises(Exception, match="differs"):
        warc.read_records(index.withColumn("digest", F.lit("0")), folder).collect()


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    levels = U.build_cascade(keys.where("pmod(xxhash64(key), 5) = 0"), keys.unionAll(keys.limit(10)))
    rows = U._hashed(keys).withColumn("listed", F.expr("pmod(xxhash64(key), 5) = 0")).toPandas()
    found = U.member(levels, rows.h1.to_numpy().view("uint64"), rows.h2.to_numpy().view("uint64"))
    assert len(levels) > 2 and (found == rows.listed.to_numpy()).all()


def test_verdicts_on_odd_urls(spark, monkeypatch):
    urls = [None, "", "nourl", "http://X.Example.COM/en/71?q", "ftp://a.com/en/", "https://spam-farm.example.org:80/x", "https://m.SPAM-farm.example.org#f", "http://b.example.net/de/8", "http://notnet/de/", "x://é.org/es/\ny", "http:///en/", "a://b.org/es/" + "z" * 50_000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    want = {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("example.com/en/7", "allow"), 4: ("com/en/", "block"), 5: (None, "allow"), 6: (None, "block"), 7: ("example.net/de/8", "allow"), 8: (None, "allow"), 9: ("org/es/", "block"), 10: (None, "allow"), 11: ("org/es/", "block")}
    rows = U.judge_urls(pages).collect()
    assert len(rows) == len(urls) + 1 and {r.id: (r.rule, r.verdict) for r in rows} == want
    assert {r.id: (r.host, r.path) for r in rows}[9] == ("é.org", "/es/\ny")
    assert U.judge_urls(pages.limit(0)).count() == 0
    monkeypatch.setattr(U, "MOST_BITS", 100)  # several cascades
    assert {r.id: (r.rule, r.verdict) for r in U.judge_urls(pages).collect()} == want


def test_query_gives_the_verdicts_of_the_contracts_rules(spark, tmp_path):
    want = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://example.com/en/6": ("com/en/", "block"), "http://a.net/de/1": ("net/de/", "allow"), "http://spam-farm.example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://b.example.net/de/80?q": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block")}
    spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: (r.rule, r.verdict) for r in queries()["op4_url_bloom_cascade"](spark, str(tmp_path)).collect()}
    assert rows == dict(enumerate(want.values()))


def test_hosts_of_many_labels(spark):
    pages = spark.createDataFrame([(0, "http://" + "a." * 50_000 + "spam-farm.example.net/"), (1, "http://" + "b." * 50_000 + "farm.example.net/"), (2, "http://" + "." * 9000)], "page_id long, url string")
    assert {r.id: r.verdict for r in U.judge_urls(pages).collect()} == {0: "block", 1: "allow", 2: "allow"}


def test_archives_outgrow_batches(spark, monkeypatch):
    """One task, one archive, whatever the number of batches; string ids come back from the records' headers."""
    monkeypatch.setattr(warc, "LEAST_REVISIT", 10)
    pages = spark.createDataFrame([(f"p <{i}> é", "u", f"page {i % 30} " * 2000) for i in range(1200)], "page_id string, url string, html string").coalesce(1)
    folder = warc.shared_dir(spark)
    index = warc.write_archives(warc.assign_types(pages).coalesce(1), folder)
    assert index.select("file").distinct().count() == 1
    got = warc.read_records(index, folder).collect()
    low = {k: min(f"p <{i}> é" for i in range(k, 1200, 30)) for k in range(30)}
    assert len(got) == 1200 and all((r.refers_to or r.id) == low[int(r.id[3:].split(">")[0]) % 30] and (r.record_type == "revisit") == (r.refers_to is not None) for r in got)
