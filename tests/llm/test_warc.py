import gzip
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelens.llm import warc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.text(max_size=2)), max_size=12), max_size=9))
def test_loser_tree_merges_like_sorting(runs):
    got = list(warc.LoserTree([iter(sorted(r)) for r in runs]))
    assert got == sorted(x for r in runs for x in r)


def _pages(spark):
    same = "<html>" + "copy " * 40
    rows = [(i, f"https://www.site{i % 3}.example.org:80/p/{i % 11}?q#f", same if i % 3 == 0 else f"<p>{i}</p>" * 30)
            for i in range(400)]
    rows += [(1000, None, None), (1001, "not a url\r\nInjected: 1", ""), (1002, "http://a.b/é", "short"),
             (1003, "http://a.b/x", "short"), (None, "http://a.b/y", same), (1004, "http://u:p@WWW2.A.b", "é" * 50),
             (1005, "ftp://a.b", "é" * 50), (1004, "http://u:p@WWW2.A.b", "é" * 50), (1006, "http://a.b/z", "é" * 49)]
    return rows, spark.createDataFrame([(*r, 0, "x") for r in rows],
                                       "page_id long, url string, html string, n int, digest string").repartition(7)


def test_archives_round_trip_in_index_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 5)
    rows, pages = _pages(spark)
    index = warc.merged_index(warc.write(warc.records(pages)), range_entries=40)
    entries = index.orderBy("index_range", "index_row").collect()
    keys = [(e["url_key"], e["captured"], e["page_id"]) for e in entries]
    assert keys == sorted(keys) and len(keys) == len(rows)
    assert len({e["index_range"] for e in entries}) > 3
    # the hot site's captures are in several ranges
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            d = hashlib.sha256(raw).hexdigest()
            first[d] = min(page, first.get(d, page))
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        revisit = len(raw) >= 100 and first[d] != page
        want.append((str(page), len(raw), d, "revisit" if revisit else "response", str(first[d] if revisit else None)))
    got = warc.read(index).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]))
                  for r in got) == sorted(want)


def test_more_runs_than_the_fan_in_are_merged_in_passes(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows, pages = _pages(spark)
    blocks = warc.write(warc.records(pages).repartition(23))
    assert blocks.select("run").distinct().count() == 23
    one = warc.merged_index(blocks, range_entries=30, fan_in=1000)
    many = warc.merged_index(blocks, range_entries=30, fan_in=3)  # 23, 8, 3 runs
    columns = ["url_key", "captured", "page_id", "path", "offset", "length"]

    def keys(index):
        return [tuple(r[c] for c in columns) for r in index.orderBy("index_range", "index_row").collect()]

    got = keys(many)
    assert [k[:3] for k in got] == sorted(k[:3] for k in got) and len(got) == len(rows)
    assert sorted(got) == sorted(keys(one))
    assert warc.read(many).count() == len(rows)


def test_blocks_are_dealt_to_the_ranges_they_reach(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    _, pages = _pages(spark)
    blocks = warc.write(warc.records(pages).repartition(9))
    runs = blocks.select("run").distinct().withColumn("group", F.abs(F.hash("run")) % 2)
    dealt = warc._ranges(blocks.join(runs, "run").withColumn("group", F.col("group").cast("long")), 30, 4).collect()
    for r in dealt:  # every row's block reaches into its range, and no block is missing from one that it reaches
        assert r["low"] is None or r["high"] is None or tuple(r["low"]) < tuple(r["high"])
    reached = {(r["path"], r["block"]) for r in dealt}
    assert reached == {(b["path"], b["block"]) for b in blocks.collect()}


def test_one_key_in_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    pages = spark.createDataFrame([(7, "http://a.b/hot", "x")] * 200 + [(i, "http://a.b/c", str(i)) for i in range(40)],
                                  "page_id long, url string, html string").repartition(6)
    index = warc.merged_index(warc.write(warc.records(pages).repartition(6)), range_entries=8, fan_in=2)
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in index.orderBy("index_range", "index_row").collect()]
    assert len(keys) == 240 and keys == sorted(keys)


def test_records_are_standard_members(spark):
    _, pages = _pages(spark)
    blocks = warc.write(warc.records(pages.where("page_id = 1001")))
    e = warc.merged_index(blocks).first()
    with open(e["path"].removeprefix("file:"), "rb") as f:
        f.seek(e["offset"])
        fields, payload = warc.parse(gzip.decompress(f.read(e["length"])))
    assert payload == b"" and "Injected" not in fields and fields["WARC-Type"] == "response"
    assert fields["WARC-Record-ID"].startswith("<urn:uuid:") and fields["WARC-Date"] == "2024-01-01T00:16:41Z"


def test_url_keys(spark):
    urls = ["https://www.Blog.Example.com:8080/A?b=1#c", "http://example.com", "odd", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(warc.url_key(F.col("url"))).collect()] == [
        "com,example,blog)/A?b=1", "com,example)/", "odd", ""]


def test_empty_table(spark):
    _, pages = _pages(spark)
    blocks = warc.write(warc.records(pages.limit(0)))
    assert warc.read(warc.merged_index(blocks)).count() == 0
