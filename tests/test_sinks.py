"""Sinks and readers of the sources, on odd texts and orders."""

from warraq import registry
from warraq.sources import corpus

ODD = [None, "", " ", "  a", "a\t", "\na\n", "\n\n\"", "a\rb", "a\r\nb\r\n", '"', '""', 'a "b", c\n"d"', "\\", 'a\\"b', ",", "\x00", "\x00a", "\x1fa\x1f", "null", "﻿a", " a "]


def test_csv_keeps_odd_texts(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 2 else " en", t) for i, t in enumerate(ODD)], "doc_id long, lang string, text string")
    for k, df in enumerate((rows, rows.select("text"))):
        corpus.write_csv(df, f"{tmp_path}/{k}")
        back = corpus.read_csv(spark, f"{tmp_path}/{k}", df.schema)
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_csv_roundtrip_of_odd_documents(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(ODD)]
    spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()["sink_csv_roundtrip"](spark, str(tmp_path)).collect() == [(len(rows) + 3, 0, 0)]


def test_csv_roundtrip_counts_what_is_lost_and_made(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a", "en"), (1, "a", "en"), (2, "b", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    read = corpus.read_csv
    monkeypatch.setattr(corpus, "read_csv", lambda *a: read(*a).distinct().union(spark.createDataFrame([(3, "en", "c")], "doc_id long, lang string, text string")))
    assert registry.queries()["sink_csv_roundtrip"](spark, str(tmp_path)).collect() == [(3, 1, 1)]


def test_archive_pages_with_equal_addresses_come_by_page(spark, tmp_path):
    """Larger files are read first, so pages of the same address and order lay in the order of files before."""
    page = lambda i, size: (i, f"http://a.com/en/{i // 14}", f"<p>{i}</p>" + "x" * size)
    for name, first, size in (("a", 0, 1), ("b", 7, 40), ("c", 14, 900), ("d", 21, 9000)):
        spark.createDataFrame([page(first + i, size) for i in range(7)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet/k={name}")
    got = registry.queries()["src_archive_pages"](spark, str(tmp_path)).orderBy("seq").collect()
    want = sorted(range(28), key=lambda i: (i % 7, i // 14, i))
    assert [r.seq for r in got] == list(range(28))
    assert [int(r.html[3 : r.html.index("</p>")]) for r in got] == want
