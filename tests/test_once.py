"""Landed days that come again."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lotwatch.schemas import FX
from lotwatch.sources import udtfs
from lotwatch.streaming import once
from tests.test_listings import incoming


def test_days_count_once(spark, tmp_path):
    """A replayed, a doubled and a late day give one row each, over restarts; one that comes far too late gives none."""
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda day, usd: (day, datetime(2026, 1, 1), "GBP", {"USD": usd})
    runs = [[row(date(2026, 1, 1), 1.0), row(date(2026, 1, 1), 1.0)], [row(date(2026, 1, 3), 3.0), row(date(2026, 1, 1), 1.5)], [row(date(2026, 1, 2), 2.0), row(None, 9.0)], [row(date(2026, 1, 30), 4.0)], [row(date(2026, 1, 4), 5.0), row(date(2026, 1, 30), 4.0)]]
    for rows in runs:
        spark.createDataFrame(rows, FX).coalesce(1).write.mode("append").parquet(landing)
        once.rates(spark, landing, root).awaitTermination()
    got = spark.read.parquet(f"{root}/rates").select("date", "rates").collect()
    assert sorted((r["date"].day, r["rates"]["USD"]) for r in got) == [(1, 1.0), (2, 2.0), (3, 3.0), (30, 4.0)]


def test_listings_count_once(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = incoming(spark, {"id": "ebay:1"}, {"id": "ebay:2"}).drop("ordinal")
    for day in ("2026-01-01", "2026-01-01", "2026-01-02"):
        rows.withColumn("day", F.lit(day).cast("date")).coalesce(1).write.mode("append").parquet(landing)
        once.listings(spark, landing, root).awaitTermination()
    got = spark.read.parquet(f"{root}/landed").collect()
    assert sorted((r["id"], r["day"].day) for r in got) == [("ebay:1", 1), ("ebay:1", 2), ("ebay:2", 1), ("ebay:2", 2)]


def test_table_functions(spark):
    """Nulls and empty pages have no rows; feeds of both kinds, entities, CDATA and namespaces give the same."""
    udtfs.register(spark)
    rss = '<?xml version="1.0"?><rss xmlns:media="http://m.example/"><channel><title>no item</title><item><title><![CDATA[A & B &nbsp;c]]></title><link>https://x.example/1</link><pubDate>today</pubDate><description>&lt;b&gt;big&lt;/b&gt; &eacute;t&eacute;</description><media:thumbnail url="https://i.example/1"/></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A &amp; B &#38;nbsp;c</title><link href="https://x.example/1"/><updated>today</updated><summary type="html">&lt;b&gt;big&lt;/b&gt; été&lt;img src="https://i.example/1"&gt;</summary></entry></feed>'
    rows = spark.createDataFrame([(1, rss), (2, atom), (3, None), (4, " "), (5, "<rss/>")], "i int, body string")
    rows.createOrReplaceTempView("pages_of_test")
    got = spark.sql("SELECT p.i, e.* FROM pages_of_test p, LATERAL feed_items(p.body) e ORDER BY i").collect()
    assert [tuple(r) for r in got] == [(i, 0, "A & B &nbsp;c", "https://x.example/1", "today", "big été", "https://i.example/1") for i in (1, 2)]
    got = spark.sql("""SELECT p.i, e.pos, e.t FROM pages_of_test p, LATERAL page_elements(p.body, 'item', '{"t": "title"}') e""").collect()
    assert [(r["i"], r["pos"]) for r in got] == [(1, 0)]
    with pytest.raises(Exception, match="constant card"):
        spark.sql("SELECT e.* FROM pages_of_test p, LATERAL page_elements(p.body, p.body, '{}') e").collect()
