"""Feed items in source order, however the files are read."""

from pyspark.sql import functions as F

from tracemill.sources import readers


def test_the_first_item_of_a_url_does_not_depend_on_the_split(spark, tmp_path):
    def item(url, title):
        return f"<item><link>{url}</link><title>{title}</title><description>{'text ' * 40}{title}</description></item>"

    for name, size in (("b", 40), ("a", 3), ("c", 200)):  # the largest file is planned first
        rows = [item(f"http://x/{i % 7}", f"{name}{i}") for i in range(size)]
        (tmp_path / f"{name}.xml").write_text("<rss>" + "\n".join(rows) + "</rss>")
    want = {**{f"http://x/{i}": f"b{i}" for i in range(3, 7)}, **{f"http://x/{i}": f"a{i}" for i in range(3)}}
    now = F.lit("2024-01-01").cast("timestamp")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("2000b", "16k", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            found = readers.feed_articles(readers.read_feed_files(spark, str(tmp_path)), F.lit("s"), now).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert {r.url: r.title for r in found} == want
