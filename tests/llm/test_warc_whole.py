"""Every written record is read, however long its header."""

import io

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import new_path


@pytest.mark.parametrize("packed", [True, False])
def test_warc_long_headers(packed):
    urls = ["u", "data:" + "x" * 3_000_000, "v"]
    made = [warc.build_record(i, u, b"payload", None, "") for i, u in enumerate(urls)]
    data = b"".join(warc.gzip_member(r) if packed else r for r in made)
    assert [(x[0], x[2]["warc-target-uri"]) for x in warc.SalvageReader(io.BytesIO(data))] == [("record", u) for u in urls]


def test_op4_reads_every_page_or_fails(spark, tmp_path):
    pages = spark.createDataFrame([(i, "data:" + "x" * (70_000 * i), f"html {i}") for i in range(4)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["page_id"] for r in warc.op4_warc(spark, str(tmp_path)).collect()} == set(range(4))
    a = warc.write_archives(pages, new_path(spark, "t")).withColumn("n_records", F.col("n_records") + 1)
    with pytest.raises(Exception, match="records, but"):
        warc.read_archives(a, whole=True).count()
