"""Archives whose records share an id, and headers longer than a block."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from streamloom.llm import warc


def test_records_of_one_id(spark):
    long = ["long é " * 90_000, "other è " * 90_000, "third " * 120_000]
    url = "http://x/" + "u" * 200_000
    rows = [(1, "http://x/1", long[0])] * 3 + [(2, "http://x/2", long[0])] * 2 + [(1, "http://x/3", long[2])]
    rows += [(None, "http://x/n", long[1]), (None, "http://x/n", long[1]), (None, url, "<p>c</p>"), (None, "http://x/m", "m" * 600_000), (7, url, long[2] + "7")]
    chunks = warc.write_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = Counter(map(tuple, warc.read_records(chunks.repartition(3, "chunk")).collect()))
    want = Counter()
    for i, u, h in rows:
        body = h.encode()
        again = i == 2
        want[i, len(body), warc.base32_digest(hashlib.sha1(body).digest()), "revisit" if again else "response", 1 if again else None, u] += 1
    assert got == want
    assert chunks.select("row").distinct().count() == len(rows)
    broken = chunks.where((F.col("record") != "<urn:page:none>") | (F.col("chunk") != 1))
    with pytest.raises(Exception, match="out of order|digest"):
        warc.read_records(broken).collect()
