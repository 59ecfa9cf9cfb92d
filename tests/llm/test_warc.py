import base64
import hashlib

from pyspark.sql import functions as F

from timelake.llm import warc
from timelake.llm.common import fresh_path


def expected(rows, least=0):
    out = []
    last = {}
    for k, _, h in rows:
        if k is not None:
            last[h or ""] = max(last.get(h or "", k), k)
    seen = set()
    for k, _, h in sorted((r for r in rows if r[0] is not None), key=str):
        p = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        same = len(p) >= least and (last[h or ""] != k or (k, h or "") in seen)
        seen.add((k, h or ""))
        out.append((k, len(p), d, "revisit" if same else "response", last[h or ""] if same else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://x/{i}\r\né", "<p>é%d</p>" % (i % 7)) for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "u", "<x>" * 50000), (52, "u", "<x>" * 50000), (None, "u", "z"), (53, "v", "a\r\n\r\nb")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)


def read(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    assert read(warc.round_trip(frame(spark, ROWS))) == expected(ROWS)
    assert read(warc.round_trip(frame(spark, ROWS), min_revisit=9)) == expected(ROWS, 9)
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_rolls_names_and_repeats(spark):
    a, b = fresh_path(spark, "a"), fresh_path(spark, "b")
    one = warc.write_warc(frame(spark, ROWS), a, roll=600).orderBy("file").collect()
    two = warc.write_warc(frame(spark, ROWS[::-1]), b, roll=600).orderBy("file").collect()
    assert one == two and len(one) > 8 and all(r.bytes >= 600 or r.records for r in one)
    texts = {r.page_id: r.payload for r in warc.read_warc(spark, a).where(F.col("record_type") == "response").collect()}
    assert texts[53] == b"a\r\n\r\nb" and texts[52] == b"<x>" * 50000


def test_shards_depend_on_the_records_alone(spark):
    rows = spark.range(0, 60_000, 1, 7).selectExpr("id * 37 % 1000003 as page_id", "'u' as url", "repeat(cast(id % 5000 as string), 3) as html")
    found = []
    for partitions in ("4", "4", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append(warc.write_warc(rows.repartition(int(partitions) + len(found)), fresh_path(spark, "same"), roll=30_000).orderBy("file").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2]
    parts = {r.file[:11] for r in found[0]}
    assert len(parts) == warc.LEAST_RANGES and len(found[0]) > len(parts) and sum(r.records for r in found[0]) == 60_000


def test_payloads_that_many_pages_share(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 5)
    monkeypatch.setattr(warc, "HOT_SHARE", 10)
    assert read(warc.round_trip(frame(spark, ROWS))) == expected(ROWS)
