import hashlib

from tabulith.llm import warc


def page_rows():
    big = "<p>ü " + "x" * 1200 + "</p>"
    rows = [(i, f"http://h/{i}", f"<html>{i} " + f"paragraph {i % 7} " * 200) for i in range(60)]
    rows += [(100, "u", big), (101, None, big), (102, "u", big), (102, "u", big), (None, "u", big), (200, "a\r\nb", "small"), (201, "c", "small"), (300, "n", None), (301, "e", "")]
    return rows + [(400, "long", "<div>" * 400_000)]


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = max(same, default=None)
        revisit = len(data) >= 1000 and first is not None and i != first
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, size string")
    archives = warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(archives).collect()
    assert all(r.error is None for r in got)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(rows)
    html = {i: h for i, _, h in rows}
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in got if r.record_type == "response")
    first = archives.first().archive.removeprefix("file://")
    assert open(first, "rb").read(4) in (warc.DICTIONARY_MAGIC, warc.FRAME_MAGIC)


def test_dictionary_is_used():
    records = [warc._record(i, "u", f"<p>{'shared words here ' * 60}{i * 7919}".encode(), None, False, "d") for i in range(400)]
    data = warc._archive(records)
    assert data[:4] == warc.DICTIONARY_MAGIC
    at = [0]

    def read(n):
        out = data[at[0] : at[0] + n]
        at[0] += n
        return out

    assert list(warc._frames(read)) == records


def test_damage(spark, tmp_path):
    good = warc._record(1, "u", b"abc", None, False, "d")
    assert warc.parse_record(good)["error"] is None
    for bad in (good[:-1], good.replace(b"WARC-Date", b"X-Date"), good.replace(b"abc", b"abd"), b"junk", good.replace(b"WARC/1.1", b"WURC/1.1")):
        assert warc.parse_record(bad)["error"]
    path = tmp_path / "cut.warc.zst"
    path.write_bytes(warc._archive([good, good])[:-9])
    rows = warc.read_warc(spark.createDataFrame([(f"file://{path}",)], "archive string")).collect()
    assert [r.error is None for r in rows] == [True, False]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(pages)).count() == 0


def test_empty_pages_pass_by(spark):
    """Empty pages are one payload, and still in many archives of many tasks: they meet in no join."""
    pages = spark.range(0, 100_000, 1, 6).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, '', NULL) AS html")
    archives = warc.write_warc(pages)
    assert archives.count() >= 6 and archives.agg({"records": "max"}).first()[0] < 30_000
    got = warc.read_warc(archives, with_payload=False)
    assert got.where("record_type = 'response' AND payload_bytes = 0 AND error IS NULL").count() == 100_000
