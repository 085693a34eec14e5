import hashlib

import pytest

from causeway.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"", b"plain\n\nbody", warc.http_response(b"x\r\n\r\ny" * 50)]
    data = warc.arc_head(version) + b"".join(warc.arc_record(version, f"http://a/{i}", b, "19990203040506", "text/html") for i, b in enumerate(bodies))
    got = list(warc.read_arc(data))
    assert got[0].url == "filedesc://pages.arc"
    assert [r.body for r in got[1:]] == bodies and [r.url for r in got[1:]] == [f"http://a/{i}" for i in range(3)]


def test_hand_written_archives():
    v1 = (
        b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 70\n1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
        b"\nhttp://x.org/ 1.2.3.4 19961104142103 text/html 44\nHTTP/1.0 200 Document follows\r\n\r\n<b>hi</b>\n\n\n"
        b"\ndns:x.org 1.2.3.4 19961104142104 text/dns 9\nx.org. IN\n"
    )
    got = list(warc.read_arc(v1))
    assert [(r.url, r.ip, r.date, r.content_type) for r in got[1:]] == [
        ("http://x.org/", "1.2.3.4", "19961104142103", "text/html"), ("dns:x.org", "1.2.3.4", "19961104142104", "text/dns")]
    heads = [h for r in got for h, _ in warc.read_warc(warc.warc_record(1, r) + warc.END)]
    assert [(h["warc-type"], h["content-type"]) for h in heads] == [
        ("warcinfo", "application/warc-fields"), ("response", "application/http; msgtype=response"), ("response", "text/dns")]
    v2 = (
        b"filedesc://new.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 new.arc 16\n2 0 Someone\nURL\n"
        b"\nftp://x.org/f 1.2.3.4 19961104142103 text/plain 200 fac069 - 20 new.arc 4\ndata\n"
    )
    got = list(warc.read_arc(v2))
    assert got[1].body == b"data"
    (h, block), = warc.read_warc(warc.warc_record(1, got[1]) + warc.END)
    assert (h["warc-type"], h["content-type"], block) == ("resource", "text/plain", b"data")


def test_odd_header_lines_are_skipped_when_asked():
    first, last = (warc.arc_record(1, f"http://a/{i}", b"abc", "19990203040506", "text/html") for i in range(2))
    data = warc.arc_head(1) + first + b"some odd line\nhttp://q 1 2\n" + last
    with pytest.raises(ValueError):
        list(warc.read_arc(data))
    assert [r.url for r in warc.read_arc(data, strict=False)][1:] == ["http://a/0", "http://a/1"]


def test_arc_errors():
    data = warc.arc_head(1) + warc.arc_record(1, "http://a", b"abc", "19990203040506", "text/html")
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.arc_head(2) + data[len(warc.arc_head(1)) :]))


def test_warc_record_has_equivalent_fields():
    arc = warc.ArcRecord("http://a/", "1.2.3.4", "19990203040506", "text/html", warc.http_response(b"hello"))
    (h, block), = warc.read_warc(warc.warc_record(7, arc) + warc.END)
    assert block == arc.body and h["warc-date"] == "1999-02-03T04:05:06Z" and h["warc-type"] == "response"
    assert h["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"hello").hexdigest()
    (h, block), = warc.read_warc(warc.warc_record(8, arc, 7) + warc.END)
    assert h["warc-type"] == "revisit" and h["warc-refers-to"] == warc.record_id(7, hashlib.sha256(b"hello").hexdigest()) and warc.split_http(block)[1] == b""


def test_hard_pages(spark):
    long = "ä\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(5, None, None, 1), (3, "http://x y\n", "", 1), (9, "u", long, 1), (2, "u", long, 1), (4, "v", "short", 1), (8, "v", "short", 1), (10, "u", long, 1), (10, "u", long, 1)]
    records = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int"), version=2).collect()
    got = {r.page_id: r for r in records}
    assert len(records) == len(rows)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert {i for i in got if got[i].record_type == "revisit"} == {9, 10}
    assert got[9].refers_to == got[10].refers_to == 2 and got[4].refers_to is None


def test_pages_without_id_and_long_ones(spark):
    text = "x" * 200
    rows = [(None, "u", text), (None, "u", text), (7, "u", text), (8, "u", text), (9, "u", "y" * 3_000_000)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got) == [
        ("7", "response", None, 200), ("8", "revisit", 7, 200), ("9", "response", None, 3_000_000),
        ("None", "response", None, 200), ("None", "response", None, 200)]


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query(same_as_sql):
    same_as_sql("op7_warc")
