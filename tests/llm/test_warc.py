"""Archives against the pages they are of, and against the format."""

import base64
import glob
import gzip
import hashlib
import tempfile

import pytest

from tessera.llm import warc

MARK = "WARC/1.1\r\nWARC-Type: response\r\n\r\n"
PAGES = [(1, "http://a/1", "<p>same"), (2, "http://a/2", "<p>same"), (3, None, "<p>same"), (4, "x", None), (5, "y", ""), (6, "http://b\r\nWARC-Type: evil", "once\r\n\r\nmore\r\n\r\n"), (7, "u", MARK), (8, "u", MARK), (9, "é", "ü" * 100_000), (None, "n", "<p>same"), (10, "z", "tie"), (10, "z", "tie")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(p, u, h, 1, "x", None) for p, u, h in PAGES], "page_id bigint, url string, html string, salt int, type string, digest string").repartition(3)


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, pages):
    last = {}
    for p, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    got = warc.round_trip(pages).collect()
    rows = sorted((tuple(r) for r in got if r.page_id != 10), key=str)
    want = sorted(((p, len((h or "").encode()), sha(h), "response" if p == last[h or ""] else "revisit", None if p == last[h or ""] else last[h or ""]) for p, _, h in PAGES if p != 10), key=str)
    assert rows == want
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 10) == [("response", None), ("revisit", 10)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_responses(pages):
    got = {r.page_id: r.record_type for r in warc.round_trip(pages, least_bytes=8).collect() if r.page_id != 10}
    assert {p: got[p] for p in (1, 4, 7, 8)} == {1: "response", 4: "response", 7: "revisit", 8: "response"}


def records(path):
    """Headers and blocks of an archive, by the format alone: version line, fields, a block of Content-Length bytes, two line ends."""
    for name in sorted(glob.glob(f"{path}/*.gz")):
        data, at = gzip.open(name).read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            version, *lines = data[at:end].decode().split("\r\n")
            assert version == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines)
            size = int(fields["Content-Length"])
            block = data[end + 4 : end + 4 + size]
            assert data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
            at = end + 8 + size
            yield fields, block


def test_archives_follow_the_format(spark, pages):
    base = tempfile.mkdtemp(prefix="spark-")
    archive = warc.write(pages, f"{base}/all")
    new = warc.deduplicate(spark, f"{base}/all", archive, f"{base}/once")
    first, second = list(records(f"{base}/all")), list(records(f"{base}/once"))
    for found, info in ((first, archive), (second, new)):
        kinds = [f["WARC-Type"] for f, _ in found]
        assert len(found) == len(PAGES) + 1 and kinds.count("warcinfo") == 1
        assert {f["WARC-Warcinfo-ID"] for f, _ in found} == {f"<urn:uuid:{info}>"} and len({f["WARC-Record-ID"] for f, _ in found}) == len(found)
    assert sorted(b.partition(b"\r\n\r\n")[2] for f, b in first if f["WARC-Type"] == "response") == sorted((h or "").encode() for _, _, h in PAGES)
    responses = {f["WARC-Record-ID"]: (f, b) for f, b in second if f["WARC-Type"] == "response"}
    assert not {f["WARC-Record-ID"] for f, _ in first} & set(responses)
    assert len({f["WARC-Payload-Digest"] for f, _ in responses.values()}) == len(responses) == len({h or "" for _, _, h in PAGES})
    for f, b in second:
        payload = b.partition(b"\r\n\r\n")[2]
        if f["WARC-Type"] == "revisit":
            original, block = responses[f["WARC-Refers-To"]]
            assert not payload and original["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] == f"sha1:{sha(block.partition(b'\r\n\r\n')[2].decode())}"
        elif f["WARC-Type"] == "response":
            assert f["WARC-Payload-Digest"] == f"sha1:{sha(payload.decode())}" and int(f["X-Payload-Length"]) == len(payload)


def test_a_damaged_record_is_an_error(spark, pages):
    base = tempfile.mkdtemp(prefix="spark-")
    archive = warc.write(pages, f"{base}/all")
    name = next(x for x in glob.glob(f"{base}/all/*.gz") if b"once" in gzip.open(x).read())
    data = gzip.open(name).read().replace(b"once", b"wonce")
    with gzip.open(name, "wb") as f:
        f.write(data)
    for crc in glob.glob(f"{base}/all/.*.crc"):
        __import__("os").unlink(crc)
    with pytest.raises(Exception, match="cut short|as its digest"):
        warc.read(spark, f"{base}/all", archive).collect()
