import base64
import hashlib
import io

import pytest
import zstandard

from tablewright.llm import warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "<p>same</p>"),
    (3, None, "<p>other</p>" * 3),
    (4, "http://a/4\r\nX: y", "<p>same</p>"),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "WARC/1.1\r\n\r\n é日🙂 " * 20_000),
    (7, "http://a/7", "WARC/1.1\r\n\r\n é日🙂 " * 20_000),
    (None, "http://a/n", "<p>same</p>"),
    (None, "http://a/m", "alone"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(
        [(*r, "x", "x") for r in rows], "page_id bigint, url string, html string, content string, rid string"
    )


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, least):
    manifest = warc.write_archives(pages(spark), revisit_from_bytes=least)
    rows = warc.read_archives(manifest).collect()
    assert len(rows) == len(PAGES) == sum(r["records"] for r in manifest.collect())
    last = {}
    for i, _, html in PAGES:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    wanted = []
    for i, url, html in PAGES:
        data = (html or "").encode()
        first = last.get(html or "")
        revisit = len(data) >= least and i != first and sum((h or "") == (html or "") for _, _, h in PAGES) > 1
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        plain = None if url is None else url.replace("\r", "").replace("\n", "")
        wanted.append((i, plain, "revisit" if revisit else "response", first if revisit else None, len(data), digest, None if revisit else data))
    got = [(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0


def archive(n=300):
    records = [warc.page_record(i, f"http://h/{i}", f"<p>page {i} {'text ' * (i % 40)}</p>".encode(), False, None, "2020-01-01T00:00:00Z") for i in range(n)]
    return records, warc.build_archive(records)


def test_one_frame_per_record_after_the_dictionary():
    records, data = archive()
    assert data[:4] == warc.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    at, view = 8 + size, memoryview(data)
    for record in records:
        length = warc.frame_length(view[at:])
        assert zstandard.ZstdDecompressor(dict_data=known).decompress(data[at : at + length]) == record
        at += length
    assert at == len(data)
    # an ordinary reader that knows the dictionary sees one stream
    stream = zstandard.ZstdDecompressor(dict_data=known).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True)
    assert stream.read() == b"".join(records)


def test_few_records_need_no_dictionary():
    records, data = archive(1)
    assert data[:4] == warc.FRAME and len(list(warc.read_archive(data))) == 1


def test_damage_is_noticed():
    _, data = archive()
    for bad in (data[:-3], data[:6000], b"\0" + data[1:], data + b"junk", data[:-20] + bytes(10) + data[-10:]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(bad))
    good = warc.page_record(1, "http://h/", b"payload", False, None, "2020-01-01T00:00:00Z")
    fields, block = warc.parse_record(good)
    assert warc.page_of(fields, block)["payload"] == b"payload"
    for old, new in (
        (b"WARC/1.1", b"WARC/2.0"),
        (b"WARC-Date", b"Date"),
        (b"payload\r\n\r\n", b"payloae\r\n\r\n"),
        (b"payload\r\n\r\n", b"payload\r\n\r\n\r\n"),
        (b"Content-Length: 7", b"Content-Length: 9"),
        (b"x-page:1>", b"x-other:1>"),
    ):
        with pytest.raises(warc.ArchiveError):
            warc.page_of(*warc.parse_record(good.replace(old, new)))


def test_archives_of_other_writers(spark, tmp_path):
    """Frames without a stated size, field names in any case, the older version, other record types."""
    page = warc.page_record(7, "http://a", b"<p>hi</p>" * 300, False, None, "2020-01-01T00:00:00Z")
    older = page.replace(b"WARC/1.1", b"WARC/1.0", 1).replace(b"Content-Length: ", b"content-length: ", 1).replace(b"WARC-Type", b"warc-TYPE")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: x\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"

    def streamed(record):
        packer = zstandard.ZstdCompressor().compressobj()
        return packer.compress(record) + packer.flush()

    data = b"".join(streamed(r) for r in (info, page, older))
    assert zstandard.frame_content_size(data) < 0
    fields = [f for f, _ in warc.read_archive(data)]
    assert [f["WARC-Type"] for f in fields] == ["warcinfo", "response", "response"]
    path = tmp_path / "a.warc.zst"
    path.write_bytes(data)
    manifest = spark.createDataFrame([(str(path), 3, len(data))], warc.MANIFEST)
    rows = warc.read_archives(manifest).collect()
    assert [(r["page_id"], r["payload_bytes"]) for r in rows] == [(7, 2_700)] * 2
