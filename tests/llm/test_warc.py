"""Round trip of records, framing and digests."""

import io

import pytest

from candlewake.llm import warc as W


def test_records_come_back_from_their_members():
    payloads = [b"", b"x" * 300, "é\r\n\r\nWARC/1.1".encode(), bytes(range(256)) * 5000]
    file = b"".join(W.record(i, f"http://h/{i}\r\nEvil: 1", p, W.hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads))
    file += W.record(9, None, payloads[1], W.hashlib.sha256(payloads[1]).hexdigest(), 1)
    got = [W.parse(*r) for r in W.read_records(io.BytesIO(file))]
    assert [g[0] for g in got] == [0, 1, 2, 3, 9] and [g[6] for g in got] == [*payloads, None]
    assert got[4][2:6] == (300, W.hashlib.sha256(payloads[1]).hexdigest(), "revisit", 1)
    assert got[0][1] == "http://h/0%0D%0AEvil:%201"


def test_damage_is_an_error(monkeypatch):
    good = W.record(1, "u", b"x" * 300, W.hashlib.sha256(b"x" * 300).hexdigest(), None)
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(good[:-20])))
    wrong = W.record(1, "u", b"x" * 300, W.hashlib.sha256(b"y").hexdigest(), None)
    with pytest.raises(ValueError):
        [W.parse(*r) for r in W.read_records(io.BytesIO(wrong))]
    pack = W.zlib.compressobj(6, W.zlib.DEFLATED, 31)
    plain = W.zlib.decompress(good, 31).replace(b"x" * 300, b"x" * 299 + b"z")
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(pack.compress(plain) + pack.flush())))


def test_archives_roll_and_payloads_return(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 2000)
    rows = [(i, "u", f"<p>{i % 7}</p>" * 40) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = W.write(pages)
    got = {r.page_id: r for r in W.read(files, payloads=True).collect()}
    assert files.count() > 3 and len(got) == 60
    for i, _, html in rows:
        first = i % 7
        assert got[i].refers_to == (first if i != first else None)
        assert got[i].payload == (html.encode() if i == first else None)
