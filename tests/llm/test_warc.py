import gzip
import hashlib
import io
import json

import pytest

from quarry.llm import warc as W


def records(n):
    return [W.page_record(i, f"https://x.example/{i}", f"<p>{i}</p>".encode() * (i * 40 + 1), "0" * 40, None if i % 3 else 1) for i in range(n)]


@pytest.mark.parametrize("members", [1, 3])
def test_monolith_becomes_members(tmp_path, members):
    every = records(9)
    step = len(every) // members
    source = tmp_path / "a.warc.gz"
    source.write_bytes(b"".join(gzip.compress(b"".join(every[k : k + step])) for k in range(0, len(every), step)))
    assert W.normalise_file(f"file://{source}", f"file://{tmp_path}/b.warc.gz") == 9
    index = [json.loads(x) for x in (tmp_path / "b.warc.gz.idx").read_text().splitlines()]
    data = (tmp_path / "b.warc.gz").read_bytes()
    assert [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index] == every
    assert index[-1]["offset"] + index[-1]["length"] == len(data) and gzip.decompress(data) == b"".join(every)
    assert index[4]["uri"] == "https://x.example/4" and not list(tmp_path.glob("*.tmp"))


def test_pieces_may_end_anywhere():
    every = records(7)
    whole = b"".join(every)
    for size in (1, 7, 100, 10**6):
        got = list(W.split_records(whole[i : i + size] for i in range(0, len(whole), size)))
        assert [W.parse_record(x + b"\r\n\r\n") for x in got] == [W.parse_record(x) for x in every]
    with pytest.raises(ValueError):
        list(W.split_records([whole[:-40]]))
    assert b"".join(W.inflate(io.BytesIO(gzip.compress(whole[:50]) + gzip.compress(whole[50:])), 13)) == whole


def test_pages(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 4000)
    big, wide = "x" * 1000, "é" * 500
    rows = [(1, "https://a/", big), (2, "https://b/", big), (3, "https://c/", "small"), (4, "https://d/", "small"), (5, None, wide), (6, "https://e/\r\nX: y", wide), (7, "https://f/", "x" * 999), (8, "https://g/", None), (9, "https://h/", "x" * 999), (10, "https://i/", "")]
    df = spark.createDataFrame([(*r, "k", b"p") for r in rows], "page_id long, url string, html string, key string, payload binary").repartition(3)
    got = {r.page_id: r for r in W.page_archives(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        copies = [j for j, _, h in rows if (h or "") == (html or "")]
        first = max(copies) if len(payload) >= 1000 else i
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))


def test_edges(spark):
    schema = "page_id long, url string, html string"
    assert W.page_archives(spark.createDataFrame([], schema)).count() == 0
    big = "y" * 2000
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in W.page_archives(spark.createDataFrame([(None, "u", big), (2, "u", big), (2, "u", big), (1, "u", big)], schema)).collect())
    assert got == [("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("None", "revisit", 2)]


def test_truncated_trailers_are_noticed(tmp_path):
    whole = gzip.compress(b"".join(records(3)))
    for cut in (1, 4, 8, 30):
        with pytest.raises(ValueError):
            list(W.inflate(io.BytesIO(whole[:-cut])))
    assert b"".join(W.inflate(io.BytesIO(whole + b"\0" * 100 + whole), 64)) == b"".join(records(3)) * 2


def test_record_ids_are_unique_and_revisits_name_their_response(spark, tmp_path):
    big = "z" * 1500
    rows = [(2, "https://a/", big), (2, "https://a/", big), (1, "https://b/", big), (3, "https://c/", "s"), (3, "https://c/", "s")]
    got = W.page_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).select("archive").distinct().collect()
    ids, revisits = [], []
    for r in got:
        with gzip.open(r.archive.removeprefix("file:")) as f:
            for data in W.split_records(iter([f.read()])):
                fields, _ = W.parse_record(data)
                ids.append(fields["warc-record-id"])
                revisits += [fields] if fields["warc-type"] == "revisit" else []
    assert len(set(ids)) == len(ids) == 5
    assert [(f["warc-refers-to-target-uri"], f["warc-refers-to-date"]) for f in revisits] == [("https://a/", W.DATE)]
