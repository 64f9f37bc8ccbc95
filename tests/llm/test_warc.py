import base64
import gzip
import hashlib
import io

import pytest

from folioscope.llm import warc

PAGES = "page_id long, url string, html string, payload string, first long"


def brute(pages):
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    rows = []
    for p, _, h in pages:
        body = (h or "").encode()
        least = first.get(h or "")
        kind = "response" if p == least else "revisit"
        rows.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, None if kind == "response" else least))
    return sorted(rows, key=str)


def test_round_trip(spark):
    pages = [(i, f"http://h{i % 5}.example/ü {i}\n", f"<p>page {i % 17}</p>" * (i % 9)) for i in range(120)]
    pages += [(500, None, None), (501, "u", ""), (None, "u", "<p>page 3</p>"), (None, None, "alone"), (7, "u", pages[7][2]), (502, "u", "long € " * 60000), (503, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n")]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], PAGES)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == brute(pages)


def test_normaliser_makes_a_member_for_each_record(tmp_path):
    folder = warc.Folder(f"file://{tmp_path}")
    records = [warc.page_record(i, "u", b"x" * i * 1000, warc.payload_digest(b"x" * i * 1000), i, False) for i in range(20)]
    assert warc.write_monolithic(folder, "a.warc.gz", records) == 20
    index = list(warc.normalise(folder, "a.warc.gz", "b.warc.gz"))
    data = (tmp_path / "b.warc.gz").read_bytes()
    whole = gzip.decompress((tmp_path / "a.warc.gz").read_bytes())
    assert gzip.decompress(data) == whole
    assert [r[1] + r[2] for r in index[:-1]] == [r[1] for r in index[1:]] and index[-1][1] + index[-1][2] == len(data)
    for (_, offset, length, name, _), record in zip(index, records):
        member = gzip.GzipFile(fileobj=io.BytesIO(data[offset : offset + length])).read()
        assert member == record.body() and name == record.headers["WARC-Record-ID"]
    lines = (tmp_path / "b.warc.gz.idx").read_text().splitlines()
    assert lines == ["\t".join(map(str, r[1:])) for r in index]
    assert not [p for p in tmp_path.iterdir() if p.name not in ("a.warc.gz", "b.warc.gz", "b.warc.gz.idx")]


def test_a_cut_archive_is_an_error(tmp_path):
    folder = warc.Folder(f"file://{tmp_path}")
    warc.write_monolithic(folder, "a.warc.gz", [warc.page_record(1, "u", b"abc", "D", 1, False)])
    whole = gzip.decompress((tmp_path / "a.warc.gz").read_bytes())
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(whole[:-20]))
    with pytest.raises(ValueError):
        list(warc.normalise(folder, "c.warc.gz", "d.warc.gz"))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_a_task_that_runs_twice_in_another_order(spark, tmp_path, monkeypatch):
    """Each attempt's own result reads its own files; small files and ranges make several of each."""
    from folioscope.llm.common import saved

    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    pages = [(i, "u", f"<p>{i % 40}</p>" * (i % 30)) for i in range(150)] + [(900 + i, "u", "") for i in range(40)]
    uri = f"file://{tmp_path}"
    orders = [pages, pages[::-1]]
    ranges = [saved(warc.write_archives(spark.createDataFrame([(*p, "x", 1) for p in rows], PAGES).coalesce(1), uri)) for rows in orders]
    for own in ranges:
        assert own.count() > 5 and sorted(map(tuple, warc.read_archives(own, uri).collect()), key=str) == brute(pages)


def test_well_compressed_input_comes_in_portions():
    data = gzip.compress(b"\0" * 50_000_000) + gzip.compress(b"end")
    sizes = [len(x) for x in warc.inflated(io.BytesIO(data))]
    assert sum(sizes) == 50_000_003 and max(sizes) <= 1 << 20


def test_ranges_cover_the_sidecar(tmp_path):
    folder = warc.Folder(f"file://{tmp_path}")
    warc.write_monolithic(folder, "a", (warc.page_record(i, "u", b"x" * i, "D", i, False) for i in range(20)))
    ranges = list(warc._ranges(warc.normalise(folder, "a", "b"), 7))
    lines = [(tmp_path / "b.idx").read_bytes()[start : start + length].decode().splitlines() for _, start, length, _, _ in ranges]
    assert [len(x) for x in lines] == [7, 7, 6] == [r[3] for r in ranges] and sum(lines, []) == (tmp_path / "b.idx").read_text().splitlines()
    assert sum(r[4] for r in ranges) == (tmp_path / "b").stat().st_size
