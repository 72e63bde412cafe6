import hashlib
import io

import pytest

from lensaudit.llm import common, warc

SCHEMA = "page_id long, url string, html string, archive string, digest string"


def _run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = warc.read_pages(spark, warc.write_pages(df, common.work_dir(spark, "warc")))
    return sorted(map(tuple, out.collect()), key=repr)


def _brute(rows):
    out = []
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        ids = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        first = min(ids, default=None)
        again = len(raw) >= 100 and first is not None and page != first
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip_with_copies_nulls_and_clashing_columns(spark):
    long, text = "é<p>" * 60, "x" * 99
    rows = [(5, "http://a/\r\nX: y", long, "x", "y"), (3, "http://b/", long, None, None), (9, None, long, None, None), (1, "u", None, None, None), (2, "u", "", None, None), (7, "ü", text, None, None), (8, "u", text, None, None), (None, "u", long, None, None), (3, "http://b/", long, None, None)]
    assert _run(spark, rows) == _brute(rows)


def test_empty_table_and_only_null_ids(spark):
    assert _run(spark, []) == []
    rows = [(None, "u", "z" * 200, None, None)] * 2
    assert [r[3] for r in _run(spark, rows)] == ["response"] * 2


def _archive(records):
    return b"".join(warc.write_archive(iter(records), warc.train([b"<html>page %d</html>" % i for i in range(3)])))


def _read(raw, chunk=7):
    return list(warc.read_archive(io.BytesIO(raw), chunk))


def test_reader_takes_any_chunking_and_an_empty_archive():
    records = [warc.make_record(i, "u", b"p" * i * 50, "0" * 64, None, False) for i in range(4)]
    for chunk in (1, 7, 1 << 20):
        assert [len(b.partition(b"\r\n\r\n")[2]) for _, b in _read(_archive(records), chunk)] == [0, 50, 100, 150]
    assert _read(_archive([])) == []


def test_reader_rejects_faults():
    good = warc.make_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    whole = _archive([good])
    for raw in (b"", whole[:6], whole[:200], whole[:-3], b"\0" * 8 + whole[8:], _archive([good[:-4]]), _archive([good + good]), _archive([good.replace(b"payload\r\n", b"payloaX\r\n")]), _archive([good.replace(b"WARC-Date", b"X-Date")]), _archive([good.replace(b"WARC/1.1", b"WURC/1.1")])):
        with pytest.raises(warc.WarcError):
            _read(raw)
    fields, block = _read(whole)[0]
    fields["warc-payload-digest"] = "sha256:" + "0" * 64
    with pytest.raises(warc.WarcError):
        warc.page_record(fields, block)
