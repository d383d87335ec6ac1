"""Archives: what is written is read back, by offsets, whatever payloads hold."""

import base64
import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest

from terrane.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(rng):
    odd = ["", None, "\r\n\r\n", "\r\n", "\r", "\n\n", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "x\r\r\n\r\n", "\x00\x01 ퟿ \U0001f600", "ends\r\n", "ends\r\n\r"]
    rows = [(i, f"http://a/{i}", html) for i, html in enumerate(odd)]
    rows += [(100 + i, "http://b/\r\nWARC-Type: forged", "<p>hot</p>") for i in range(60)]  # a third of all
    rows += [(200 + i, None, "".join(rng.choice("\r\n<a>ä ") for _ in range(rng.randrange(1, 3000)))) for i in range(60)]
    rows += [(300, "http://long", "long " * 400_000), (None, "http://none", "<p>hot</p>"), (None, None, "only without ids"), (None, None, "only without ids"), (400, "u", "again"), (400, "u", "again"), (399, "u", "again"), (-5, "u", "negative"), (2**40, "u", "negative")]
    return rows


def plain(rows, min_bytes=0):
    largest, times = {}, {}
    for i, _, html in rows:
        times[html or ""] = times.get(html or "", 0) + 1
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keep = largest.get(html or "")
        revisit = len(data) >= min_bytes and times[html or ""] > 1 and i != keep
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    return pages(random.Random(4))


@pytest.fixture(scope="module")
def table(spark, rows):
    from pyspark.sql import functions as F

    clashing = ("payload", "keep", "sha256", "of", "largest", "value", "head", "block", "archive", "offset", "path", "a.b", "a`b")
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(7) for c in clashing})


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("min_bytes", [0, 6, 10**9])
def test_round_trip(table, rows, min_bytes):
    assert got(warc.archived_pages(table, min_bytes)) == plain(rows, min_bytes)


def test_files(spark, table, rows, tmp_path):
    """The first files are one stream each; the others hold a member a record where the index says, and payloads come back whole."""
    warc.write_archives(table, str(tmp_path / "streams"))
    before = sorted(tmp_path.glob("streams/*.gz"))
    for file in before:
        one = zlib.decompressobj(31)
        one.decompress(file.read_bytes())
        assert one.eof and not one.unused_data
    index = warc.normalise(spark, str(tmp_path / "streams"), str(tmp_path / "archives"), most_bytes=20_000)
    archives = {f.name: f.read_bytes() for f in tmp_path.glob("archives/*.warc.gz")}
    members = index.collect()
    assert len(members) == len(rows) and len(archives) > len(before)
    assert {m["archive"] for m in members} == set(archives)
    for name, data in archives.items():
        own = sorted((m["offset"], m["length"]) for m in members if m["archive"] == name)
        assert [o for o, _ in own] == [0, *(o + n for o, n in own)][:-1] and sum(own[-1]) == len(data)
        for offset, length in own:
            one = zlib.decompressobj(31)
            record = one.decompress(data[offset : offset + length])
            assert one.eof and not one.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    # the same records, in all, as in the streams
    assert sorted(b"".join(gzip.decompress(f.read_bytes()) for f in before)) == sorted(b"".join(map(gzip.decompress, archives.values())))
    payloads = {r["page_id"]: r["payload"].decode() for r in warc.read_records(spark, str(tmp_path / "archives")).where("record_type = 'response' and page_id is not null").collect()}
    assert payloads == {i: html or "" for i, _, html in rows if i in payloads}
    one = warc.read_records(spark, str(tmp_path / "archives"), index.where("page_id = 300")).collect()
    assert len(one) == 1 and one[0]["payload"].decode() == "long " * 400_000 and one[0]["url"] == "http://long"


def test_targets_cannot_forge_heads(spark, table, tmp_path):
    warc.write_archives(table, str(tmp_path / "streams"))
    index = warc.normalise(spark, str(tmp_path / "streams"), str(tmp_path / "archives"))
    assert {r["url"] for r in index.where("page_id between 100 and 159").collect()} == {"http://b/%0D%0AWARC-Type: forged"}


def test_damage_is_found(spark, table, tmp_path):
    warc.write_archives(table.where("page_id >= 200 and page_id < 300"), str(tmp_path / "streams"))
    index = warc.normalise(spark, str(tmp_path / "streams"), str(tmp_path / "archives"), level=0)
    file = next(iter(tmp_path.glob("archives/*.warc.gz")))
    file.write_bytes(file.read_bytes().replace("ä".encode(), "ö".encode()))
    with pytest.raises(Exception, match="incorrect data check|digest"):
        warc.read_records(spark, str(tmp_path / "archives"), index).collect()


def test_attempts_that_are_lost(spark, table, tmp_path):
    """Files that no accepted attempt wrote are not read."""
    warc.write_archives(table, str(tmp_path / "streams"))
    warc.normalise(spark, str(tmp_path / "streams"), str(tmp_path / "archives"))
    want = got(warc.read_records(spark, str(tmp_path / "archives")))
    (tmp_path / "archives" / "left-over.warc.gz").write_bytes(b"half a member")
    assert got(warc.read_records(spark, str(tmp_path / "archives"))) == want


def test_other_writers_archives(spark, tmp_path):
    """Folded lines, further fields, a file of several members, and more white space between records."""
    record = b"WARC/1.0\r\nWARC-Type: response\r\nX-More: a\r\n b\r\ncontent-length: %d\r\nPage-Id: %d\r\nWARC-Payload-Digest: sha1:%s\r\n\r\n%s\r\n\r\n"

    def one(i, payload):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        return record % (len(block), i, base64.b32encode(hashlib.sha1(payload).digest()), block)

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(one(1, b"one") + b"\r\n\r\n" + one(2, b"\r\n\r\n")) + gzip.compress(one(3, b"\xff\xfe not UTF-8")))
    warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {(r["page_id"], bytes(r["payload"])) for r in warc.read_records(spark, str(tmp_path / "out")).collect()} == {(1, b"one"), (2, b"\r\n\r\n"), (3, b"\xff\xfe not UTF-8")}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10**6])
def test_pieces(size):
    """Records from pieces as a reader of lines may cut them."""
    rng = random.Random(size)
    blocks = ["".join(rng.choice("\r\n\r\nab") for _ in range(rng.randrange(40))).encode() for _ in range(200)]
    stream = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    assert [b for _, b in warc.split_records(stream.split(b"\r\n\r\n"))] == blocks
    assert [b for _, b in warc.split_records(stream.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n"))] == blocks
    with pytest.raises(ValueError):
        list(warc.split_records([stream + b"WARC/1.1\r\nContent-Length: 50"]))


def test_empty(spark):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0
