import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest

from tarnlight.llm import warc

BLOCKS = [b"<p>%d</p>" % i + bytes(random.Random(i).randrange(256) for _ in range(300 * i)) for i in range(8)]


def built(zipped):
    parts = [warc.record_bytes(f"urn:page:{i}", f"http://x/{i}", b) for i, b in enumerate(BLOCKS)]
    return [gzip.compress(p, mtime=0) for p in parts] if zipped else parts


def read(data, zipped):
    found = list(warc.Salvage(lambda at, n: data[at : at + n], len(data), zipped).run())
    at = 0
    for kind, start, length, *_ in found:
        assert start == at and length > 0  # records and gaps cover the file
        at += length
    assert at == len(data)
    return [f[4] for f in found if f[0] == "record"], [f for f in found if f[0] == "gap"]


@pytest.mark.parametrize("zipped", [False, True])
def test_whole_file(zipped):
    assert read(b"".join(built(zipped)), zipped) == (BLOCKS, [])
    assert read(b"", zipped) == ([], [])


@pytest.mark.parametrize("zipped", [False, True])
def test_damage_loses_its_own_record_only(zipped):
    parts = built(zipped)
    for bad in range(8):
        for harm in (lambda p: p[: len(p) // 2], lambda p: p[: len(p) // 2] + b"\0\xff" * 4 + p[len(p) // 2 + 8 :], lambda p: b"junk" + p[4:], lambda p: b"x" * 50 + p):
            data = b"".join(harm(p) if i == bad else p for i, p in enumerate(parts))
            blocks, gaps = read(data, zipped)
            assert [b for b in BLOCKS if b in blocks] == blocks and len(blocks) >= 7
            assert (len(gaps) == 1 and gaps[0][3]) or (blocks == BLOCKS and not gaps)  # a header that still parses may differ


@pytest.mark.parametrize("zipped", [False, True])
def test_only_damage_is_one_gap(zipped):
    assert [g[1:3] for g in read(b"nothing of use " * 40_000, zipped)[1]] == [(0, 600_000)]


def test_version_lines_inside_of_a_block_are_no_records():
    inner = warc.record_bytes("urn:page:1", None, b"inner")
    outer = warc.record_bytes("urn:page:0", None, b"before " + inner + b" after")
    assert read(outer, False) == ([b"before " + inner + b" after"], [])
    assert read(b"WARC/1.1\r\nbroken\r\n\r\n" + outer, False)[0] == [b"before " + inner + b" after"]


@pytest.mark.parametrize("zipped", [False, True])
def test_against_a_search_at_every_byte(zipped):
    """What the reader finds is what trying each byte in turn finds."""

    def brute(data):
        reader = warc.Salvage(lambda at, n: data[at : at + n], len(data), zipped)
        at, gap, out = 0, None, []
        while at < len(data):
            try:
                found, total = reader.records(at)
            except warc.Bad:
                gap = at if gap is None else gap
                at += 1
                continue
            if gap is not None:
                out.append(("gap", gap, at - gap))
                gap = None
            out += [("record", at, total, block) for _, block in found]
            at += total
        return out + ([("gap", gap, at - gap)] if gap is not None else [])

    rng, parts = random.Random(3), built(zipped)[:5]
    for _ in range(12):
        data = bytearray(b"".join(parts))
        for _ in range(rng.randint(1, 3)):
            at, size = rng.randrange(len(data)), rng.randint(1, 400)
            harm = rng.choice(["cut", "zero", "insert"])
            data[at : at + size] = b"" if harm == "cut" else bytes(min(size, len(data) - at)) if harm == "zero" else data[at : at + size] + b"WARC/1.0\r\nx"
        got = [(k, start, length, *rest[1:]) if k == "record" else (k, start, length) for k, start, length, *rest in warc.Salvage(lambda at, n, data=bytes(data): data[at : at + n], len(data), zipped).run()]
        assert got == brute(bytes(data))


@pytest.mark.parametrize("zipped", [False, True])
def test_headers_may_be_long(zipped):
    parts = [warc.record_bytes(f"urn:page:{i}", "http://x/" + "y" * n, b) for i, (n, b) in enumerate(zip((70_000, 10, 300_000, 5), BLOCKS))]
    data = b"".join(gzip.compress(p, mtime=0) if zipped else p for p in parts)
    assert read(data, zipped) == (BLOCKS[:4], [])
    assert read(b"WARC/1.1\r\n" + b"no end " * 30_000 + data, zipped) == (BLOCKS[:4], [("gap", 0, 210_010, "no member magic" if zipped else "malformed header")])


def test_members_of_several_records_and_other_digests():
    parts = built(False)
    member = gzip.compress(b"".join(parts[:3]), mtime=0)
    found = list(warc.Salvage(lambda at, n: member[at : at + n], len(member), True).run())
    assert [f[4] for f in found] == BLOCKS[:3] and {f[1:3] for f in found} == {(0, len(member))}
    block = b"some bytes"
    for kind in warc.DIGESTS:
        own = hashlib.new(kind, block)
        for value in (own.hexdigest(), base64.b32encode(own.digest()).decode(), base64.b32encode(own.digest()).decode().lower().rstrip("=")):
            assert not warc.differs(f"{kind}:{value}", block) and warc.differs(f"{kind}:{value}", block + b"x")
    assert not warc.differs("crc32:0", block) and not warc.differs("", block)


PAGES = [(i, f"http://x/{i}", f"<html>{'é' * i}</html>") for i in range(60)] + [(None, None, None), (60, None, "h"), (61, "http://y", None), (62, "u", ""), (62, "u", "")] + [(63, "long", "z" * 3_000_000)]


def test_round_trip_through_files(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "page_id AS file", "'x' AS path")
    found = warc.salvaged(warc.archived(pages, file_bytes=500_000))
    got = sorted(repr((r["record_id"], r["url"], bytes(r["block"]).decode())) for r in found.where("kind = 'record'").collect())
    assert got == sorted(repr(("urn:page:" + ("" if i is None else str(i)), u, h or "")) for i, u, h in PAGES)
    assert found.where("kind = 'gap'").count() == 0


def test_harmed_files_give_the_unharmed_records(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    found = warc.salvaged(warc.archived(pages, harm=True, file_bytes=500_000)).collect()
    whole = [(u, h or "") for i, u, h in PAGES if warc.damaged(b"abc", f"{i} {u}") == b"abc"]
    got = [(r["url"], bytes(r["block"]).decode()) for r in found if r["kind"] == "record"]
    assert len(whole) < len(PAGES) and not Counter(whole) - Counter(got) and len(got) < len(PAGES)
    assert sum(r["kind"] == "gap" for r in found) >= 1 and all(r["reason"] for r in found if r["kind"] == "gap")


def test_empty_tables(spark):
    assert warc.salvaged(warc.archived(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    assert warc.salvaged(spark.createDataFrame([(None,)], "path string")).count() == 0
