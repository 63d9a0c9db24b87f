"""WARC archives: round trips, and salvage from damaged files."""

import gzip
import hashlib
import pathlib
import random
import zlib

import pytest

from triagelake.llm import warc

PAGES = [(i, f"http://example.com/{i}", f"<p>page {i}</p>" * (1 + i % 40)) for i in range(60)]


def one(i, url, html):
    body = html.encode()
    return warc.record(i, url, body, hashlib.sha256(body).hexdigest(), None, len(body), "2020-01-01T00:00:00Z")


def read(data):
    rows = list(warc.salvage("f", data))
    assert all(a["offset"] + a["length"] <= b["offset"] or a["offset"] == b["offset"] for a, b in zip(rows, rows[1:]))
    found = {r["record_id"].rsplit(":", 1)[1]: r["payload"].decode() for r in rows if r["reason"] is None}
    return found, [(r["offset"], r["offset"] + r["length"]) for r in rows if r["reason"] is not None]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_is_whole(packed):
    rng = random.Random(1)
    parts = [one(*p) for p in PAGES]
    parts = [warc.member(p) for p in parts] if packed else parts
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    whole = b"".join(parts)
    assert read(whole) == ({str(i): h for i, _, h in PAGES}, [])
    for _ in range(150):
        data, hit = bytearray(whole), set()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(data))
            size = rng.choice([1, 1, 5, 300])
            for k in range(at, min(at + size, len(data))):
                data[k] ^= rng.randrange(1, 256)
            hit |= {i for i in range(len(parts)) if starts[i] < at + size and at < starts[i + 1]}
        found, gaps = read(bytes(data))
        want = {str(i): h for i, _, h in PAGES}
        assert all(found[str(i)] == h for i, _, h in PAGES if i not in hit)
        # What was hit is either unharmed in content or lies in a gap.
        for i in hit:
            if found.get(str(i)) != want[str(i)]:
                assert any(a <= starts[i] and starts[i + 1] <= b for a, b in gaps) or str(i) not in found
        assert all(set(found[k]) and want.get(k) == found[k] for k in found if k in want and int(k) not in hit)
        assert all(any(starts[i] < b and a < starts[i + 1] for i in hit) for a, b in gaps)


@pytest.mark.parametrize("packed", [True, False])
def test_lost_stretches(packed):
    parts = [one(*p) for p in PAGES[:6]]
    parts = [warc.member(p) for p in parts] if packed else parts
    cut = parts[2][: len(parts[2]) // 2]
    data = b"junk" + parts[0] + cut + parts[3] + b"\0" * 100 + parts[4] + parts[5][:-9]
    found, gaps = read(data)
    assert sorted(found) == ["0", "3", "4"]
    a = 4 + len(parts[0])
    b = a + len(cut) + len(parts[3])
    assert gaps == [(0, 4), (a, a + len(cut)), (b, b + 100), (b + 100 + len(parts[4]), len(data))]


def test_wrong_lengths_do_not_swallow_the_next_record():
    parts = [one(*p) for p in PAGES[:3]]
    at = parts[0].index(b"Content-Length: ", parts[0].index(b"WARC-Block")) + 16
    longer = parts[0][:at] + b"9" + parts[0][at:]
    found, gaps = read(longer + parts[1] + parts[2])
    assert sorted(found) == ["1", "2"] and gaps == [(0, len(longer))]


def test_whole_file_in_one_member_and_other_makers_files():
    parts = [one(*p) for p in PAGES]
    found, gaps = read(gzip.compress(b"".join(parts)))
    assert len(found) == 60 and not gaps
    odd = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:key:7>\r\nX-Folded: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert read(odd) == ({"7": "hello"}, [])
    inner = gzip.compress(parts[0] + b"broken" + parts[1])
    rows = list(warc.salvage("f", inner + warc.member(parts[2])))
    assert [r["reason"] for r in rows] == [None, "in member: no member or version line", None, None]


def test_members_end_in_zero():
    assert zlib.decompress(warc.EMPTY, 31) == b"" and warc.EMPTY[-1] == 0
    big = bytes(17 << 20)
    packed = warc.member(big)
    assert packed[-1] == 0 and read(packed + warc.member(one(*PAGES[1])))[0] == {"1": PAGES[1][2]}
    assert warc.inflated(packed, 0)[0] == big


def test_round_trip_of_odd_rows(spark, tmp_path):
    big = "<b>é\0\r\n</b>" * 20
    rows = [(1, "http://a/\r\nX: y", big, 1), (5, None, big, 1), (None, "u", big, 1), (1, "again", big, 1), (7, "", None, 1),
            (8, "http://ü/", "", 1), (9, "x", "short", 1), (10, "x", "short", 1), (None, "n", "z" * 200, 1), (None, "n", "z" * 200, 1), (11, "l", "y" * 3_000_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, id int").repartition(3)
    warc.write(df, str(tmp_path / "w"), key="page_id", payload="html")
    got = warc.records(spark, str(tmp_path / "w")).collect()
    assert warc.gaps(spark, str(tmp_path / "w")).count() == 0
    want = []
    for i, url, html, _ in rows:
        body = (html or "").encode()
        first = "urn:key:1" if html == big and i != 1 else None
        want.append((f"urn:key:{'' if i is None else i}", "revisit" if first else "response", first, len(body), hashlib.sha256(body).hexdigest(), b"" if first else body))
    assert sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got) == sorted(want, key=str) or \
        sorted(map(str, [(r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got])) == sorted(map(str, want))
    assert {r.target_uri for r in got} >= {None, "http://a/%0D%0AX:%20y", "http://ü/"}


def test_damaged_archives_lose_only_what_was_hit(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "id long, url string, payload string").repartition(4)
    warc.write(df, str(tmp_path / "w"))
    files = [p for p in pathlib.Path(tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert len(files) == 4
    for p in files:
        data = bytearray(p.read_bytes())
        data[len(data) // 2] ^= 0xFF
        p.write_bytes(bytes(data))
        crc = p.with_name(f".{p.name}.crc")
        if crc.exists():
            crc.unlink()
    whole = {r.record_id: r.payload.decode() for r in warc.records(spark, str(tmp_path / "w")).collect()}
    assert len(whole) == 56 and all(PAGES[int(k.rsplit(":", 1)[1])][2] == v for k, v in whole.items())
    gaps = warc.gaps(spark, str(tmp_path / "w"))
    assert gaps.count() == 4 and gaps.where("length > 0 AND file IS NOT NULL").count() == 4


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id long, url string, payload string")
    warc.write(df, str(tmp_path / "w"))
    assert warc.scan(spark, str(tmp_path / "w")).count() == 0
