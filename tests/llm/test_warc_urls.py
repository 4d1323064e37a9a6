"""Archives and URL rules."""

import base64
import hashlib
import random
import re

import pytest

from nodeloom.llm import urlrules, warc

rng = random.Random(5)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, sha1 string, number int")


def test_round_trip_with_segments_chunks_and_repeats(spark, tmp_path):
    big = "".join(rng.choice("añ\r\n<p>日 \x00") for _ in range(40_000)) + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/", "one"), (2, "http://b/", "one"), (9, None, "one"), (3, "u\r\nInjected: 1", ""), (4, "", None),
            (5, "http://c/", big), (6, "http://d/", big), (None, "http://e/", "one"), (None, "n", "alone"), (9, "again", "one")]
    path = str(tmp_path / "warc")
    warc.write(pages(spark, rows), path, segment_bytes=700, chunk_bytes=333, records_per_file=25)
    back = warc.read(spark, path).collect()
    assert len(back) == len(rows)
    got = sorted((r["key"] or -1, r["type"], r["refers_to"], r["size"], r["digest"]) for r in back)
    last = {}
    for key, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), key if key is not None else -1)
    want = []
    for key, _, html in rows:
        raw = (html or "").encode()
        first = last[html or ""]
        whole = (key if key is not None else -1) == first
        want.append((key if key is not None else -1, "response" if whole else "revisit", None if whole else first, len(raw),
                     base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert got == sorted(want, key=lambda w: (w[0], w[1], w[2] or 0))
    payload = {r["key"]: bytes(r["payload"]) for r in back if r["payload"] is not None}
    assert payload[6] == big.encode() and payload[4] == b"" and payload[9] == b"one"
    kinds = [h["warc-type"] for f in (tmp_path / "warc").glob("part-*") for h, _ in warc.parse(f.read_bytes())]
    assert kinds.count("continuation") > 50


def test_damage_is_reported(spark, tmp_path):
    path = tmp_path / "warc"
    warc.write(pages(spark, [(1, "u", "x" * 5000)]).repartition(1), str(path), segment_bytes=1000, compression="none")
    part = next(p for p in path.glob("part-*") if p.stat().st_size)
    data = part.read_bytes()
    records = re.split(rb"(?=WARC/1\.1\r\n)", data)
    for crc in path.glob(".*.crc"):
        crc.unlink()
    part.write_bytes(b"".join(r for r in records if b"Segment-Number: 3\r\n" not in r))
    with pytest.raises(Exception, match="segments missing"):
        warc.read(spark, str(path)).collect()
    part.write_bytes(data.replace(b"Total-Length: ", b"Total-Length: 1"))
    with pytest.raises(Exception, match="stated"):
        warc.read(spark, str(path)).collect()
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(data[:-30]))


def test_segments_are_ordered_whatever_the_order_of_records(spark, tmp_path):
    body = "".join(chr(97 + i % 26) for i in range(9000))
    path = tmp_path / "warc"
    warc.write(pages(spark, [(1, "u", body), (2, "v", body[::-1])]).repartition(1), str(path), segment_bytes=500, compression="none")
    out = tmp_path / "mixed"
    out.mkdir()
    records = [r for p in path.glob("part-*") for r in re.split(rb"(?=WARC/1\.1\r\n)", p.read_bytes()) if r]
    rng.shuffle(records)
    for i in range(3):
        (out / f"{i}.warc").write_bytes(b"".join(records[i::3]))
    assert {r["key"]: bytes(r["payload"]).decode() for r in warc.read(spark, str(out)).collect()} == {1: body, 2: body[::-1]}


def test_chunk_framing():
    for body in (b"", b"a", b"\r\n" * 50, bytes(range(256)) * 40):
        assert warc.dechunked(warc.chunked(body, 100)) == body
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_empty_tables(spark):
    empty = pages(spark, [(1, "u", "x")]).limit(0)
    assert warc.report(empty).count() == 0
    rules = spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")
    assert urlrules.judge(empty, rules).count() == 0


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?q#f", "https://example.com/en/", "http://sub.example.com/en", "http://com/",
        "http://a.net/es/1", "http://a.net/ES/1", "http://net/fr/", "http://x.org/en/", "http://example.com", "http://example.com?x=/en/",
        "http://a..net/es/x", "x://y://example.com/en/", "http://a.net/es/1/2/3/" + "p/" * 3000, "http://example.com/english", "http://ex.com/a\nb/c"]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
         ("example.com", "/engl", "block"), ("ex.com", "/a\nb", "block"), ("org", "", "block"), ("org", "", "allow"), (None, "/", "block"), ("com", None, "block")]


def plain(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    best = max(((len(h + p), h + p, v) for h, p, v in RULES if h is not None and p is not None and host
                and (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("broadcast", [0, 100])
def test_url_rules_match_plain_version(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", broadcast)
    table = pages(spark, [(i if i else None, u, "") for i, u in enumerate(URLS + URLS)])
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urlrules.judge(table, rules).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, ((i if i else None, *plain(u)) for i, u in enumerate(URLS + URLS))))
    none = urlrules.judge(table, rules.limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")} and len(none) == len(URLS) * 2
