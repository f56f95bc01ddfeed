"""Operators 7 and 8."""

from __future__ import annotations

import json
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from examloom.llm import media, oracles, queries, url_filter
from examloom.llm.url_filter import filter_urls, rule


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 65536, 65541, 200_000])
def test_media_round_trip(n):
    data = media.padded(bytes(i * 7 % 251 for i in range(n)))
    assert len(data) % 64 == 0 and len(data) >= max(64, n)
    file = media.mux(data)
    assert media.payload(file) == data
    (track,) = media.tracks(file)
    assert (track["codec"], track["duration"], track["samples"]) == ("raw", len(data), len(data) // 64)


def test_walk_and_sample_tables():
    """A track with sizes of their own, two chunks, and only some key frames."""
    sizes, keys = [5, 3, 4, 6], [1, 4]
    data = b"\0" * 8 + b"A" * 8 + b"gap" + b"B" * 10
    b, f = media.box, media.full
    table = b(
        b"stbl", f(b"stsd", struct.pack(">I", 1), b(b"avc1", bytes(8))), f(b"stsz", struct.pack(">II", 0, 4), struct.pack(">4I", *sizes)),
        f(b"stsc", struct.pack(">I3I", 1, 1, 2, 1)), f(b"stco", struct.pack(">I2I", 2, 8, 19)), f(b"stss", struct.pack(">I2I", 2, *keys)),
    )
    trak = b(b"trak", b(b"mdia", f(b"mdhd", struct.pack(">IIIIHH", 0, 0, 600, 1200, 0, 0)), b(b"minf", table)))
    file = b(b"mdat", data[8:]) + b(b"moov", trak, b(b"free", b"x"))
    (track,) = media.tracks(file)
    assert track == {"codec": "avc1", "timescale": 600, "duration": 1200, "samples": 4, "keyframes": 2, "ranges": [[8, 13], [23, 29]]}
    starts, _ = media.sample_ranges(file, {p[-1]: (lo, hi) for p, lo, hi in media.walk(file)})
    assert np.array_equal(starts, [8, 13, 19, 23])
    assert media.tracks(b"") == [] and media.tracks(file[:40]) == [] and list(media.walk(b"\0\0\0\x04abcd")) == []


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_damaged_files(data):
    """Whatever is changed or cut off, a file is read to its end or its damage is told."""
    whole = media.mux(media.padded(bytes(range(256)) * 300))
    file = bytearray(whole)
    tables = [hi for path, lo, hi in media.walk(whole) if path[-1] in (b"stsz", b"stsc", b"stco", b"mdhd", b"stsd", b"stss")]
    for _ in range(data.draw(st.integers(1, 4))):
        at = data.draw(st.sampled_from(tables)) - data.draw(st.integers(1, 40))
        file[at] = data.draw(st.integers(0, 255))
    file = bytes(file)[: data.draw(st.sampled_from([len(file), len(file), len(file) - 1, len(file) - 70, 40]))]
    for t in media.tracks(file):
        assert "damaged" in t or all(0 <= a <= b <= len(file) for a, b in t["ranges"])
    assert len(media.payload(file)) <= len(file)


def test_a_count_beyond_the_file():
    file = bytearray(media.mux(media.padded(b"x" * 1000)))
    at = file.index(b"stsz")
    file[at + 12 : at + 16] = b"\xff\xff\xff\xff"
    assert media.tracks(bytes(file)) == [{"damaged": "more samples than the file has room for"}] and media.payload(bytes(file)) == b""


def test_read_media_of_odd_files(spark):
    good = media.mux(media.padded(b"abc"))
    bad = good.replace(b"stsc" + bytes(4), b"stsc" + bytes(3) + b"\1").replace(b"\0\0\0\1\0\0\0\1\0\0\0\1", b"\0\0\0\1\0\0\0\1\0\0\1\0")
    rows = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, good[:50]), (5, bad)], "id int, media binary")
    got = {r["id"]: r["r"] for r in rows.select("id", media.read_media(F.col("media")).alias("r")).collect()}
    assert bytes(got[1]["payload"])[:3] == b"abc"
    assert [got[i]["feature"] for i in (2, 3, 4)] == ["[]"] * 3 and "damaged" in got[5]["feature"] and bytes(got[5]["payload"]) == b""


def test_media_columns(spark, odd, none):
    rows = {r["doc_id"]: r for r in media.media_columns(odd).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    for i, r in rows.items():
        assert bytes(r["payload"]) == media.padded(texts[i]) and r["n_bytes"] == len(texts[i])
    assert rows[1]["media"] == rows[2]["media"] and json.loads(rows[7]["feature"])[0]["samples"] == 1
    assert media.media_columns(none).count() == 0


RULES = [rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/")]


def brute_rank(seeds: dict, links: list[tuple], reverse: bool, steps=300, d=url_filter.DAMPING) -> dict:
    """Power iteration; a host without links gives what it holds back to the seeds in every step."""
    edges = [(b, a, n) if reverse else (a, b, n) for a, b, n in links]
    out: dict = {}
    for a, _, n in edges:
        out[a] = out.get(a, 0) + n
    now = dict(seeds)
    for _ in range(steps):
        idle = sum(v for h, v in now.items() if h not in out)
        new = {h: (1 - d + d * idle) * s for h, s in seeds.items()}
        for a, b, n in edges:
            new[b] = new.get(b, 0) + d * now.get(a, 0) * n / out[a]
        now = new
    return now


def test_propagation_against_brute_force(spark):
    chain = [(f"far{i}.net", f"far{i + 1}.net", 1) for i in range(30)]
    links = [("a.org", "b.net", 2), ("b.net", "c.net", 1), ("c.net", "bad.com", 3), ("d.net", "bad.com", 1), ("b.net", "a.org", 1), ("e.net", "d.net", 5), ("b.net", "far0.net", 1), *chain]
    seeds = spark.createDataFrame([("a.org", 1.0, 0.0), ("bad.com", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(seeds, spark.createDataFrame(links, "source string, target string, links long")).collect()}
    trust, distrust = brute_rank({"a.org": 1.0, "bad.com": 0.0}, links, False), brute_rank({"a.org": 0.0, "bad.com": 1.0}, links, True)
    assert {h for h, v in trust.items() if v} | {h for h, v in distrust.items() if v} == set(got)
    for h in got:
        assert got[h] == pytest.approx((trust.get(h, 0), distrust.get(h, 0)), rel=1e-4)
    assert got["far30.net"][0] > 0 and sum(t for t, _ in got.values()) == pytest.approx(1) == sum(d for _, d in got.values())
    none = url_filter.propagate(seeds.filter("trust > 0"), spark.createDataFrame([], "source string, target string, links long"))
    assert [tuple(r) for r in none.collect()] == [("a.org", 1.0, 0.0)]


def test_propagation_against_sql(spark, tmp_path):
    """A pages table with links between hosts: chains and rings behind trusted and blocked seeds, ties among them."""
    urls = ["http://seed.org/1", "http://seed.com/de/1", *(f"http://h{i}.net/p" for i in range(60)), None, "no scheme"]
    html = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [(i, u, html(*(f"h{(i * k) % 60}.net" for k in (1, 7)), *(["seed.com"] if i % 9 == 0 else []), *(["seed.org"] if i % 11 == 0 else [])) if i % 13 else None) for i, u in enumerate(urls)]
    pages += [(100, "http://both.net/", html("seed.com")), (101, "http://seed.org/2", html("both.net")), (102, "http://chain0.net/", html("seed.com"))] + [(103 + i, f"http://chain{i + 1}.net/", html(f"chain{i}.net")) for i in range(25)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {r[0]: r for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracles.op8(queries.URL_RULES, url_filter.DAMPING, url_filter.DECIMALS)})").fetchall()}
    got = {r["page_id"]: tuple(r) for r in filter_urls(df, RULES).collect()}
    assert got == want
    assert got[127][4] == "block" and {v[4] for v in got.values() if v[3] is None} == {"allow", "block"}


def test_urls(spark):
    page = lambda i, url, *targets: (i, url, "".join(f'<a href="http://{t}/x">' for t in targets), "?", "?")
    pages = [
        page(1, "http://a.example.org/en/1?x"), page(2, "http://a.example.org/en/2#y", "good.net"), page(3, "HTTP://WWW.x.COM/de/1"), page(4, "http://linker.net/p", "www.x.com"), page(5, "http://good.net"),
        page(6, None), page(7, "no scheme"), page(8, "http://alone.net/"), page(9, "http://notorg/x"), page(2, "http://a.example.org/en/2#y", "good.net"), page(None, "ftp://u.com/fr/é?q#f"), page(11, "http://x.com?/fr/"), page(12, "http://org"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, rule string, host string")
    rows = filter_urls(df, RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("a.example.org", "/en/1", "example.org/en/1", "block")
    assert got[2] == ("a.example.org", "/en/2", "org/", "allow")
    assert got[3] == ("www.x.com", "/de/1", "com/de/", "block")
    assert got[4] == ("linker.net", "/p", None, "block") and got[5] == ("good.net", "", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][3] == "allow" and got[9][2] is None
    assert got[None] == ("u.com", "/fr/é", "com/fr/", "allow") and got[11][:3] == ("x.com", "", None) and got[12][:3] == ("org", "", None)
    assert filter_urls(df.limit(0), RULES).count() == 0
    assert filter_urls(df.withColumn("html", F.lit(None).cast("string")), []).filter("verdict <> 'allow'").count() == 0
