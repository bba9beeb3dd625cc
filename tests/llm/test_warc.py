"""WARC: round trips, roles against brute force, assembly through identifiers in any direction."""

import gzip
import hashlib

import pytest

from inspectra.llm import queries, warc

BIG = "<p>" + "é" * 80
TRAP = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 2


def pages():
    rows = [(5, "http://a/5", BIG), (2, "http://a/2", BIG), (9, "http://a/9", BIG), (2, "http://b/2", BIG),
            (3, None, "short"), (4, "http://a/4", "short"), (6, "u", None), (7, "u", ""), (8, "x\r\ny: z", TRAP), (10, "h", TRAP),
            (11, "q", "a\r\n\r\nb\n" + "c" * 200), (12, "long", "z\n" * 600_000), (13, "nul", "\x00\x1f\x8b" + "w" * 120)]
    return rows + [rows[4], rows[1]]


def brute(rows):
    out = []
    for i, u, h in rows:
        body = (h or "").encode()
        same = [(r[0], r[1] is None, r[1] or "") for r in rows if r[2] == h]
        first = min(same)
        again = len(body) >= 100 and (i, u is None, u or "") != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[0] if again else None))
    return sorted(out, key=str)


def run(spark, tmp, rows, schema="page_id long, url string, html string", parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{tmp}/pages.parquet")
    return sorted((tuple(r) for r in queries.QUERIES["op7_warc_transactions"](spark, str(tmp)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip_matches_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)  # several files a task
    assert run(spark, tmp_path, pages()) == brute(pages())


def test_one_hot_payload(spark, tmp_path):
    rows = [(i, f"u{i}", BIG if i % 3 else f"{BIG}{i}") for i in range(300)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_table_null_ids_clashing_columns(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    rows = [(None, "u", BIG, "x", 1), (4, "v", BIG, None, 2)]
    got = run(spark, tmp_path / "b", rows, "page_id long, url string, html string, record_type string, payload int", 1)
    assert [(r[0], r[3], r[4]) for r in got] == [(4, "response", None), (None, "revisit", 4)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_are_warc(spark, scratch, tmp_path, compression):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), scratch, compression=compression)
    data = b"".join((gzip.decompress if compression == "gzip" else bytes)(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    kinds = [dict(h)["warc-type"] for h, _ in warc.parse_records(data)]
    assert len(kinds) == 3 * len(pages()) and kinds.count("metadata") == kinds.count("request") == len(pages())


def record(rid, kind, block=b"", **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *(f"WARC-Concurrent-To: {x}" for x in headers.get("to", ())),
             f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_assembly_through_identifiers(spark, tmp_path):
    parts = [record("<r1>", "response", b"one"), record("<q1>", "request", b"get", to=["<r1>"]), record("<m1>", "metadata", b"k: v", to=["<q1>"]),
             record("<r2>", "response", b"two", to=["<q2>", "<m2>"]), record("<q2>", "request", b"get2"), record("<m2>", "metadata", b"n"),
             record("<r3>", "revisit"), record("<q9>", "request", b"lost", to=["<none>"]), record("<i>", "warcinfo", b"info")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))  # one member per record
    got = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    part = lambda x: x and bytes(x.block)
    assert {k: (r.record_type, part(r.request), part(r.metadata)) for k, r in got.items()} == {
        "<r1>": ("response", b"get", b"k: v"), "<r2>": ("response", b"get2", b"n"), "<r3>": ("revisit", None, None)}


def test_broken_archives_raise():
    for bad in (b"junk\r\n", record("<a>", "response", b"body")[:-8]):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))
