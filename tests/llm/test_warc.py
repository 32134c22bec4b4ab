"""WARC archives: exact round trips of awkward payloads, and revisits against brute force."""

import gzip
import hashlib
import random

import pytest

from tapewire.llm import warc

ROW = "page_id long, url string, html string, file string, digest string, o string, at int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", 1) for i, u, h in rows], ROW)


def awkward_pages():
    rng = random.Random(6)
    parts = ["\r", "\n", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "Content-Length: 5\r\n", "HTTP/1.1 200 OK\r\n\r\n", "é", "😀", "x", "<p>", "\x00"]
    rows = [(k, f"http://h/{k} a\r\nb%20", "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for k in range(120)]
    rows += [(500 - k, "http://copy", "c" * 150) for k in range(40)] + [(600, "u", "d" * 100), (601, "u", "d" * 100), (602, "u", "e" * 99), (603, "u", "e" * 99), (604, "u", "é" * 50), (605, "u", "é" * 50)]
    rows += [(700, None, None), (701, "u", ""), (None, "u", "f" * 200), (None, "u", "f" * 200), (702, "u", "f" * 200), (None, "u", "g" * 200), (None, "u", "g" * 200)]
    return rows + [(460, "http://copy", "c" * 150), (460, "http://copy", "c" * 150), (800, "u", "line\r\n\r\n" * 200000), (801, "u", "z" * 3_000_000)]


def brute(rows):
    first: dict = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100:
            first.setdefault(h, []).append(i)
    out = []
    seen = set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        again = len(raw) >= 100 and h in seen
        seen.add(h)
        low = min((x for x in first.get(h, []) if x is not None), default=None)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", low if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [1000, 3])
def test_revisits(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_PART", hot)
    rows = awkward_pages()
    random.Random(1).shuffle(rows)
    warc.write_archives(pages(spark, rows).repartition(5), str(tmp_path / "a"))
    read = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert sorted((r["payload"] for r in read)) == sorted((h or "").encode() for _, _, h in rows)
    assert all(r["payload_digest"] == r["head_digest"] and r["record_type"] == "response" for r in read)
    assert len({r["record_id"] for r in read}) == len(rows)
    warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = warc.replayed(spark, str(tmp_path / "b")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    # archives of revisits resolve to the same
    warc.deduplicate(spark, str(tmp_path / "b"), str(tmp_path / "c"))
    twice = warc.replayed(spark, str(tmp_path / "c")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in twice) == brute(rows)
    fresh = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path / "b")).collect()}
    assert not set(fresh) & {r["record_id"] for r in read}
    revisits = [r for r in fresh.values() if r["record_type"] == "revisit"]
    assert revisits and all(r["payload_bytes"] == 0 and fresh[r["refers_to"]]["payload_digest"] == r["head_digest"] for r in revisits)


def record(kind, block, **fields):
    head = "".join(f"\r\n{k.replace('_', '-')}: {v}" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}{head}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """A member of its own for each record, other types, bytes that are no UTF-8, a revisit of the other file."""
    raw = b"HTTP/1.1 200 OK\r\nX: \xe9\r\n\r\n" + bytes(range(256)) * 2
    digest = hashlib.sha256(bytes(range(256)) * 2).hexdigest()
    one = [record("warcinfo", b"software: x\r\n", WARC_Record_ID="<i>"), record("response", raw, WARC_Record_ID="<r>", Page_Id=9, WARC_Target_URI="http://a/")]
    two = [record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Record_ID="<v>", Page_Id=3, WARC_Payload_Digest=f"sha256:{digest}"), record("revisit", b"", WARC_Record_ID="<w>", Page_Id=4, WARC_Payload_Digest="sha256:00", WARC_Refers_To="<gone>")]
    (tmp_path / "a").mkdir()
    for name, records in (("1.warc.gz", one), ("2.warc.gz", two)):
        (tmp_path / "a" / name).write_bytes(b"".join(map(gzip.compress, records)))
    warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    kept = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "b")).collect()}
    assert bytes(kept[9]["payload"]) == bytes(range(256)) * 2 and kept[9]["http"].encode("latin-1") == raw[: -512]
    assert kept[None]["record_type"] == "warcinfo" and bytes(kept[None]["payload"]) == b"software: x\r\n"
    got = sorted(tuple(r) for r in warc.replayed(spark, str(tmp_path / "b")).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == [(3, 512, "revisit", 9), (4, None, "revisit", None), (9, 512, "response", None)]


@pytest.mark.parametrize("spoilt", [b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort", b"no archive\r\n\r\n"])
def test_broken_archives_raise(spark, tmp_path, spoilt):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(gzip.compress(spoilt))
    with pytest.raises(Exception, match=r"x\.warc\.gz: record 0"):
        warc.read_archives(spark, str(tmp_path / "a")).collect()


def test_split_archives_raise_and_empty_tables_pass(spark, tmp_path):
    rows = [(k, "u", "p" * 5000) for k in range(60)]
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "a"), compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        with pytest.raises(Exception, match="was split"):
            warc.read_archives(spark, str(tmp_path / "a")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 60
    warc.write_archives(pages(spark, []), str(tmp_path / "e"))
    warc.deduplicate(spark, str(tmp_path / "e"), str(tmp_path / "f"))
    assert warc.replayed(spark, str(tmp_path / "f")).collect() == []
