"""The keyed table, the streams that write to it, and content hashes."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tapewire.sources import store as so
from tapewire.sources.keyed import KeyedTable
from tapewire.streaming import jobs as sj

KV = "k string, v int"


def frame(spark, rows, schema=KV):
    return spark.createDataFrame(rows, schema)


def content(table, **options):
    return sorted(((r.k or "", r.v) for r in table.read(**options).collect()))


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), KV, ["k"], 16)
    assert content(t) == []
    t.merge(frame(spark, [(f"a{i}", i) for i in range(60)] + [(None, 1)]))
    before = t.published()
    t.merge(frame(spark, [("a3", 100), ("a3", 100), ("a3", 99), ("new", 5), (None, 2)]))
    after = t.published()
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 3
    assert content(t) == sorted([("", 2), ("new", 5), *((f"a{i}", 100 if i == 3 else i) for i in range(60))])
    assert sorted((r.k, r.v) for r in t.lookup(frame(spark, [("a3", 0), ("a3", 1), ("no", 1)])).collect()) == [("a3", 100)]
    assert [r.v for r in t.lookup(frame(spark, [(None, 0)])).collect()] == [2]
    t.merge(frame(spark, []))
    assert t.published() == after
    c = t.copied(str(tmp_path / "copy"), 4)
    assert content(c) == content(t) and set(c.published().values()) == {1}


def test_failure_before_publishing_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path), KV, ["k"], 4)
    t.merge(frame(spark, [("a", 1), ("b", 2)]))
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.merge(frame(spark, [("a", 10), ("c", 3)]))
    assert content(t) == [("a", 1), ("b", 2)]
    t.merge(frame(spark, [("a", 10), ("c", 3)]))
    assert content(t) == [("a", 10), ("b", 2), ("c", 3)]
    t.merge(frame(spark, [("a", 10), ("c", 3)]), version=2)  # the same merge again
    assert content(t) == [("a", 10), ("b", 2), ("c", 3)] and content(t, before=2) == [("a", 1), ("b", 2)]


def test_order_of_new_rows(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k string, v int, w int", ["k"], 2)
    t.merge(frame(spark, [("a", 1, 9), ("a", 2, 1), ("a", 2, 3)], "k string, v int, w int"), order=["v"])
    assert [(r.v, r.w) for r in t.read().collect()] == [(2, 3)]


def headlines(n=300, seed=3):
    rng = random.Random(seed)
    day = dt.datetime(2024, 1, 1)
    return [(day + dt.timedelta(days=rng.randrange(50)), rng.choice("AAAB"), f"h{k}", rng.choice(["negative", "neutral", "positive"]), rng.random()) for k in range(n)]


SCORED = "date timestamp, ticker string, headline string, label_name string, confidence double"


def land(spark, path, rows, schema=SCORED):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_daily_signals_take_late_rows_and_replays(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    table = KeyedTable(spark, str(tmp_path / "out"), "date date, ticker string, signal double, headline_count long", ["date", "ticker"], 4)
    rows = headlines()
    day = lambda k, text: (dt.datetime(2024, 1, 1) + dt.timedelta(days=k), "A", text, "negative", 0.99)
    late = [day(47, "late"), day(2, "too late")]
    land(spark, source, [*rows, day(49, "last")])
    run = lambda body: sj.run_to_end(sj.daily_signal_stream(sj.read_news_stream(spark, source, SCORED)), body, state)
    run(sj.upsert(table))
    land(spark, source, late)
    seen = []

    def twice(batch, batch_id):  # as after a failure between the sink and the end of the batch
        seen.append(batch_id)
        sj.upsert(table)(batch, batch_id)
        sj.upsert(table)(batch, batch_id)

    run(twice)
    assert seen
    want: dict = {}
    sign = {"negative": 1, "neutral": 0, "positive": -1}
    for d, t, _, label, conf in [*rows, day(49, "last"), late[0]]:
        if conf >= 0.7:
            want.setdefault((d.date(), t), []).append(sign[label])
    got = {(r.date, r.ticker): (round(r.signal, 9), r.headline_count) for r in table.read().collect()}
    assert got == {k: (round(sum(v) / len(v), 9), len(v)) for k, v in want.items()}


def test_volume_windows(spark, tmp_path):
    daily = KeyedTable(spark, str(tmp_path / "d"), "date date, ticker string, n long", ["date", "ticker"], 4, ["ticker"])
    windows = KeyedTable(spark, str(tmp_path / "w"), "end_date date, ticker string, n long", ["end_date", "ticker"], 4, ["ticker"])
    body = sj.volume_windows(daily, windows, 5)
    d = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    batches = [[(d(0), "A", 3), (d(1), "B", 1)], [(d(0), "A", 5), (d(3), "A", 2)], [(d(2), "A", 1)]]
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "date date, ticker string, n long")
        body(batch, k)
        if k == 1:
            body(batch, k)
    want: dict = {}
    for (day, t), n in {(d(0), "A"): 5, (d(1), "B"): 1, (d(3), "A"): 2, (d(2), "A"): 1}.items():
        for j in range(1, 6):
            key = (day + dt.timedelta(days=j), t)
            want[key] = want.get(key, 0) + n
    assert {(r.end_date, r.ticker): r.n for r in windows.read().collect()} == want


def test_alerts_do_not_depend_on_the_order_of_batches(spark, tmp_path):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    updates = [(t, start + dt.timedelta(hours=k), rng.choice(["BUY", "HOLD", "SELL"])) for t in "ABC" for k in rng.sample(range(200), 25)]
    want = []
    for t in "ABC":
        mine = sorted((ts, r) for x, ts, r in updates if x == t)
        want += [(t, ts, p, r) for (_, p), (ts, r) in zip(mine, mine[1:], strict=False) if p != r]
    rng.shuffle(updates)
    history, alerts = (KeyedTable(spark, str(tmp_path / n), s, ["ticker", "ts"], 3, ["ticker"]) for n, s in (("h", sj.HISTORY), ("a", sj.ALERTS)))
    body = sj.recommendation_alerts(history, alerts)
    for k in range(4):
        batch = spark.createDataFrame(updates[k::4], "ticker string, ts timestamp, recommendation string")
        body(batch, k)
        if k == 2:
            body(batch, k)
    assert sorted(tuple(r) for r in sj.current_alerts(alerts).select("ticker", "ts", "previous", "recommendation").collect()) == sorted(want)


def outside_hash(folder, block):
    sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
    files = []
    for f in sorted(folder.iterdir()):
        if f.name.startswith((".", "_")):
            continue
        raw = f.read_bytes()
        lines = raw.split(b"\n")
        lines = lines[:-1] if lines[-1] == b"" else lines
        leaves = [sha(x) for x in lines]
        blocks = [sha("".join(leaves[k : k + block])) for k in range(0, len(leaves), block)]
        files.append(sha(sha("".join(blocks)) + f" {len(raw)}"))
    return sha("".join(files))


def test_content_hash_is_that_of_the_files_however_split(spark, tmp_path):
    rng = random.Random(4)
    (tmp_path / "a").write_bytes(bytes(rng.randrange(256) for _ in range(60000)))
    (tmp_path / "b").write_bytes(b"line\n" * 3000)
    (tmp_path / "c").write_bytes(b"no end")
    want = outside_hash(tmp_path, 7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128MB", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert so.content_hash(spark, str(tmp_path), 7).first().hash == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c").write_bytes(b"no end\n")
    assert so.content_hash(spark, str(tmp_path), 7).first().hash == outside_hash(tmp_path, 7) != want
    assert so.content_hash(spark, str(tmp_path)).select(F.length("hash")).first()[0] == 64
