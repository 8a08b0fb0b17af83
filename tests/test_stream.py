"""Prior-rows features on a stream: restarts, late rows, repeated batches."""

from __future__ import annotations

import os
from pathlib import Path
from urllib.parse import urlparse

import pytest

from clickloom.sources.store import scratch_path
from clickloom.streaming.history import History, read_arriving


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SCHEMA = "row_id long, ip long, app int, epoch_time long, is_attributed int"
ROWS = [(i, i % 3 if i % 7 else None, i % 2, 10 * (i // 2), i % 5 % 2 if i % 11 else None) for i in range(60)]


def by_hand(rows, keys):
    out, before = {}, {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        key = tuple(r[{"ip": 1, "app": 2}[k]] for k in keys)
        if None in key or r[3] is None:
            continue
        seen = before.setdefault(key, [])
        known = [y for _, y in seen if y is not None]
        gaps = [r[3] - seen[-p][0] if len(seen) >= p else -1 for p in (1, 2)]
        out[r[0]] = (sum(known) / len(known) if known else -1.0, len(known), *gaps)
        seen.append((r[3], r[4]))
    return out


class Arriving:
    def __init__(self, spark, history):
        self.spark, self.history = spark, history
        self.folder, self.out, self.state = (scratch_path(spark, f"test-{n}") for n in ("in", "out", "state"))

    def add(self, rows, run=True, **options):
        df = self.spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(self.folder)
        if run:
            self.run(**options)

    def run(self, **options):
        self.history.run(read_arriving(self.spark, self.folder, SCHEMA, **options), self.out, self.state)

    def got(self, final=True, waiting=True):
        parts = [self.history.final(self.spark, self.out)] * final + [self.history.waiting(self.spark, self.state)] * waiting
        rows = [r for p in parts for r in p.collect()]
        n = len(self.history.keys)
        assert len(rows) == len({r.row_id for r in rows})
        return {r.row_id: tuple(r)[1 + n:] for r in rows}


@pytest.mark.parametrize("keys", [("ip",), ("ip", "app")])
def test_stream_equals_batch_over_restarts(spark, keys):
    a = Arriving(spark, History(keys))
    for i in (0, 20, 40):
        a.add(ROWS[i : i + 20])
    want = by_hand(ROWS, keys)
    assert a.got() == want
    # Only rows that no row on time can precede are final: all but those of the last time.
    last = max(r[3] for r in ROWS)
    assert set(a.got(waiting=False)) == {r[0] for r in ROWS if r[0] in want and r[3] < last}
    assert a.history.late(spark, a.out).count() == 0


def test_disorder_within_the_delay_and_late_rows(spark):
    a = Arriving(spark, History(("ip",), delay="100 seconds"))
    first = [(1, 1, 0, 500, 1), (2, 1, 0, 450, 0), (3, 2, 0, 480, 1)]
    a.add(first)
    on_time, late = [(4, 1, 0, 420, 1), (5, 1, 0, 520, 0)], [(6, 1, 0, 399, 1), (7, 3, 0, 10, 0)]
    a.add(on_time + late)
    a.add([(8, 2, 0, 900, 1)])
    assert a.got() == by_hand(first + on_time + [(8, 2, 0, 900, 1)], ("ip",))
    side = a.history.late(spark, a.out).collect()
    assert sorted((r.row_id, r.ip, r.epoch_time) for r in side) == [(6, 1, 399), (7, 3, 10)]


def test_a_batch_that_is_repeated_gives_the_same_rows(spark):
    a = Arriving(spark, History(("ip",)))
    for i in (0, 15, 30, 45):
        a.add(ROWS[i : i + 15], run=False)
    a.run(files=1)
    want = a.got(waiting=False)
    # As if the driver was lost after the last batch had written, before it was marked as done.
    commits = Path(urlparse(a.state).path, "commits")
    newest = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (newest, commits / f".{newest.name}.crc"):
        if p.exists():
            os.unlink(p)
    a.run()
    assert a.got(waiting=False) == want
    assert a.got() == by_hand(ROWS, ("ip",))


def test_no_rows(spark):
    a = Arriving(spark, History(("ip",)))
    a.add([])
    assert a.history.final(spark, a.out).count() == 0 and a.history.late(spark, a.out).count() == 0


def test_settings_are_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    a = Arriving(spark, History(("ip",)))
    a.add(ROWS[:4])
    assert spark.conf.get(name) == before
