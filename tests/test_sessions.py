"""Edit sessions and changed reports: a stream against the fold of the same events as a table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import sessions

KIND = "capture_id long, overlay_id long, seq long, op string, ts timestamp, dx double, dy double, x double, y double, w double, h double"
START = dt.datetime(2024, 1, 1)


def made(n_captures=4, n=160, seed=1):
    rng, rows = random.Random(seed), []
    for c in range(n_captures):
        for o in range(3):
            rows.append((c, o, o, "place", START, None, None, 0.1 * o, 0.2 * o, 0.3, 0.2))
        for s in range(3, n):
            op = rng.choice(["move"] * 6 + ["resize", "select", "toggle", "toggle", "add", "delete"])
            rows.append((c, rng.randrange(3 if c else 4), s, op, START + dt.timedelta(seconds=10 * s + c), rng.uniform(-0.4, 0.4), rng.uniform(-0.4, 0.4), None, None, None, None))
    return rows


def plain(rows):
    """The boxes of one capture after its events, written out."""
    boxes, selected, gone, out = {}, None, set(), set()
    for _, o, _, op, _, dx, dy, *box in sorted(rows, key=lambda r: r[2]):
        if op == "place":
            boxes[o] = list(box)
        elif op in ("select", "add"):
            selected = o
        elif op == "delete":
            gone |= {selected} & set(boxes)
            selected = None
        elif o in boxes and o not in gone:
            x, y, w, h = boxes[o]
            if op == "move":
                boxes[o] = [min(max(x + dx, 0), 1 - w) if 1 - w >= 0 else 0, min(max(y + dy, 0), 1 - h) if 1 - h >= 0 else 0, w, h]
            elif op == "resize":
                boxes[o] = [max(0, min(1 - w - dx, x)), max(0, min(1 - h - dy, y)), min(1, max(0.01, w + dx)), min(1, max(0.01, h + dy))]
            else:
                out ^= {o}
    return {o: (*(round(v, 6) for v in b), o in out, o in gone, o == selected) for o, b in boxes.items()}


def states(df):
    return {(r.capture_id, r.overlay_id): tuple(r)[2:] for r in df.collect()}


def test_table_fold_matches_a_plain_version(spark):
    rows = made()
    got = states(sessions.replayed(spark.createDataFrame(rows, KIND)))
    for c in range(4):
        for o, want in plain([r for r in rows if r[0] == c]).items():
            assert got[c, o][:7] == pytest.approx(want)
        last = max((r for r in rows if r[0] == c), key=lambda r: r[2])
        assert got[c, None][7:] == (sessions.STATES.get(last[3], "idle"), last[2], 160)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run(spark, query, tmp_path, name):
    """Run a stream until what is there now is through; its updates are kept as files."""

    def keep(batch, n):
        batch.write.mode("append").parquet(f"{tmp_path}/{name}")

    mode = "append" if name == "polls" else "update"
    query.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)


def write(spark, rows, kind, path):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(path))


def test_stream_equals_table_over_a_restart(spark, store, tmp_path):
    rows = made()
    parts = [[r for r in rows if r[2] < 40], [r for r in rows if 40 <= r[2] < 90], [r for r in rows if 80 <= r[2]]]  # some events come twice
    for part in parts[:2]:
        write(spark, part, KIND, tmp_path / "in")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(spark, sessions.edited(stream), tmp_path, "out")
    half = states(sessions.latest(spark.read.parquet(f"{tmp_path}/out")))
    assert half == states(sessions.replayed(spark.createDataFrame(parts[0] + parts[1], KIND)))
    write(spark, parts[2], KIND, tmp_path / "in")
    run(spark, sessions.edited(stream), tmp_path, "out")  # goes on from the checkpoint
    whole = states(sessions.latest(spark.read.parquet(f"{tmp_path}/out")))
    assert whole == states(sessions.replayed(spark.createDataFrame(rows, KIND))) != half


def test_a_stuck_capture_ends_in_error_and_recovers(spark, store, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    e = lambda c, s, op, m: (c, 0, s, op, at(m), 0.1, 0.0, *((0.0, 0.0, 0.2, 0.2) if op == "place" else (None,) * 4))
    first = [e(1, 0, "place", 0), e(1, 1, "move", 1), e(2, 0, "place", 0), e(2, 1, "toggle", 1), e(3, 0, "move", 1)]
    later = [e(9, 0, "place", 120), e(3, 1, "toggle", 119)]
    for part in (first, later, [e(9, 1, "toggle", 121)]):
        write(spark, part, KIND, tmp_path / "in")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(spark, sessions.edited(stream), tmp_path, "out")
    got = states(sessions.latest(spark.read.parquet(f"{tmp_path}/out")))
    assert got[1, None][7] == "error" and got[1, 0][0] == pytest.approx(0.1)  # busy since minute 1
    assert got[2, None][7] == "analyzed" and got[3, None][7] == "analyzed" and got[9, None][7] == "analyzed"
    every = spark.createDataFrame(first + later, KIND)
    table = states(sessions.replayed(every, now="2024-01-01 02:00:00"))
    assert {k: v[7] for k, v in table.items() if k[1] is None and k[0] != 9} == {(1, None): "error", (2, None): "analyzed", (3, None): "analyzed"}
    assert states(sessions.replayed(every))[1, None][7] == "analyzing"
    write(spark, [e(1, 2, "toggle", 122)], KIND, tmp_path / "in")
    run(spark, sessions.edited(stream), tmp_path, "out")
    assert states(sessions.latest(spark.read.parquet(f"{tmp_path}/out")))[1, None][7] == "analyzed"


def test_changed_reports(spark, store, tmp_path):
    stamps = {1: [10, 10, 11, 11, 10, 10], 2: [5, 5], 3: [7, 8, 7, 8]}
    rows = [(r, s, stamp, START + dt.timedelta(seconds=s)) for r, l in stamps.items() for s, stamp in enumerate(l)]
    kind = "report long, seq long, stamp long, ts timestamp"
    want = {(1, 0, 10), (1, 2, 11), (1, 4, 10), (2, 0, 5), (3, 0, 7), (3, 1, 8), (3, 2, 7), (3, 3, 8)}
    assert {tuple(r) for r in sessions.changed_reports(spark.createDataFrame(rows, kind)).collect()} == want
    for part in ([r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3]):
        write(spark, part, kind, tmp_path / "in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(spark, sessions.changed_reports(stream), tmp_path, "polls")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/polls").collect()]
    assert len(got) == len(want) and set(got) == want


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert sessions.replayed(none).count() == 0 and sessions.latest(sessions.replayed(none)).where(F.lit(True)).count() == 0
