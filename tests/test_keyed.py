"""Access state in the state store: many batches, restarts and expiry against a batch result."""

from datetime import datetime, timedelta, timezone

import pytest

from assocgraph.streaming import keyed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "node long, ts timestamp"


def put(spark, folder, number, rows):
    """One file, as one batch."""
    spark.createDataFrame([(n, None if h is None else START + timedelta(hours=h)) for n, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/b{number:03d}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def hours(ms):
    return None if ms is None else (ms / 1000 - START.timestamp()) / 3600


def test_many_batches_restart_and_expiry(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    source, folder, seen = tmp_path / "in", str(tmp_path / "state"), []
    batches = [[(1, 0), (2, 1), (1, 2)], [(3, 3), (1, 3)], [(2, 30)], [(2, 31), (5, 31)], [(1, 60)], [(9, 61), (9, 61)]]
    for i, rows in enumerate(batches[:3]):
        put(spark, source, i, rows)
    sink = lambda batch, number: seen.append({r.node: (r.n, r.alive) for r in batch.collect()})
    keyed.follow(stream(spark, source), timedelta(hours=20), folder, sink)
    for i, rows in enumerate(batches[3:], 3):
        put(spark, source, i, rows)
    keyed.follow(stream(spark, source), timedelta(hours=20), folder, sink)  # goes on from the state
    got = {r.node: (r.n, hours(r.last_ms)) for r in keyed.state(spark, folder).collect()}
    alive = {r.node for r in keyed.state(spark, folder).filter("alive").collect()}
    assert keyed.state(spark, folder).count() == len(got)
    flat = [x for rows in batches for x in rows]
    assert got == {n: (sum(1 for m, _ in flat if m == n), max(h for m, h in flat if m == n)) for n, _ in flat}
    assert alive == {1, 9}  # the others were idle for twenty hours before the last access
    # a batch changes the nodes that it holds and those whose time is over, no others
    held = [set(b) for b in seen if b]
    assert held[0] == {1, 2} and held[1] == {1, 3} and all(len(b) <= 3 for b in held)
    assert spark.conf.get(keyed.PROVIDER, None) != keyed.ROCKS and spark.conf.get(keyed.PARTS) == "4"


def test_nothing_to_follow(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    (tmp_path / "in").mkdir()
    keyed.follow(stream(spark, tmp_path / "in"), timedelta(hours=1), str(tmp_path / "state"))
    put(spark, tmp_path / "in", 0, [(None, 1), (7, None)])
    keyed.follow(stream(spark, tmp_path / "in"), timedelta(hours=1), str(tmp_path / "state"))
    got = {r.node: (r.n, hours(r.last_ms)) for r in keyed.state(spark, str(tmp_path / "state")).collect()}
    assert got == {None: (1, 1.0), 7: (1, None)}
