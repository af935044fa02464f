"""What stored layouts shuffle and hold when their tables grow."""

from pathlib import Path

from quayline.plans import files
from quayline.sources.tables import Tables
from tests.conftest import random_frames


def stored(spark, path):
    f = random_frames(spark, 92, orders=80, lines=300, days=110)
    for name in ("customer", "orders", "lineitem"):
        getattr(f, name).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return Tables(spark, str(path))


def test_increments_go_through_the_segment_only(spark, tmp_path, monkeypatch):
    tables, seen = stored(spark, tmp_path), []
    extend = files.extend_ledger

    def noting(path, orders, lines, new_orders, new_lines):
        seen.append((orders, lines, new_orders, new_lines))
        return extend(path, orders, lines, new_orders, new_lines)

    monkeypatch.setattr(files, "extend_ledger", noting)
    found = files.ledger_incremental(tables, "BUILDING").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, files.ledger_stored(tables, "BUILDING").collect()))
    own = {r[0] for r in files.orders_of_segment(tables.orders, tables.customer, "BUILDING").select("o_orderkey").collect()}
    for frames in seen:
        for frame in frames:
            # a plain read of stored rows: no join or exchange is repeated
            assert "Join" not in (plan := frame._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
            assert {r[0] for r in frame.select(frame.columns[0]).collect()} <= own
    assert len(seen) == len(files.INCREMENTS) + 1


def test_clustered_buckets_follow_the_lines(spark, tmp_path, monkeypatch):
    tables, written = stored(spark, tmp_path), []
    monkeypatch.setattr(files, "write_clustered", lambda given, root, buckets: written.append(buckets))
    files.clustered(tables)
    monkeypatch.setattr(files, "stored_bytes", lambda spark, path: 4 << 30 if Path(path).name == "lineitem.parquet" else 0)
    files.clustered(tables)
    files.clustered(tables, 5)
    assert written == [files.BUCKETS, 256, 5]
