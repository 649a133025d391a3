import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripmarts.operators import clean as C
from tripmarts.sources import clean_store, footers, readers, schemas
from tripmarts.sources.clean_store import CleanStore

AT = dt.datetime(2024, 5, 1, 10)


def trips(spark, rows):
    """fhv trips from (base, zone, minutes)."""
    data = [(base, AT, AT + dt.timedelta(minutes=m), zone, zone) for base, zone, m in rows]
    return spark.createDataFrame(data, schemas.FHV)


def test_rows_once_per_source(spark, monkeypatch):
    rows = [("a", 1, None), ("a", None, 1), ("a", 1, None), ("b", 1, None), ("b", 1, None), ("b", 2, 2), (None, None, None)]
    df = spark.createDataFrame(rows, "source string, x long, y long").repartition(3)
    want = sorted(set(rows), key=repr)
    assert sorted(map(tuple, clean_store.once_per_source(df).collect()), key=repr) == want
    monkeypatch.setattr(clean_store, "BROADCAST_HASHES", 0)
    assert sorted(map(tuple, clean_store.once_per_source(df).collect()), key=repr) == want
    assert clean_store.once_per_source(df.limit(0)).count() == 0


def test_single_rows_are_not_shuffled(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "source string, x long")
    plan = clean_store.once_per_source(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_counted_report_equals_full_report(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("a", -1), ("b", -1), ("b", None)], "source string, x long")
    valid = F.col("x") > 0
    old = C.removal_report(df, df.where(valid).distinct(), ["source"]).orderBy("source")
    assert C.counted_report(df, valid, ["source"]).orderBy("source").select(old.columns).collect() == old.collect()


def test_backfill_and_reclean(spark, tmp_path):
    store = CleanStore(spark, str(tmp_path / "raw"), str(tmp_path / "clean"), "fhv")
    trips(spark, [("B1", 5, 10), ("B1", 5, 10), (None, 5, 10), ("B2", 0, 3), ("B3", 7, -1)]).repartition(2).write.parquet(str(tmp_path / "raw/fhv/2024-05"))
    trips(spark, [(None, 5, 10)]).write.parquet(str(tmp_path / "raw/fhv/2024-06"))
    (tmp_path / "raw/fhv/2024-07").mkdir()
    (tmp_path / "raw/fhv/2024-07/part.parquet").write_bytes(b"PAR1 cut off")
    assert store.backfill() == ["2024-05", "2024-06"] and store.read().count() == 1
    assert store.backfill() == ["2024-06"]  # nothing valid, so no twin
    found = {r["source"]: (r["raw_files"], r["raw_rows"], r["clean_rows"], r["removed"]) for r in store.report().collect()}
    assert found["2024-05"][1:] == (5, 1, 4) and found["2024-06"][1:] == (1, 0, 1) and len(found) == 2
    store.read_raw(["2024-05"]).write.mode("overwrite").partitionBy("source").parquet(store.clean)  # a twin of older rules
    assert store.reclean() == [["2024-05"]] and store.reclean() == []
    assert [(r["rows"], r["violations"]) for r in store.validate().collect()] == [(1, 0)]
    part = next((tmp_path / "clean/fhv/source=2024-05").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:40])
    assert "2024-05" in store.backfill() and store.read().count() == 1
    with pytest.raises(ValueError, match="truncated"):
        readers.read_family(spark, "fhv", str(tmp_path / "raw/fhv/2024-07"))


def test_footers(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "a b=%c"))
    spark.range(0).write.parquet(str(tmp_path / "none"))
    good = next((tmp_path / "a b=%c").glob("*.parquet")).read_bytes()
    for name, data in {"cut": good[:-5], "short": b"PAR1", "text": b"hello world, hello", "nothing": b"", "bent": good[:4] + bytes(len(good) - 12) + good[-8:]}.items():
        (tmp_path / f"{name}.parquet").write_bytes(data)
    rows = footers.footers(spark, str(tmp_path), pattern="*.parquet").collect()
    by_name = {r["path"].rsplit("/", 1)[1]: r["status"] for r in rows}
    assert {k: by_name[f"{k}.parquet"] for k in ("cut", "short", "text", "nothing", "bent")} == {"cut": "truncated", "short": "truncated", "text": "foreign", "nothing": "empty", "bent": "damaged"}
    assert sorted(r["rows"] for r in rows if r["status"] == "readable")[-1] == 7 and len({r["columns"] for r in rows if r["status"] == "readable"}) == 1


def test_sources_landed_in_one_pass(spark, tmp_path, monkeypatch):
    from catalog import storage

    table, asked = trips(spark, [("B1", 5, 10), ("B1", 5, 10), ("B2", 7, 3), (None, 9, 1)]), []
    monkeypatch.setattr(storage, "T", lambda name: lambda spark, d: asked.append(name) or table)
    base = F.col("dispatching_base_num")
    storage.land(spark, None, "fhv", "fhv_trips", str(tmp_path / "raw"), {"one": base == "B1", "two": base == "B2", "none": base == "B3"})
    assert asked == ["fhv_trips"]
    store = CleanStore(spark, str(tmp_path / "raw"), str(tmp_path / "clean"), "fhv", partitioned=True)
    assert store.backfill() == ["none", "one", "two"]
    assert {r["source"]: (r["raw_rows"], r["clean_rows"]) for r in store.report().collect()} == {"one": (2, 1), "two": (1, 1), "none": (0, 0)}
    assert sorted(r["source"] for r in store.read().collect()) == ["one", "two"]
