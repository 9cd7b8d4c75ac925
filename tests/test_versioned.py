"""Tables in versions: whole versions for readers, restore, prune, batches that run twice."""

from __future__ import annotations

import threading

import pytest

from tidemark.sources.versioned import VersionedTable


def rows(spark, *data):
    return spark.createDataFrame(list(data), "day string, id long, v double, note string")


def got(df):
    return sorted((r.day, r.id, r.v, r.note) for r in df.collect())


@pytest.mark.parametrize("partition", [None, "day"])
def test_changes_make_versions(spark, tmp_path, partition):
    t = VersionedTable(spark, str(tmp_path / "t"), partition)
    assert t.versions() == []
    with pytest.raises(ValueError):
        t.read()
    a, b = ("d 1/x", 1, 1.0, "a"), ("d2", 2, 2.0, None)
    assert t.append(rows(spark, a, b)) == 1
    assert t.append_new(rows(spark, ("d2", 2, 9.0, "z"), ("d2", 3, 3.0, "c"), ("d2", 3, 3.0, "c")), "id") == 2
    assert got(t.read()) == sorted([a, b, ("d2", 3, 3.0, "c")])
    assert t.upsert(rows(spark, ("d2", 2, 5.0, "new"), ("d3", 4, 4.0, "d")), ["id"], "v", ("note",)) == 3
    assert got(t.read()) == sorted([a, ("d2", 2, 5.0, "new"), ("d2", 3, 3.0, "c"), ("d3", 4, 4.0, "d")])
    assert t.upsert(rows(spark, ("d2", 2, 6.0, None)), ["id"], "v", ("note",)) == 4
    assert ("d2", 2, 6.0, "new") in got(t.read())
    t.rebuild(rows(spark, ("d2", 7, 7.0, "only")))
    assert got(t.read()) == (sorted([a, ("d2", 7, 7.0, "only"), ("d3", 4, 4.0, "d")]) if partition else [("d2", 7, 7.0, "only")])
    assert t.restore(2) == 6
    assert got(t.read()) == got(t.read(2)) == sorted([a, b, ("d2", 3, 3.0, "c")])
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert again.partition == partition and got(again.read()) == got(t.read())
    other = t.backup(str(tmp_path / "copy"), 1)
    assert got(other.read()) == sorted([a, b])
    with pytest.raises(ValueError):
        t.backup(str(tmp_path / "copy"))


def test_prune_deletes_files(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "day")
    for k in range(4):
        t.append(rows(spark, (f"2024-01-0{k + 1}", k, 1.0, None), (None, 9, 1.0, None)))
    assert t.vacuum(keep=9) == 0
    t.drop_partitions(lambda day: day < "2024-01-03")
    before = len(list((tmp_path / "t").rglob("*.parquet")))
    assert t.vacuum() == 2 and t.versions() == [5]
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == before - 2
    assert got(t.read().where("day is not null")) == [("2024-01-03", 2, 1.0, None), ("2024-01-04", 3, 1.0, None)]
    assert t.read().where("day is null").count() == 4
    assert t.vacuum(older_than_s=3600) == 0


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    one = rows(spark, ("d", 1, 1.0, None))
    assert [t.append(one, ("s", n)) for n in (0, 1, 1, 0, 2)] == [1, 2, 2, 2, 3]
    assert t.append(one, ("other", 0)) == 4
    assert t.read().count() == 4


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    VersionedTable(spark, path).append(rows(spark, ("d", 0, 0.0, None)))
    seen, failed = [], []

    def write(k):
        try:
            VersionedTable(spark, path).append(rows(spark, ("d", 2 * k, 1.0, None), ("d", 2 * k + 1, 1.0, None)))
        except Exception as e:
            failed.append(e)

    def read():
        for _ in range(6):
            seen.append(VersionedTable(spark, path).read().count())

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)] + [threading.Thread(target=read)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and all(n % 2 for n in seen)
    t = VersionedTable(spark, path)
    assert t.versions() == [1, 2, 3, 4, 5] and sorted(r.id for r in t.read().collect()) == [0, *range(2, 10)]


def test_nothing_to_write(spark, tmp_path):
    for partition in (None, "day"):
        t = VersionedTable(spark, str(tmp_path / f"t{partition}"), partition)
        t.append(rows(spark))
        t.upsert(rows(spark), ["id"], "v")
        t.append_new(rows(spark), "id")
        assert t.read().count() == 0 and t.read().columns == ["day", "id", "v", "note"]
