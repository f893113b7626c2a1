"""Changes of partitioned tables against plain Python, and the files they leave alone."""

import datetime
import os

from lodestone.sources.partitions import PartitionedTable, bucket_of

D = datetime.date
SCHEMA = "id long, day date, version int, note string"


def rows():
    return [(k, None if k % 10 == 9 else D(2024, 1, 1 + k % 8), 1, f"n{k}") for k in range(80)]


def make(spark, tmp_path, data=None):
    return PartitionedTable.create(spark.createDataFrame(rows() if data is None else data, SCHEMA), str(tmp_path / "t"), "day")


def files(table):
    out = {}
    for root, _, names in os.walk(table.path):
        for n in names:
            if n.startswith("part-"):
                out.setdefault(os.path.basename(root), []).append((n, os.stat(os.path.join(root, n)).st_mtime_ns))
    return {k: sorted(v) for k, v in out.items()}


def content(table):
    return sorted((tuple(r) for r in table.read().select("id", "day", "version", "note").collect()), key=str)


def changed(before, after):
    return {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}


def test_upsert_touches_old_and_new_partitions_only(spark, tmp_path):
    table = make(spark, tmp_path)
    before = files(table)
    new = [(0, D(2024, 1, 1), 2, "same day"), (2, D(2024, 1, 5), 2, "moved"), (3, D(2024, 1, 4), 0, "late and older"), (500, D(2024, 2, 1), 1, "new"), (19, None, 2, "null day")]
    table.upsert(spark.createDataFrame(new, SCHEMA), "id", "version")
    want = {r[0]: r for r in rows()} | {r[0]: r for r in new if r[0] != 3}
    assert content(table) == sorted(want.values(), key=str)
    assert changed(before, files(table)) == {"day=2024-01-01", "day=2024-01-03", "day=2024-01-05", "day=2024-01-04", "day=2024-02-01", "day=__HIVE_DEFAULT_PARTITION__"}


def test_delete_touches_partitions_of_its_ids_and_removes_emptied_ones(spark, tmp_path):
    table = make(spark, tmp_path)
    before = files(table)
    gone = [k for k in range(80) if k % 8 == 2 and k % 10 != 9] + [4, 1000, None]
    table.delete(spark.createDataFrame([(k,) for k in gone], "id long"), "id")
    assert content(table) == sorted((r for r in rows() if r[0] not in gone), key=str)
    after = files(table)
    assert "day=2024-01-03" not in after and changed(before, after) == {"day=2024-01-03", "day=2024-01-05"}
    assert not os.path.exists(os.path.join(table.path, "day=2024-01-03"))


def test_retention_drops_days_and_leaves_the_rest(spark, tmp_path):
    table = make(spark, tmp_path)
    before = files(table)
    assert sorted(table.retain(D(2024, 1, 4))) == [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)]
    assert files(table) == {k: v for k, v in before.items() if k not in ("day=2024-01-01", "day=2024-01-02", "day=2024-01-03")}
    assert content(table) == sorted((r for r in rows() if r[1] is None or r[1] >= D(2024, 1, 4)), key=str)


def test_nothing_to_do_writes_nothing(spark, tmp_path):
    table = make(spark, tmp_path)
    before = files(table)
    assert table.delete(spark.createDataFrame([(1000,)], "id long"), "id") == [] == table.upsert(spark.createDataFrame([], SCHEMA), "id", "version")
    assert table.retain(D(2020, 1, 1)) == [] and files(table) == before


def test_rows_by_buckets_of_their_id(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("bucket", bucket_of("id", 8))
    table = PartitionedTable.create(df, str(tmp_path / "b"), "bucket")
    before = files(table)
    assert len(table.upsert(df.where("id = 5").selectExpr("id", "day", "2 AS version", "'x' AS note", "bucket"), "id", "version")) == 1
    assert len(changed(before, files(table))) == 1 and table.read().where("id = 5").first().note == "x" and table.read().count() == 80
