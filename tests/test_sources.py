import numpy as np
import pytest

from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from optabula.sources.binary import (
    PUSHDOWN,
    PushingReader,
    read_binary_blocks,
    read_binary_rows,
)
from optabula.sources.tables import random_blocks, read_csv_matrix, reference_models_from_rows


def write(path, values):
    path.write_bytes(np.asarray(values).astype(">f8").tobytes())


def test_rows_keep_their_position_over_files_and_splits(spark, tmp_path):
    data = np.arange(60.0).reshape(20, 3)
    write(tmp_path / "a.bin", data[:13])
    write(tmp_path / "b.bin", data[13:])
    (tmp_path / "_SUCCESS").write_text("")
    scan = read_binary_rows(spark, str(tmp_path), 3, split_bytes=50)
    assert scan.rdd.getNumPartitions() > 5
    rows = scan.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(20))
    assert np.array_equal([r["values"] for r in rows], data)


def test_file_uri_and_single_file(spark, tmp_path):
    write(tmp_path / "a.bin", [[1.0, -2.5]])
    rows = read_binary_rows(spark, f"file://{tmp_path}/a.bin", 2).collect()
    assert [tuple(r["values"]) for r in rows] == [(1.0, -2.5)]


def test_blocks(spark, tmp_path):
    data = np.arange(24.0)
    write(tmp_path / "a.bin", data)
    rows = read_binary_blocks(spark, str(tmp_path), 4, 3).orderBy("block_id").collect()
    assert [r["n_rows"] for r in rows] == [4, 4]
    assert np.array_equal(np.concatenate([r["values"] for r in rows]), data)


@pytest.mark.parametrize("split_bytes", [1, 200, 1 << 20])
def test_blocks_go_over_file_ends_and_end_short(spark, tmp_path, split_bytes):
    data = np.arange(23 * 3.0)
    for k, part in enumerate(np.split(data, [15, 18, 18, 60])):
        write(tmp_path / f"{k}.bin", part)
    rows = read_binary_blocks(spark, str(tmp_path), 5, 3, split_bytes).orderBy("block_id").collect()
    assert [(r["block_id"], r["n_rows"]) for r in rows] == [(0, 5), (1, 5), (2, 5), (3, 5), (4, 3)]
    assert np.array_equal(np.concatenate([r["values"] for r in rows]), data)


RANGES = [("pos >= 4 AND pos < 9", range(4, 9)), ("pos = 13", [13]), ("pos > 17", [18, 19]),
          ("pos <= 1", [0, 1]), ("pos IN (3, 6)", [3, 6]), ("pos > 30", []),
          ("pos = 5 OR values[0] = 6", [2, 5]), ("pos > 3 AND pos < 2", [])]


@pytest.mark.parametrize("condition, want", RANGES)
@pytest.mark.parametrize("pushed", ["true", "false"])
def test_filters_on_positions(spark, tmp_path, condition, want, pushed):
    data = np.arange(60.0).reshape(20, 3)
    for name, part in zip("abc", np.split(data, [6, 7])):
        write(tmp_path / f"{name}.bin", part)
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, pushed)
    try:
        rows = read_binary_rows(spark, str(tmp_path), 3, split_bytes=50).where(condition)
        found = sorted((r["pos"], *r["values"]) for r in rows.collect())
    finally:
        spark.conf.set(PUSHDOWN, before)
    assert found == [(p, *data[p]) for p in want]


@pytest.mark.parametrize("first, end", [(0, 2), (1, 4), (3, None), (4, 9), (5, None), (2, 2)])
def test_ranges_of_blocks(spark, tmp_path, first, end):
    data = np.arange(23 * 3.0)
    for k, part in enumerate(np.split(data, [15, 18, 18, 60])):
        write(tmp_path / f"{k}.bin", part)
    rows = read_binary_blocks(spark, str(tmp_path), 5, 3, 1, first, end).orderBy("block_id").collect()
    want = list(range(5))[first:end]
    assert [r["block_id"] for r in rows] == want
    for r in rows:
        assert r["values"] == data[15 * r["block_id"]:15 * r["block_id"] + 15].tolist()


def test_only_the_bytes_of_a_range_are_read(tmp_path):
    for name, n in (("a", 13), ("b", 1), ("c", 86)):
        write(tmp_path / f"{name}.bin", np.zeros((n, 3)))
    reader = PushingReader(f"file://{tmp_path}", 3, 100)
    other = EqualTo(("values",), 1)
    assert list(reader.pushFilters([
        GreaterThanOrEqual(("pos",), 12), LessThan(("pos",), 16), other])) == [other]
    ranges = [r for split in reader.partitions() for r in split.ranges]
    assert [(r[0][-5:], *r[1:]) for r in ranges] == [
        ("a.bin", 288, 24), ("b.bin", 0, 24), ("c.bin", 0, 48)]
    assert [s.first_record for s in reader.partitions()] == [12]


def test_partial_record_is_refused(spark, tmp_path):
    write(tmp_path / "a.bin", np.arange(7.0))
    with pytest.raises(Exception, match="no multiple of the record"):
        read_binary_rows(spark, str(tmp_path), 3).collect()


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        read_binary_rows(spark, str(tmp_path / "nowhere"), 3).collect()
    assert read_binary_rows(spark, str(tmp_path), 3).count() == 0


def test_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1.5,2,-3\n4,5,6e-3\n")
    assert [r["values"] for r in read_csv_matrix(spark, str(tmp_path)).collect()] == [
        [1.5, 2.0, -3.0], [4.0, 5.0, 0.006]]
    row = read_csv_matrix(spark, str(tmp_path), 3, target_last=True).first()
    assert row["features"] == [1.5, 2.0] and row["target"] == -3.0


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\nx,4\n")
    with pytest.raises(Exception):
        read_csv_matrix(spark, str(tmp_path), 2).collect()


def test_random_blocks(spark):
    def rows(per_partition, seed=1):
        df = random_blocks(spark, 23, 2, 5, per_partition, seed)
        return df.rdd.getNumPartitions(), df.orderBy("block_id").collect()

    parts, a = rows(2)
    assert parts == 3 and [r["n_rows"] for r in a] == [5, 5, 5, 5, 3]
    flat = np.concatenate([r["values"] for r in a])
    assert len(flat) == 46 and flat.min() >= 0 and flat.max() < 1 and len(set(flat)) == 46
    assert rows(1)[1] == a and rows(2, seed=2)[1] != a


def test_reference_models(spark):
    df = reference_models_from_rows(spark, [("p", 1, "true", [0.5, 0.0]), ("p", 1, "optimal", [0.4, 0.1])])
    assert sorted(tuple(r) for r in df.collect()) == [
        ("p", 1, "optimal", 0, 0.4), ("p", 1, "optimal", 1, 0.1),
        ("p", 1, "true", 0, 0.5), ("p", 1, "true", 1, 0.0)]
