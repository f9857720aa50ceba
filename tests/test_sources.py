import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tuneprep import storage
from tuneprep.operators.mapping import map_batches
from tuneprep.sources import arrow_files, layout_path, read_arrow, read_split, read_stream, read_train_eval, split_path, write_arrow, write_prepared
from tuneprep.storage import materialize, scratch_path, shared_dir


def ids(df):
    return sorted(r.id for r in df.collect())


def test_paths():
    assert split_path("/d", "train") == "/d/train"
    assert split_path("/d/", "train", "data/rl/") == "/d/data/rl/train"
    assert split_path("/d", None, "") == "/d"
    with pytest.raises(ValueError):
        split_path("", "train")


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_written_splits_are_read_back(spark, out_dir, fmt):
    for split, rows in (("train_prefs", 5), ("test_prefs", 2)):
        write_prepared(spark.range(rows), layout_path(out_dir, "reward_train"), split, fmt)
    options = {"data_dir": "reward", "fmt": fmt}
    train, evaluation = read_train_eval(spark, out_dir, **options)
    assert ids(train) == list(range(5)) and ids(evaluation) == [0, 1]
    assert ids(read_split(spark, f"{out_dir}/reward", "test_prefs", data_dir="", fmt=fmt)) == [0, 1]
    stream = read_stream(spark, out_dir, train.schema, "train_prefs", max_files_per_trigger=1, **options)
    assert stream.isStreaming and stream.columns == ["id"]


def test_split_column_prunes_partitions(spark, out_dir):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train"))
    path = write_prepared(df, out_dir, partition_by=("split",))
    assert path == f"{out_dir}/final"
    part = read_split(spark, path, "test", split_column="split")
    assert part.columns == ["id"] and ids(part) == [0, 1, 2]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(ValueError):
        read_split(spark, path, split_column="split")


def test_results_are_replaced(spark, out_dir):
    write_prepared(spark.range(9), out_dir)
    assert ids(spark.read.parquet(write_prepared(spark.range(3), out_dir))) == [0, 1, 2]


def test_a_failed_write_leaves_the_earlier_result(spark, out_dir):
    path = write_prepared(spark.range(9), out_dir)
    failing = spark.range(0, 100, 1, 4).withColumn("x", F.when(F.col("id") > 90, F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        write_prepared(failing, out_dir)
    assert ids(spark.read.parquet(path)) == list(range(9))
    assert os.listdir(out_dir) == ["final"]


def test_a_result_is_made_from_the_one_it_replaces(spark, out_dir):
    path = write_prepared(spark.range(9), out_dir, "a/b")
    assert write_prepared(spark.read.parquet(path).where("id > 5"), out_dir, "a/b") == path
    assert ids(spark.read.parquet(path)) == [6, 7, 8]


def test_a_killed_replacement_is_brought_back(spark, out_dir):
    path = write_prepared(spark.range(3), out_dir)
    aside = f"{out_dir}/_final.replaced"
    os.rename(path, aside)  # killed between the two renames
    storage.restore_folder(spark, path)
    assert ids(spark.read.parquet(path)) == [0, 1, 2]
    spark.range(7).write.parquet(aside)  # killed before the old one was deleted
    write_prepared(spark.range(2), out_dir)
    assert ids(spark.read.parquet(path)) == [0, 1] and os.listdir(out_dir) == ["final"]
    with pytest.raises(Exception, match="none"):
        storage.replace_folder(spark, f"{out_dir}/none", path)
    assert ids(spark.read.parquet(path)) == [0, 1]


def test_arguments(spark, out_dir):
    with pytest.raises(ValueError):
        read_split(spark, out_dir, "train", fmt="csv")
    with pytest.raises(ValueError):
        layout_path(out_dir, "other")
    with pytest.raises(ValueError):
        write_prepared(spark.range(1), "")


def test_scratch_tables(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_dir(spark) == configured.rstrip("/")
    assert ids(materialize(spark.range(4), "t")) == [0, 1, 2, 3]


def test_dropping_scratch_tables(spark, out_dir, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: out_dir)
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    spark.range(3).write.parquet(f"{out_dir}/kept")
    storage.drop_scratch(spark)
    assert spark.read.parquet(f"{out_dir}/kept").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


@pytest.mark.parametrize("layout", ["file", "stream"])
def test_arrow_files(spark, tmp_path, layout):
    table = pa.table(
        {
            "id": pa.array(range(1000), pa.int64()),
            "prompt": pa.array([None if i % 7 == 0 else f"p{i}" for i in range(1000)]),
            "messages": pa.array([[{"role": "user", "content": f"m{i}"}] for i in range(1000)]),
        }
    )
    (tmp_path / "train").mkdir()
    for part in range(2):
        new = pa.ipc.new_file if layout == "file" else pa.ipc.new_stream
        with new(str(tmp_path / "train" / f"part{part}.arrow"), table.schema) as writer:
            writer.write_table(table.slice(part * 500, 500), max_chunksize=5)
    (tmp_path / "train" / "_state.json").write_text("{}")
    df = read_split(spark, str(tmp_path), "train", fmt="arrow")
    assert df.columns == ["id", "prompt", "messages"]
    assert df.rdd.getNumPartitions() == 2  # two small files
    cut = read_arrow(spark, f"{tmp_path}/train", task_bytes=5_000)
    assert cut.rdd.getNumPartitions() > 4
    assert ids(cut) == list(range(1000))
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 1000 and rows[7].prompt is None and rows[8].prompt == "p8"
    assert rows[999].messages[0].content == "m999"
    single = read_split(spark, f"file://{tmp_path}/train/part1.arrow", fmt="arrow")
    assert ids(single) == list(range(500, 1000))
    assert ids(single.select("id").where("id < 510")) == list(range(500, 510))


def test_map_batches_keeps_partitions(spark, out_dir):
    spark.range(100).coalesce(1).write.parquet(out_dir)
    scan = spark.read.parquet(out_dir)
    wide = spark.range(0, 100, 1, 50)
    assert map_batches(wide, lambda b: b, "id long", 4).rdd.getNumPartitions() == 50

    def double(batch):
        return batch.assign(id=batch["id"] * 2)

    for workers in (None, 0, 3):
        assert ids(map_batches(scan, double, "id long", workers)) == list(range(0, 200, 2))


def arrow_names(path):
    return sorted(p.name for p in path.iterdir())


def test_arrow_is_written_and_read_back(spark, tmp_path):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("p"), "id")).alias("prompt"), F.array(F.struct(F.lit("user").alias("role"), "id")).alias("m")
    )
    path = write_prepared(df.repartition(5), str(tmp_path), "train", "arrow")
    back = read_split(spark, str(tmp_path), "train", fmt="arrow")
    assert back.schema.simpleString() == df.schema.simpleString() and not back.exceptAll(df).count() and back.count() == 1000
    assert all(name.endswith(".arrow") or name == "_manifest.json" for name in arrow_names(tmp_path / "train"))
    assert ids(read_arrow(spark, path, columns=["id"])) == list(range(1000))
    assert ids(read_split(spark, write_prepared(df.limit(3), str(tmp_path), "train", "arrow"), fmt="arrow")) == [0, 1, 2]
    write_arrow(df.where("id >= 998").coalesce(1), path, "append")
    assert ids(read_arrow(spark, path)) == [0, 1, 2, 998, 999]
    assert len(arrow_names(tmp_path / "train")) <= 3
    assert read_arrow(spark, write_prepared(df.limit(0), str(tmp_path), "none", "arrow"), df.schema).count() == 0
    with pytest.raises(ValueError):
        write_prepared(df, str(tmp_path), "train", "arrow", ("id",))


def test_a_failed_arrow_job_leaves_the_old_result(spark, tmp_path):
    path = write_prepared(spark.range(5), str(tmp_path), "train", "arrow")
    names = arrow_names(tmp_path / "train")
    fails = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="broken"):
            write_arrow(fails, path, mode)
        assert names == [name for name in arrow_names(tmp_path / "train") if not name.startswith("_staging")]
        assert not list((tmp_path / "train").glob("_staging*/*")) and ids(read_arrow(spark, path)) == list(range(5))
    with pytest.raises(Exception, match="broken"):
        write_arrow(fails, f"{tmp_path}/new")
    assert not list((tmp_path / "new").glob("**/*.arrow"))
    write_arrow(spark.range(3), path)
    assert len(arrow_names(tmp_path / "train")) <= 4 and ids(read_arrow(spark, path)) == [0, 1, 2]


def test_arrow_files_that_no_commit_names_do_not_count(spark, tmp_path):
    path = write_prepared(spark.range(5), str(tmp_path), "train", "arrow")
    with pa.ipc.new_file(f"{path}/part-lost.arrow", pa.schema([("id", pa.int64())])) as writer:
        writer.write_table(pa.table({"id": [77]}))
    assert ids(read_arrow(spark, path)) == list(range(5))


@pytest.fixture
def pushdown(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("layout", ["file", "stream"])
def test_arrow_filters_are_pushed(spark, tmp_path, pushdown, layout):
    table = pa.table(
        {
            "id": pa.array(range(100), pa.int64()),
            "split": pa.array(["train"] * 60 + [None] * 10 + ["test"] * 30).dictionary_encode(),
            "score": pa.array([i / 10 for i in range(100)]),
        }
    )
    new = pa.ipc.new_file if layout == "file" else pa.ipc.new_stream
    with new(f"{tmp_path}/x.arrow", table.schema) as writer:
        writer.write_table(table, max_chunksize=10)
    part = read_split(spark, str(tmp_path), "test", split_column="split", fmt="arrow")
    assert ids(part) == list(range(70, 100))
    plan = spark._jvm.PythonSQLUtils.explainString(part._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(split), EqualTo(split,test)]" in plan and "Filter [" not in plan
    df = read_arrow(spark, str(tmp_path))
    for where, expected in {
        "id >= 95": range(95, 100), "id in (3, 50, 200)": [3, 50], "split is null and id < 62": [60, 61], "split like 'te%' and id <= 71": [70, 71],
        "score > 9.85": [99], "id % 50 = 0": [0, 50], "split = 'test' or id = 1": [1, *range(70, 100)], "not split = 'test' and id > 57": [58, 59],
    }.items():
        assert ids(df.where(where)) == list(expected), where
    reader = arrow_files.DecidingArrowReader(str(tmp_path), df.schema, 1 << 20)
    assert list(reader.pushFilters([arrow_files.EqualTo(("split",), "test")])) == []
    read = list(reader.read(reader.partitions()[0]))
    assert sum(batch.num_rows for batch in read) == 30
    if layout == "file":
        assert len(read) == 3  # batches without a match are not read


def test_arrow_stream_goes_on_after_a_restart(spark, tmp_path):
    schema, path, out = spark.range(1).schema, str(tmp_path / "in"), str(tmp_path / "out")
    batches = []

    def run():
        stream = read_stream(spark, path, schema, fmt="arrow")
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log")
        writer.trigger(availableNow=True).start().awaitTermination()
        batches.append(spark.read.schema(schema).parquet(out).count())

    write_arrow(spark.range(10), path)
    run()
    run()
    write_arrow(spark.range(10, 25), path, "append")
    write_arrow(spark.range(25, 30), path, "append")
    run()
    assert batches == [10, 10, 30]
    assert ids(spark.read.parquet(out)) == ids(read_arrow(spark, path)) == list(range(30))


def test_arrow_stream_of_files_put_there(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, value, time):
        with pa.ipc.new_file(f"{tmp_path}/in/{name}", pa.schema([("id", pa.int64())])) as writer:
            writer.write_table(pa.table({"id": [value]}))
        os.utime(f"{tmp_path}/in/{name}", ns=(time, time))

    reader = arrow_files.ArrowStreamReader(str(tmp_path / "in"), spark.range(1).schema, 1 << 20)
    offsets = [reader.initialOffset()]
    for names in (["b"], [], ["a", "c"], ["d"]):
        for name in names:
            put(f"{name}.arrow", ord(name), 10**18 if name != "d" else 10**18 + 1)  # a, b and c at the same time
        offsets.append(reader.latestOffset())
    arrived = [[p.path[-7:-6] for p in reader.partitions(a, b)] for a, b in zip(offsets, offsets[1:])]
    assert arrived == [["b"], [], ["a", "c"], ["d"]]
    assert [p.path[-7:-6] for p in reader.partitions(offsets[0], offsets[-1])] == ["a", "b", "c", "d"]
