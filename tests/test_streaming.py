"""Streams equal the batch result, across micro-batches and restarts."""

import pytest
from pyspark.sql import functions as F

from tuneprep.operators import encoding
from tuneprep.operators.batching import pack_wrapped
from tuneprep.sources import read_stream
from tuneprep.streaming import batches, read_blocks, read_side, stream_pack, stream_split, stream_take

KEY = ["k"]
ROWS, FILES = 100, 5


@pytest.fixture(scope="module")
def source(spark):
    """Five files in key order, 20 rows each, arriving one by one."""
    from tuneprep.storage import scratch_path

    path = scratch_path(spark, "stream-source")
    for part in range(FILES):
        rows = spark.range(part * 20, part * 20 + 20).select(
            F.col("id").alias("k"), F.format_string("a b%d c", F.col("id")).alias("text")
        )
        rows.coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark, path):
    schema = spark.read.parquet(path).schema
    return read_stream(spark, path, schema, max_files_per_trigger=1)


def sides(spark, out, schema):
    return {side: sorted(r.k for r in read_side(spark, out, side, schema).collect()) for side in ("valid", "train")}


@pytest.mark.parametrize("size, taken", [(0, 1), (1, 1), (20, 20), (50, 50), (100, 100), (500, 100)])
def test_split_sizes(spark, source, out_dir, size, taken):
    stream = stream_of(spark, source)
    stream_split(stream, out_dir, size, KEY).awaitTermination()
    assert sides(spark, out_dir, stream.schema) == {"valid": list(range(taken)), "train": list(range(taken, ROWS))}


@pytest.mark.parametrize("fail_at", [0, 2, 3])
def test_restart_after_failure(spark, source, out_dir, monkeypatch, fail_at):
    """Fails after a micro-batch's rows are written and before its ledger entry."""
    stream = stream_of(spark, source)
    write, state = batches._write_side, {"left": 1}

    def failing(df, out, side, batch_id):
        write(df, out, side, batch_id)
        if side == ("valid" if fail_at == 0 else "train") and batch_id == fail_at and state["left"]:
            state["left"] = 0
            raise RuntimeError("lost")

    monkeypatch.setattr(batches, "_write_side", failing)
    with pytest.raises(Exception, match="lost"):
        stream_split(stream, out_dir, 50, KEY).awaitTermination()
    stream_split(stream_of(spark, source), out_dir, 50, KEY).awaitTermination()
    assert state["left"] == 0
    assert sides(spark, out_dir, stream.schema) == {"valid": list(range(50)), "train": list(range(50, ROWS))}


def test_prepare_is_applied_to_both_sides(spark, source, out_dir):
    schema = "k long, upper string"

    def prepare(df):
        return df.select("k", F.upper("text").alias("upper"))

    stream_split(stream_of(spark, source), out_dir, 30, KEY, prepare).awaitTermination()
    schema = prepare(spark.read.parquet(source)).schema
    for side in ("valid", "train"):
        assert all(r.upper == f"A B{r.k} C" for r in read_side(spark, out_dir, side, schema).collect())


def test_nothing_written_yet(spark, source, out_dir):
    schema = spark.read.parquet(source).schema
    assert read_side(spark, out_dir, "train", schema).count() == 0


@pytest.mark.parametrize("size, taken", [(0, 1), (33, 33), (1000, 100)])
def test_take(spark, source, out_dir, size, taken):
    writer = stream_take(stream_of(spark, source), size).writeStream.format("parquet")
    writer = writer.option("path", f"{out_dir}/rows").option("checkpointLocation", f"{out_dir}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{out_dir}/rows").count() == taken


def packed(rows, vocab, length):
    return sorted((r.block_id, r.input_ids) for r in pack_wrapped(encoding.encode(rows, vocab), length, KEY, eos_id=9).collect())


def blocks(spark, out, side="blocks"):
    return sorted((r.block_id, r.input_ids) for r in read_blocks(spark, out, side).collect())


@pytest.mark.parametrize("length", [7, 20, 1, 1000])
def test_packing_goes_on_over_micro_batches(spark, source, out_dir, length):
    rows = spark.read.parquet(source)
    vocab = encoding.Vocabulary(encoding.build_vocab(rows, 50))
    stream_pack(stream_of(spark, source), out_dir, vocab, length, KEY, eos_id=9).awaitTermination()
    assert blocks(spark, out_dir) == packed(rows, vocab, length)


def test_packing_after_a_failure(spark, source, out_dir, monkeypatch):
    """Fails after a micro-batch's blocks are written and before what it leaves over is."""
    rows = spark.read.parquet(source)
    vocab = encoding.Vocabulary(encoding.build_vocab(rows, 50))
    write, state = batches._write_side, {"left": 2}

    def failing(df, out, side, batch_id):
        write(df, out, side, batch_id)
        if batch_id in (1, 3) and state["left"]:
            state["left"] -= 1
            raise RuntimeError("lost")

    monkeypatch.setattr(batches, "_write_side", failing)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            stream_pack(stream_of(spark, source), out_dir, vocab, 7, KEY, eos_id=9).awaitTermination()
    stream_pack(stream_of(spark, source), out_dir, vocab, 7, KEY, eos_id=9).awaitTermination()
    assert state["left"] == 0 and blocks(spark, out_dir) == packed(rows, vocab, 7)


def test_both_sides_are_packed_as_one_sequence_each(spark, source, out_dir):
    stream = stream_of(spark, source).select("k", F.lit("p").alias("prompt"), F.col("text").alias("response"))
    rows = spark.read.parquet(source).select("k", F.concat(F.lit("Question: p\n\nAnswer: "), "text").alias("text"))
    vocab = encoding.Vocabulary(encoding.build_vocab(rows, 50))
    batches.sft_prepare_stream(stream, out_dir, vocab, 50, 11, KEY, 9).awaitTermination()
    for side, where in (("valid", "k < 50"), ("train", "k >= 50")):
        assert blocks(spark, out_dir, side) == packed(rows.where(where), vocab, 11)


def test_no_row_is_lost_on_the_way_into_a_stream(spark, out_dir):
    """Rows without a key, below 0 and far apart arrive; so does an empty table."""
    from tuneprep.queries.streams import PARTS, arriving
    from tuneprep.storage import scratch_path

    for name, keys in (("t", [None, None, -10**12, -1, 0, 1, 5, 10**9]), ("empty", [])):
        rows = spark.createDataFrame([(k, "x") for k in keys], "k long, text string")
        rows.write.parquet(f"{out_dir}/{name}.parquet")
        out, seen = scratch_path(spark, "arrived"), []

        def run(stream):
            seen.append(1)
            writer = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log")
            return writer.trigger(availableNow=True).start()

        schema = arriving(spark, out_dir, name, ["k"], run)
        found = spark.read.schema(schema).parquet(f"{out}/rows").collect()
        assert sorted((r.k is not None, r.k or 0) for r in found) == sorted((k is not None, k or 0) for k in keys) and len(seen) == PARTS


def test_a_head_comes_first(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [])], "k int, input_ids array<int>")
    found = sorted((r.block_id, r.input_ids) for r in pack_wrapped(rows, 4, KEY, head=[8, 9]).collect())
    assert found == [(0, [8, 9, 1, 2]), (1, [3, 4, 5])]
    assert [r.input_ids for r in pack_wrapped(rows.where("k = 2"), 4, KEY, head=[8, 9]).collect()] == [[8, 9]]
    for wrong in ({"head": [1] * 4}, {"head": [1], "group_by": ["k"]}):
        with pytest.raises(ValueError):
            pack_wrapped(rows, 4, KEY, **wrong)
