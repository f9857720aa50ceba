"""Take/skip splits and packing over file streams.

Arrival order defines the prefix: micro-batch by micro-batch, and by key inside one.
Outputs and ledger entries are written per micro-batch and replaced when a batch is
run again, so a restart from the checkpoint neither loses nor repeats rows. Packing goes on
from one micro-batch to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tuneprep.operators.batching import pack_wrapped
from tuneprep.operators.columns import format_text
from tuneprep.operators.encoding import Vocabulary
from tuneprep.operators.ordering import nth_key, up_to
from tuneprep.storage import materialize

TRAIN, VALID = "train", "valid"
LEDGER = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("taken", T.LongType())])


def stream_take(stream: DataFrame, size: int) -> DataFrame:
    """The first ``max(1, size)`` rows to arrive, as a stream (append mode)."""
    return stream.limit(max(1, size))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _write_side(df: DataFrame, out: str, side: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{side}/batch_id={batch_id}")


def _start(stream: DataFrame, out: str, run: Callable[[DataFrame, int], None], trigger: dict) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/_checkpoint")
    return writer.trigger(**trigger).start()


def stream_split(
    stream: DataFrame,
    out: str,
    valid_size: int,
    order_by: Sequence[str],
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the first ``max(1, valid_size)`` rows to ``out/valid``, all others to ``out/train``.

    ``prepare`` maps the rows of either side (formatting to text, say). A ledger of
    the validation rows each micro-batch took says how many are still wanted; only
    micro-batches up to the one in which the last of them arrives are written once and
    split from there; later ones pass straight through.
    """
    prepare = prepare or (lambda df: df)

    def emit(df: DataFrame, side: str, batch_id: int) -> None:
        _write_side(prepare(df), out, side, batch_id)

    return _split(stream, out, max(1, valid_size), list(order_by), emit, trigger)


def _split(
    stream: DataFrame, out: str, wanted: int, order: list[str], emit: Callable[[DataFrame, str, int], None], trigger: dict | None
) -> StreamingQuery:
    def taken_before(spark: SparkSession, batch_id: int) -> int:
        path = f"{out}/_ledger"
        if not _exists(spark, path):
            return 0
        entries = spark.read.schema(LEDGER).parquet(f"{path}/entry=*")
        return entries.where(F.col("batch_id") < batch_id).agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        missing = wanted - taken_before(spark, batch_id)
        if missing <= 0:
            emit(batch, TRAIN, batch_id)
            return
        batch = materialize(batch, "micro-batch")
        last = nth_key(batch, order, missing)
        if last is None:
            taken = batch.count()
            emit(batch, VALID, batch_id)
        else:
            is_valid, taken = up_to(batch, order, last), missing
            emit(batch.where(is_valid), VALID, batch_id)
            emit(batch.where(~is_valid), TRAIN, batch_id)
        entry = spark.createDataFrame([(batch_id, taken)], LEDGER).coalesce(1)
        entry.write.mode("overwrite").parquet(f"{out}/_ledger/entry={batch_id}")

    return _start(stream, out, run, trigger or {"availableNow": True})


def read_side(spark: SparkSession, out: str, side: str, schema: T.StructType) -> DataFrame:
    """What a stream has written to one side so far."""
    if not _exists(spark, f"{out}/{side}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{out}/{side}").parquet(f"{out}/{side}").select(*schema.names)


BLOCKS = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("block_id", T.LongType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    ]
)
# What is left over after a micro-batch: the ids of its last, short block, and that block's number.
TAIL = T.StructType([T.StructField("seq_length", T.IntegerType()), *BLOCKS.fields])


def _write_blocks(ids: DataFrame, out: str, side: str, batch_id: int, seq_length: int, order: list[str], eos_id: int | None) -> None:
    """Pack one micro-batch behind what the one before left over.

    Its last block is written even if it is short; the next micro-batch then writes that block anew
    and whole. The ledger entry comes last: a micro-batch that runs again starts from the same entry before it.
    """
    spark, ledger = ids.sparkSession, f"{out}/_tail/{side}"
    before = f"{ledger}/entry={batch_id - 1}"
    tail = spark.read.schema(TAIL).parquet(before).first() if _exists(spark, before) else None
    first, head = (tail.block_id, tail.input_ids) if tail is not None else (0, [])
    packed = pack_wrapped(ids, seq_length, order, eos_id=eos_id, head=head)
    _write_side(packed.withColumn("block_id", F.col("block_id") + first), out, side, batch_id)
    written = spark.read.schema(BLOCKS).parquet(f"{out}/{side}/batch_id={batch_id}")
    last = written.agg(F.max("block_id")).first()[0]
    short = written.where(F.size("input_ids") < seq_length).first()  # none, or the last
    left = (last + 1 if last is not None else first, []) if short is None else (short.block_id, short.input_ids)
    entry = spark.createDataFrame([(seq_length, batch_id, *left)], TAIL).coalesce(1)
    entry.write.mode("overwrite").parquet(f"{ledger}/entry={batch_id}")


def stream_pack(
    stream: DataFrame,
    out: str,
    vocab: Vocabulary,
    seq_length: int,
    order_by: Sequence[str],
    text_col: str = "text",
    eos_id: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Encode and pack the stream into ``out/blocks``, as one sequence without a cut between micro-batches.

    Ids left over at the end of a micro-batch, fewer than a block, are kept in a ledger
    and come first in the next one. :func:`read_blocks` gives the blocks so far.
    """
    order = list(order_by)

    def run(batch: DataFrame, batch_id: int) -> None:
        ids = vocab.encode(batch, {text_col: "input_ids"}).select(*order, "input_ids")
        _write_blocks(ids, out, "blocks", batch_id, seq_length, order, eos_id)

    return _start(stream, out, run, trigger or {"availableNow": True})


def read_blocks(spark: SparkSession, out: str, side: str = "blocks") -> DataFrame:
    """(batch_id, block_id, input_ids) that a stream has packed so far: all whole blocks, and the last short one."""
    blocks = read_side(spark, out, side, BLOCKS)
    if not _exists(spark, f"{out}/_tail/{side}"):
        return blocks
    entries = spark.read.schema(TAIL).parquet(f"{out}/_tail/{side}/entry=*")  # one row a micro-batch
    last = entries.orderBy(F.desc("batch_id")).first()
    return blocks.where((F.size("input_ids") == last.seq_length) | (F.col("batch_id") == last.batch_id))


def sft_prepare_stream(
    stream: DataFrame,
    out: str,
    vocab: Vocabulary,
    valid_size: int,
    seq_length: int,
    order_by: Sequence[str],
    eos_id: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Prompt/response rows to packed blocks of both sides, as they arrive.

    The first ``valid_size`` rows are split off; each side is formatted, encoded and packed as one
    sequence into ``out/train`` and ``out/valid`` (see :func:`stream_pack` and :func:`read_blocks`).
    """
    order = list(order_by)

    def emit(df: DataFrame, side: str, batch_id: int) -> None:
        ids = vocab.encode(format_text(df, order), {"text": "input_ids"}).select(*order, "input_ids")
        _write_blocks(ids, out, side, batch_id, seq_length, order, eos_id)

    return _split(stream, out, max(1, valid_size), order, emit, trigger)
