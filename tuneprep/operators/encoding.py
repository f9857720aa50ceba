"""Vocabulary building and token ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions.messages import ChatTemplate
from tuneprep.functions.text import word_tokens
from tuneprep.operators.columns import TEXT_FIELD, pair_texts, prompt_texts
from tuneprep.operators.ordering import OrderedKeys, up_to
from tuneprep.storage import materialize

IDS = T.ArrayType(T.IntegerType())
UNKNOWN_ID = 0
# At most this many words are sent to every executor; of a larger vocabulary the rest is joined.
BROADCAST_WORDS = 500_000
BROADCAST_BYTES = 256 << 20


def build_vocab(
    df: DataFrame, size: int, text_col: str = TEXT_FIELD, first_id: int = 1
) -> DataFrame:
    """The ``size`` most frequent words as (token, id, n), ids by count, then by word.

    Counting combines before the shuffle, so a word that makes up a third of all
    text costs one row per task. The counts are written once, in their order, and the
    first of them are read back with their positions.
    """
    if size < 1:
        raise ValueError("A vocabulary needs at least one word.")
    counts = df.select(F.explode(word_tokens(F.col(text_col))).alias("token")).groupBy("token").agg(
        (-F.count(F.lit(1))).alias("_rank")
    )
    top = OrderedKeys(counts, ["_rank", "token"], unique=True).first(size, "_row")
    return top.select("token", (F.col("_row") + first_id).cast("int").alias("id"), (-F.col("_rank")).alias("n"))


def _lookup(spark, table: pa.Table, unknown_id: int | None):
    """A column function words -> ids over a broadcast word list, one Arrow batch at a time.

    Words not in the list get ``unknown_id``, which may be None for NULL.
    """
    words = spark.sparkContext.broadcast(
        (table["token"].combine_chunks().cast(pa.string()), table["id"].combine_chunks().cast(pa.int32()))
    )

    @F.arrow_udf(IDS)
    def lookup(tokens: pa.Array) -> pa.Array:
        known, ids = words.value
        found = ids.take(pc.index_in(tokens.flatten(), value_set=known))
        starts = pc.subtract(tokens.offsets, tokens.offsets[0])
        return pa.ListArray.from_arrays(starts, found if unknown_id is None else pc.fill_null(found, unknown_id))

    return lookup


class Vocabulary:
    """A vocabulary ready for use: broadcast if it is small enough, else kept as a table."""

    def __init__(self, vocab: DataFrame, unknown_id: int = UNKNOWN_ID, broadcast_words: int = BROADCAST_WORDS):
        self.unknown_id = unknown_id
        self.broadcast_words = broadcast_words
        self.table = materialize(vocab.select("token", "id"), "vocabulary")
        rows, size, last = self.table.agg(F.count(F.lit(1)), F.sum(F.octet_length("token")), F.max("id")).first()
        self.ids = 1 + max(unknown_id, last or 0)  # all ids are below
        self.lookup = None
        if rows <= broadcast_words and (size or 0) <= BROADCAST_BYTES:
            self.lookup = _lookup(vocab.sparkSession, self.table.toArrow(), unknown_id)

    def encode(self, df: DataFrame, columns: dict[str, str], max_length: int | None = None) -> DataFrame:
        """Add one id array per text column: ``columns`` maps text column to output column.

        The first ``max_length`` words count, if given. Rows need no key.
        """
        tokens = {output: word_tokens(F.col(text), max_length) for text, output in columns.items()}
        if self.lookup is not None:
            return df.withColumns({output: self.lookup(words) for output, words in tokens.items()})
        return self._encode_large(df, tokens)

    def _encode_large(self, df: DataFrame, tokens: dict[str, Column]) -> DataFrame:
        """Broadcast the words that are frequent in these very texts and join the rest.

        Frequent words are known whether the vocabulary has them or not, so each word
        left to the join is rare, and no join key is hot. The rows are written once, with
        a number of their own, and all text columns are looked up together.
        """
        names = list(tokens)
        words = {f"_words{i}": tokens[name] for i, name in enumerate(names)}
        rows = materialize(
            df.withColumns(words).withColumn("_row", F.monotonically_increasing_id()), "texts"
        )
        every = F.explode(F.flatten(F.array(*words))).alias("token")
        counts = rows.select(every).groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
        used = materialize(
            counts.join(self.table, "token", "left").select(
                "token", F.coalesce("id", F.lit(self.unknown_id)).alias("id"), (-F.col("_n")).alias("_rank")
            ),
            "words",
        )
        is_frequent = self._frequent(used)
        lookup = _lookup(df.sparkSession, used.where(is_frequent).select("token", "id").toArrow(), None)
        rare = used.where(~is_frequent).select("token", "id")

        looked_up = materialize(
            rows.withColumns({f"_ids{i}": lookup(F.col(f"_words{i}")) for i in range(len(names))}), "looked-up"
        )
        sides = F.array(
            *[
                F.struct(F.lit(i).alias("side"), F.arrays_zip(F.col(f"_words{i}").alias("word"), F.col(f"_ids{i}").alias("id")).alias("pairs"))
                for i in range(len(names))
            ]
        )
        left_over = (
            looked_up.select("_row", F.inline(sides).alias("_side", "_pairs"))
            .select("_row", "_side", F.posexplode("_pairs").alias("_pos", "_pair"))
            .where(F.col("_pair.id").isNull())
        )
        item = F.struct("_pos", "id")
        found = (
            left_over.select("_row", "_side", "_pos", F.col("_pair.word").alias("token"))
            .join(rare, "token")
            .groupBy("_row")
            .agg(*[F.collect_list(F.when(F.col("_side") == i, item)).alias(f"_rare{i}") for i in range(len(names))])
        )

        def whole(i: int) -> Column:
            numbered = F.transform(f"_ids{i}", lambda value, pos: F.struct(pos.alias("_pos"), value.alias("id")))
            known = F.filter(numbered, lambda x: x["id"].isNotNull())
            both = F.when(F.col(f"_rare{i}").isNull(), known).otherwise(F.concat(known, f"_rare{i}"))
            return F.transform(F.array_sort(both), lambda x: x["id"])

        joined = looked_up.join(found, "_row", "left").withColumns({name: whole(i) for i, name in enumerate(names)})
        return joined.select(*dict.fromkeys([*df.columns, *names]))

    def _frequent(self, used: DataFrame) -> Column:
        """Which words to broadcast: the most frequent, as many as are certain to fit."""
        order, words = ["_rank", "token"], max(1, self.broadcast_words)
        keys = OrderedKeys(used, order, unique=True)
        while True:
            last = keys.nth(words)
            chosen = F.lit(True) if last is None else up_to(used, order, last)
            size = used.where(chosen).agg(F.sum(F.octet_length("token"))).first()[0] or 0
            if size <= BROADCAST_BYTES or words == 1:
                return chosen
            words //= 2


def encode(
    df: DataFrame,
    vocab: DataFrame | Vocabulary,
    text_col: str = TEXT_FIELD,
    output: str = "input_ids",
    max_length: int | None = None,
) -> DataFrame:
    """Add the id array of one text column."""
    return _ready(vocab).encode(df, {text_col: output}, max_length)


def _ready(vocab: DataFrame | Vocabulary) -> Vocabulary:
    return vocab if isinstance(vocab, Vocabulary) else Vocabulary(vocab)


def encode_with(
    df: DataFrame,
    tokenize: Callable[[list[str]], list[list[int]]],
    text_col: str = TEXT_FIELD,
    output: str = "input_ids",
    max_length: int | None = None,
) -> DataFrame:
    """Add id arrays from a caller's own tokenizer, called with one Arrow batch of texts.

    ``tokenize`` must be picklable and gets whole texts, an empty one in place of NULL;
    ids are cut to ``max_length``.
    """

    @F.arrow_udf(IDS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([ids[:max_length] for ids in tokenize(texts.to_pylist())], type=pa.list_(pa.int32()))

    return df.withColumn(output, run(F.coalesce(F.col(text_col), F.lit(""))))


def attention_mask(ids: Column) -> Column:
    """All ones, as long as the ids."""
    return F.array_repeat(F.lit(1), F.size(ids))


def pad_or_eos(pad_id: int | None, eos_id: int) -> int:
    """The padding id: the end-of-text id where a vocabulary has none of its own."""
    return eos_id if pad_id is None else pad_id


def encode_pairs(
    df: DataFrame,
    vocab: DataFrame | Vocabulary,
    max_length: int | None = None,
    template: ChatTemplate | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Preference rows to ids and masks of both sides (plus the ``keep`` key columns)."""
    texts = pair_texts(df, template, keep)
    ids = _ready(vocab).encode(texts, {"text_j": "input_ids_j", "text_k": "input_ids_k"}, max_length)
    return ids.select(
        *keep,
        "input_ids_j",
        attention_mask(F.col("input_ids_j")).alias("attention_mask_j"),
        "input_ids_k",
        attention_mask(F.col("input_ids_k")).alias("attention_mask_k"),
    )


def encode_prompts(
    df: DataFrame,
    vocab: DataFrame | Vocabulary,
    max_length: int | None = None,
    template: ChatTemplate | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Prompt rows to the single column ``input_ids`` (plus the ``keep`` key columns)."""
    texts = prompt_texts(df, template, keep)
    return encode(texts, vocab, max_length=max_length).select(*keep, "input_ids")
