"""Language shares of whole texts by expectation-maximisation over n-gram likelihoods.

Each language's model is its frequency of letter trigrams (bytes of the UTF-8 text, A-Z
folded, everything between words as one space), hashed into a fixed table and counted
over all training rows. A document is a mixture: EM finds the languages' shares from the
likelihoods of its words, and the set of languages is the one of the nested sets (largest
shares first, up to all learned languages) with the best likelihood less a penalty per language.
EM runs for each document until its shares stand still.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0; so is
every text where nothing could be learned. Training rows with NULL lang or text do not count.
Rows are judged one by one, so repeated rows get the same answer; very long texts are
read whole, by the task that has them. A column that has the name of a new one gets underscores before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.llm.common import APPEND_BYTES, append_columns, free_name
from tuneprep.llm.words import LOWER, slices, text_bytes

SIZE = 1 << 16
PIECES = 8
SMOOTHING = 0.5
TOLERANCE, MOST_ROUNDS = 1e-3, 500  # EM stops when no share moves by more; the rounds only bound a text without an answer
PENALTY = 8.0
UNKNOWN = "und"
LEAST_SHARE = 0.5

# Byte classes: letters as they are, anything else below 128 is a gap.
LETTER = np.where((np.arange(256) >= 128) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 32).astype(np.uint8)


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams around every letter; where each word starts among them; each row's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    code = LETTER[data]
    before, after = np.empty_like(code), np.empty_like(code)
    before[1:], after[:-1] = code[:-1], code[1:]
    filled = bounds[:-1] < bounds[1:]
    before[bounds[:-1][filled]] = 32
    after[bounds[1:][filled] - 1] = 32
    letters = np.flatnonzero(code != 32)
    a, b, c = (x[letters].astype(np.uint32) for x in (before, code, after))
    key = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    grams = (key >> np.uint32(16)).astype(np.int64)
    starts = np.flatnonzero(a == 32)
    return grams, starts, np.searchsorted(letters[starts], bounds)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for cut in slices(batch, "text", APPEND_BYTES):
            data, bounds = text_bytes(cut.column("text"))
            grams, starts, first = trigrams(data, bounds)
            at = np.append(starts, len(grams))[first]
            for lang, a, b in zip(cut.column("lang").to_pylist(), at[:-1], at[1:], strict=True):
                counts = totals.setdefault(lang, np.zeros(SIZE, np.int64))
                counts += np.bincount(grams[a:b], minlength=SIZE) if b - a > SIZE // 4 else 0
                if b - a <= SIZE // 4:
                    np.add.at(counts, grams[a:b], 1)
    for lang, counts in totals.items():
        pieces = np.split(counts, PIECES)
        yield pa.RecordBatch.from_pydict(
            {"lang": [lang] * PIECES, "piece": list(range(PIECES)), "counts": [p.tobytes() for p in pieces]}
        )


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SIZE // PIECES, np.int64)
    for counts in rows["counts"]:
        total += np.frombuffer(counts, np.int64)
    return pd.DataFrame({"lang": rows["lang"][:1], "piece": rows["piece"][:1], "counts": [total.tobytes()]})


@dataclass
class LanguageModel:
    """Names of the learned languages and their log-frequencies, one row of the table per language."""

    names: list[str]
    table: np.ndarray


def learn_languages(docs: DataFrame) -> LanguageModel:
    """Count all rows' trigrams per ``lang``: one small row per task and piece, one model per language.

    The driver gets the finished tables, half a MB for each language.
    """
    schema = "lang string, piece long, counts binary"
    rows = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.mapInArrow(_count, schema).groupBy("lang", "piece").applyInPandas(_add, schema).toPandas()
    names = sorted(counted["lang"].unique())
    table = np.zeros((len(names), SIZE))
    for lang, piece, counts in zip(counted["lang"], counted["piece"], counted["counts"], strict=True):
        width = SIZE // PIECES
        table[names.index(lang), piece * width : (piece + 1) * width] = np.frombuffer(counts, np.int64)
    table = np.log((table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * SIZE))
    return LanguageModel(names, table.astype(np.float32))


def _climb(likelihood: np.ndarray, row: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM from given shares until each row's stand still: the shares, and the rows' log-likelihoods."""
    rows = len(share)
    words = np.bincount(row, minlength=rows)
    first = np.cumsum(words) - words
    result, active = share.copy(), np.arange(rows)
    part, at, starts, counts, now = likelihood, row, first, words, share
    for _ in range(MOST_ROUNDS):
        joint = part * now[at]
        joint /= joint.sum(axis=1)[:, None]
        new = np.add.reduceat(joint, starts, axis=0) / counts[:, None]
        moves = np.abs(new - now).max(axis=1) > TOLERANCE
        result[active], now = new, new
        if not moves.any():
            break
        if counts[moves].sum() < 0.7 * counts.sum():  # go on with the words of rows that still move
            part, counts, active, now = part[moves[at]], counts[moves], active[moves], new[moves]
            at = np.repeat(np.arange(len(active)), counts)
            starts = np.cumsum(counts) - counts
    return result, np.add.reduceat(np.log((likelihood * result[row]).sum(axis=1)), first)


def shares(likelihood: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language shares of every row (rows x languages) and how many languages the row has.

    ``likelihood`` holds words x languages, scaled to 1 for each word's best language;
    ``row`` is the row of each word, ``first`` the first word of each row; no row is empty.
    """
    rows, languages = len(first), likelihood.shape[1]
    words = np.bincount(row, minlength=rows)
    penalty = PENALTY * 0.5 * np.log(words + 1)  # for each further language
    share, whole = _climb(likelihood, row, np.full((rows, languages), 1 / languages))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    chosen, size = (rank == 0).astype(float), np.ones(rows, np.int64)
    best = np.add.reduceat(np.log(np.maximum(likelihood[np.arange(len(row)), rank.argmin(axis=1)[row]], 1e-300)), first)
    for k in range(2, languages + 1):
        # No set is likelier than all languages together, so most rows are settled.
        open_rows = np.flatnonzero(whole - (k - 1) * penalty > best - 1e-6)
        if not len(open_rows):
            break
        of_row = np.full(rows, -1)
        of_row[open_rows] = np.arange(len(open_rows))
        mine = of_row[row] >= 0
        start = np.where(rank[open_rows] < k, np.maximum(share[open_rows], 1e-3), 0)
        found, fitted = _climb(np.maximum(likelihood[mine], 1e-300), of_row[row[mine]], start / start.sum(axis=1)[:, None])
        gain = fitted - (k - 1) * penalty[open_rows]
        better = gain > best[open_rows]
        at = open_rows[better]
        best[at], chosen[at], size[at] = gain[better], found[better], k
    return chosen, size


LANGUAGES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def _predict(batch: pa.RecordBatch, text: str, names: list[str], model: np.ndarray, listed: bool) -> list[pa.Array]:
    column = batch.column(text)
    data, bounds = text_bytes(column)
    grams, starts, first = trigrams(data, bounds)
    lang = np.full(batch.num_rows, UNKNOWN, object)
    score = np.zeros(batch.num_rows)
    mixtures: list[list] = [[] for _ in range(batch.num_rows)]
    filled = np.flatnonzero(np.diff(first))
    if len(filled) and len(names):
        ascii_letters = (LETTER[data] != 32) & (data < 128)
        seen = np.append(0, np.cumsum(ascii_letters))[bounds]
        lettered = np.ones(batch.num_rows, bool)
        for i in filled[np.diff(seen)[filled] == 0]:
            lettered[i] = any(c.isalpha() for c in column[int(i)].as_py())
        logs = np.stack([np.add.reduceat(row[grams], starts) for row in model], axis=1)
        logs -= logs.max(axis=1, keepdims=True)
        row = np.repeat(np.arange(len(filled)), np.diff(first)[filled])
        share, size = shares(np.exp(np.maximum(logs, -60).astype(float)), row, first[:-1][filled])
        best = share.argmax(axis=1)
        lang[filled] = np.array(names, object)[best]
        score[filled] = np.minimum(share[np.arange(len(filled)), best], 1.0)
        lang[~lettered], score[~lettered] = UNKNOWN, 0.0
        for i, own, n in zip(filled.tolist(), share, size.tolist(), strict=True) if listed else ():
            order = np.argsort(-own, kind="stable")[:n]
            mixtures[i] = [{"lang": names[j], "share": float(own[j])} for j in order] if lettered[i] else []
    found = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
    return [*found, pa.array(mixtures, LANGUAGES)] if listed else found


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score"), mixture: str | None = None
) -> DataFrame:
    """All columns and, under ``names``, the language and its share of the text.

    ``mixture`` names a further column for the whole set of languages that was chosen: an array of (lang, share), largest first.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.table))
    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    if mixture is not None:
        part = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
        fields.append(T.StructField(mixture, T.ArrayType(part)))
    return append_columns(docs, text, fields, lambda batch: _predict(batch, text, *shared.value, mixture is not None))


def keep_identified(docs: DataFrame, model: LanguageModel, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows whose text has a language with at least ``least_share`` of it, with their own columns."""
    lang, share = free_name(docs, "lang_pred"), free_name(docs, "lang_share")
    found = identify(docs, model, names=(lang, share))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(share) >= least_share)).select(docs.columns)
