"""The corpus operators as queries over whole tables."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm import bpe
from tuneprep.llm.chat_tree import build_tree, read_tree
from tuneprep.llm.common import held_out
from tuneprep.llm.decontaminate import contaminated
from tuneprep.llm.hard_negatives import mine
from tuneprep.llm.language import identify, learn_languages
from tuneprep.llm.mixing import document_rates
from tuneprep.llm.near_dedup import near_duplicates
from tuneprep.llm.neighbours import search
from tuneprep.llm.quality import learn_quality, score_quality
from tuneprep.llm.repeats import remove_repeats
from tuneprep.llm.resampling import resample
from tuneprep.llm.token_ids import tokenized
from tuneprep.llm.warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers unless they find it themselves (as with ``--py-files``)."""
    root = Path(__file__).resolve().parents[2]
    found = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if root not in found and not any(p.endswith("/tuneprep.zip") for p in spark.sparkContext.listFiles):
        packed = shutil.make_archive(f"{tempfile.mkdtemp()}/tuneprep", "zip", root, "tuneprep")
        spark.sparkContext.addPyFile(packed)


def query(function):
    @functools.wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_token_ids(spark, sf_dir):
    return tokenized(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    model = learn_languages(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), model).drop("text")


@query
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    weights = learn_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, weights).drop("text")


@query
def op1_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Target weights over the domains that the labels define; toxic documents may be thinned.
MIXTURE = {"good": 0.85, "plain": 0.13, "toxic": 0.02}
THIN = ("toxic",)


def domain_labels(spark, sf_dir):
    named = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return table(spark, sf_dir, "labels").select("doc_id", named.alias("domain"))


@query
def op4_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return document_rates(docs, domain_labels(spark, sf_dir), MIXTURE, THIN)[0]


@query
def op6_warc(spark, sf_dir):
    return archived(table(spark, sf_dir, "pages"))


PROBE = "</s>[INST] ok [/INST]"


@query
def op10_chat_tree(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_tree(*build_tree(given.unionByName(probe), TOKENIZER))


@query
def op2_learned_partitions(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))


@query
def op3_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query
def op9_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_bpe_chunks(spark, sf_dir):
    rule = bpe.rules(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf_dir, "documents"), rule)


@query
def op13_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


SQL["op12_hard_negatives"] = """
WITH numbered AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM numbered a JOIN numbered r ON a.vec_id <> r.vec_id
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 5
"""


# CRC-32 byte by byte, over the bytes of the feature's hexadecimal form.
SQL["op13_importance_resampling"] = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, true AS corpus, text FROM documents
    UNION ALL SELECT NULL, NULL, false, text FROM benchmark
),
words AS (
    SELECT * EXCLUDE (text), regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
),
features AS (
    SELECT r, corpus, unnest(list_concat(w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
    FROM words
),
counted AS (SELECT feature, r, corpus, count(*) AS n FROM features GROUP BY ALL),
steps AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM range(256) x(i)
),
spelled AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)),
bucketed AS (
    SELECT feature, xor(4294967295, list_reduce(
        list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) % 10000 AS bucket
    FROM spelled, steps
),
totals AS (
    SELECT bucket, coalesce(sum(n) FILTER (corpus), 0) AS s, coalesce(sum(n) FILTER (NOT corpus), 0) AS t
    FROM counted JOIN bucketed USING (feature) GROUP BY bucket
),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
    FROM totals
),
weights AS (
    SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features
    FROM counted JOIN bucketed USING (feature) JOIN gains USING (bucket) WHERE corpus GROUP BY r
),
scored AS (
    SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM words LEFT JOIN weights USING (r) WHERE corpus
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS all_able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * all_able // 100 THEN place END AS rank FROM placed
"""


# A set's class stands for all documents with that set; links between classes are confirmed on whole sets.
SQL["op3_near_duplicates"] = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s
    FROM words
),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE doc_id IS NOT NULL AND len(s) > 0 GROUP BY s),
members AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
links AS (
    SELECT a.rep AS a, b.rep AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.rep <> b.rep
    GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
),
reached(rep, other) AS (
    SELECT rep, rep FROM classes
    UNION SELECT reached.rep, links.b FROM reached JOIN links ON links.a = reached.other
),
smallest AS (SELECT rep, min(other) AS component FROM reached GROUP BY rep),
found AS (
    SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, CASE WHEN t.doc_id IS NULL THEN NULL ELSE coalesce(component, t.doc_id) END AS component_id
    FROM sets t LEFT JOIN classes c ON c.s = t.s LEFT JOIN smallest USING (rep)
)
SELECT *, coalesce(doc_id = component_id, true) AS kept FROM found
"""


# Five hexadecimal digits are four letters of base 32.
SQL["op6_warc"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM payloads)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


SQL["op9_repeats"] = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
    SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i,
        unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS key
    FROM texts WHERE doc_id IS NOT NULL
),
sources AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS source FROM windows),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM sources WHERE source < doc_id),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM texts),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) FILTER (c.i IS NULL) AS rest, count(c.i) AS n_removed
    FROM words LEFT JOIN covered c USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""


# A control string and a backslash each get one more character when they are escaped.
SQL["op10_chat_tree"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\\')) AS body,
        length(role) + len(regexp_extract_all(role, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\\|\n')) AS head
    FROM turns
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE head + 16 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
