"""Small tables and plain-Python versions for the corpus operators."""

import random

from pyspark.sql import functions as F

WORDS = [f"{a}{b}{c}" for a in "bdklmnrst" for b in "aeiou" for c in "nrst"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def frame(spark, rows, schema="doc_id long, text string"):
    """A table with further columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, schema)
    extra = {c: F.lit(7) for c in ("rate", "tokens", "rep", "value", "chunk", "part", "path", "component", "copy", "run", "a", "u")}
    return df.withColumns({k: v for k, v in extra.items() if k not in df.columns})


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
