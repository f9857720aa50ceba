"""Column functions that reproduce Python text semantics with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: what separates the words of a text.
WORD_SEPARATOR = r"[ \t\n\r\f\x0B]+"


def none_str(value: Column, dtype: T.DataType | None = None) -> Column:
    """``str(value)``: NULL becomes the text ``None``.

    Spark and Python print booleans, floats and nested values differently, so a
    known type other than text or a whole number is refused, booleans aside.
    """
    if isinstance(dtype, T.BooleanType):
        value = F.when(value, "True").when(~value, "False")
    elif dtype is not None and not isinstance(dtype, (T.StringType, T.IntegralType, T.NullType)):
        raise TypeError(f"A text field must be a string, not {dtype.simpleString()}.")
    return F.coalesce(value.cast("string"), F.lit("None"))


def py_strip(value: Column) -> Column:
    """``str.strip()``, Unicode whitespace included."""
    return F.btrim(value, F.lit(PYTHON_WHITESPACE))


def py_capitalize(value: Column) -> Column:
    """``str.capitalize()``: first character in title case (upper, digraphs aside), all others lower."""
    return F.concat(F.initcap(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2))))


def qa_text(question: Column, answer: Column) -> Column:
    """The plain prompt/response text. Both sides must already be text, never NULL."""
    return F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer: "), answer)


def prompt_text(prompt: Column) -> Column:
    """The plain prompt that a policy continues; the last space is part of it."""
    return F.concat(F.lit("Question: "), prompt, F.lit("\n\nAnswer: "))


def csv_list(value: Column) -> Column:
    """Comma-separated text to an array of stripped non-empty items; NULL if none is left."""
    items = F.filter(F.transform(F.split(value, ","), py_strip), lambda item: item != "")
    return F.when(F.size(items) > 0, items)


def word_tokens(text: Column, max_length: int | None = None) -> Column:
    """Whitespace-separated words, the first ``max_length`` of them; NULL text has none.

    The cut happens before anything is exploded or sent anywhere: splitting stops
    once enough pieces exist (one for a leading empty piece, one for the rest).
    """
    text = F.coalesce(text, F.lit(""))
    if max_length is None:
        return F.array_remove(F.split(text, WORD_SEPARATOR), "")
    pieces = F.slice(F.split(text, WORD_SEPARATOR, max_length + 2), 1, max_length + 1)
    return F.slice(F.array_remove(pieces, ""), 1, max_length)
