"""JSON text as a script reads it, by Arrow batches: the last of repeated keys counts, and errors have a place."""

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get the function with the query, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A string, or a word that is a number for Python's reader but not in JSON.
_STRING_OR_WORD = re.compile(r'"(?:[^"\\]|\\.)*"|(NaN|-?Infinity)', re.S)
# Digits beyond which a whole number is read as a floating one, as no exact type holds it.
_MOST_DIGITS = 300


class _Word(ValueError):
    pass


def _word(name):
    raise _Word(name)


def _beyond(found):
    """A number beyond floating ones stays a number."""
    return found[1].replace("Infinity", "1e999") if found[1] else found[0]


def _whole_number(digits):
    return int(digits) if len(digits) <= _MOST_DIGITS else float(digits)


def read_text(text: str) -> tuple[str | None, int | None]:
    """(text with each key once, None), or (None, place of the error in code points)."""
    repeated = False

    def unique(pairs):
        nonlocal repeated
        found = dict(pairs)  # the last value, at the place of the first
        repeated = repeated or len(found) < len(pairs)
        return found

    try:
        value = json.loads(text, object_pairs_hook=unique, parse_constant=_word, parse_int=_whole_number)
    except json.JSONDecodeError as error:
        return None, error.pos
    except _Word:
        return None, next(m.start(1) for m in _STRING_OR_WORD.finditer(text) if m[1])
    except RecursionError:
        return None, 0
    return (text if not repeated else _STRING_OR_WORD.sub(_beyond, json.dumps(value))), None


@F.arrow_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error_at", T.IntegerType())]))
def read_json_text(texts: pa.Array) -> pa.Array:
    """Struct of `read_text`; null for null."""
    read = [None if t is None else dict(zip(("json", "error_at"), read_text(t))) for t in texts.to_pylist()]
    return pa.array(read, pa.struct([("json", pa.string()), ("error_at", pa.int32())]))
