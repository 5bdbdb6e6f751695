"""Model reply handling as column expressions.

JSON is read in two lanes. The JVM lane (``whole_json``) takes texts that are
one JSON value by the strict grammar, where both readers agree. What it leaves
(duplicate keys, NaN and the infinities, escapes of lone surrogates, and texts
that are not JSON at all) goes to the exact lane, an Arrow-batched UDF over
Python's ``json.loads``, which is how the service reads; it gets nulls for all
other rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver import schemas as S
from palaver.functions.text import strip

# Reply cleaning patterns (any-case "json"/"jso" after an
# optional fence, then white space; a closing fence at the very end).
_LEADING_FENCE = r"(?iU)^(```)?json?\s*"
_TRAILING_FENCE = r"```$"
_BARE_FENCE = r"(?U)^```\s*"


def join_choices(choices: Column) -> Column:
    """Every choice preceded by one space; an empty list gives ''."""
    return F.array_join(F.transform(choices, lambda c: F.concat(F.lit(" "), c)), "")


def clean_reply(raw: Column, strip_bare_fence: bool = False) -> Column:
    """P5: strip, drop a leading (fence +) json/jso tag, drop a closing fence."""
    s = F.regexp_replace(strip(raw), _LEADING_FENCE, "")
    if strip_bare_fence:
        s = F.regexp_replace(s, _BARE_FENCE, "")
    return F.regexp_replace(s, _TRAILING_FENCE, "")


def guarded(s: Column) -> Column:
    """A text as the first of two entries of a parsed array, the second being a hash of the text; see ``whole_json``."""
    return F.try_parse_json(F.concat(F.lit("["), s, F.lit(","), F.xxhash64(s).cast("string"), F.lit("]")))


def unguarded(pair: Column, s: Column) -> Column:
    whole = (F.try_variant_get(pair, "$[1]", "bigint") == F.xxhash64(s)) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def whole_json(s: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null for any other.

    The SQL parser stops after the first value, so the text is read with a hash of
    itself behind it: only a text that is a whole value leaves exactly these two.
    """
    return unguarded(guarded(s), s)


def has_surrogate_escape(s: Column) -> Column:
    """Whether a text may hold half of a surrogate pair, which UTF-8 cannot write."""
    return F.contains(s, F.lit("\\u")) & s.rlike(r"\\u[dD][89a-fA-F]")


def is_json_sql(s: Column) -> Column:
    """P6, SQL mode: the text is one whole JSON value by the strict grammar."""
    return F.coalesce(whole_json(s).isNotNull(), F.lit(False))


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """P6, exact lane: what Python's JSON reader makes of a text, written again; null if it refuses.

    The last of two equal keys wins, as it does there. NaN and the infinities,
    which Python reads and JSON cannot write, become a number out of any
    accepted range; so do integers beyond a double. Half a surrogate pair, which
    no text column can hold, becomes U+FFFD.
    """
    def text(x):
        return x if x.isascii() else x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    def plain(x):
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return 1e300
        if isinstance(x, int) and not isinstance(x, bool) and abs(x) > 10 ** 300:
            return 1e300 if x > 0 else -1e300
        if isinstance(x, str):
            return text(x)
        if isinstance(x, dict):
            return {text(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    def again(x):
        if x is None:
            return None
        try:
            return json.dumps(plain(json.loads(x)))
        except (ValueError, RecursionError):
            return None
    return s.map(again).astype(object)


def _is_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def metadata_keys(cleaned: Column) -> Column:
    """Top-level keys of a JSON object reply; null when it is not an object."""
    v = F.try_parse_json(cleaned)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.json_object_keys(cleaned))


def missing_fields(cleaned: Column) -> Column:
    """Sorted required fields absent from the object (null for non-objects)."""
    required = F.array(*[F.lit(f) for f in S.REQUIRED_METADATA_FIELDS])
    return F.array_sort(F.array_except(required, metadata_keys(cleaned)))


def conversation_type(v: Column) -> Column:
    return F.try_variant_get(v, "$.conversation_type", "string")


def topic_codes(v: Column) -> Column:
    """E3 per topic: 0 ok, 1 bad structure, 2 score out of range, 3 score not a number.

    Null when ``topics`` is not an array.
    """
    topics = F.try_variant_get(v, "$.topics", "array<variant>")

    def code(t):
        is_obj = F.schema_of_variant(t).startswith("OBJECT")
        name = F.try_variant_get(t, "$.name", "variant")
        score = F.try_variant_get(t, "$.confidence_score", "variant")
        num = F.try_variant_get(t, "$.confidence_score", "double")
        return (F.when(~F.coalesce(is_obj, F.lit(False)) | name.isNull() | score.isNull(), F.lit(1))
                .when(~_is_number(score), F.lit(3))
                .when((num < 0) | (num > 1), F.lit(2))
                .otherwise(F.lit(0)))
    return F.transform(topics, code)


def first_topic_problem(v: Column) -> Column:
    """First non-zero topic code (null when all topics pass)."""
    return F.try_element_at(F.filter(topic_codes(v), lambda c: c > 0), F.lit(1))
