"""URL parsing as column expressions.

``try_parse_url`` is not used: the admission rules need the scheme and the
path of strings that are not valid URLs too, so the parts are cut with
regular expressions that never raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# path = after "scheme://authority", up to the query or fragment
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_PARAMS = r";[^/]*$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def path(url: Column) -> Column:
    """Without query, fragment and the ``;parameters`` of the last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), _PARAMS, "")


def extension(url_path: Column) -> Column:
    """Lower-cased path from its last dot; the last character when no dot."""
    low = F.lower(url_path)
    return (F.when(url_path.contains("."), F.regexp_extract(low, r"([.][^.]*)$", 1))
            .otherwise(F.substring(low, -1, 1)))
