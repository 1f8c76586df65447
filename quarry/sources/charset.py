"""Text from bytes of a named charset."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_ERRORS = 20
#: What the handler below leaves where bytes made no character: one for a run of them.
RUN = re.compile("\ufffe+")


def to_utf8(data: bytes, charset: str = "") -> str:
    """The text of the bytes: a ? for each run that isn't valid. Beyond MAX_ERRORS invalid bytes in a charset other than
    UTF-8 the bytes are taken as UTF-8 after all. Unknown charsets are tried with hyphens for underscores."""
    name = charset.strip().lower() or "utf-8"
    try:
        codecs.lookup(name)
    except LookupError:
        name = name.replace("_", "-")
        try:
            codecs.lookup(name)
        except LookupError:
            name = "utf-8"
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        pass
    except (ValueError, LookupError):
        return data.decode("utf-8", "replace")
    errors = 0

    def skip(e: UnicodeError):
        nonlocal errors
        errors += e.end - e.start
        return "\ufffe", e.end

    codecs.register_error("quarry-skip", skip)
    text = data.decode(name, "quarry-skip")
    if errors >= MAX_ERRORS and name not in ("utf-8", "utf8"):
        return data.decode("utf-8", "replace")
    return RUN.sub("?", text)


@F.pandas_udf(StringType())
def decoded(data: pd.Series, charset: pd.Series) -> pd.Series:
    """Columns of bytes and of charsets to text; null bytes stay null."""
    return pd.Series([None if d is None else to_utf8(bytes(d), c or "") for d, c in zip(data, charset)], dtype=object)
