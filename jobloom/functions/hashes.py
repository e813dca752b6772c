"""Content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.common import col
from jobloom.functions.text import squeeze


# what does not count as content (fixed values)
LEFT_OUT = (r"(?i)<script[^>]*>[\s\S]*?</script>", r"(?i)<style[^>]*>[\s\S]*?</style>", r"<!--[\s\S]*?-->")


def cleaned(content: Column | str) -> Column:
    """Content without scripts, styles, comments and extra space."""
    out = col(content)
    for pattern in LEFT_OUT:
        out = F.regexp_replace(out, pattern, "")
    return squeeze(out)


def content(url: Column | str, text: Column | str) -> Column:
    """SHA-256 of the URL without query and fragment plus the cleaned content."""
    return F.sha2(F.concat(F.regexp_extract(col(url), r"^[^?#]*", 0), cleaned(text)), 256)


def simple(text: Column | str, clean: bool = False) -> Column:
    return F.sha2(cleaned(text) if clean else col(text), 256)


def is_sha256(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike("(?i)^[a-f0-9]{64}$"), F.lit(False))


def key(prefix: str, value: Column | str) -> Column:
    """``prefix:hash``, or null for something that is no hash."""
    return F.when(is_sha256(value), F.concat(F.lit(prefix + ":"), col(value)))
