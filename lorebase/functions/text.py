"""String expressions shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only, as a byte-wise LIKE does; É and other letters stay distinct."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def like_prefix(c: Column, prefix: str) -> Column:
    """``c LIKE prefix || '%'`` without an escape character and ASCII-case-insensitive.

    ``%`` and ``_`` inside the prefix act as wildcards; a backslash is an ordinary character.
    """
    folded = prefix.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return ascii_lower(c).like(folded.replace("\\", "\\\\") + "%")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)
