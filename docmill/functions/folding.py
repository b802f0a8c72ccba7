"""Case folding of terms: each character's own upper case, never longer than one character and never by locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(value: Column) -> Column:
    """A key that is equal for values that differ in case only.

    ASCII values take the fast path.  Elsewhere a character stays as it is where its upper case has several characters (such as
    sharp s) and for the dotless i, so that folding never joins values of different lengths.
    """
    one = F.transform(F.split(value, ""), lambda c: F.when((c == "ı") | (F.length(F.upper(c)) != 1), c).otherwise(F.upper(c)))
    return F.when(F.octet_length(value) == F.length(value), F.upper(value)).otherwise(F.array_join(one, ""))
