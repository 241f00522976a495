"""What several operators share: words, the held-out fold, samples chosen by a hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.operators.marks import likely
from quillspark.storage import new_path, release, remove, table, written

__all__ = ["WORD", "held_out", "likely", "new_path", "release", "remove", "sampled", "table", "written"]

#: Words are what space, and tab to carriage return, separate.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def sampled(key: Column, rate: float) -> Column:
    """The same share of rows at every run, chosen by a hash of the key."""
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) < int(min(1.0, rate) * (1 << 30))
