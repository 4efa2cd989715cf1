"""Small column helpers; the shared folder comes from ``heddle.plans.stored``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.plans.stored import drop_path, drop_table, fresh_path, shared_root, small_batches, written

__all__ = ["drop_path", "drop_table", "fresh_path", "md5_uint60", "shared_root", "small_batches", "written"]


def md5_uint60(*parts: Column | str) -> Column:
    """A hash that other SQL engines can repeat: the first 15 hex digits of the MD5 of
    the parts, joined by ``:``, as a non-negative integer."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")
