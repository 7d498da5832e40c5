"""Where a row stands in its file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_order() -> Column:
    """A struct that sorts rows by file and by place within the file.

    The last field grows within a task, and a task reads the blocks of a file
    whole, so the three fields together follow the order of the lines.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
