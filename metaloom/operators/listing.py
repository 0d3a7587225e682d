"""File listings as relations: for collections that are listed by a table, not by a walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.operators.resolve import glob_regex
from metaloom.sources.files import IGNORED


def filtered(listing: DataFrame, ext: list[str], exclude: list[str] = ()) -> DataFrame:
    """The walked files with a wanted extension, neither hidden nor excluded, before any content is read."""
    keep = F.lit(False)
    for e in ext:
        keep = keep | F.lower("file").endswith(f".{e.lower().lstrip('.')}")
    for glob in (*IGNORED, *exclude):
        keep = keep & ~F.col("file").rlike(glob_regex(glob))
    return listing.where(keep & ~F.col("file").rlike(r"(^|/)\.[^/]"))


def minus_ignored(walked: DataFrame, ignored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that stay, files that the ignore rules take), by file."""
    return walked.join(ignored.select("file"), "file", "left_anti"), walked.join(ignored.select("file").distinct(), "file", "left_semi")


def united(named: DataFrame, walked: DataFrame) -> DataFrame:
    """Every file once, with its place in order of name."""
    both = named.select("file").union(walked.select("file")).distinct()
    return both.orderBy("file")
