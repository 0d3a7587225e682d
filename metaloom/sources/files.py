"""Document files as a DataFrame: named files, directory walks, globs, ignore rules, standard input."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators.resolve import glob_regex

IGNORED = ("**/node_modules/**", "**/.git/**")
SCHEMA = "file string, content string, named boolean, ord long"


class InputError(ValueError):
    """Nothing to read, or a name that isn't there."""


def is_glob(name: str) -> bool:
    return any(c in name for c in "*?[{") or name.startswith("!")


def posix(path: str) -> str:
    return path.replace(os.sep, "/")


@dataclass
class Targets:
    """The files of a run, as labels relative to its base, in code-unit order."""

    named: list[str] = field(default_factory=list)
    walked: list[str] = field(default_factory=list)
    gitignore_skipped: int = 0
    gitignore_answered: bool = False

    @property
    def all(self) -> list[str]:
        return sorted({*self.named, *self.walked}, key=lambda x: x.encode("utf-16-be", "surrogatepass"))


def _extensions(ext: list[str]) -> tuple[str, ...]:
    return tuple(f".{e.lower().lstrip('.')}" for e in ext)


def git_ignored(labels: list[str], base: str) -> set[str] | None:
    """Those of the labels that git ignores, by one subprocess; None if git can't tell."""
    if not labels:
        return set()
    try:
        done = subprocess.run(["git", "check-ignore", "--stdin", "-z"], cwd=base, input="\0".join(labels).encode() + b"\0", capture_output=True, check=False)
    except OSError:
        return None
    if done.returncode not in (0, 1):
        return None
    return {x for x in done.stdout.decode("utf-8", "surrogateescape").split("\0") if x}


def find(inputs: list[str], ext: list[str], base: str = ".", exclude: list[str] = (), gitignore: bool = True, allow_empty: bool = False) -> Targets:
    """Named files stay whatever their extension or the ignore rules; walks and globs obey both."""
    ignore = [re.compile(glob_regex(g)) for g in (*IGNORED, *exclude)]
    wanted = _extensions(ext)
    out, missing = Targets(), []

    def fits(label: str) -> bool:
        hidden = any(part.startswith(".") and part not in (".", "..") for part in label.split("/"))
        return not hidden and label.lower().endswith(wanted) and not any(r.search(label) or r.search("./" + label) for r in ignore)

    def walk(folder: str) -> list[str]:
        found = []
        for where, folders, files in os.walk(os.path.join(base, folder)):
            folders[:] = sorted(d for d in folders if not d.startswith(".") and d != "node_modules")
            found += [posix(os.path.relpath(os.path.join(where, f), base)) for f in sorted(files)]
        return found

    for name in inputs:
        full = os.path.join(base, name)
        if os.path.isfile(full):
            out.named.append(posix(os.path.relpath(full, base)))
        elif os.path.isdir(full):
            out.walked += [f for f in walk(name) if fits(f)]
        elif is_glob(name):
            pattern = re.compile(glob_regex(posix(os.path.normpath(name))))
            start = posix(os.path.normpath(name)).split("/")
            root = "/".join(start[: next((i for i, part in enumerate(start) if is_glob(part)), 0)])
            out.walked += [f for f in walk(root or ".") if pattern.search(f) and fits(f)]
        else:
            missing.append(name)
    if missing and not allow_empty:
        raise InputError(f"no such file or directory: {', '.join(missing)}")
    out.walked = sorted(set(out.walked) - set(out.named))
    if gitignore and out.walked:
        ignored = git_ignored(out.walked, base)
        if ignored is not None:
            out.gitignore_answered = True
            out.gitignore_skipped = len(ignored)
            out.walked = [f for f in out.walked if f not in ignored]
    if not out.all and not allow_empty:
        raise InputError(f"no files match {', '.join(inputs)} with extensions {', '.join(wanted)}" + (f", excluding {', '.join(exclude)}" if exclude else ""))
    return out


def read(spark: SparkSession, targets: Targets, base: str = ".") -> DataFrame:
    """file, content, named, ord; the contents are read by the executors, in parallel.

    The files must lie where the executors see them.
    """
    named = set(targets.named)
    rows = [(f, f in named, i) for i, f in enumerate(targets.all)]
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    root = os.path.abspath(base)
    files = spark.createDataFrame(rows, "file string, named boolean, ord long").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))

    @F.pandas_udf("string")
    def content(labels):
        def one(label: str) -> str:
            with open(os.path.join(root, label), encoding="utf-8", errors="replace", newline="") as f:
                return f.read()

        return labels.map(one)

    return files.select("file", content("file").alias("content"), "named", "ord")


def read_folder(spark: SparkSession, path: str, ext: list[str], exclude: list[str] = ()) -> DataFrame:
    """file, content, named, ord of a folder on any file system that Spark reads, listed and filtered by Spark.

    For collections too large to list on the driver: names are filtered in the plan,
    before contents are used, and no order is settled.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    label = F.regexp_replace(F.try_url_decode(F.col("path")), r"^file:/*", "/")
    root = re.sub(r"^file:/*", "/", path if "://" in path else os.path.abspath(path)).rstrip("/") + "/"
    below = F.when(label.startswith(root), F.substr(label, F.lit(len(root) + 1))).otherwise(label)
    keep = F.lit(False)
    for e in _extensions(ext):
        keep = keep | F.lower("path").endswith(e)
    for g in (*IGNORED, *exclude):
        keep = keep & ~below.rlike(glob_regex(g))
    return rows.where(keep & ~below.rlike(r"(^|/)\.[^/]")).select(label.alias("file"), "content", F.lit(False).alias("named"), F.xxhash64("path").alias("ord"))


def standard_input(spark: SparkSession, content: str) -> DataFrame:
    """Standard input as a document ahead of all others; its format must be forced."""
    return spark.createDataFrame([("<stdin>", content, True, -1)], SCHEMA)


def respect_gitignore(flag: bool | None, config: bool | None) -> tuple[bool, bool]:
    """(whether ignore rules hold, whether a notice is due if git can't tell)."""
    if flag is not None:
        return flag, flag
    return (True if config is None else config), bool(config)
