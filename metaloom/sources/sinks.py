"""Writing files: atomically, one at a time, on the machines that hold them."""

from __future__ import annotations

import os
import stat
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from metaloom.sources.files import git_ignored


def write_atomic(path: str, text: str, tries: int = 3) -> None:
    """The file as a whole or not at all; its mode stays."""
    temporary = os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path)}.{uuid.uuid4().hex[:8]}")
    try:
        with open(temporary, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        if os.path.exists(path):
            os.chmod(temporary, stat.S_IMODE(os.stat(path).st_mode))
        for left in range(tries - 1, -1, -1):
            try:
                os.replace(temporary, path)
                return
            except PermissionError:
                if not left:
                    raise
                time.sleep(0.05)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_files(changed: DataFrame, base: str) -> DataFrame:
    """file, error after the (file, content) rows are written under ``base``; a write may be tried again without harm."""
    root = os.path.abspath(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    write_atomic(os.path.join(root, file), content)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], ["file", "error"])

    return changed.select("file", "content").mapInArrow(run, "file string, error string")


def refuse_target(path: str, cwd: str, force: bool = False) -> None:
    """A new file must neither be there already nor be one that git ignores."""
    full = os.path.join(cwd, path)
    if os.path.exists(full) and not force:
        raise FileExistsError(f"{path} exists already")
    folder = os.path.dirname(full) or "."
    if os.path.isdir(folder) and git_ignored([os.path.basename(full)], folder):
        raise ValueError(f"{path} is ignored by git, so nobody else would have it")
