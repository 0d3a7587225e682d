"""DataFrame extraction: documents in, metadata objects with positions out.

``documents`` is (file, content) with an optional ``ord``; the result adds format, present,
``data_json`` (the object in document order), ``lines`` and ``cols`` (pointer to position) and
``error``.  One narrow stage of Arrow batches; Catalyst prunes the columns that aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.values import dump

from .extractors import EXTRACTORS, ExtractError, Extractor, by_extension

SCHEMA = "format string, present boolean, data_json string, lines map<string,int>, cols map<string,int>, error string"

#: Whether front matter in JSON opens a text, and what stands in it: the part that stays in the JVM.
JSON_FENCE = r"^\uFEFF?;;;\r?\n([\s\S]*?)\r?\n?;;;[ \t]*(?:\r?\n|$)"

#: Rows of which a worker holds the objects at once; Arrow batches are larger.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``SLICE`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def extension(file: Column) -> Column:
    """The lower-cased extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file, r"(\.[^./\\]+)$", 1))


def format_of(file: Column, forced: str | None = None, extractors: dict[str, Extractor] | None = None) -> Column:
    """The format a file is read as; null for an unknown extension."""
    if forced is not None:
        if forced not in (extractors or EXTRACTORS):
            raise ValueError(f"unknown format {forced!r}; supported: {', '.join(extractors or EXTRACTORS)}")
        return F.lit(forced)
    known = by_extension(extractors)
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[extension(file)]


def extract_text(content: str, name: str, file: str | None, extractors: dict[str, Extractor] | None = None) -> dict:
    """The columns of one document."""
    try:
        found = (extractors or EXTRACTORS)[name].extract(content, file)
    except ExtractError as e:
        return {"format": name, "present": False, "data_json": "{}", "lines": {}, "cols": {}, "error": str(e)}
    return {"format": name, "present": found.present, "data_json": dump(found.data, moments=True), "lines": found.lines, "cols": found.cols, "error": None}


def extract_row(file: str, content: str, name: str | None, extractors: dict[str, Extractor] | None = None) -> dict:
    """``extract_text``, or an error if no format is known."""
    if name is None:
        return {"format": None, "present": False, "data_json": "{}", "lines": {}, "cols": {}, "error": f"no extractor for {file}"}
    return extract_text(content, name, file, extractors)


def inputs(documents: DataFrame, forced: str | None, extractors: dict[str, Extractor] | None, keep: tuple[str, ...]) -> DataFrame:
    """file, text, the format it is read as, and the columns of ``keep``."""
    return documents.select("file", F.coalesce("content", F.lit("")).alias("_text"), format_of(F.col("file"), forced, extractors).alias("_as"), *keep)


def extract(documents: DataFrame, forced: str | None = None, extractors: dict[str, Extractor] | None = None, on_error: str = "column", keep: tuple[str, ...] = ()) -> DataFrame:
    """file, the columns of ``SCHEMA`` and those of ``keep``.

    ``on_error`` "column" puts a block that can't be read, or an unknown format, in
    ``error``; "raise" ends the run with it.
    """
    rows = inputs(documents, forced, extractors, keep)
    names = ("format", "present", "data_json", "lines", "cols", "error")
    kinds = (pa.string(), pa.bool_(), pa.string(), pa.map_(pa.string(), pa.int32()), pa.map_(pa.string(), pa.int32()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[str, list] = {n: [] for n in names}
            for file, content, name in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row = extract_row(file, content, name, extractors)
                if row["error"] is not None and on_error == "raise":
                    raise ValueError(f"{file}: {row['error']}")
                for n in names:
                    found[n].append(list(row[n].items()) if n in ("lines", "cols") else row[n])
            arrays = [pa.array(found[n], k) for n, k in zip(names, kinds)]
            kept = [batch.column(i) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, *arrays], ["file", *batch.schema.names[3:], *names])

    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    return rows.mapInArrow(run, f"file string{kept}, {SCHEMA}")


def json_front_matter(content: Column) -> Column:
    """The JSON object of a ``;;;`` block as a VARIANT, in the JVM; null if there is none or it can't be read.

    The fast path for corpora whose metadata is JSON: no Python, and inside code
    generation.  ``extract`` gives positions and errors as well.
    """
    inner = F.regexp_extract(content, JSON_FENCE, 1)
    return F.when(content.rlike(JSON_FENCE), F.try_parse_json(F.when(F.trim(inner) == "", F.lit("{}")).otherwise(inner)))


def capabilities() -> list[tuple[str, str, bool]]:
    """(name, extensions, writable) of each format."""
    from .writers import WRITERS

    return [(e.name, ",".join(e.extensions), e.name in WRITERS) for e in EXTRACTORS.values()]
