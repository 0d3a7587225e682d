"""Named end-to-end queries over the metadata operators, with DuckDB SQL for the same rows.

The tables of the driver hold no documents with metadata blocks, so queries render
them from columns, extract them again and go on from there; the SQL works on the
columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .extraction import ORACLES as EXTRACTION_SQL
from .extraction import QUERIES as EXTRACTION
from .governance import ORACLES as GOVERNANCE_SQL
from .governance import QUERIES as GOVERNANCE
from .governance import flagship
from .profiling import ORACLES as PROFILING_SQL
from .profiling import QUERIES as PROFILING
from .reporting import ORACLES as REPORTING_SQL
from .reporting import QUERIES as REPORTING
from .scalars import ORACLES as SCALARS_SQL
from .scalars import QUERIES as SCALARS
from .shapes import ORACLES as SHAPES_SQL
from .shapes import QUERIES as SHAPES
from .vocabulary import ORACLES as VOCABULARY_SQL
from .vocabulary import QUERIES as VOCABULARY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**EXTRACTION, **GOVERNANCE, **PROFILING, **REPORTING, **SCALARS, **SHAPES, **VOCABULARY}
ORACLE_SQL: dict[str, str] = {**EXTRACTION_SQL, **GOVERNANCE_SQL, **PROFILING_SQL, **REPORTING_SQL, **SCALARS_SQL, **SHAPES_SQL, **VOCABULARY_SQL}

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
