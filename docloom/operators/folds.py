"""Folds over small groups (a page, a document), many groups to an Arrow batch.

A group is collected to one row of ordered arrays; the fold is a plain function of that row. A group a pandas frame, as
grouped maps have it, costs more than most of these folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def collected(rows: DataFrame, keys: list[str], order: list[str], columns: list[str | Column], name: str) -> DataFrame:
    """One row a group: keys, and name, an array of its rows in order, each a struct of order and columns."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias(name))


def folded(groups: DataFrame, function: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that function yields for each row of groups, given as a dictionary of plain Python values."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    made = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for group in batch.to_pylist() for row in function(group)]
            columns = list(zip(*out)) if out else [()] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, made)], schema=made)

    return groups.mapInArrow(run, kind)
