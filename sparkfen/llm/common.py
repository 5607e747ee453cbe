"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words, besides the blank.
BLANKS = ("\t", "\n", "\x0b", "\x0c", "\r")


def spaced(text: Column) -> Column:
    """The text with every white-space character a blank; a missing text is empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return out


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, as an array."""
    return F.array_remove(F.split(spaced(text), " "), "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a plain reuse would be evaluated anew inside each lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


_HELD: dict = {}


def held(owner: str, key: object, make: Callable[[], object]) -> object:
    """The one large cache of this worker process, made anew where another operator, or key, had it before.

    Workers serve many stages one after the other; so their memory is that of the largest cache, not of all.
    """
    if _HELD.get("key") != (owner, key):
        _HELD.clear()
        _HELD.update(value=make(), key=(owner, key))
    return _HELD["value"]


def annotate(
    df: DataFrame,
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[[pa.RecordBatch], list]],
) -> DataFrame:
    """df with new columns that a Python function makes from each Arrow batch.

    start() runs once in each task and returns the function, which gets a batch of all columns and returns an array
    for each field. Columns of df that have a field's name are replaced. There is no shuffle.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    base = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*base.schema.fields, *fields])
    types = [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            made = [pa.array(x, type=t) if not isinstance(x, pa.Array) else x for x, t in zip(work(batch), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)
            del batch, made
        pa.default_memory_pool().release_unused()

    return base.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type of the Spark types used here."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind.simpleString()]


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text of a column."""
    return column.cast(pa.binary()).to_pylist()
