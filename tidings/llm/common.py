"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with a null text as the empty one; other columns stay behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Bytes of a slice, as far as its rows are of even length.
SLICE_BYTES = 16 << 20


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and some SLICE_BYTES, which bound a task's memory where many very long texts come together."""
    rows = max(1, min(rows, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _list(column: pa.Array) -> list:
    """Values of a column; those of a list of numbers are numpy arrays."""
    if pa.types.is_list(column.type) and pa.types.is_primitive(column.type.value_type) and not column.null_count and not column.values.null_count:
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        return [values[a:b] for a, b in zip(ends, ends[1:])]
    return column.to_pylist()


_kept: dict[Hashable, object] = {}


def remembered(step: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` made for a step's first task in this worker; it goes when the worker gets a task of another step."""
    _forget_others(step)
    if step not in _kept:
        _kept[step] = make()
    return _kept[step]


def _forget_others(step: Hashable) -> None:
    """Workers live on from step to step, so what one has remembered must not add up to what the next needs."""
    if _kept.keys() - {step}:
        _kept.clear()
        pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, per_batch: Callable[[list, list], dict], schema: str, rows: int = 512, step: Hashable = None) -> DataFrame:
    """Apply ``per_batch(ids, texts) -> columns`` to slices of each Arrow batch; ``step`` names what it has ``remembered``."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_others(step)
        for batch in batches:
            for part in _slices(batch, rows):
                cols = per_batch(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, inputs: list[str], per_batch: Callable[..., dict], schema: str, rows: int = 512, drop: list[str] = []) -> DataFrame:
    """Add or replace columns by ``per_batch(*lists of inputs) -> columns``; all others but those to ``drop`` pass as they are."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    made = _parse_datatype_string(schema)
    names = {*made.names, *drop}
    full = StructType([f for f in df.schema if f.name not in names] + list(made))
    arrow, rest = to_arrow_schema(full), [f.name for f in df.schema if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_others(None)
        for batch in batches:
            for part in _slices(batch, rows):
                cols = per_batch(*(_list(part.column(part.schema.get_field_index(c))) for c in inputs))
                out = {c: part.column(part.schema.get_field_index(c)) for c in rest} | cols
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, full)


def text_key(text) -> list:
    """Two columns that name a text by its content, so that ids may be null or repeated."""
    return [F.xxhash64(text).alias("_tidings_k1"), F.xxhash64(F.lit(7), text).alias("_tidings_k2")]


KEY = ["_tidings_k1", "_tidings_k2"]
