"""The public surface: the engine class and namespaces over a default engine.

Only here do lazy DataFrames become tables, tuples and dicts.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from types import SimpleNamespace

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .errors import LakeError, UnsupportedFormat
from .operators import audit, docs, lake, lakemap, slicing
from .plans import sqlgate
from .session import session
from .sources import readers, registry

#: Rows of a batch, at most.
MAX_BATCH = 1 << 20
#: Names of the switch that makes ingest normalise.
NORMALIZE = "QUARRY_INGEST_NORMALIZE"


def _text(value: object, name: str) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{name} must be a string")
    return value


def _files(work):
    """What Spark says about files and folders as an OSError."""

    def run(*a, **k):
        try:
            return work(*a, **k)
        except (PySparkException, Py4JJavaError) as e:
            raise LakeError(str(e).splitlines()[0]) from e

    run.__doc__, run.__name__ = work.__doc__, work.__name__
    return run


class AuditEngine:
    """All operations with one set of thresholds."""

    def __init__(self, min_passenger: int = 1, max_passenger: int = 9, min_fare: float = 0.01, max_speed_mph: float = 100.0, spark: SparkSession | None = None):
        self.thresholds = audit.Thresholds(min_passenger, max_passenger, min_fare, max_speed_mph)
        self._spark = spark

    @property
    def spark(self) -> SparkSession:
        return self._spark or session()

    # --- SQL ---
    def execute_sql(self, query: str, error_on_empty: bool = True) -> pa.Table:
        """The whole result of a query over paths."""
        return sqlgate.execute(self.spark, _text(query, "query"), error_on_empty)

    def execute_sql_batches(self, query: str) -> list[pa.RecordBatch]:
        return sqlgate.collect(sqlgate.query(self.spark, _text(query, "query"))).to_batches()

    def execute_sql_stream(self, query: str) -> sqlgate.BatchIterator:
        """The result batch by batch, when asked for."""
        return sqlgate.stream(self.spark, _text(query, "query"))

    # --- audits ---
    @_files
    def process_batch(self, batch: pa.RecordBatch | DataFrame):
        """Clean and trash of a record batch (tables back) or a DataFrame (lazy)."""
        if isinstance(batch, DataFrame):
            return audit.split(audit.flag_static(batch, self.thresholds))
        if not isinstance(batch, pa.RecordBatch):
            raise TypeError("a pyarrow RecordBatch or a DataFrame is needed")
        df = self.spark.createDataFrame(pa.Table.from_batches([batch]))
        return tuple(x.toArrow() for x in audit.split(audit.flag_static(df, self.thresholds)))

    @_files
    def process_file(self, file_path: str, batch_size: int = MAX_BATCH) -> tuple[int, int, int]:
        """(total, clean, trash) of a file; a batch size of 0 reads nothing."""
        if not isinstance(batch_size, int):
            raise TypeError("batch_size must be an integer")
        if batch_size < 0:
            raise OverflowError("batch_size must not be negative")
        if registry.known(_text(file_path, "file_path")) is None:
            raise UnsupportedFormat(f"Unsupported format: {file_path}")
        df = readers.read_file(self.spark, file_path)
        if not batch_size or not df.columns:
            return 0, 0, 0
        return audit.counts(audit.flag_static(df, self.thresholds))

    @_files
    def filter_matrix(self, file_path: str, rules: Sequence[str]) -> tuple[pa.Table, pa.Table]:
        """Clean and trash tables of a file under rules."""
        flagged = audit.flag_rules(readers.read_file(self.spark, _text(file_path, "file_path")), list(rules))
        return tuple(x.toArrow() for x in audit.split(flagged))

    @_files
    def filter_files_parallel(self, path_pattern: str, rules: Sequence[str] = (), partition_filter: str | None = None, num_threads: int | None = None) -> dict[str, int]:
        """Counts over all files of a path, folder or glob; Spark sets the parallelism."""
        return lake.filter_files(self.spark, _text(path_pattern, "path_pattern"), list(rules), partition_filter)

    # --- reading ---
    @_files
    def slice_rows(self, file_path: str, offset: int, limit: int) -> pa.Table:
        return slicing.slice_rows(self.spark, file_path, offset, limit).toArrow()

    @_files
    def slice_cols(self, file_path: str, selected_cols: Sequence[str], offset: int, limit: int) -> pa.Table:
        return slicing.slice_rows(self.spark, file_path, offset, limit, list(selected_cols)).toArrow()

    @_files
    def preview_sample(self, file_path: str, limit_rows: int) -> tuple[pa.Table, pa.Table]:
        return tuple(x.toArrow() for x in slicing.preview(self.spark, file_path, limit_rows, self.thresholds))

    # --- lake ---
    @_files
    def process_and_write_lake(self, input_dir: str, clean_output_dir: str, trash_output_dir: str, partition_filter: str | None = None, batch_size: int | None = None) -> tuple[int, int, int, int]:
        return lake.write_clean_and_trash(self.spark, input_dir, clean_output_dir, trash_output_dir, partition_filter, self.thresholds)

    @_files
    def generate_gold_table(self, input_dir: str, gold_output_dir: str, table_version: str, partition_filter: str | None = None, batch_size: int | None = None) -> tuple[int, int, str]:
        return lake.write_gold(self.spark, input_dir, gold_output_dir, table_version, partition_filter, self.thresholds)

    @_files
    def split_file(self, file_path: str, max_rows_per_file: int, output_dir: str, format: str = "parquet") -> int:  # noqa: A002
        return lake.split_file(self.spark, file_path, max_rows_per_file, output_dir, format)

    @_files
    def ingest(self, src_dir: str, dst_dir: str, auto_normalize: bool | None = None) -> tuple[int, int]:
        normalize = auto_normalize if auto_normalize is not None else os.environ.get(NORMALIZE, "").lower() in ("1", "true")
        return lake.ingest(self.spark, src_dir, dst_dir, normalize)

    @_files
    def create_map(self, dir_path: str) -> str:
        return lakemap.create_map(self.spark, dir_path)

    @_files
    def doctor(self, dir_path: str, auto_heal: bool = False) -> dict:
        return lakemap.doctor(self.spark, dir_path, auto_heal)

    # --- documentation ---
    @_files
    def export_data_dictionary_md(self, target_path: str, output_path: str) -> str:
        return docs.write_dictionary(self.spark, target_path, output_path)

    @_files
    def generate_er_graph(self, path: str, output_path: str) -> str:
        return docs.write_graph(self.spark, path, output_path)

    generate_er_graph_py = generate_er_graph


_default = AuditEngine()


def _space(*names: str) -> SimpleNamespace:
    return SimpleNamespace(**{n: getattr(_default, n) for n in names})


read = _space("slice_rows", "slice_cols", "preview_sample")
filter = _space("process_batch", "process_file", "filter_matrix", "filter_files_parallel")  # noqa: A001
sql = _space("execute_sql", "execute_sql_batches", "execute_sql_stream")
lake_ops = _space("process_and_write_lake", "generate_gold_table", "split_file", "ingest", "create_map", "doctor")
dictionary = _space("export_data_dictionary_md")
graph = _space("generate_er_graph")
formats = SimpleNamespace(register_delimited=registry.register_delimited, register_reader=registry.register_reader, unregister_format=registry.unregister_format, list_formats=registry.list_formats)
