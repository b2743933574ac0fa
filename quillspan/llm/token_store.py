"""Token-id output: Parquet list columns with chosen encodings, row groups and
page indexes, for reads of a few documents or of metadata alone.

Token ids are dictionary-encoded (a vocabulary is small), ids and lengths
delta-packed. Rows are in order of doc_id, over all files and in each, so that
the minima and maxima of files, row groups and pages let a reader skip what it
doesn't ask for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentencepiece_bpe as bpe
from . import store

FILE_BYTES = 32 << 20  # of the input in each file, about
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
METADATA = ("lang", "source")


def tokenized(docs: DataFrame, model_path: str = bpe.MODEL, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = METADATA) -> DataFrame:
    """Rows (doc_id, *metadata, n_tokens, tokens), each partition a range of doc_id and sorted by it.

    Null texts have null tokens and length, empty ones an empty list; texts of
    any length are encoded whole. Null ids come first; repeated rows each stay,
    and an id that many rows repeat takes as many ranges as it needs. Metadata columns that docs lacks are
    left out, as are those named like a column of the result; others are not read.
    """
    kept = [m for m in metadata if m in docs.columns and m not in ("doc_id", "tokens", "n_tokens", id_col, text_col)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, F.col(text_col).cast("string").alias("__text"))
    rows = rows.repartitionByRange(store.partitions_for(docs, FILE_BYTES), "doc_id", F.monotonically_increasing_id()).sortWithinPartitions("doc_id")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.select(range(batch.num_columns - 1))
            for run, ids, n, _ in bpe.encode_texts(batch.column(batch.num_columns - 1), model_path, False):
                part = head.slice(run.first, run.n)
                yield pa.RecordBatch.from_arrays([*part.columns, n, ids], [*part.schema.names, "n_tokens", "tokens"])

    return rows.mapInArrow(apply, schema)


def write_tokens(tokens: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write rows of tokenized() to path; column and offset indexes are part of each file."""
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",  # delta-packed then, as the sorted ids and the lengths are ints
        "parquet.enable.dictionary#n_tokens": "false",
    }
    tokens.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] | None = None, first: int | None = None, last: int | None = None, ids: Sequence[int] | None = None) -> DataFrame:
    """Chosen columns of the documents with first <= doc_id <= last, or with doc_id in ids; conditions reach the scan."""
    rows = spark.read.parquet(path)
    if ids is not None:
        wanted = sorted({i for i in ids if i is not None})
        rows = rows.where(F.col("doc_id").isin(wanted))
        first, last = (wanted[0], wanted[-1]) if wanted else (first, last)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select(*columns) if columns else rows


def stored(docs: DataFrame, model_path: str = bpe.MODEL) -> DataFrame:
    """Tokens of docs, written to the shared folder and read again: rows of tokenized(), whose rules hold for nulls and the like."""
    path = store.new_path(docs.sparkSession, "tokens")
    write_tokens(tokenized(docs, model_path), path)
    return read_tokens(docs.sparkSession, path)
