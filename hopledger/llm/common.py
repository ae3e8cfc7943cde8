"""What the operators share: words, Arrow batches in small slices, tables written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopledger.session import checkpoint_folder

WORD = r"[^\x20\x09-\x0D]+"
LOWER_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Characters of text that a task holds at once beside the Arrow batch it was given.
SLICE_CHARS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder all executors share and read from there; this cuts its lineage."""
    path = f"{checkpoint_folder(df.sparkSession)}/hopledger-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` texts together have about ``chars`` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for row, size in enumerate(sizes):
        if row > begin and total + size > chars:
            yield batch.slice(begin, row - begin)
            begin, total = row, 0
        total += size
    if len(sizes) > begin:
        yield batch.slice(begin)


def map_slices(
    df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
) -> DataFrame:
    """``make`` builds a function once per task; it turns each slice of rows into rows of ``schema``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, column):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [text or "" for text in batch.column(column).to_pylist()]


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: blanks become spaces, so words are what lies between them."""
    blanks = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.length(F.trim(blanks)) == 0, F.lit(0)).otherwise(
        F.size(F.array_remove(F.split(blanks, " ", -1), ""))
    ).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
