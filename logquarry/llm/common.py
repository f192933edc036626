"""Words of a text, batches of rows, and names that clash with nothing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that Python gets at a time.
BATCH_ROWS = 256
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Characters of a text that are taken at once; bounds memory only.
PART_CHARS = 1 << 20

# Bytes to bytes: A-Z become a-z, every other ASCII character that is neither a letter nor a digit a space.
# Bytes above 0x7F belong to letters of other scripts and stay.
ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """The lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, as UTF-8; none for null."""
    return text.encode().translate(ALNUM).split() if text else []


def blank_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8, with A-Z lower-cased on request."""
    if not text:
        return []
    raw = text.encode()
    return (raw.translate(LOWER) if lower else raw).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(df: DataFrame, name: str) -> Column:
    """A top-level column, even if its name holds dots."""
    return df["`" + name.replace("`", "``") + "`"]


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session was told to hand Python ``BATCH_ROWS`` rows at a time at most.

    The default of 10,000 whole texts would be held several times over, in the executor and in its Python worker.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_SETTING)) > BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


def id_and_text(df: DataFrame) -> DataFrame:
    """Only doc_id and text, so that no other column is read or can clash."""
    return in_small_batches(df).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def row_hash(*columns: Column) -> Column:
    """128 bits as a string of two 64-bit hashes; null and empty differ."""
    marked = [c for x in columns for c in (x.isNull(), x)]
    return F.concat_ws("-", F.hex(F.xxhash64(*marked)), F.hex(F.xxhash64(F.lit("second"), *marked)))


def parts(text: str) -> Iterator[str]:
    """A text in parts of about ``PART_CHARS``, cut before a blank or line feed, where no word and no special token
    goes on and no character joins the one before."""
    start = 0
    while len(text) - start > PART_CHARS:
        end = start + PART_CHARS
        found = [i for i in (text.find(" ", end), text.find("\n", end)) if i >= 0]
        if not found:
            break
        yield text[start : min(found)]
        start = min(found)
    yield text[start:]


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece holds about ``most_bytes`` of a text column, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch."""
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
