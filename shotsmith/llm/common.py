"""Small helpers shared by the training-data operators.

Every operator takes DataFrames.  Intermediates that are read more than once
are written as Parquet under the shared folder named by ``spark.checkpoint.dir``
(``write_once``), so a lost executor costs a re-read, never a re-run, and no
task depends on files of one machine.  ``drop_run_folder`` removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from shotsmith.session import checkpoint_dir, ship_package

WHITE = r"[\x20\x09-\x0D]"          # the only characters that separate words
NOT_WHITE = r"[^\x20\x09-\x0D]+"    # a word


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_folder(spark: SparkSession) -> str:
    """The folder of this session's intermediates, inside the shared folder."""
    return f"{checkpoint_dir(spark)}/shotsmith-run"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and read back."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy.written_at = path
    return copy


def drop_copy(copy: DataFrame) -> None:
    """Remove the files of a table that ``write_once`` returned, when every
    step that reads them has been written itself."""
    _delete(copy.sparkSession, copy.written_at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_run_folder(spark: SparkSession) -> None:
    """Remove every intermediate of this session.  The owner of the session
    calls it once the results that still read them are stored."""
    _delete(spark, run_folder(spark))


def spread(spark: SparkSession) -> int:
    """Number of tasks for a numbered repartition."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_chars(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` holding about ``limit`` characters each, so a
    step over one range has bounded memory whatever the Arrow batch holds."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


# --- word hashes ---------------------------------------------------------

# Odd multipliers of the polynomial hashes modulo 2**64 (fixed values).
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK_BYTES = 1 << 18
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)

_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 (kept per process, grown by doubling)."""
    got = _powers.get(int(base))
    if got is None or len(got) <= n:
        size = 1 << max(12, int(n).bit_length())
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[int(base)] = got
    return got[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out *= WORD_BASE
        out += values[j: j + n]
    return out


def word_spans(raw: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word of a UTF-8 text, as byte offsets.

    The hash is a 64-bit polynomial over the bytes; a word is a maximal run
    of bytes other than space and 0x09-0x0D (those never occur inside a
    multi-byte character).
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    white = _IS_WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    # prefix sums of (byte + 1) * base**i; a word is the difference of two,
    # shifted back by the inverse power.  Words are taken in blocks so that the
    # power tables stay small whatever the length of the text.
    h = np.empty(len(start), dtype=np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + BLOCK_BYTES)))
        base, stop = int(start[a]), int(end[b - 1])
        part = data[base:stop].astype(np.uint64)
        part += np.uint64(1)
        part *= powers(BYTE_BASE, stop - base)[: stop - base]
        total = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = start[a:b] - base, end[a:b] - base
        h[a:b] = (total[e] - total[s]) * powers(BYTE_BACK, stop - base)[s]
        a = b
    return start, end, mix(h)


# --- columns made in tasks -----------------------------------------------

def with_columns(df: DataFrame, inputs: list[str], make, new: dict[str, str],
                 drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``new`` (name -> Spark type) made batch by batch
    from ``inputs``; every other column passes through untouched, whatever its
    type.  ``make`` gets one Python list per input and returns one per output.
    An input column of the same name as an output is replaced.
    """
    from pyspark.sql.types import StructType
    kept = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    made = StructType.fromDDL(", ".join(f"`{k}` {t}" for k, t in new.items()))
    schema = StructType(kept + made.fields)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        for batch in batches:
            got = make(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(v, type=k) for v, k in zip(got, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
