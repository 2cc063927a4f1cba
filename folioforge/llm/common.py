"""Small helpers shared by the operators: intermediate tables, row hashes, byte-range hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a key list may have to be broadcast (16 MB of longs); longer lists are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows from which a group of copies counts as large: what is said of it is broadcast instead of dealt by key.
LARGE = 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary one if all runs in this process,
    as in tests; on a cluster an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="folioforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, deleted when the driver ends (lazy results may be read until then)."""
    top = f"{checkpoint_dir(spark).rstrip('/')}/folioforge-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(top)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return f"{top}/{name}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it again: lineage ends here, a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(text: Column) -> Column:
    """Tells rows of one id (or of none) apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Mark a table of counted ``rows`` for broadcast if it is within the bound; leave it to a shuffle join beyond."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def crc_of(column: str) -> Column:
    """crc32 of a column's text form."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def small_batches(spark: SparkSession) -> None:
    """Let 1,000 rows cross to Python at once where the session still has Spark's default of 10,000: documents are long, and a batch of
    them is held by the executor and by the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of so many rows, so that Python objects are made for few texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    release()


def release() -> None:
    """Give freed memory back to the system: workers are used again by later stages, and an idle one should be small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE = 0xD1342543DE82EF95
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _inverse(_BASE))):
            _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased if asked."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of each run of ``size`` words (of the whole list if it is shorter; of nothing if it is empty)."""
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    data = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    a, b = starts[: len(words) - size + 1], ends[size - 1 :]
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * _ODD)


#: Rows taken of a class none of whose texts is within the length bound: its shortest ones.
LONG_ROWS = 20


def class_sample(keyed: DataFrame, texts: DataFrame, per_class: int, max_chars: int) -> list[Row]:
    """(doc_id, key, text) of a bounded sample, by doc_id and key: ``per_class`` ids of each class at most, those of smallest id hash with a text of 1 to
    ``max_chars`` characters, or the LONG_ROWS shortest texts of a class that has only longer ones. Of several texts of an id the
    smallest counts. Null ids, keys and texts are left out.

    ``keyed`` has doc_id, key and n, the length of the text; ``texts`` has doc_id, text and, where one id may have several keys, key. Only
    lengths are counted, ranked and shuffled; texts are picked out where they are. Classes are counted first; an id is then
    ranked only if its hash is below what lets about twice the wanted number pass, so the ranking of a class reads a bounded
    number of rows however large the class is.
    """
    own = keyed.filter("doc_id is not null and key is not null and n > 0")
    fits = F.col("n") <= max_chars
    counts = {r["key"]: r.fit for r in own.groupBy("key").agg(F.count_if(fits).alias("fit")).collect()}
    if not counts:
        return []
    kind = own.schema["key"].dataType.simpleString()
    passing = {k: min(1.0, (2 * per_class + 100) / n) for k, n in counts.items() if n} or {next(iter(counts)): 0.0}
    # As an Arrow table: rows of Python would start a second daemon with workers of its own on each executor.
    shares = keyed.sparkSession.createDataFrame(pa.table({"key": list(passing), "share": list(passing.values())}), f"key {kind}, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    few = own.filter(fits).join(F.broadcast(shares), "key").filter(place < F.col("share")).select("key", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = few.withColumn("r", rank).filter(F.col("r") <= per_class).select("key", "doc_id", F.lit(max_chars).alias("most"))
    for lost in (k for k, n in counts.items() if not n):
        long = own.filter(F.col("key") == F.lit(lost)).orderBy("n", F.xxhash64("doc_id"), "doc_id").limit(LONG_ROWS)
        ids = ids.union(long.groupBy("key", "doc_id").agg(F.max("n").alias("most")))
    on = ["key", "doc_id"] if "key" in texts.columns else ["doc_id"]
    found = texts.join(F.broadcast(ids), on).filter((F.length("text") > 0) & (F.length("text") <= F.col("most"))).groupBy("key", "doc_id").agg(F.min("text").alias("text"))
    return sorted(found.collect(), key=lambda r: (r.doc_id, r["key"]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of a bounded sample (see ``class_sample``). ``training`` says which ids may be learned from; of several
    labels of an id the rounded mean counts."""
    known = labels.filter(training & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("key"))
    sized = docs.filter(training).select("doc_id", F.length("text").alias("n"))
    found = class_sample(sized.join(known, "doc_id"), docs.select("doc_id", "text"), per_class, max_chars)
    return [r.text for r in found], np.array([r["key"] for r in found], np.int64)


def adam(params: dict[str, np.ndarray], gradients, steps: int, rate: float) -> None:
    """Full-batch Adam: ``gradients(step)`` gives one array per parameter; parameters change in place."""
    m = {k: np.zeros_like(v) for k, v in params.items()}
    s = {k: np.zeros_like(v) for k, v in params.items()}
    for t in range(1, steps + 1):
        for k, g in gradients(t).items():
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.01 * (g * g - s[k])
            params[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
