"""Helpers shared by the training-data operators.

Rows and keys.  A document row is identified by its ``doc_id`` together with a
64-bit hash of (doc_id, text), so that null ids and ids that occur on rows with
different texts stay apart; rows equal in both are one document and get equal
results.  Operators read only the columns they name, so further columns of the
input, whatever they are called, never clash with theirs.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: Rows in one Arrow batch; texts may be long, so batches stay small.
BATCH_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small (one row may hold a very long text) and ship this package to the workers, once a context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if not getattr(sc, "_lexloom_shipped", False):
        root = Path(__file__).resolve().parents[1]
        packed = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}-{sc.applicationId}.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(packed))
        sc._lexloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set, and then in local mode alone."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


#: Folders of the intermediate tables written here, in order.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``release``: how many intermediate tables there are so far."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the intermediate tables written after the mark ``since`` but for the last ``keep``; frames that read them end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    cut = max(since, len(_written) - keep)
    for path in _written[since:cut]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _written[since:cut]


def boxed(docs: DataFrame) -> DataFrame:
    """(row, id, k): the rows of ``docs`` as one struct beside their keys, so that no column of theirs clashes with a helper's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), row_key().alias("k"))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """64-bit key of a document row (see the module text)."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes; bytes.split() cuts at exactly the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length, column by column; int64 columns as differences, all but hashes (uint64) compressed."""
    out, names = [], sorted(arrays)
    c = zstandard.ZstdCompressor(level=1)
    for n in names:
        a = np.ascontiguousarray(arrays[n])
        if a.dtype == np.int64 and len(a):
            with np.errstate(over="ignore"):
                a = np.concatenate((a[:1], a[1:] - a[:-1]))
        raw = a.tobytes()
        kind = a.dtype.str.encode().ljust(4) + n.encode().ljust(8)
        data = raw if a.dtype == np.uint64 else c.compress(raw)
        out += [kind, len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    at, out = 0, {}
    d = zstandard.ZstdDecompressor()
    while at < len(blob):
        dtype, name = blob[at : at + 4].decode().strip(), blob[at + 4 : at + 12].decode().strip()
        n = int.from_bytes(blob[at + 12 : at + 20], "little")
        data = blob[at + 20 : at + 20 + n]
        at += 20 + n
        a = np.frombuffer(data if dtype == "<u8" else d.decompress(data), dtype=dtype)
        if dtype == "<i8":
            with np.errstate(over="ignore"):
                a = np.cumsum(a)
        out[name] = a
    return out


def unpack_all(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts = [unpack(b) for b in blobs]
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]} if parts else {}


def split_by(key: np.ndarray):
    """(value, its places in order) for each value of ``key``."""
    order = np.argsort(key, kind="stable")
    values, at = np.unique(key[order], return_index=True)
    for v, a, b in zip(values.tolist(), at, [*at[1:], len(order)]):
        yield v, order[a:b]
