"""What the operators of this subpackage share: inputs, checkpoints, Arrow limits."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store it knows will do."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a session on this one machine (local master, as in tests) gets a temporary folder; on a cluster
    that folder would be out of the executors' reach, so it is an error there.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="notegrain-"))
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch; the same for all operators, whichever is planned last.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Session setting: Arrow batches of at most BATCH_BYTES, unless they are smaller already.

    Two batches in each of a worker's tasks are then little beside an executor's memory. Row limits are left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).lower())
    if not now or not 0 < int(now[1]) << 10 * " kmgt".index(now[2] or " ") <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut, without a copy, into runs of so many rows, and of about so many bytes, at most.

    Operators differ in what they can hold, so they cut for themselves. A row above the size is a piece by itself.
    """
    for batch in batches:
        at, each = 0, max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        while at < batch.num_rows:
            piece = batch.slice(at, each)
            # a piece that has the long rows is cut further
            while piece.num_rows > 1 and piece.nbytes > 2 * size:
                piece = piece.slice(0, piece.num_rows // 2)
            yield piece
            at += piece.num_rows


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators need; columns of other names can't clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
