"""Session settings and the few rules every operator shares: where lineage is cut, what may be broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that a side may have to be broadcast; callers prove or measure the size first.
BROADCAST_BYTES = 64 << 20


def local_session(cpus: int = 8, memory: str = "16g", partitions: int | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's session is used as it is."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("biblioweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and forget its lineage, in the folder that all executors share.

    The folder is ``spark.checkpoint.dir`` of the session. Where that is unset a temporary folder is made if the session is
    local (tests, a single machine), and removed at exit; on a cluster it must be set, as executors don't share a
    machine's folders. The copy is reliable: losing an executor loses nothing.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="biblioweave-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows * row_bytes`` stays under BROADCAST_BYTES, else as it is.

    Both are proven bounds, or ``rows`` is a count and ``row_bytes`` that of columns of fixed width.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def broadcast_if_measured(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its measured size stays under BROADCAST_BYTES, else as it is.

    Measured are the bytes of its texts and 48 a row and column for what a hash table takes up; ``df`` should be cheap to read.
    """
    texts = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n, t in df.dtypes if t == "string"]
    size = df.agg(F.sum(sum(texts, F.lit(48 * len(df.columns)).cast("long")))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fresh(names: Iterable[str], stem: str) -> str:
    """A column name that starts with ``stem`` and clashes with none of ``names`` (letter case ignored)."""
    taken = {n.lower() for n in names}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name
