"""Session defaults and the one way this library cuts lineage.

Intermediate tables that several later plans read are written as Parquet into the folder all executors share
(``spark.checkpoint.dir``), so a lost executor costs a re-read and never a recomputation of the whole history.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; everything else is the deployment's business.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A union that keeps its children's partitioning can be zipped with one that was coalesced to other partitions.
    "spark.sql.unionOutputPartitioning": "false",
    # Texts may be long: an Arrow batch is bounded by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    # The candidate cap of 2000 rows a question must still become a WindowGroupLimit.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
}


#: Frees the shuffles of a statement when it ends; else they stay until the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each application, so they needn't have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for module in sorted(package.rglob("*.py")):
            file.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def build_session(master: str = "local[*]", app: str = "docloom", **conf: str) -> SparkSession:
    """A session for tests, benchmarks and notebooks; clusters bring their own."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read. Where the session names none, a local run gets a temporary one; on a cluster
    that is an error, as every executor would write to a disk of its own."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return context.getCheckpointDir().get().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends here, and the files outlive any
    executor; the shuffles it took are freed at once, as nothing reads them again. The jobs that this takes run at once, while the caller's plan is still being built. The files are removed
    by ``discard``, at the latest when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table.materialized_at = files.makeQualified(where).toString()
    return table


def stored(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Within a task: some columns of a materialized table by its ``materialized_at``, so many rows at once and always in
    the same order. A task that has to see a whole table reads it here, which costs no shuffle and no copy."""
    if path.startswith("file:"):
        files, path = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        files, path = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(path))
    for name in sorted(x.path for x in found if x.path.endswith(".parquet")):
        with files.open_input_file(name) as file:
            yield from pq.ParquetFile(file, pre_buffer=False, buffer_size=1 << 20).iter_batches(rows, columns=columns, use_threads=False)


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that no later plan reads; what ``materialize`` returned, not a frame made of it."""
    for table in tables:
        files, where = _file_system(table.sparkSession, table.materialized_at)
        files.delete(where, True)
