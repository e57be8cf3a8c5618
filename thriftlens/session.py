"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans and may be set on a session that already runs.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A per-group row limit is applied before the shuffle, whatever its size.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2147483647",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "8", app: str = "thriftlens") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="thriftlens-wh-"))
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    return configure(spark)


# Ids, mostly digits, fill staged tables; snappy, Spark's own choice, leaves them nearly as long as they are.
STAGED_CODEC = "zstd"

# The scratch folder of each local application that has no shared one.
_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a scratch folder in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="thriftlens-")
    return _scratch[app]


# Where jobs that remove their own staged tables keep them, the innermost last.
_job_folders: ContextVar[tuple[str, ...]] = ContextVar("job_folders", default=())

# Spark drops the shuffle files of a query when it ends, not when the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the tables that ``cut_lineage`` writes inside: for jobs whose results are written by then. Inside, shuffle files go with
    the query that wrote them, so a job of many steps needs the disk of its largest one."""
    folder = f"{shared_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    token = _job_folders.set((*_job_folders.get(), folder))
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        _job_folders.reset(token)
        spark.conf.set(DROP_SHUFFLES, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def removes_staged(job: Callable) -> Callable:
    """A job, called with a session or a DataFrame first, inside ``staging``."""

    @wraps(job)
    def run(first, *args, **options):
        with staging(first if isinstance(first, SparkSession) else first.sparkSession):
            return job(first, *args, **options)

    return run


def cut_lineage(df: DataFrame, lasting: bool = False, by: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back from there.

    Used where one result feeds several later reads. The files outlive lost executors, and later
    reads fetch only the columns they need. A ``lasting`` table outlives the innermost ``staging`` around it. ``by`` names columns whose hash buckets the files
    are, as many as the session has shuffle partitions: joins by these columns then leave the table where it lies. ``dealt`` says that ``df`` comes from such a join and
    is dealt out that way already.
    """
    spark = df.sparkSession
    folders = _job_folders.get()[:-1] if lasting else _job_folders.get()
    folder = folders[-1] if folders else shared_dir(spark).rstrip("/")
    name = f"staged-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    if not by:
        df.write.option("compression", STAGED_CODEC).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(buckets, *by)
    named = name.replace("-", "_")
    rows.write.format("parquet").option("compression", STAGED_CODEC).bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(named)
    table = spark.table(named)
    spark.sql(f"DROP TABLE {named}")  # from the catalogue; the files stay
    return table
