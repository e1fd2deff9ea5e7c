"""Session, table access and staged (lineage-cutting) writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_stage_dir: dict[str, str] = {}
_shipped: set[str] = set()


def get_spark(app: str = "jobloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session; their Python workers may run anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="jobloom-")) / "jobloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_root(spark: SparkSession) -> str:
    """The application's folder for staged tables, in the shared folder spark.checkpoint.dir; it is deleted when the
    application ends. Only a session on one machine may do without that setting and gets an own folder; elsewhere each
    executor would write to its own disk, so that is an error."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _stage_dir:
        conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not conf and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not conf:
            folder = tempfile.mkdtemp(prefix="jobloom-stage-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            conf = "file://" + folder
        root = f"{conf.rstrip('/')}/jobloom-{app}"
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        _stage_dir[app] = root
    return _stage_dir[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that lineage ends there and a lost executor costs only
    the tasks that read it."""
    path = f"{stage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

