"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "twinclock", cores: str = "*", shuffle: int = 8, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, because there the driver and the
    executors are one machine.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="twinclock-")
    return _local_folder


_runs: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """The folder of this application inside the shared one. It is removed when the driver ends, or by
    ``clear_run_folder`` once nothing reads its tables any more."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_folder(spark)}/twinclock-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clear_quietly, spark)
    return _runs[app]


def clear_run_folder(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application."""
    folder = _runs.pop(spark.sparkContext.applicationId, None)
    if folder is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear_quietly(spark: SparkSession) -> None:
    try:
        clear_run_folder(spark)
    except Exception:  # noqa: BLE001  the session may be gone by now; the folder then stays
        pass


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives executor loss."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
