"""Session defaults and the shared scratch space in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def get_spark(app: str = "fragloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; what the caller or the cluster sets wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset and Spark runs in one local process, a temporary folder is set instead; on a cluster
    without the setting this raises, as a folder of one machine would not survive the loss of an executor.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder so that a lost executor never means computing a long lineage again.

    Operators that work in rounds ``drop`` what the next round no longer reads. The tables that a result reads stay until
    ``forget``, which whoever has written the result may call, or until the program ends.
    """

    _open: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._made = 0
        Scratch._open[self.root] = spark

    def table(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` once and returns the written table."""
        path = f"{self.root}/{self._made}"
        self._made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def measured(self, df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
        """The written table and the ``measures``, named aggregates that are taken while it is written."""
        seen = Observation()
        path = f"{self.root}/{self._made}"
        self._made += 1
        df.observe(seen, *measures).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out, seen.get

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that ``table`` returned and that no frame reads any more."""
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                delete(self.spark, path)

    def forget(self) -> None:
        """Deletes all written tables; no frame that reads one may be used after that."""
        Scratch._open.pop(self.root, None)
        delete(self.spark, self.root)

    @staticmethod
    @atexit.register
    def forget_all() -> None:
        """Deletes all scratch tables of this program's sessions that are still running."""
        for root, spark in list(Scratch._open.items()):
            Scratch._open.pop(root, None)
            try:
                if spark.sparkContext._jsc is not None:
                    delete(spark, root)
            except Exception:  # noqa: BLE001  # the session has gone, and its folder with it or not
                return


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application, so that they need not have it installed."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    own = tempfile.mkdtemp(prefix="spark-")  # the driver's own copy, which Spark serves to all
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    target = Path(own) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(spark.sparkContext.applicationId)
