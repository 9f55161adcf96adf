"""Session settings shared by all plans."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone results depend on, and give this package to the Python workers of all executors."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Add the package to the context once; the driver's copy is sent to every executor, whatever its path there is."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_chronoloom_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="chronoloom-")) / "chronoloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._chronoloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` of the session names it.

    Where it is unset, a run in one process (master ``local[...]``) gets a temporary folder; anything else is refused, because
    a folder of one machine is unknown to the others.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_chronoloom_folder"):
        sc._chronoloom_folder = tempfile.mkdtemp(prefix="chronoloom-")
    return sc._chronoloom_folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    _ship(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
