"""Session helpers: shipping the package to Python workers, checkpoints, sizes."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers on every executor.

    The zip is served by the driver's file server, so nothing needs to be
    installed on the executors.  Done once per Spark application.
    """
    sc = spark.sparkContext
    if getattr(sc, "_folioflow_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="folioflow-")) / "folioflow.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, Path(_ROOT.name) / p.relative_to(_ROOT))
    sc.addPyFile(str(out))
    sc._folioflow_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    The folder is the one named in ``spark.checkpoint.dir``.  Where that is unset
    a local master takes a folder of its own; a cluster has to name one that all
    its machines share.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
            where = os.path.join(tempfile.gettempdir(), "folioflow-checkpoints")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
