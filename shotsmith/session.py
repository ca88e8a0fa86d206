"""Session helpers.

Library code never builds its own session: every operator takes the caller's
DataFrames.  ``get_session`` is for tests, the bench and command-line use.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Upper bound (rows) for a side we are willing to broadcast after counting it.
BROADCAST_ROW_LIMIT = 2_000_000


def get_session(cpus: str | int = "*", shuffle_partitions: int = 8,
                app: str = "shotsmith") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it
    as is.  Only a local-mode session without one (tests, the bench) gets a
    fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for it "
            "before running shotsmith jobs on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="shotsmith-ckpt-"))
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Make ``shotsmith`` importable in Python workers (``mapInPandas`` code).

    On a cluster the package comes with ``--py-files`` (or is installed on the
    executors).  A local session whose driver did not start in the repository
    gets a zip of the package through ``addPyFile`` once.
    """
    sc = spark.sparkContext
    if getattr(sc, "_shotsmith_shipped", False):
        return
    if "shotsmith" in sc.getConf().get("spark.submit.pyFiles", ""):
        sc._shotsmith_shipped = True
        return
    if not sc.master.startswith("local"):
        return
    import os
    import zipfile

    import shotsmith
    pkg_dir = os.path.dirname(os.path.abspath(shotsmith.__file__))
    base = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="shotsmith-pyfiles-"), "shotsmith.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
    sc._shotsmith_shipped = True
