"""A session with the settings the library expects, and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "panelworks", master: str | None = None, **conf: str) -> SparkSession:
    """AQE on, UTC, shuffle partitions left to AQE. ``conf``: further settings."""
    build = SparkSession.builder.appName(app)
    if master:
        build = build.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}
    return build.config(map=settings).getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table under ``root``; any store that Spark reads."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where the setting is missing, a folder of this machine
    serves a local master only; on a cluster its executors could not see it, so that is an error."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_panelworks_dir", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="panelworks-")
            spark.sparkContext._panelworks_dir = base
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: cuts the lineage and outlives lost executors."""
    import uuid

    path = f"{work_dir(df.sparkSession)}/panelworks/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
