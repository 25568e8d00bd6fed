"""Where jobs put what they write for themselves."""

import uuid


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine uses that machine's /tmp; any other must set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file:/tmp/vendorlens-{spark.sparkContext.applicationId}"


def scratch_path(spark, name: str) -> str:
    """A new folder below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df, name: str):
    """``df`` written below the shared folder and read again: for what is used several times, or must not change when a task runs again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
