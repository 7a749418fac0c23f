"""Written intermediate tables for jobs whose later steps read an earlier result several times.

The table goes to the shared folder the cluster names in ``spark.checkpoint.dir`` (or the one given
to ``setCheckpointDir``), so a lost executor costs a re-read, not a recomputation. A session whose
driver and executors are one local process gets a folder of its own; any other session without a
shared folder is an error, because its executors could not read each other's files.
"""

import tempfile
import uuid

_LOCAL = {}
_WRITTEN = {}


def shared_folder(spark):
    """The folder of this session for written steps; raises where no shared folder is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[context.applicationId]


def step_path(spark, name="step"):
    """A new path under the shared folder, remembered for ``forget``."""
    path = f"{shared_folder(spark)}/billwright/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settle(df, name="step"):
    """Write the frame once and read it back: short lineage, known size, pruned columns."""
    spark = df.sparkSession
    path = step_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark):
    """Delete every step this application has written; frames that read them are void afterwards."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
