"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Scratch folders of sessions in one process that name none, by application.
OWN_ROOTS = {}


def build_session(app_name="voxloom", master=None, **extra):
    """A session with this package's settings; ``extra`` keys win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark):
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a session in one process may lack the setting; it then gets one
    temporary folder. On a cluster the setting is a must: a folder on one machine
    is useless to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not in_one_process(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in OWN_ROOTS:
        OWN_ROOTS[application] = tempfile.mkdtemp(prefix="voxloom-")
    return OWN_ROOTS[application]


def in_one_process(master):
    """True for ``local`` and ``local[...]``, but not for ``local-cluster[...]``."""
    return master == "local" or master.startswith("local[")


def file_system(spark, path):
    """The Hadoop file system of a path, and the path in its form."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark, path):
    system, hadoop_path = file_system(spark, path)
    return system.exists(hadoop_path)


def remove_folder(spark, path):
    """Delete a folder with all in it; none is fine."""
    system, hadoop_path = file_system(spark, path)
    system.delete(hadoop_path, True)


def scratch_path(spark, name):
    """A new path below the scratch folder, unique to this call."""
    return f"{scratch_root(spark)}/voxloom/{name}-{uuid.uuid4().hex}"


def stored(rows, name):
    """Write rows that should be few and read them back from the scratch folder.

    Catalyst takes a top-k per group for as large as its input. The stored
    file tells it the true size, so that a join broadcasts the rows if, and
    only if, they are small, and leaves the large side unshuffled.
    """
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
