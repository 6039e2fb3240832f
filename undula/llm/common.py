"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that Spark hands to Python at once, at most: a batch of texts is held by the JVM, by Arrow and by Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, in which a batch for Python has at most BATCH_ROWS rows from now on (fewer if it is set so)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="undula-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The table goes when the session's JVM ends.
    """
    spark = small_batches(df.sparkSession)
    path = f"{shared_folder(spark)}/undula-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: int | str | None) -> bool:
    """Whether a row is kept from training: crc32 of its id as text, mod 5, is 0 (a null id: as empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def is_held_out(column) -> F.Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(docs: DataFrame, per_class: int, max_chars: int, label: str, labels: DataFrame | None = None, max_labels: int = 1000) -> list[tuple[str, object]]:
    """(text, label) of at most per_class rows of each label, those with the smallest hash of doc_id, for fitting on the driver.

    The label is a column of docs, or of labels (doc_id and that column). Empty texts and those over max_chars characters are
    not drawn. An id of several labels has the least of them, an id of several texts its least text. Ids and lengths alone are
    joined and ordered; only the drawn rows' texts are fetched, by a broadcast of their ids. The numbers of rows and characters
    are bounded at every size of input. More than max_labels labels are refused.
    """
    spark = docs.sparkSession
    fits = lambda n: (n > 0) & (n <= max_chars)
    ids = docs.select(F.col("doc_id").alias("_id"), F.length("text").alias("_n"), *([F.col(label).alias("_y")] if labels is None else []))
    if labels is not None:
        ids = ids.join(labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")), "_id")
    ids = written(ids.where(fits(F.col("_n")) & F.col("_y").isNotNull()).groupBy("_id").agg(F.min("_y").alias("_y")), "labelled")
    if ids.select("_y").distinct().limit(max_labels + 1).count() > max_labels:
        raise ValueError(f"column {label} has more than {max_labels} values; fitting on the driver takes at most {max_labels}")
    # least hashes of each label and part of it, then of each label: no task holds a whole label
    for part in (["_y", F.pmod(F.xxhash64("_id"), F.lit(64))], ["_y"]):
        order = Window.partitionBy(*part).orderBy(F.xxhash64("_id"), "_id")
        ids = ids.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_class).drop("_k")
    drawn = ids.collect()
    if not drawn:
        return []
    few = spark.createDataFrame(drawn, ids.schema)
    found = docs.select("doc_id", "text").where(fits(F.length("text"))).join(F.broadcast(few), F.col("doc_id").eqNullSafe(F.col("_id")))
    rows = found.groupBy("doc_id", "_y").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["_y"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"]))]
