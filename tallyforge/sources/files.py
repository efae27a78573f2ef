"""Digests of the files below a path."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import digest_prefix
from tallyforge.session import config_table

#: Larger files are not held in a row, which takes their size several times over.
WHOLE_BYTES = 128 << 20
#: Files that are streamed at a time.
STREAMS = 4


def _streamed_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, read from front to back by the driver's JVM through Spark's own file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(jvm.java.io.BufferedInputStream(stream, 1 << 20))
    finally:
        stream.close()


def file_manifest(spark: SparkSession, path: str, glob: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``file, bytes, sha256, set_id``, one row per file.

    ``set_id`` is the digest of the sorted relative names, joined by line breaks;
    names are listed by the driver anyway when Spark plans the scan. A file of up
    to ``whole_bytes`` is read by one task. A SHA-256 needs all bytes in order
    and neither a row nor Spark's readers give a large file in pieces, so larger
    ones are streamed by the driver, in constant memory, when this is called.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    # Columns stay lazy: the set digest reads no file content.
    root = path.rstrip("/").split("://")[-1]
    relative = F.substring_index(F.col("path"), root + "/", -1)
    names = files.agg(
        digest_prefix(F.array_join(F.sort_array(F.collect_list(relative)), "\n"), 16).alias("set_id")
    )
    limit = min(whole_bytes, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    digests = files.where(F.col("length") <= limit).select(
        relative.alias("file"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    large = files.where(F.col("length") > limit).select("path", relative.alias("file"), "length").collect()
    if large:
        with ThreadPoolExecutor(STREAMS) as pool:
            found = pool.map(lambda r: _streamed_digest(spark, r.path), large)
            rows = [(r.file, r.length, sha256) for r, sha256 in zip(large, found)]
        digests = digests.union(config_table(spark, rows, {"file": "string", "bytes": "long", "sha256": "string"}))
    return digests.withColumn("set_id", names.scalar())
