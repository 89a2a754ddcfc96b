"""Helpers shared by the operators: tables, the shared folder, written intermediate tables, lookups kept per worker."""

import tempfile
import uuid

from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark):
    """The folder that all executors share (``spark.checkpoint.dir``). Only a session on one machine may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark, tag):
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df, tag):
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, tag)
    # small row groups: a task buffers one
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


class Lookup:
    """Results by key, kept in a worker process between tasks. It starts anew once ``limit`` keys are held."""

    def __init__(self, compute, limit):
        self.compute, self.limit, self.known = compute, limit, {}

    def many(self, keys):
        """The dictionary, which now holds every key of the set ``keys``."""
        known = self.known
        missing = list(keys.difference(known))
        if missing:
            if len(known) + len(missing) > self.limit:
                known.clear()
                missing = list(keys)
            known.update(zip(missing, self.compute(missing)))
        return known


def slices(batches, rows=128):
    """Arrow batches as (ids, texts) of a few rows at a time, so that few texts are Python strings at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            yield part.column("id"), part.column("text").to_pylist()
