"""What the operators share: tables in the shared folder, word rules, the split into learned and held-out rows."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset, a session of one process makes a folder of its own; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = Path(tempfile.mkdtemp(prefix="dossier-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dossier/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.dossier_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    for t in tables:
        if path := getattr(t, "dossier_path", None):
            jvm = t.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """A broadcast of a table of up to `most` rows, which are counted; a larger one is shuffled, whatever size the planner takes it for."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(c: Column) -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.encode(F.coalesce(c, F.lit("")), "UTF-8")


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for rows that no model may learn from. A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
