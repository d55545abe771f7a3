"""What the corpus operators share: tables, names that clash with none, text conventions; scratch tables as in the rest of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, scratch, shared_dir, small, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores added where df has a column of that name, so that new columns clash with none."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def held_out(id_col: str = "doc_id"):
    """The third of documents that no model here learns from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def parallel(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
