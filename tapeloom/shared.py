"""Tables, the cluster's shared folder, and small helpers that all operators use."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters of white space as Unicode has it, no-break space included; like WORD_CHARS for the
#: regular expressions of Java and of RE2 alike.
SPACES = r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNI_SPACE = f"[{SPACES}]"
#: The characters of words: letters and numbers of any script, and the underscore.
WORD_CHARS = r"\p{L}\p{N}_"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset a temporary one, but only if Spark runs in
    one process, as in tests: on a cluster an unset folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        named = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes when the driver's program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _MADE:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone: its folder is no longer ours to reach
            return


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder, whatever its file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stripped(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(c, f"^{UNI_SPACE}+|{UNI_SPACE}+$", "")


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tokenizer_folder() -> str:
    """Folder of the public vocabulary files; TAPELOOM_TOKENIZERS overrides the default."""
    return os.environ.get("TAPELOOM_TOKENIZERS", "/opt/tokenizers")


def beside(*rows: DataFrame) -> DataFrame:
    """Tables of one row each, with different columns, as one row; no join is made."""
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def first_rows(rows: DataFrame, keys: list[str], order: list[Column | str], k: int, place: str = "place") -> DataFrame:
    """The first `k` rows of each key with their place from 1. A key may hold any share of the rows: its rows are cut
    down to `k` in each of many shards before they meet. `order` must be total for the result to be fixed."""
    shard = F.pmod(F.xxhash64(*rows.columns), F.lit(max(tasks(rows.sparkSession), 8)))
    some = rows.withColumn("_shard", shard).withColumn(place, F.row_number().over(Window.partitionBy(*keys, "_shard").orderBy(*order)))
    few = some.where(F.col(place) <= k).drop("_shard", place)
    return few.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)
