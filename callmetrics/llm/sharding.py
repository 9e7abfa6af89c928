"""Operator 2, sharding: a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, made from two hashes of its name. Shards take
turns, each claiming the next slot of its permutation that is free, until the table is full. A key's shard is found
in the table in constant time. Shards get equal numbers of slots to within one, and when a shard joins or leaves,
few slots change hands.

The table has `size` rows, whatever the data holds, so it is broadcast. A null key has a slot of its own by the same
hash. Repeated keys go to the same shard. Other columns stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; about a hundred slots or more for each shard keep shards even.
TABLE_SIZE = 65_537


def table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index of its shard."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    if size < 2 or any(size % k == 0 for k in range(2, math.isqrt(size) + 1)):
        raise ValueError("the table's size must be a prime: only then does every permutation reach every slot")
    seeds = [hashlib.blake2b(name.encode(), digest_size=16).digest() for name in shards]
    at = [int.from_bytes(s[:8], "little") % size for s in seeds]
    skip = [int.from_bytes(s[8:], "little") % (size - 1) + 1 for s in seeds]
    owner, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return np.array(owner, np.int32)


def assign(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """The rows with `slot` and `shard`; columns of these names are replaced."""
    spark = df.sparkSession
    owner = table(shards, size)
    rows = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner.tolist())], "slot long, shard string")
    kept = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(size)).cast("long"))
    return kept.join(F.broadcast(rows), "slot").select(*kept.columns, "shard")


def write(df: DataFrame, path: str, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> None:
    """Writes one folder for each shard; rows of a shard are dealt by slot, so no task gets a whole shard."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assign(df, shards, key, size).repartition(n, "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the shard of each document, of 256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign(docs, [f"shard-{i:05d}" for i in range(256)])
