"""The set of keys met so far, for loops that ask about a few keys at a time.

Keys stay in the tables that brought them; sixteen small tables are merged into one, sixteen of those into the
next, so there are few at any time and a key is rewritten a logarithm of times. A Bloom filter of all keys, one
64-bit word and four bits for each key, is kept as at most ``words`` numbers: a key whose bits aren't all set
is new, without a look at the tables, and a round that brings only new keys costs what it brings. The others
are compared exactly. A full filter merely sends more keys to that comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import written

_FAN = 16


def unions(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Seen:
    def __init__(self, spark: SparkSession, keys: list[str], words: int = 1 << 16):
        self.spark, self.keys = spark, keys
        self.bits = np.zeros(words, np.int64)
        self.tiers: list[list[DataFrame]] = [[]]

    def _hashed(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.keys])
        bits = [f"shiftleft(1L, CAST(shiftright(_h, {20 + 8 * k}) & 63 AS INT))" for k in range(4)]
        word = F.pmod("_h", F.lit(len(self.bits))).cast("int")
        return rows.withColumn("_h", h).withColumns({"_word": word, "_mask": F.expr(" | ".join(bits))}).drop("_h")

    def add(self, rows: DataFrame) -> None:
        """Take in ``rows``, a written table of distinct keys that weren't in."""
        for r in self._hashed(rows.select(*self.keys)).groupBy("_word").agg(F.bit_or("_mask").alias("bits")).collect():  # at most ``words`` rows
            self.bits[r["_word"]] |= r["bits"]
        self.tiers[0].append(rows.select(*self.keys))
        for k, tier in enumerate(self.tiers):
            if len(tier) == _FAN:
                if k + 1 == len(self.tiers):
                    self.tiers.append([])
                self.tiers[k + 1].append(written(unions(tier), "seen"))
                tier.clear()

    def marked(self, rows: DataFrame, out: str) -> DataFrame:
        """``rows`` with ``out``: false where the key is new by the filter, null where ``known`` has to tell."""
        at = np.flatnonzero(self.bits)
        bloom = self.spark.createDataFrame(pd.DataFrame({"_word": at.astype(np.int32), "_bits": self.bits[at]}), "_word int, _bits long")
        asked = self._hashed(rows).join(F.broadcast(bloom), "_word", "left")  # at most ``words`` rows
        maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
        return asked.withColumn(out, F.when(~maybe, F.lit(False))).drop("_word", "_bits", "_mask")

    def known(self, marked: DataFrame, out: str) -> DataFrame:
        """``marked`` with every null of ``out`` settled against the tables."""
        held = unions([t for tier in self.tiers for t in tier])
        held = held.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(self.keys)], F.lit(True).alias("_held"))
        same = F.col(out).isNull()
        for n, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
        return marked.join(held, same, "left").withColumn(out, F.col("_held").isNotNull()).select(*marked.columns)
