"""Shared pieces: written intermediate tables, row identity, skew-safe group joins, hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with at least this share of all rows is "hot"; there are at most 1 / share of them.
HOT_SHARE = 1 / 2000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch folder only for a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at replicated files,
    so a lost executor costs a re-read and never the work before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, text``: the id as it is, a hash of the text, the text with null as ''.

    (id, th) names a row by content, so it survives recomputation; rows that repeat both are
    true copies of each other and get equal results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def held_out(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text leaves remainder 2 (a null id counts as the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod == 2


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str,
                how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """Join ``rows`` with one-row-per-key ``groups`` when a key may hold a third of all rows.

    ``groups[size]`` is the number of rows of the key. Keys with at least ``share`` of the total
    are at most ``1 / share`` by arithmetic, so that part is broadcast; the others are small and
    meet in a shuffle join. ``how`` is inner or left. Both inputs are read twice: pass tables.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(2, int(total * share))
    hot = F.broadcast(groups.where(F.col(size) >= limit))
    cold = groups.where(F.col(size) < limit)
    on_hot = rows.join(hot, keys, "inner")
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return on_hot.unionByName(rest.join(cold, keys, how))


# ---- polynomial hashes of byte strings, modulo 2^64 (vectorised) -------------------------------

def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class ByteHash:
    """Hashes of many substrings of one byte string from one prefix sum.

    With P[i] = sum of code(b_j) B^j over j < i, the hash of [s, e) is (P[e] - P[s]) B^-s, the
    same wherever the substring stands. B is odd and so has an inverse modulo 2^64. Positions
    are relative to ``block`` byte blocks only through the length of the power tables, which grow
    to the longest string seen.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 7):
        self.codes = _byte_codes(seed)
        self.inverse = pow(self.BASE, -1, 2**64)
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        self.up, self.down = powers(self.BASE, n), powers(self.inverse, n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.up) - 1:
            self.grow(2 * n)
        out = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.codes[data] * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * self.down[start])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the high bits over the whole word (finaliser of a public 64-bit hash)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))
