"""Exact dedup by composable polynomial fingerprints.

A text is hashed in chunks; the hash of a concatenation follows from the hashes of its parts by
a length shift, H(AB) = H(A) r^|B| + H(B) modulo a prime, so chunks are hashed independently and
combined (``combine``). Texts with equal fingerprints are then compared chunk by chunk: copies
of a text agree in every chunk, so per (fingerprint, chunk number) the smallest and the largest
chunk must be equal. This aggregate is combined before the shuffle, streams through sorted
chunks and never holds a group. Where it finds a difference, the fingerprint's texts are told
apart by their SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.llm.common import join_groups, keyed, powers, stash

#: Two primes below 2^31: a product of a byte and a power fits 39 bits, a chunk's sum 55.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1299709721)
CHUNK = 1 << 16


def power_table(base: int, prime: int, n: int) -> np.ndarray:
    """base^(n-1) .. base^0 modulo prime, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n][::-1].copy()


def combine(left: tuple, right: tuple, primes=PRIMES, bases=BASES) -> tuple:
    """(length, h1, h2) of AB from those of A and B."""
    n = right[0]
    return (left[0] + n, *((left[i + 1] * pow(bases[i], n, primes[i]) + right[i + 1]) % primes[i] for i in range(2)))


def chunk_hash(chunk: bytes, tables: list, primes=PRIMES) -> tuple:
    data = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64)
    return (len(chunk), *(int((data * t[len(t) - len(data):]).sum() % np.uint64(p)) for t, p in zip(tables, primes)))


def fingerprint(data: bytes, tables: list, primes=PRIMES, bases=BASES, chunk: int = CHUNK) -> tuple:
    out = (0, 0, 0)
    for k in range(0, len(data), chunk):
        out = combine(out, chunk_hash(data[k:k + chunk], tables, primes), primes, bases)
    return out


def squeeze(text: str) -> bytes:
    """UTF-8 without the white space [\\x20\\x09-\\x0D] (bytes.split knows these six alone)."""
    return b"".join((text or "").encode().split())


def fingerprints(rows: DataFrame, primes=PRIMES, bases=BASES, chunk: int = CHUNK) -> DataFrame:
    """``id, th, n_chars, n_bytes, h1, h2, sha`` of ``keyed`` rows."""
    def run(batches):
        tables = [power_table(b, p, chunk) for b, p in zip(bases, primes)]
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py()
                data = squeeze(text)
                out.append((len(text), *fingerprint(data, tables, primes, bases, chunk), hashlib.sha256(data).hexdigest()))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())],
                ["id", "th", "n_chars", "n_bytes", "h1", "h2", "sha"])
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, th long, n_chars long, n_bytes long, h1 long, h2 long, sha string")


def chunks(rows: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """``keys..., chunk_no, part``: the normalised texts cut into chunks."""
    def run(batches):
        for batch in batches:
            held = [batch.column(k).to_pylist() for k in keys]
            out, size = [], 0
            for i, text in enumerate(batch.column("text")):
                data = squeeze(text.as_py())
                for no, k in enumerate(range(0, len(data), chunk)):
                    out.append((*(h[i] for h in held), no, data[k:k + chunk]))
                    size += chunk if len(data) > chunk else len(data)
                if size > 8 << 20:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

    def batch_of(out):
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())],
                                          [*keys, "chunk_no", "part"])
    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", chunk_no long, part binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 primes=PRIMES, bases=BASES, chunk: int = CHUNK) -> DataFrame:
    """One row per different (id, text): ``id, th, keep_id, keep_th, group_size, copies, kept, sha``.

    Of equal texts the one with the most code points stays, then the smallest id (a null id comes
    last). ``copies`` counts the rows that repeat id and text; they count in ``group_size``. Null
    and empty texts are equal to each other and to texts of white space only. An empty table
    gives an empty result; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    facts = ["n_chars", "n_bytes", "h1", "h2", "sha"]
    fps = stash(fingerprints(rows, primes, bases, chunk).groupBy("id", "th").agg(
        *(F.first(c).alias(c) for c in facts), F.count("*").alias("copies")), "fingerprints")
    key = ["n_bytes", "h1", "h2"]
    many = stash(fps.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1 and n_bytes > 0"), "repeated")
    again = join_groups(fps.select(*key, F.col("id").alias("a_id"), F.col("th").alias("a_th")), many, key, "n")
    texts = rows.select("id", "th", "text").join(
        again, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("th") == F.col("a_th")))
    differ = stash(chunks(texts.select(*key, "text"), key, chunk)
                   .groupBy(*key, "chunk_no").agg(F.min("part").alias("least"), F.max("part").alias("most"))
                   .where("least <> most").select(*key).distinct().withColumn("differ", F.lit(True)), "collisions")
    named = fps.withColumn("part", F.lit(""))
    if not differ.isEmpty():
        named = (fps.join(differ, key, "left")
                 .withColumn("part", F.when(F.col("differ"), F.col("sha")).otherwise(F.lit(""))).drop("differ"))
    key = [*key, "part"]
    best = F.min_by(F.struct(F.col("id").alias("keep_id"), F.col("th").alias("keep_th")),
                    F.struct(-F.col("n_chars"), F.col("id").isNull(), "id", "th"))
    groups = stash(named.groupBy(*key).agg(F.sum("copies").alias("group_size"), F.count("*").alias("n"),
                                           best.alias("best")), "groups")
    out = join_groups(named, groups, key, "n").select(
        "id", "th", "best.keep_id", "best.keep_th", "group_size", "copies", "sha")
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group."""
    kept = stash(exact_groups(docs, id_col, text_col).where("kept").select(
        F.col("id").alias("__id"), F.col("th").alias("__th"), "copies"), "kept")
    rows = docs.withColumn("__t", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.join(kept.drop("copies"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th")), "left_semi")
    if not kept.where("copies > 1").isEmpty():
        rows = rows.dropDuplicates([id_col, "__t"])
    return rows.select(*docs.columns)
