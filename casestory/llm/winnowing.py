"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-word hash in every run of w consecutive k-grams, so any
two texts that share k + w - 1 words share a fingerprint: with k = 5 and w = 6 every shared
window of 10 words is found. Documents' fingerprints meet the benchmark's on equality, hits are
extended to the windows around them, and a window counts when its 128-bit hash is one of the
benchmark's.

Before the join a document's fingerprint is looked up in a bit table of the benchmark's
fingerprints. Its size is fixed (2^23 bits, 1 MB) whatever the benchmark; a large benchmark fills
it and lets more through, never less. Items shorter than a window are one window of their own
length; for these lengths every gram of a document is looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.llm.common import ByteHash, keyed, stash

WINDOW, GRAM = 10, 5
FILTER_BITS = 23
#: Bytes that are no part of a word, after lower-casing: all ASCII but digits and letters.
SEPARATORS = bytes(0x20 if b < 0x30 or 0x39 < b < 0x61 or 0x7A < b < 0x80 else b for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(SEPARATORS).split()


class Grams:
    """A text's words on one line, with hashes of any run of words."""

    def __init__(self, words: list[bytes], hasher: ByteHash):
        self.hasher, self.n, self.line = hasher, len(words), b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=self.n)
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        self.prefix = hasher.prefix(np.frombuffer(self.line, dtype=np.uint8))

    def hashes(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words (64 bits)."""
        n = self.n - size + 1
        return self.hasher.spans(self.prefix, self.start[:n], self.end[size - 1:]) if n > 0 else np.zeros(0, np.uint64)

    def exact(self, at: int, size: int) -> bytes:
        """128-bit hash of one run of words."""
        return xxhash.xxh3_128_digest(self.line[self.start[at]:self.end[at + size - 1]])

    def winnowed(self, gram: int, window: int) -> np.ndarray:
        """Positions of the smallest gram hash in every run of window - gram + 1 grams."""
        h, w = self.hashes(gram), window - gram + 1
        if len(h) < w:
            return np.zeros(0, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``item, size, window, mark``: each item's windows; ``mark``: hashes to look for in documents.

    Full windows carry the fingerprints of the window itself, short items their own hash.
    """
    def run(batches):
        hasher = ByteHash()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                g = Grams(normal_words(text), hasher)
                size = min(window, g.n)
                if not size:
                    continue
                if size < window:
                    out.append((item, size, g.exact(0, size), int(g.hashes(size)[0].astype(np.int64))))
                    continue
                h = g.hashes(gram).astype(np.int64)
                w = window - gram + 1
                least = np.lib.stride_tricks.sliding_window_view(h.view(np.uint64), w).argmin(axis=1) + np.arange(len(h) - w + 1)
                out += [(item, window, g.exact(i, window), int(h[p])) for i, p in enumerate(least)]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.column("item").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()),
                 pa.array(cols[3], pa.int64())], ["item", "size", "window", "mark"])
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(run, f"item {kind}, size int, window binary, mark long")


def bit_table(marks: DataFrame, bits: int = FILTER_BITS) -> dict[int, np.ndarray]:
    """size -> bit table of its marks; at most 2^(bits - 6) words of 64 bits for each of the
    at most ten sizes reach the driver."""
    slot = F.shiftrightunsigned(F.col("mark"), 64 - bits)
    words = (marks.select("size", F.shiftright(slot, 6).alias("word"),
                          F.expr(f"shiftleft(1L, cast(shiftrightunsigned(mark, {64 - bits}) & 63 as int))").alias("bit"))
             .groupBy("size", "word").agg(F.bit_or("bit").alias("bits")).collect())
    out: dict[int, np.ndarray] = {}
    for size, word, value in words:
        out.setdefault(size, np.zeros(1 << (bits - 6), np.uint64))[word] = np.uint64(value & (2**64 - 1))
    return out


def candidates(rows: DataFrame, tables, bits: int = FILTER_BITS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id, th, n_words`` once per row, and ``start, size, mark, window`` per gram that may hit."""
    def run(batches):
        hasher, known = ByteHash(), tables.value

        def passing(size, h):
            slot = h >> np.uint64(64 - bits)
            return (known[size][(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0

        def batch_of(out, kind):
            cols = list(zip(*out))
            types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              ["id", "th", "n_words", "start", "size", "mark", "window"])

        for batch in batches:
            out, kind = [], batch.column("id").type
            for id_, th, text in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("text")):
                g = Grams(normal_words(text.as_py()), hasher)
                out.append((id_, th, g.n, None, None, None, None))
                for size in known:
                    if size < window:
                        h = g.hashes(size)
                        for p in np.flatnonzero(passing(size, h)):
                            out.append((id_, th, None, int(p), size, int(h[p].astype(np.int64)), g.exact(p, size)))
                        continue
                    at = g.winnowed(gram, window)
                    h = g.hashes(gram)[at]
                    for p, mark in zip(at[passing(size, h)], h[passing(size, h)].astype(np.int64)):
                        for s in range(max(0, p - window + gram), min(p, g.n - window) + 1):
                            out.append((id_, th, None, int(s), size, int(mark), g.exact(s, size)))
                if len(out) > 20_000:
                    yield batch_of(out, kind)
                    out = []
            if out:
                yield batch_of(out, kind)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, th long, n_words long, start long, size int, mark long, window binary")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: ``id, th, n_words, n_hit, items, hits``.

    ``items`` are the ids of the items with an occurring window, as text, sorted; ``hits`` the
    word ranges [start, end) that occurring windows cover, merged. Null texts have no words; items
    without words have no window; equal items all count; a null item id shows as ''. Rows
    that repeat id and text get equal results. Empty tables on either side give no hits.
    """
    spark = docs.sparkSession
    marks = stash(benchmark_windows(items, item_col, item_text, window, gram), "benchmark")
    tables = spark.sparkContext.broadcast(bit_table(marks))
    found = stash(candidates(keyed(docs, id_col, text_col), tables, FILTER_BITS, window, gram), "candidates")
    # fingerprints join first, then the extended windows; both sides without repeats
    hits = (found.where("start is not null").join(marks.select("size", "mark").distinct(), ["size", "mark"], "left_semi")
            .join(marks.select("size", "window").distinct(), ["size", "window"], "left_semi")
            .select("id", "th", "start", "size", "window").distinct())
    hits = stash(hits, "hits")
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
                              F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                                       F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                                                        F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    spans = hits.groupBy("id", "th").agg(merged.alias("hits"))
    # a window's items: (document, window) pairs and (window, item) pairs without repeats
    owners = marks.select("size", "window", F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item")).distinct()
    by_item = (hits.select("id", "th", "size", "window").distinct().join(owners, ["size", "window"])
               .groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items")))
    flagged = spans.join(by_item, (spans.id.eqNullSafe(by_item.id)) & (spans.th == by_item.th)).select(
        spans.id.alias("f_id"), spans.th.alias("f_th"), "hits", "items")
    all_rows = found.where("n_words is not null").select("id", "th", "n_words")
    out = all_rows.join(flagged, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    none = F.array().cast("array<string>")
    return out.select("id", "th", "n_words",
                      F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).alias("n_hit"),
                      F.coalesce("items", none).alias("items"), "hits")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    hit = stash(contamination(docs, items, id_col, text_col).where("n_hit > 0").select(
        F.col("id").alias("__id"), F.col("th").alias("__th")).distinct(), "contaminated")
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(hit, docs[id_col].eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left_anti")
