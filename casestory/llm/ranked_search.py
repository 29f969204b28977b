"""Ranked lexical search by term-at-a-time evaluation with limited accumulators.

Documents are read once: each gives its number of terms and the frequencies of those terms that some
item may ask for, found in a fixed bit table of the items' terms. Document frequencies, the
number and length of documents come from that table, and with them the weight of every term.

The documents of a task are indexed in blocks. For each item the postings of its terms are
added rarest term first. A document gets an accumulator when a term first meets it; once the terms
still to come cannot lift a new document to the k-th partial score, no more accumulators are made
and the later terms only update the survivors, exactly. The k-th score of earlier blocks of the task
holds for the later ones. A task returns k rows per item, so the last ranking sees k rows per item
and task.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casestory.llm.common import stash

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FILTER_BITS = 23
#: Documents and postings of a block; item terms that are handled at once.
BLOCK_DOCS, BLOCK_POSTINGS, ITEM_TERMS = 16384, 2_000_000, 200_000
KNOWN = 200_000

_UPPER = {c: c + 32 for c in range(65, 91)}


def terms_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``iid, item, term`` once per item row and different term; ``iid`` numbers the item rows."""
    def run(batches):
        find = re.compile(TERM).findall
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = dict.fromkeys(find((text or "").translate(_UPPER)))
                out += found
                at += [i] * len(found)
            own = batch.select(["iid", "item"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.string())], ["iid", "item", "term"])
    rows = items.select(F.monotonically_increasing_id().alias("iid"), F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(run, f"iid long, item {kind}, term string")


def bit_table(terms: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bit table of the terms' hashes: at most 2^(bits - 6) words reach the driver."""
    slot = F.shiftrightunsigned(F.xxhash64("term"), 64 - bits)
    words = (terms.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(term), {64 - bits}) & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    out = np.zeros(1 << (bits - 6), np.uint64)
    for word, value in words:
        out[word] = value & (2**64 - 1)
    return out


def frequencies(docs: DataFrame, table, id_col: str, text_col: str, bits: int = FILTER_BITS) -> DataFrame:
    """``doc, n, terms, tfs``: per document with a term its number of terms and the frequencies of
    those that pass the bit table."""
    def run(batches):
        find, words, known = re.compile(TERM).findall, table.value, {}

        def passes(term):
            slot = xxhash.xxh64_intdigest(term.encode(), 42) >> (64 - bits)
            return int(words[slot >> 6]) >> (slot & 63) & 1

        for batch in batches:
            sizes, terms, tfs, ends = [], [], [], [0]
            for text in batch.column("text"):
                found = find((text.as_py() or "").translate(_UPPER))
                sizes.append(len(found))
                if len(known) > KNOWN:
                    known.clear()
                for term, n in Counter(found).items():
                    hit = known.get(term)
                    if hit is None:
                        hit = known[term] = passes(term)
                    if hit:
                        terms.append(term)
                        tfs.append(n)
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))],
                ["doc", "n", "terms", "tfs"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, n long, terms array<string>, tfs array<bigint>").where("n > 0")


def length_part(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """m of a document: 50 and half its length in hundredths of the mean."""
    return 50 + (50 * n * docs) // length


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Block:
    """Postings of a block of documents by term number."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.ids, self.doc, self.value = ids, doc[order], value[order]
        self.terms, starts = np.unique(term[order], return_index=True)
        self.ends = np.append(starts, len(order))
        self.most = np.maximum.reduceat(self.value, starts) if len(starts) else starts

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int):
        """(scores, documents, accumulators made) of the k best with a score above 0 and of at
        least ``floor``. ``terms`` come rarest first."""
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        at, weights = at[there], weights[there]
        bound = weights * self.most[at]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # rest[i]: the most that terms i, i + 1, ... add
        score = np.zeros(len(self.ids), dtype=np.int64)
        alive = np.zeros(len(self.ids), dtype=bool)
        made, limit, creating = 0, floor, True
        for i, (t, w) in enumerate(zip(at, weights)):
            if creating:
                if made >= k and rest[0] - rest[i] > rest[i]:  # else no partial score can pass the rest
                    limit = max(limit, int(np.partition(score, -k)[-k]))
                creating = rest[i] >= limit
            span = slice(self.ends[t], self.ends[t + 1])
            doc, add = self.doc[span], w * self.value[span]
            if not creating:
                held = alive[doc]
                doc, add = doc[held], add[held]
            else:
                made += int((~alive[doc]).sum())
                alive[doc] = True
            score[doc] += add  # a document has a term once
        keep = score > max(0, floor - 1)
        if keep.sum() > k:
            keep &= score >= np.partition(score, -k)[-k]
        best = np.flatnonzero(keep)
        best = best[np.lexsort((self.ids[best], -score[best]))][:k]
        return score[best], self.ids[best], made


def _ranked(held: DataFrame, entries, docs: int, length: int, k: int) -> DataFrame:
    """``iid, doc, score``: per task the k best documents of each item."""
    def run(batches):
        words, numbers, items = entries.value
        last = np.iinfo(np.int64).max
        best = {iid: (np.empty(0, np.int64), np.empty(0, np.int64)) for iid, _, _ in items}

        def search(parts):
            ids, n, doc, term, tf = (np.concatenate(c) for c in zip(*parts))
            block = Block(ids, doc, term, impact(tf, length_part(n, docs, length)[doc]))
            for iid, terms, weights in items:
                scores, found = best[iid]
                s, d, _ = block.search(terms, weights, k, int(scores[-1]) if len(scores) == k else 0)
                s, d = np.concatenate([scores, s]), np.concatenate([found, d])
                order = np.lexsort((d, -s))[:k]
                best[iid] = s[order], d[order]

        parts, at, size = [], 0, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                piece = batch.slice(begin, 1024)
                terms = piece.column("terms")
                per = np.diff(terms.offsets.to_numpy())
                flat = terms.flatten()
                code = np.fromiter(map(numbers.get, flat.to_pylist(), (-1 for _ in range(len(flat)))), dtype=np.int64, count=len(flat))
                doc, tf = np.repeat(np.arange(len(per)), per), piece.column("tfs").flatten().to_numpy()
                asked = code >= 0
                parts.append((piece.column("doc").fill_null(last).to_numpy(), piece.column("n").to_numpy(), doc[asked] + at, code[asked], tf[asked]))
                at += len(per)
                size += int(asked.sum())
                if at >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    search(parts)
                    parts, at, size = [], 0, 0
        if parts:
            search(parts)
        for iid, (scores, found) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), iid)), pa.array(found, mask=found == last), pa.array(scores)], ["iid", "doc", "score"])
    return held.mapInArrow(run, "iid long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """``item, rank, doc, score`` of the k highest-scoring documents with a score above 0 per item row.

    Equal scores go by id, a null id last. Null and empty texts have no terms: such documents count
    nowhere and such items give no rows. Repeated documents are ranked each for itself, repeated
    items each get their rows. Fewer than k matches give all; empty tables give no rows. Items are
    handled in blocks of about ``item_terms`` terms, which is what a task and the driver hold.
    """
    spark = docs.sparkSession
    asked = stash(terms_of(items, item_col, item_text), "item-terms")
    kind = asked.schema["item"].dataType.simpleString()
    none = spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    table = spark.sparkContext.broadcast(bit_table(asked.select("term").distinct()))
    held = stash(frequencies(docs, table, id_col, text_col), "frequencies")
    n_docs, length = held.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return none
    each = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * F.lit(n_docs) + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighted = stash(asked.join(each, "term").withColumn("weight", weight.cast("long")), "weighted")
    total = weighted.count()
    blocks = max(1, -(-total // item_terms))
    parts = []
    for block in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("iid"), F.lit(blocks)) == block).select("iid", "term", "df", "weight").collect()
        rows.sort(key=lambda r: (r["iid"], r["df"], r["term"]))
        words = sorted({r["term"] for r in rows})
        numbers = {t: c for c, t in enumerate(words)}
        by_item: dict[int, list] = {}
        for r in rows:
            by_item.setdefault(r["iid"], []).append((numbers[r["term"]], r["weight"]))
        listed = [(iid, *np.array(e, dtype=np.int64).T) for iid, e in by_item.items()]
        parts.append(_ranked(held, spark.sparkContext.broadcast((words, numbers, listed)), n_docs, length, k))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("iid").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = weighted.select("iid", "item").distinct()
    return ranked.join(names, "iid").select("item", "rank", "doc", "score")
