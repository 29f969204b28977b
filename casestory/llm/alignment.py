"""Alignment of the tokens that two tokenizers make of the same text.

Both token rows of a batch of documents stand in one byte line. ``pandas.merge_asof``, keyed by
document, finds for every token's start the covering token of the other side; both directions
together are all overlaps. Where the last overlapping tokens end together the text is cut, and the
tokens between two cuts are a group.

A document's id pairs (a token of either side in one group) are counted over the corpus: batches
are written with their different pairs, the pairs are counted by a grouping that combines on the map
side, and each batch gets the counts of its own pairs back.

A byte-level BPE vocabulary (A) and a sentencepiece model (B) are read on the driver and sent to the
tasks, 2 MB for the public ones; executors need no such files. Texts are encoded in chunks that
begin at a space between two other characters, where neither tokenizer joins, and chunks are
remembered within a task.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestory.llm.common import keyed, stash

#: Tokens of one batch and of one call of the alignment, at most about; chunks remembered in a task.
BATCH, PART, KNOWN = 1_500_000, 400_000, 400_000
#: A chunk of more characters is not remembered, and its A side goes to the tokenizer whose time
#: does not grow with the square of a word.
LONG = 512
#: Id pairs of one group that are held at once.
PAIRS = 2_000_000


# ---- tokenizers ---------------------------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: visible characters stand for themselves, the
    other bytes, in order, for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers of a task, with the byte lengths of their tokens."""

    def __init__(self, byte_json: bytes, piece_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(byte_json.decode())
        self.slow.encode_special_tokens = True
        given = json.loads(byte_json)
        special = {t["content"] for t in given["added_tokens"]}
        alphabet = byte_alphabet()
        vocab = {t: i for t, i in given["model"]["vocab"].items() if t not in special}
        self.a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        # ids in the order of the merges are ranks; else only the slow way is open
        pairs = [m if isinstance(m, list) else m.split(" ") for m in given["model"]["merges"]]
        made = [vocab["".join(m)] for m in pairs]
        splits = given["pre_tokenizer"] or {}
        self.quick = None
        if made == sorted(made) and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space"):
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in self.a_bytes.items()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.b_bytes = {i: self._piece(i) for i in range(self.pieces.vocab_size())}
        # a piece with a space after another character could join two chunks
        self.apart = not any(re.search(b"[^ ] ", p) for p in self.b_bytes.values())
        self.n_a, self.n_b = max(self.a_bytes, default=0) + 1, len(self.b_bytes)
        self.a_len = np.array([len(self.a_bytes.get(i, b"")) for i in range(self.n_a)])
        self.b_len = np.array([len(self.b_bytes[i]) for i in range(self.n_b)])

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[3:5], 16)])
        return self.pieces.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, chunk: str) -> tuple[list[int], list[int], bool]:
        """A and B ids of a chunk, which begins with a space, and whether both spell it."""
        if self.quick is None or len(max(chunk.split(" "), key=len)) > LONG:
            a = self.slow.encode(chunk, add_special_tokens=False).ids
        else:
            a = self.quick.encode_ordinary(chunk)
        b = self.pieces.encode(chunk[1:])
        data = chunk.encode()
        return a, b, b"".join(map(self.a_bytes.get, a)) == data and b"".join(map(self.b_bytes.get, b)) == data

    _odd = re.compile(r" \s|\s ").search
    _border = re.compile(r"(?<=\S)(?= \S)").split

    def chunks(self, text: str) -> list[str]:
        """Chunks of space + text; each begins with a space."""
        if not self.apart:
            return [" " + text]
        if self._odd(text) or text[:1].isspace() or text[-1:].isspace():
            return self._border(" " + text)
        return [" " + w for w in text.split(" ")]


class Chunks:
    """Token ids of the chunks seen so far, in one line per side."""

    def __init__(self, tokenizers: Tokenizers):
        self.of = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.a, self.b = (array("q"), array("q", [0])), (array("q"), array("q", [0]))
        self.wrong: set[int] = set()
        self.n = 0

    def codes(self, text: str) -> list[int] | None:
        """Chunk numbers of a text; None where a side does not spell it."""
        chunks, number = self.of.chunks(text), self.number
        new = [c for c in dict.fromkeys(chunks) if c not in number]
        if new:
            number = self._learn(new)
        out = [number[c] for c in chunks]
        return None if self.wrong and not self.wrong.isdisjoint(out) else out

    def _learn(self, new: list[str]) -> dict[str, int]:
        """Encode new chunks; all numbers, those of long chunks only here. Chunks that begin and
        end as borders ask are encoded in one go and cut at their ends."""
        plain = [c for c in new if len(c) <= LONG and c[1:] and not c[1].isspace() and not c[-1].isspace()]
        a, b, right = self.of.encode("".join(plain)) if plain and self.of.quick else ([], [], False)
        if right:
            ends = np.cumsum([len(c.encode()) for c in plain])
            for (ids, at), got, lengths in ((self.a, a, self.of.a_len), (self.b, b, self.of.b_len)):
                at.extend((np.searchsorted(np.cumsum(lengths[got]), ends) + 1 + len(ids)).tolist())
                ids.extend(got)
            self.number.update(zip(plain, range(self.n, self.n + len(plain))))
            self.n += len(plain)
        number = self.number
        for chunk in new:
            if chunk in number:
                continue
            a, b, right = self.of.encode(chunk)
            for (ids, at), got in ((self.a, a), (self.b, b)):
                ids.extend(got)
                at.append(len(ids))
            if not right:
                self.wrong.add(self.n)
            if len(chunk) > LONG and number is self.number:
                number = dict(number)
            number[chunk] = self.n
            if len(chunk) <= LONG:
                self.number[chunk] = self.n
            self.n += 1
        return number

    def tokens(self, codes: np.ndarray, side) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens per chunk) of a row of chunks."""
        n = self.sizes(codes, side)
        begin = np.frombuffer(side[1], np.int64)[codes]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.frombuffer(side[0], np.int64)[at], n

    def sizes(self, codes: np.ndarray, side) -> np.ndarray:
        ends = np.frombuffer(side[1], np.int64)
        return ends[codes + 1] - ends[codes]


# ---- the alignment of a batch -------------------------------------------------------------------

def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For tokens (``at``: first byte, ``doc``), sorted by ``at``: per A token the B token that covers
    its start, and per B token the A token that covers its start. Their union is all overlaps."""
    over_a = pd.merge_asof(a, b.assign(other=np.arange(len(b))), on="at", by="doc")["other"].to_numpy(np.int64)
    over_b = pd.merge_asof(b, a.assign(other=np.arange(len(a))), on="at", by="doc")["other"].to_numpy(np.int64)
    return over_a, over_b


def groups(a_doc, a_len, b_doc, b_len) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every A and every B token; both sides spell the same bytes per document."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    over_a, over_b = overlaps(pd.DataFrame({"at": a_end - a_len, "doc": a_doc}), pd.DataFrame({"at": b_end - b_len, "doc": b_doc}))
    # the last B token that overlaps an A token covers its start or starts in it
    last = np.maximum(over_a, np.searchsorted(over_b, np.arange(len(a_len)), side="right") - 1)
    cut = b_end[last] == a_end
    b_cut = np.zeros(len(b_len), dtype=bool)
    b_cut[last[cut]] = True
    return np.cumsum(cut) - cut, np.cumsum(b_cut) - b_cut


def pair_counts(doc, a_ids, a_group, b_ids, b_group, n_b: int):
    """(document, pair, links): how many A-B token pairs of a document's groups are of an id pair.

    ``doc`` is the document of each group, a pair is a_id * n_b + b_id.
    """
    na, nb = np.bincount(a_group, minlength=len(doc)), np.bincount(b_group, minlength=len(doc))
    a_first, b_first = np.cumsum(na) - na, np.cumsum(nb) - nb
    size = na * nb
    keys, counts = [], []
    small = np.flatnonzero(size <= PAIRS)
    ends = np.cumsum(size[small])
    begin = 0
    while begin < len(small):
        stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right"))
        g = small[begin:stop]
        n = size[g]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = np.repeat(g, n)
        pair = a_ids[a_first[g] + at // nb[g]] * n_b + b_ids[b_first[g] + at % nb[g]]
        keys.append(np.stack([doc[g], pair]))
        counts.append(np.ones(len(pair), dtype=np.int64))
        begin = stop
    for g in np.flatnonzero(size > PAIRS):  # a text without common borders: different ids only
        a, ka = np.unique(a_ids[a_first[g]:a_first[g] + na[g]], return_counts=True)
        b, kb = np.unique(b_ids[b_first[g]:b_first[g] + nb[g]], return_counts=True)
        step = max(1, PAIRS // len(b))
        for s in range(0, len(a), step):
            pair = (a[s:s + step, None] * n_b + b).ravel()
            keys.append(np.stack([np.full(len(pair), doc[g]), pair]))
            counts.append(np.outer(ka[s:s + step], kb).ravel())
    return _summed(keys, counts)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Equal (document, pair) once, with the sum of their counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    (doc, pair), n = np.concatenate(keys, axis=1), np.concatenate(counts)
    order = np.lexsort((pair, doc))
    doc, pair, n = doc[order], pair[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else order
    return doc[first], pair[first], np.add.reduceat(n, first) if len(first) else n


class Batch:
    """Documents whose tokens are aligned together."""

    def __init__(self, chunks: Chunks):
        self.chunks = chunks
        of = chunks.of
        # text of an id as it stands in a group list, followed by , | ; or nothing
        self.text = [[f"{i}{s}" for i in range(max(of.n_a, of.n_b))] for s in (",", "|", ";")]
        self.text = [t for row in zip(*self.text) for t in row]
        self.clear()

    def clear(self) -> None:
        self.rows, self.held, self.pending, self.size, self.total = [], [], [], 0, 0

    def add(self, id_, th, codes: list[int] | None) -> None:
        """A document, in parts of at most about PART tokens: a cut stands between all chunks."""
        doc = len(self.rows)
        self.rows.append({"id": id_, "th": th, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": hashlib.sha256() if codes else None})
        lengths = None
        if codes:
            codes = np.array(codes)
            lengths = np.cumsum(self.chunks.sizes(codes, self.chunks.a))
        begin = 0
        while lengths is not None and begin < len(codes):
            stop = max(begin + 1, int(np.searchsorted(lengths, (lengths[begin - 1] if begin else 0) + PART - self.size)))
            self.pending.append((doc, codes[begin:stop]))
            self.size += int(lengths[stop - 1] - (lengths[begin - 1] if begin else 0))
            begin = stop
            if self.size >= PART:
                self.align()

    def align(self) -> None:
        if not self.pending:
            return
        docs, parts = zip(*self.pending)
        codes = np.concatenate(parts)
        at = np.repeat(np.array(docs), [len(p) for p in parts])
        of = self.chunks.of
        a, per_a = self.chunks.tokens(codes, self.chunks.a)
        b, per_b = self.chunks.tokens(codes, self.chunks.b)
        a_doc, b_doc = np.repeat(at, per_a), np.repeat(at, per_b)
        ga, gb = groups(a_doc, of.a_len[a], b_doc, of.b_len[b])
        na, nb = np.bincount(ga), np.bincount(gb)
        first = np.cumsum(na) - na
        doc = a_doc[first]
        self.held.append(pair_counts(doc, a, ga, b, gb, of.n_b))
        self._write(docs[0], doc, a, ga, na, b, gb, nb)
        low = docs[0]
        sums = [np.bincount(d - low, w, minlength=docs[-1] - low + 1).astype(np.int64) for d, w in
                ((a_doc, None), (b_doc, None), (doc, None), (doc, na * nb))]
        for row, *n in zip(self.rows[low:], *sums):
            for name, x in zip(("n_a", "n_b", "n_groups", "n_links"), n):
                row[name] += int(x)
        self.total += len(a)
        self.pending, self.size = [], 0

    def _write(self, low, doc, a, ga, na, b, gb, nb) -> None:
        """Group lists into the documents' hashes: a1,a2|b1;a3|b2 with a ; also where a part goes on."""
        before_a, before_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        line = np.empty(len(a) + len(b), dtype=np.int64)
        ends_a, ends_b = np.cumsum(na) - 1, np.cumsum(nb) - 1
        mark = np.zeros(len(a), dtype=np.int64)
        mark[ends_a] = 1
        line[np.arange(len(a)) + before_b[ga]] = a * 3 + mark
        mark = np.zeros(len(b), dtype=np.int64)
        mark[ends_b] = 2
        line[np.arange(len(b)) + (before_a + na)[gb]] = b * 3 + mark
        tokens = np.bincount(doc - low, na + nb).astype(np.int64)
        listed, at = [self.text[c] for c in line.tolist()], 0
        for k, n in enumerate(tokens.tolist()):
            if n:
                row = self.rows[low + k]
                text = "".join(listed[at:at + n])[:-1]
                row["sha"].update((";" + text if row["n_a"] else text).encode())
                at += n

    def result(self) -> tuple[np.ndarray, np.ndarray, list[dict]]:
        """The batch's different pairs, how many documents hold each, and the documents, each with
        its pairs (as places in that list) and their links."""
        self.align()
        doc, pair, links = _summed([np.stack(h[:2]) for h in self.held], [h[2] for h in self.held])
        pairs, at, holders = np.unique(pair, return_inverse=True, return_counts=True)
        ends = np.searchsorted(doc, np.arange(len(self.rows) + 1))
        at, links = at.astype("<u4"), links.astype("<u8")
        # links of up to 2^16 - 1 each fit two bytes, and nearly always do
        docs = []
        for k, r in enumerate(self.rows):
            own = links[ends[k]:ends[k + 1]]
            own = own.astype("<u2") if not len(own) or own.max() < 2**16 else own
            docs.append({"id": r["id"], "th": r["th"], "n_a": r["n_a"], "n_b": r["n_b"], "n_groups": r["n_groups"], "n_links": r["n_links"],
                         "sha": r["sha"].hexdigest() if r["sha"] else "", "at": at[ends[k]:ends[k + 1]].tobytes(), "links": own.tobytes()})
        return pairs, holders, docs


def _batches(rows: DataFrame, sources) -> DataFrame:
    """``pairs, holders, docs``: one row per batch of documents."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        chunks = Chunks(Tokenizers(*sources.value))
        batch, types = Batch(chunks), None

        def row():
            pairs, holders, docs = batch.result()
            batch.clear()
            if chunks.n > KNOWN:
                chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array([pairs], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int64())), pa.array([docs], pa.list_(types))], ["pairs", "holders", "docs"])

        for given in batches:
            if types is None:
                types = pa.struct([("id", given.column("id").type), ("th", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                                   ("n_links", pa.int64()), ("sha", pa.string()), ("at", pa.binary()), ("links", pa.binary())])
            for id_, th, text in zip(given.column("id").to_pylist(), given.column("th").to_pylist(), given.column("text")):
                text = text.as_py()
                batch.add(id_, th, chunks.codes(text) if text else None)
                if batch.total + batch.size >= BATCH or chunks.n > KNOWN or len(batch.rows) >= 20_000:
                    yield row()
        if batch.rows:
            yield row()
    docs = f"array<struct<id:{kind},th:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,sha:string,at:binary,links:binary>>"
    return rows.mapInArrow(run, f"pairs array<bigint>, holders array<bigint>, docs {docs}")


def align(docs: DataFrame, byte_json: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, th, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A tokenizes space + text, B the text, to which it adds the space. Null and empty texts, and
    texts that a side does not spell byte for byte, have no tokens: zeros and an empty hash. An id
    pair's count is the number of rows that hold it linked; rows that repeat a document count
    each. ``n_best`` are links whose count is the highest of their A id, ``count_sum`` the counts
    summed over links. Empty tables give no rows.
    """
    spark = docs.sparkSession
    with open(byte_json, "rb") as f, open(piece_model, "rb") as g:
        given = f.read(), g.read()
    n_b = Tokenizers(*given).n_b
    held = _batches(keyed(docs, id_col, text_col), spark.sparkContext.broadcast(given))
    held = stash(held.withColumn("batch", F.monotonically_increasing_id()), "aligned")
    each = held.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.pairs", "p.holders")
    counts = stash(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n")), "pair-counts")
    # as many rows as A has ids
    top = counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("n").alias("top"))
    known = counts.withColumn("a", F.floor(F.col("pair") / n_b)).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    asked = held.select("batch", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(known, "pair").groupBy("batch").agg(F.collect_list(F.struct("at", "n", "best")).alias("answers"))  # bounded by the batch
    met = held.select("batch", "docs").join(answers.withColumnRenamed("batch", "b"), F.col("batch") == F.col("b"), "left")
    return met.select("docs", "answers").mapInArrow(_totals, _result(keyed(docs, id_col, text_col)))


def _result(rows: DataFrame) -> str:
    kind = rows.schema["id"].dataType.simpleString()
    return f"id {kind}, th long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _totals(batches):
    names = ["id", "th", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for batch in batches:
        for k in range(batch.num_rows):
            docs, answers = batch.column("docs")[k].values, batch.column("answers")[k].values
            count = best = np.zeros(0, dtype=np.int64)
            if answers is not None and len(answers):
                at = answers.field("at").to_numpy()
                count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                count[at] = answers.field("n").to_numpy()
                best[at] = answers.field("best").to_numpy(zero_copy_only=False)
            sums, bests = [], []
            for at, links in zip(docs.field("at"), docs.field("links")):
                at, links = np.frombuffer(at.as_py(), "<u4"), links.as_py()
                links = np.frombuffer(links, "<u2" if len(links) == 2 * len(at) else "<u8").astype(np.int64)
                sums.append(int(links @ count[at]))
                bests.append(int(links @ best[at]))
            own = [docs.field(n) for n in ("id", "th", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), docs.field("sha")], names)


def tokenizer_files(spark: SparkSession) -> tuple[str, str]:
    """Byte-level vocabulary and piece model in the session's ``casestory.tokenizers`` folder, else
    in the public one."""
    folder = spark.conf.get("casestory.tokenizers", "/opt/tokenizers")
    return f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model"
