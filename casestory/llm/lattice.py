"""LM scoring by subword lattice likelihood.

The pieces are those of an existing byte-level vocabulary. A word, led by a space, is a lattice
of all its segmentations into pieces; its probability is their sum, by forward recursion in log
space. Pieces that begin with a space begin words and no others do, so the lattice of a document
is the chain of its words' lattices and its marginal log probability the sum of theirs.

Piece scores start from the vocabulary's ranks and are re-estimated on the different training
words by expectation-maximisation (forward-backward expected counts). Training tokens join their
lattice as one more arc, by absolute discounting. Texts fall into ``CLASSES`` classes (languages,
mostly) by their pairs of bytes; with c_k, N_k, V_k the counts of class k,

    P(token | k) = max(c_k - D_k, 0) / N_k
                 + (D_k V_k / N_k) (b max(c - D, 0) / N + (1 - b + b D V / N) P_pieces(token | k)),

which sums to one over all tokens, and a text of class k has log P(k) + sum of log P(token | k):
over all texts at most one in total. Counts are gathered over the whole training part; what
reaches the driver is bounded by the vocabulary (piece counts), by ``FREQUENT`` (frequent words)
and by ``SEEDS`` (texts that start the classes).
"""

from __future__ import annotations

import base64
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestory.llm.common import ByteHash, held_out, keyed, stash

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ROUNDS = 3
#: Words with this share of all tokens are looked up in the task: at most FREQUENT of them.
FREQUENT = 200_000
#: Words that one task scores.
TASK_WORDS = 50_000
LONG_WORD = 64
#: Words whose sums are held together in training: all their arcs, in all classes, stand in memory.
TRAIN_BLOCK = 4096
SLOT_BITS = 20
#: Classes of texts; buckets for the byte pairs that tell them; texts that start them; rounds over all.
CLASSES, BUCKETS, SEEDS, CLASS_ROUNDS = 8, 1024, 2000, 3
BACK_OFF = 0.3
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def read_pieces(path: str) -> list[bytes]:
    """Pieces that can occur in lower-cased words, in rank order: at most one space, and that first."""
    pieces = []
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece = base64.b64decode(line.split()[0])
                inner = piece[1:] if piece[:1] == b" " else piece
                if not any(b in SPACES or 0x41 <= b <= 0x5A for b in inner):
                    pieces.append(piece)
    have = set(pieces)
    return pieces + [p for p in (bytes([b]) for b in range(256) if b not in SPACES[1:]) if p not in have]


class Lattice:
    """Sums over segmentations for many words at once, by length; pieces are found by hash."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp, self.hasher = logp, ByteHash()
        lengths = np.array([len(p) for p in pieces])
        self.longest, self.sizes = int(lengths.max()), set(lengths.tolist())
        self.keys = np.zeros(len(pieces), dtype=np.uint64)
        for size in self.sizes:
            ids = np.flatnonzero(lengths == size)
            data = np.frombuffer(b"".join(pieces[k] for k in ids), dtype=np.uint8).reshape(-1, size)
            self.keys[ids] = self._prefix(data)[:, size]
        # open addressing: few slots are taken, so most lookups end at the first
        self.slots = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        for k, slot in enumerate(self._slot(self.keys).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot] = k

    def _prefix(self, data: np.ndarray) -> np.ndarray:
        n, size = data.shape
        if size > len(self.hasher.up) - 1:
            self.hasher.grow(2 * size)
        out = np.zeros((n, size + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.hasher.codes[data] * self.hasher.up[:size], axis=1, out=out[:, 1:])
        return out

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def _find(self, h: np.ndarray):
        """Places of the hashes that are a piece, and the pieces."""
        slot = self._slot(h)
        at = self.slots[slot]
        rows = np.flatnonzero(at >= 0)
        found_rows, found = [], []
        while len(rows):
            ids = at[rows]
            same = self.keys[ids] == h[rows]
            found_rows.append(rows[same])
            found.append(ids[same])
            rows = rows[~same]
            slot[rows] = (slot[rows] + 1) % len(self.slots)
            at[rows] = self.slots[slot[rows]]
            rows = rows[at[rows] >= 0]
        if len(found) == 1:
            return found_rows[0], found[0]
        if not found:
            return rows, at[rows]
        return np.concatenate(found_rows), np.concatenate(found)

    def arcs(self, data: np.ndarray):
        """(start, end, rows, pieces) of words of one length."""
        prefix, size = np.ascontiguousarray(self._prefix(data).T), data.shape[1]
        down = self.hasher.down
        out = []
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                if end - start in self.sizes:
                    with np.errstate(over="ignore"):
                        h = (prefix[end] - prefix[start]) * down[start]
                    rows, ids = self._find(h)
                    if len(rows):
                        out.append((start, end, rows, ids))
        return out

    def forward(self, arcs, n: int, size: int) -> np.ndarray:
        """alpha[end, class, word]; ``logp`` has a row of piece scores per class."""
        alpha = np.full((size + 1, len(self.logp), n), -np.inf)
        alpha[0] = 0.0
        for start, end, rows, ids in arcs:  # by end: every start is complete when it is used
            alpha[end][:, rows] = np.logaddexp(alpha[end][:, rows], alpha[start][:, rows] + self.logp[:, ids])
        return alpha

    def expected(self, data: np.ndarray, counts: np.ndarray, has: np.ndarray | None = None) -> None:
        """Add the expected number of each piece over the words' segmentations: ``has`` [word, class]
        tells in which classes a word counts, ``counts`` has the shape of ``logp`` (one class: its row).

        Arcs are found once for all classes; a word and a class of it are a pair with sums of its own.
        """
        n, size = data.shape
        of, kind = np.nonzero(np.ones((n, 1), dtype=bool) if has is None else has)
        each = np.bincount(of, minlength=n)
        first = np.cumsum(each) - each
        steps = []
        for start, end, rows, ids in self.arcs(data):
            times = each[rows]
            pairs = np.repeat(first[rows] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            steps.append((start, end, pairs, kind[pairs] * self.logp.shape[1] + np.repeat(ids, times)))
        logp = self.logp.ravel()
        plain = -self.logp.min() * size < 690  # sums of probabilities do not underflow: no logarithms needed
        p, add, times = (np.exp(logp), np.add, np.multiply) if plain else (logp, np.logaddexp, np.add)
        alpha = np.full((size + 1, len(of)), 0.0 if plain else -np.inf)
        beta = alpha.copy()
        alpha[0] = beta[size] = 1.0 if plain else 0.0
        for start, end, pairs, at in steps:  # by end: every start is complete when it is used
            alpha[end, pairs] = add(alpha[end, pairs], times(alpha[start, pairs], p[at]))
        places, shares = [], []
        for start, end, pairs, at in sorted(steps, key=lambda s: -s[1]):
            through = times(p[at], beta[end, pairs])
            beta[start, pairs] = add(beta[start, pairs], through)
            share = times(alpha[start, pairs], through)
            shares.append(share / alpha[size, pairs] if plain else np.exp(share - alpha[size, pairs]))
            places.append(at)
        counts += np.bincount(np.concatenate(places), np.concatenate(shares), counts.size).reshape(counts.shape)

    def _ends(self, word: bytes) -> list[tuple[list[int], list[int]]]:
        """By end - 1: starts and pieces of one long word; pieces are found for all places at once."""
        data = np.frombuffer(word, dtype=np.uint8)
        prefix = self.hasher.prefix(data)
        ends: list[tuple[list[int], list[int]]] = [([], []) for _ in data]
        for size in self.sizes:
            if size <= len(data):
                start = np.arange(len(data) - size + 1)
                with np.errstate(over="ignore"):
                    h = (prefix[start + size] - prefix[start]) * self.hasher.down[start]
                rows, ids = self._find(h)
                for s, k in zip(rows.tolist(), ids.tolist()):
                    ends[s + size - 1][0].append(s)
                    ends[s + size - 1][1].append(k)
        return ends

    @staticmethod
    def _forward_long(ends, logp: np.ndarray) -> np.ndarray:
        """alpha[end, class]."""
        alpha = np.zeros((len(ends) + 1, len(logp)))
        for end, (starts, ids) in enumerate(ends, 1):
            terms = alpha[starts] + logp[:, ids].T
            top = terms.max(axis=0)
            alpha[end] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha

    def score_long(self, word: bytes) -> np.ndarray:
        """Forward recursion over one long word."""
        return self._forward_long(self._ends(word), self.logp)[-1]

    def expected_long(self, word: bytes, counts: np.ndarray, has: np.ndarray) -> None:
        """``expected`` of one long word in the classes ``has`` [class]."""
        ends, kinds = self._ends(word), np.flatnonzero(has)
        logp = self.logp[kinds]
        alpha = self._forward_long(ends, logp)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0.0
        places, shares = [], []
        for end in range(len(ends), 0, -1):
            starts, ids = ends[end - 1]
            through = logp[:, ids].T + beta[end]
            beta[starts] = np.logaddexp(beta[starts], through)  # a start has one piece to an end
            shares.append(np.exp(alpha[starts] + through - alpha[-1]))
            places += ids
        np.add.at(counts, (kinds[:, None], np.array(places)[None, :]), np.concatenate(shares).T)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural-log marginal probability [class, word]."""
        out = np.zeros((len(self.logp), len(words)))
        for at, data in grouped(words):
            out[:, at] = self.score_long(b" " + words[at]) if data is None else self.forward(self.arcs(data), *data.shape)[-1]
        return out


def grouped(words: list[bytes], block: int = 1 << 14):
    """Words with their space as matrices of one length: (places, bytes), long ones alone: (place, None)."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    for size in np.unique(length):
        places = np.flatnonzero(length == size)
        if size > LONG_WORD:
            yield from ((int(p), None) for p in places)
            continue
        for k in range(0, len(places), block):
            at = places[k:k + block]
            data = np.frombuffer(b"".join(b" " + words[p] for p in at), dtype=np.uint8).reshape(-1, size)
            yield at, data


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# ---- classes of texts ---------------------------------------------------------------------------

def sketch(text: str | None) -> np.ndarray:
    """Counts of the pairs of neighbouring bytes, lower-cased, in buckets; a last 1 counts the text."""
    data = np.frombuffer((text or "").encode().lower(), dtype=np.uint8).astype(np.uint16)
    out = np.bincount((data[:-1] * 37 + data[1:] * 101) % BUCKETS, minlength=BUCKETS + 1).astype(np.float64)
    out[-1] = 1.0
    return out


def class_of(theta: np.ndarray, counts: np.ndarray) -> int:
    """The likeliest class: ``theta`` has the log bucket rates and, last, the log prior of each class."""
    return int((theta @ counts).argmax())


def class_sums(theta: np.ndarray, sketches) -> np.ndarray:
    """Sums of sketches by class."""
    out = np.zeros_like(theta)
    for counts in sketches:
        out[class_of(theta, counts)] += counts
    return out


def class_rates(sums: np.ndarray) -> np.ndarray:
    rates = np.log((sums[:, :-1] + 0.1) / (sums[:, :-1] + 0.1).sum(axis=1, keepdims=True))
    return np.hstack([rates, np.log((sums[:, -1:] + 0.5) / (sums[:, -1:] + 0.5).sum())])


def start_classes(sketches: list, classes: int, restarts: int = 8, settle: int = 6) -> np.ndarray:
    """Hard clustering of the seed texts from random texts, several times; the likeliest stays."""
    rng = np.random.default_rng(0)
    used = np.array([c for c in sketches if c[:-1].any()]).reshape(-1, BUCKETS + 1)
    long = used.sum(axis=1) >= 200
    firm = used[long] if long.any() else used
    best, best_fit = class_rates(np.zeros((classes, BUCKETS + 1))), -np.inf
    for _ in range(restarts if len(used) else 0):
        theta = class_rates(firm[rng.permutation(max(classes, len(firm)))[:classes] % len(firm)])
        for _ in range(settle):
            theta = class_rates(np.eye(classes)[(used @ theta.T).argmax(axis=1)].T @ used)
        fit = (used @ theta.T).max(axis=1).sum()
        if fit > best_fit:
            best, best_fit = theta, fit
    return best


def fit_classes(rows: DataFrame, classes: int = CLASSES, rounds: int = CLASS_ROUNDS) -> np.ndarray:
    """Class model of the training rows: started on ``SEEDS`` of them, then settled over all."""
    spark = rows.sparkSession
    train = rows.where("train")
    chosen = train.select("th", "id").distinct().orderBy(F.xxhash64("th"), "th", "id").limit(SEEDS).select("th").distinct()
    texts = train.select("th", "text").join(F.broadcast(chosen), "th").dropDuplicates(["th"])  # at most SEEDS

    def sketches(batches):
        for batch in batches:
            for th, text in zip(batch.column("th"), batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([th.as_py()]), pa.array([sketch(text.as_py()).tobytes()], pa.binary())], ["th", "sketch"])
    seeds = texts.mapInArrow(sketches, "th long, sketch binary").orderBy("th").select("sketch").collect()
    theta = start_classes([np.frombuffer(s) for (s,) in seeds], classes)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(theta)

        def run(batches):
            sums = np.zeros_like(shared.value)
            for batch in batches:
                sums += class_sums(shared.value, (sketch(t.as_py()) for t in batch.column("text")))
            k, b = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(sums[k, b], pa.float64())], ["k", "b", "n"])
        sums = np.zeros_like(theta)
        for k, b, n in train.select("text").mapInArrow(run, "k int, b int, n double").groupBy("k", "b").agg(F.sum("n")).collect():
            sums[k, b] = n  # at most CLASSES x BUCKETS
        theta = class_rates(sums)
    return theta


# ---- counts and models --------------------------------------------------------------------------

def count_words(rows: DataFrame, theta: np.ndarray, max_held: int = 200_000) -> DataFrame:
    """``word, n0, c0, n1, c1, ...``: by class, occurrences in all rows (n) and in training rows (c).
    The end of a text is the empty word."""
    shared = rows.sparkSession.sparkContext.broadcast(theta)

    def run(batches):
        def batch_of(seen):
            words = [w for c in seen.values() for w in c]
            each = [len(c) for c in seen.values()]
            k, train = (np.repeat(np.array([key[j] for key in seen], dtype=np.int32), each) for j in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(k), pa.array(train),
                                               pa.array([n for c in seen.values() for n in c.values()], pa.int64())], ["word", "k", "train", "n"])
        seen, held = defaultdict(Counter), 0
        for batch in batches:
            for train, text in zip(batch.column("train").to_pylist(), batch.column("text")):
                text = text.as_py()
                words = words_of(text)
                words.append(b"")
                seen[class_of(shared.value, sketch(text)), int(train)].update(words)
                held += len(words)
                if held > 4 * max_held and sum(map(len, seen.values())) > max_held:
                    yield batch_of(seen)
                    seen, held = defaultdict(Counter), 0
        yield batch_of(seen)
    each = rows.select("train", "text").mapInArrow(run, "word binary, k int, train int, n long")
    sums = []
    for k in range(len(theta)):
        own = F.col("k") == k
        sums += [F.sum(F.when(own, F.col("n")).otherwise(F.lit(0))).alias(f"n{k}"),
                 F.sum(F.when(own & (F.col("train") == 1), F.col("n")).otherwise(F.lit(0))).alias(f"c{k}")]
    return each.groupBy("word").agg(*sums)


def gathered(batches, least: int = 4 * TASK_WORDS):
    """Words and their columns by name from several record batches at once."""
    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def train_pieces(words: DataFrame, pieces: list[bytes], classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log scores [class, piece] with the end last, by expectation-maximisation over all different
    words (``word, c0, c1, ...``) of each class."""
    spark = words.sparkSession
    logp = -np.log(np.arange(1, len(pieces) + 2, dtype=float))
    logp = np.tile(logp - np.log(np.exp(logp).sum()), (classes, 1))
    learnt = words.select("word", *(f"c{k}" for k in range(classes))).where(F.greatest(*(F.col(f"c{k}") for k in range(classes)), F.lit(0)) > 0)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, logp))

        def run(batches):
            known, scores = shared.value
            lattice, counts = Lattice(known, scores), np.zeros(scores.shape)
            for table in gathered(batches):
                words = table.column("word").to_pylist()
                has = np.stack([table.column(f"c{k}").to_numpy() > 0 for k in range(len(scores))], axis=1)
                has[[i for i, w in enumerate(words) if not w]] = False
                for at, data in grouped(words, TRAIN_BLOCK):
                    if data is None:
                        if has[at].any():
                            lattice.expected_long(b" " + words[at], counts, has[at])
                        continue
                    own = has[at].any(axis=1)
                    if own.any():
                        lattice.expected(data[own], counts, has[at][own])
            k, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[k, at], pa.float64())], ["k", "piece", "n"])
        counts = np.full((classes, len(pieces) + 1), 1e-3)
        counts[:, -1] = 1.0  # the end is one more different token
        found = learnt.mapInArrow(run, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n")).collect()
        for k, piece, n in found:  # at most classes x pieces
            counts[k, piece] += n
        logp = np.log(counts / counts.sum(axis=1, keepdims=True))
    return logp


def discount(n1: int, n2: int) -> float:
    return min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


class TokenModel:
    """Log10 scores of tokens from their training counts [class, token] and piece scores.

    ``facts``: (N, V, n1, n2) of all training tokens, then of each class.
    """

    def __init__(self, facts: list[tuple], back_off: float = BACK_OFF):
        self.facts, self.b = facts, back_off

    def base(self, c: np.ndarray) -> np.ndarray:
        n, v = self.facts[0][:2]
        return np.log10((c + 1) / (n + v + 1))

    def score(self, k: int, c: np.ndarray, ck: np.ndarray, log_pieces: np.ndarray) -> np.ndarray:
        """Of class ``k``: all training counts, those of the class, natural-log piece probabilities."""
        n, v, n1, n2 = self.facts[0]
        d, out = discount(n1, n2), np.array(log_pieces, dtype=float)
        with np.errstate(divide="ignore"):
            if n:
                out = np.logaddexp(np.log(self.b * np.maximum(c - d, 0) / n), math.log(1 - self.b + self.b * d * v / n) + out)
            n, v, n1, n2 = self.facts[1 + k]
            if n:
                d = discount(n1, n2)
                out = np.logaddexp(np.log(np.maximum(ck - d, 0) / n), math.log(d * v / n) + out)
        return out / math.log(10)


def score_words(words: DataFrame, pieces: list[bytes], logp: np.ndarray, model: TokenModel) -> DataFrame:
    """``word, class, n, known, base, score`` (log10) of each counted word in each class that has it."""
    # plain values: a broadcast is not pickled by value, so a class of this package would have to be there
    shared = words.sparkSession.sparkContext.broadcast((pieces, logp, model.facts, model.b))

    def run(batches):
        known, scores, *own = shared.value
        lattice, tokens = Lattice(known, scores), TokenModel(*own)
        for table in gathered(batches):
            words = np.array(table.column("word").to_pylist(), dtype=object)
            cs = [table.column(f"c{k}").to_numpy() for k in range(len(scores))]
            c = sum(cs)
            for k in range(len(scores)):
                n = table.column(f"n{k}").to_numpy()
                at = np.flatnonzero(n)
                own = words[at].tolist()
                lattice.logp = scores[k:k + 1]
                log_pieces = lattice.score(own)[0]
                if b"" in own:
                    log_pieces[own.index(b"")] = scores[k, -1]
                each = tokens.score(k, c[at], cs[k][at], log_pieces)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(n[at]),
                                                  pa.array(c[at] > 0), pa.array(tokens.base(c[at])), pa.array(each)],
                                                 ["word", "class", "n", "known", "base", "score"])
    return words.mapInArrow(run, "word binary, class int, n long, known boolean, base double, score double")


def document_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                    rounds: int = ROUNDS, mod: int = 7, frequent: int = FREQUENT, classes: int = CLASSES) -> DataFrame:
    """One row per row of ``docs``: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score, class``.

    Learns from rows whose crc32 of the id modulo ``mod`` is not 2. A text is its words and one
    end; null and empty texts are the end alone. Without training rows the pieces alone score. An
    empty table gives no rows; rows that repeat id and text get equal scores.
    """
    spark: SparkSession = docs.sparkSession
    rows = keyed(docs, id_col, text_col).withColumn("train", ~held_out("id", mod))
    pieces = read_pieces(vocabulary)
    theta = fit_classes(rows, classes)
    words = stash(count_words(rows, theta), "words")
    cs = [F.col(f"c{k}") for k in range(classes)]
    every, seen = sum(cs[1:], cs[0]), sum((F.col(f"n{k}") for k in range(classes)), F.lit(0))
    facts = words.agg(F.count("*"), F.sum(seen), *(f for c in (every, *cs) for f in (F.sum(c), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2)))).first()
    n_words, total = facts[0], facts[1] or 0
    model = TokenModel([tuple(x or 0 for x in facts[2 + 4 * j:6 + 4 * j]) for j in range(classes + 1)])
    # scoring a word costs far more than reading it: spread them by number, not by bytes
    words = stash(words.repartition(max(1, -(-n_words // TASK_WORDS))), "spread-words")
    logp = train_pieces(words, pieces, classes, rounds)
    scored = stash(score_words(words, pieces, logp, model), "scored")
    limit = max(2, total // frequent)
    often = scored.where((F.col("n") >= limit) | (F.length("word") == 0)).select("word", "class", "known", "base", "score").collect()
    known: list[dict] = [{} for _ in range(classes)]
    for k, r in enumerate(often):
        known[r[1]][bytes(r[0])] = k
    shared = spark.sparkContext.broadcast((known, np.array([r[2:] for r in often], dtype=float).reshape(-1, 3), theta))
    rare = scored.where((F.col("n") < limit) & (F.length("word") > 0)).select("word", "class", "known", "base", "score")
    met = _parts(rows, shared).join(rare, ["word", "class"], "left")
    own = F.col("rows") == 0
    sums = met.groupBy("id", "th", "class").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"),
        F.sum(F.when(~own, F.col("n_known")).when(F.col("known"), F.col("n")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.when(own, F.col("n") * F.col("base")).otherwise(F.col("base_part"))).alias("base"),
        F.sum(F.when(own, F.col("n") * F.col("score")).otherwise(F.col("score_part"))).alias("score"))
    out = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("id", held_out("id", mod).alias("held_out"), (F.col("n") / F.col("rows")).cast("long").alias("n_tokens"),
                      (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"), F.lit(model.facts[0][0]).cast("long").alias("train_tokens"),
                      (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"), "class")


def _parts(rows: DataFrame, shared) -> DataFrame:
    """Per row one record with the sums over its end and frequent words (``rows`` is 1; its word is a
    space and the text hash, which no word equals), and one per different other word."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "th", "class", "word", "rows", "n", "n_known", "base_part", "score_part"]

    def run(batches):
        known, values, theta = shared.value
        for batch in batches:
            ids, ths = batch.column("id"), batch.column("th")
            row, words, n, heads = [], [], [], []

            def batch_of():
                # a head closes each row's words
                at = np.array(row, dtype=np.int64)
                ends = np.cumsum(at)
                size = int(ends[-1])
                which = np.repeat(np.array([h[0] for h in heads]), at)
                full = lambda j, t: np.zeros(size, dtype=t)
                n_known, base, score, rows_ = full(0, np.int64), full(0, np.float64), full(0, np.float64), full(0, np.int32)
                last = ends - 1
                rows_[last] = 1
                n_known[last], base[last], score[last] = ([h[j] for h in heads] for j in (2, 3, 4))
                k = np.repeat(np.array([h[1] for h in heads], dtype=np.int32), at)
                return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), ths.take(pa.array(which)), pa.array(k), pa.array(words, pa.binary()),
                                                   pa.array(rows_), pa.array(n, pa.int64()), pa.array(n_known), pa.array(base), pa.array(score)], names)
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                counts = Counter(words_of(text))
                counts[b""] = 1
                k = class_of(theta, sketch(text))
                mine = known[k]
                common = counts.keys() & mine.keys()
                times = [counts[w] for w in common]
                sums = (values[[mine[w] for w in common]] * np.array(times, dtype=float)[:, None]).sum(axis=0)
                others = counts.keys() - common
                words += others
                words.append(b" " + ths[i].as_py().to_bytes(8, "big", signed=True))
                n += [counts[w] for w in others]
                n.append(sum(times))
                row.append(len(others) + 1)
                heads.append((i, k, round(sums[0]), sums[1], sums[2] + theta[k, -1] / math.log(10)))
                if len(words) > 50_000:
                    yield batch_of()
                    row, words, n, heads = [], [], [], []
            if row:
                yield batch_of()
    return rows.select("id", "th", "text").mapInArrow(
        run, f"id {kind}, th long, class int, word binary, rows int, n long, n_known long, base_part double, score_part double")
