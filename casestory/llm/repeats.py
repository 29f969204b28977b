"""Removal of repeated byte strings by an enhanced, sparse suffix array.

Only sampled suffixes are sorted: those at the smallest 200-byte hash of each window of 400 bytes.
The choice depends on the window alone, so equal windows choose the same place in them, and every
window belongs to one sampled suffix (its anchor). A suffix comes with the bytes that its windows
cover, on the left too. Suffixes whose anchors begin alike form a class; equal contexts in a class
are counted and kept once, so a class has different contexts only.

In a class the suffixes are sorted and a stack scan over their common prefixes lists the interval
tree. Below an interval of common prefix r lie the suffixes that share r bytes to the right. A second
scan over what its members share on the left lists sets with equal left extension l that is diverse
beyond it. Such a set whose suffixes stand below at least two branches of the interval is a maximal
repeat of l + r bytes, and its members are all its occurrences; equal contexts are one leaf, which is
a group itself where they occur twice. The removed bytes are those that groups of 400 bytes and more
cover. A class with more than ``CLASS`` contexts is split first, by the bytes that halves of its
windows have in common, as often as needed.

A group is maximal within the reach of its anchor, the bytes of the windows that chose it (in split
classes a half of them). A repeat that goes on behind comes as several groups, one per anchor, each
with all occurrences of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.llm.common import ByteHash, join_groups, keyed, stash

LENGTH, GRAM = 400, 200
CLASS = 4096
#: Windows handled at once; a place in a block fits the low bits of a hash.
BLOCK, PLACE_BITS = 1 << 19, 20


# ---- sampled suffixes ---------------------------------------------------------------------------

def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values: running minima from both ends of blocks of w."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def anchors(data: bytes, hasher: ByteHash, length: int = LENGTH, gram: int = GRAM):
    """Blocks of (at, first, last, hash): windows first..last have their anchor at ``at``.

    An anchor that windows of two blocks choose comes once: the last one of a block waits for the next.
    """
    whole = np.frombuffer(data, dtype=np.uint8)
    waits = None
    for begin in range(0, len(data) - length + 1, BLOCK):
        part = whole[begin:begin + BLOCK + length - 1]
        n = len(part) - gram + 1
        prefix = hasher.prefix(part)
        h = hasher.spans(prefix, np.arange(n), np.arange(n) + gram)
        low = np.uint64((1 << PLACE_BITS) - 1)
        place = (sliding_min((h & ~low) | np.arange(n, dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        at = place[first]
        block = [at + begin, first + begin, last + begin, h[at].view(np.int64)]
        if waits and waits[0][0] == block[0][0]:
            block[1][0] = waits[1][0]
        elif waits:
            block = [np.concatenate(x) for x in zip(waits, block)]
        if begin + BLOCK <= len(data) - length:
            waits, block = [x[-1:] for x in block], [x[:-1] for x in block]
        yield tuple(block)


def suffixes(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id, th, at, left, right, kh, ctx``: anchors, how far before them their first (left) and last
    (right) window begin, the hash of the gram there and of all bytes in those windows."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        hasher, digest = ByteHash(), xxhash.xxh3_64_intdigest
        names = ["id", "th", "at", "left", "right", "kh", "ctx"]
        for batch in batches:
            ids, ths = batch.column("id"), batch.column("th")
            held, cols, size = [], [], 0
            for i, text in enumerate(batch.column("text")):
                data = text.as_py().encode()
                for at, first, last, kh in anchors(data, hasher, length, gram):
                    ctx = np.fromiter((digest(data[f:e + length], seed=a - f) for a, f, e in zip(at.tolist(), first.tolist(), last.tolist())),
                                      dtype=np.uint64, count=len(at)).view(np.int64)
                    held.append(np.full(len(at), i))
                    cols.append((at, at - first, at - last, kh, ctx))
                    size += len(at)
                if size > 100_000:
                    yield _suffix_batch(ids, ths, held, cols, names)
                    held, cols, size = [], [], 0
            if size:
                yield _suffix_batch(ids, ths, held, cols, names)
    return rows.select("id", "th", "text").mapInArrow(run, f"id {kind}, th long, at long, left int, right int, kh long, ctx long")


def _suffix_batch(ids, ths, held, cols, names):
    row = pa.array(np.concatenate(held))
    at, left, right, kh, ctx = (np.concatenate(c) for c in zip(*cols))
    return pa.RecordBatch.from_arrays([ids.take(row), ths.take(row), pa.array(at), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)),
                                       pa.array(kh), pa.array(ctx)], names)


# ---- the interval tree of one class -------------------------------------------------------------

def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] equal, a[:high] different
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def intervals(lcp: list[int]):
    """Stack scan: (common prefix, parent's common prefix, first, last) of every interval of a
    suffix array whose neighbours i, i + 1 share lcp[i]."""
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
    for i, value in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > value:
            r, first = stack.pop()
            yield r, max(value, stack[-1][0] if stack else 0), first, i
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(members: list[tuple[bytes, bytes]], length: int = LENGTH):
    """For members (bytes before the anchor, bytes from it) of one class, all different: (l, r, who),
    every maximal string of l bytes before the anchor and r bytes from it, l + r >= length, that two
    or more members have, and all members that have it."""
    order = sorted(range(len(members)), key=lambda k: members[k][1])
    lcp = [common_prefix(members[a][1], members[b][1]) for a, b in zip(order, order[1:])]
    before = [m[0][::-1] for m in members]
    by_left = sorted(range(len(members)), key=lambda k: before[k])
    lcs = np.array([common_prefix(before[a], before[b]) for a, b in zip(by_left, by_left[1:])], dtype=np.int64)
    order, by_left = np.array(order), np.array(by_left)
    rank, place = np.empty_like(order), np.empty_like(order)
    rank[by_left] = place[order] = np.arange(len(members))
    steps = np.array(lcp)
    for r, _, first, last in intervals(lcp):
        least = length - r
        ranks = np.sort(rank[order[first:last + 1]])
        shared = np.minimum.reduceat(lcs[:ranks[-1]], ranks[:-1]) - least + 1  # above zero: long enough
        if shared.max() <= 0:
            continue
        who = by_left[ranks]
        branch = np.concatenate([[0], np.cumsum(steps[first:last] == r)])[place[who] - first]
        for l, _, a, b in intervals(np.maximum(shared, 0).tolist()):
            if (branch[a:b + 1] != branch[a]).any():  # else they share more than r to the right
                yield l + least - 1, r, who[a:b + 1]


def widest(repeats) -> dict[int, list[tuple[int, int]]]:
    """Per member the (l, r) of its repeats that lie in no other one of its repeats."""
    per: dict[int, dict[int, int]] = {}
    for l, r, who in repeats:
        for k in who.tolist():
            held = per.setdefault(k, {})
            held[r] = max(l, held.get(r, 0))
    out = {}
    for k, held in per.items():
        most = -1
        for r in sorted(held, reverse=True):
            if held[r] > most:
                most = held[r]
                out.setdefault(k, []).append((most, r))
    return out


# ---- the job ------------------------------------------------------------------------------------

def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``kh, ctx, n, left, right, before, after`` for ``wanted`` (id, th, at, left, right, kh, ctx, n)."""
    asked = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("at", "left", "right", "kh", "ctx", "n")).alias("asked"))
    asked = asked.select(F.col("id").alias("a_id"), F.col("th").alias("a_th"), "asked")  # as many as the text has anchors
    met = rows.join(asked, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("th") == F.col("a_th")))

    def run(batches):
        names = ["kh", "ctx", "n", "left", "right", "before", "after"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for text, asked in zip(batch.column("text"), batch.column("asked")):
                data = text.as_py().encode()
                for x in asked.as_py():
                    at = x["at"]
                    out.append((x["kh"], x["ctx"], x["n"], x["left"], x["right"], data[at - x["left"]:at], data[at:at - x["right"] + length]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    return met.select("text", "asked").mapInArrow(run, "kh long, ctx long, n long, left int, right int, before binary, after binary")


def _halves(members: DataFrame, length: int) -> DataFrame:
    """Members once per half of their class's windows: class, context and bytes cut to the half."""
    def run(batches):
        names = ["node", "low", "high", "key", "n", "left", "right", "before", "after", "kh", "ctx", "o_n", "of_node", "of_key"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 5
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                mid = (m["low"] + m["high"]) // 2
                for a, b in ((m["low"], mid), (mid + 1, m["high"])):
                    l, r = min(b, m["left"]), max(a, m["right"])
                    if l < r or a > b:
                        continue
                    before, after = m["before"][len(m["before"]) - l:], m["after"][:length - r]
                    core = before[len(before) - a:] + after[:length - b] if a else after[:length - b]
                    node = xxhash.xxh3_64_intdigest(core, seed=(m["node"] ^ (a << 16 | b)) & (2**64 - 1))
                    key = xxhash.xxh3_64_intdigest(before + after, seed=l)
                    sign = lambda x: x - 2**64 if x >= 2**63 else x
                    out.append((sign(node), a, b, sign(key), m["n"], l, r, before, after, m["kh"], m["ctx"], m["o_n"], m["node"], m["key"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    return members.mapInArrow(run, "node long, low int, high int, key long, n long, left int, right int, before binary, after binary, kh long, ctx long, o_n long, of_node long, of_key long")


def _covered(members: DataFrame, length: int) -> DataFrame:
    """``kh, ctx, from, to``: windows that the maximal repeats of a class cover, of contexts that occur once."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(rows[k]["kh"], rows[k]["ctx"], length - r, l) for k, pairs in widest(
            maximal_repeats([(r["before"], r["after"]) for r in rows], length)).items() if rows[k]["o_n"] == 1 and rows[k]["n"] == 1 for l, r in pairs]
        cols = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                        names=["kh", "ctx", "from", "to"])
    return members.groupBy("node").applyInArrow(run, "kh long, ctx long, from int, to int")


def _groups_of_classes(members: DataFrame, length: int) -> DataFrame:
    """``node, key, g, l, r``: the maximal repeats of a class, one row per repeat and context."""
    def run(table: pa.Table) -> pa.Table:
        rows, out, whole = table.to_pylist(), [], set()
        for l, r, who in maximal_repeats([(m["before"], m["after"]) for m in rows], length):
            one = rows[who[0]]
            g = xxhash.xxh3_64_intdigest(one["before"][len(one["before"]) - l:] + one["after"][:r], seed=l)
            for k in who.tolist():
                out.append((rows[k]["node"], rows[k]["key"], g - 2**64 if g >= 2**63 else g, l, r))
                if l == len(rows[k]["before"]) and r == len(rows[k]["after"]):
                    whole.add(k)
        out += [(m["node"], m["key"], m["key"], len(m["before"]), len(m["after"])) for k, m in enumerate(rows) if m["n"] > 1 and k not in whole]
        cols = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 2)], names=["node", "key", "g", "l", "r"])
    return members.groupBy("node").applyInArrow(run, "node long, key long, g long, l int, r int")


def _suffix_classes(rows: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Suffixes whose anchor occurs twice; their contexts; classes of several contexts; the members of these."""
    every = stash(suffixes(rows, length, gram), "suffixes")
    classes = stash(every.groupBy("kh").agg(F.count("*").alias("size")).where("size > 1"), "classes")
    again = stash(join_groups(every, classes, ["kh"], "size").drop("size"), "repeated-suffixes")
    one = F.min(F.struct("id", "th", "at", "left", "right")).alias("one")
    contexts = stash(again.groupBy("kh", "ctx").agg(F.count("*").alias("n"), one), "contexts")
    mixed = stash(contexts.groupBy("kh").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    wanted = stash(join_groups(contexts, mixed, ["kh"], "m").select("one.*", "kh", "ctx", "n"), "wanted")
    members = _contexts(rows, wanted, length).select(
        F.col("kh").alias("node"), F.lit(0).alias("low"), F.lit(length - gram).alias("high"), F.col("ctx").alias("key"),
        "n", "left", "right", "before", "after", "kh", "ctx", F.col("n").alias("o_n"))
    return again, contexts, mixed, stash(members.dropDuplicates(["node", "key"]), "members")


def _split(members: DataFrame, large: DataFrame, length: int) -> DataFrame:
    """Members of large classes cut to halves, with how often (total) and in how many (k) of them the cut context stands."""
    halves = stash(_halves(join_groups(members, large, ["node"], "m").drop("m"), length), "halves")
    same = stash(halves.groupBy("node", "key").agg(F.sum("n").alias("total"), F.count("*").alias("k")), "same")
    return stash(join_groups(halves, same, ["node", "key"], "k"), "met")


def _different(met: DataFrame) -> DataFrame:
    return stash(met.withColumn("n", F.col("total")).drop("total", "k", "of_node", "of_key").dropDuplicates(["node", "key"]), "members")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, most: int = CLASS) -> DataFrame:
    """``id, th, first, last``: windows of ``length`` bytes that occur elsewhere, as ranges of starts.

    They are what the groups of ``repeat_groups`` cover; of nested groups the widest are enough.
    Ranges of a text may meet. Rows that repeat id and text are different places and repeat each
    other.
    """
    again, contexts, _, members = _suffix_classes(keyed(docs, id_col, text_col), length, gram)
    # leaves of the tree: contexts that occur twice repeat as a whole
    whole = join_groups(again, contexts.where("n > 1").select("kh", "ctx", "n"), ["kh", "ctx"], "n").select(
        "id", "th", (F.col("at") - F.col("left")).alias("first"), (F.col("at") - F.col("right")).alias("last"))
    found = []
    while True:
        sizes = stash(members.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        found.append(stash(_covered(join_groups(members, sizes.where(F.col("m") <= most), ["node"], "m").drop("m"), length), "found"))
        large = sizes.where(F.col("m") > most)
        if large.isEmpty():
            break
        met = _split(members, large, length)
        found.append(met.where("total > 1 and o_n = 1").select("kh", "ctx", F.col("right").alias("from"), F.col("left").alias("to")))
        members = _different(met)
    single = contexts.where("n = 1").select("one.id", "one.th", "one.at", "kh", "ctx")
    partly = single.join(_union(found), ["kh", "ctx"]).select(
        "id", "th", (F.col("at") - F.col("to")).alias("first"), (F.col("at") - F.col("from")).alias("last"))
    return whole.unionByName(partly)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                  gram: int = GRAM, most: int = CLASS) -> DataFrame:
    """``grp, id, th, start, end``: one row per occurrence of every maximal repeat of at least ``length``
    bytes within the reach of an anchor (see above); [start, end) are bytes.

    All occurrences of a group's bytes in the corpus are listed, and each window of ``length`` bytes
    that occurs twice lies in a group that occurs exactly as often. Nested repeats are groups of their
    own. Null and empty texts, and those below ``length`` bytes, have none; an empty table gives no
    rows. Rows that repeat id and text are different places.
    """
    again, contexts, mixed, members = _suffix_classes(keyed(docs, id_col, text_col), length, gram)
    whole = F.struct(F.col("key").alias("g"), F.col("left").alias("l"), (F.lit(length) - F.col("right")).alias("r"))
    held = F.collect_list(F.struct("g", "l", "r")).alias("held")  # at most one per l and r of a context
    alone = contexts.where("n > 1").join(mixed, "kh", "left_anti").select("kh", "ctx", F.col("ctx").alias("key"), "one.left", "one.right")
    found = [alone.select("kh", "ctx", whole.alias("x")).select("kh", "ctx", "x.*")]
    below = None  # node, key, kh, ctx: the contexts that a cut context stands for
    while True:
        sizes = stash(members.groupBy("node").agg(F.count("*").alias("m")), "sizes")
        groups = _groups_of_classes(join_groups(members, sizes.where((F.col("m") <= most) & (F.col("m") > 1)), ["node"], "m").drop("m"), length)
        leaves = join_groups(members, sizes.where("m = 1"), ["node"], "m").where("n > 1").select("node", "key", whole.alias("x")).select("node", "key", "x.*")
        groups = stash(groups.unionByName(leaves), "groups")
        if below is None:
            found.append(groups.withColumnsRenamed({"node": "kh", "key": "ctx"}))
        else:
            per = stash(groups.groupBy("node", "key").agg(held).join(below.groupBy("node", "key").agg(F.count("*").alias("k")), ["node", "key"]), "per-key")
            found.append(join_groups(below, per, ["node", "key"], "k").select("kh", "ctx", F.inline("held")))
        large = sizes.where((F.col("m") > most) & (F.col("m") > 1))
        if large.isEmpty():
            break
        met = _split(members, large, length)
        if below is None:
            below = met.select("node", "key", "kh", "ctx")
        else:
            to = met.groupBy(F.col("of_node").alias("node"), F.col("of_key").alias("key")).agg(F.collect_list(F.struct("node", "key")).alias("halves"))
            to = stash(to.join(below.groupBy("node", "key").agg(F.count("*").alias("k")), ["node", "key"]), "to-halves")
            below = stash(join_groups(below, to, ["node", "key"], "k").select("kh", "ctx", F.inline("halves")), "below")
        members = _different(met)
    per = _union(found).groupBy("kh", "ctx").agg(held)
    per = stash(per.join(contexts.select("kh", "ctx", "n"), ["kh", "ctx"]), "groups-of-contexts")
    return join_groups(again, per, ["kh", "ctx"], "n").select("id", "th", "at", "kh", F.inline("held")).select(
        F.concat(F.lpad(F.hex("kh"), 16, "0"), F.lpad(F.hex("g"), 16, "0")).alias("grp"), "id", "th",
        (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("end"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    gram: int = GRAM, most: int = CLASS) -> DataFrame:
    """One row per row of ``docs``: ``id, th, n_bytes, spans, kept``.

    ``spans`` are the maximal removed byte ranges [start, end), ``kept`` the other bytes. Null
    counts as empty; texts below ``length`` bytes lose nothing; an empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeated_spans(docs, id_col, text_col, length, gram, most)
    per = stash(found.groupBy(F.col("id").alias("s_id"), F.col("th").alias("s_th")).agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("found")), "spans")
    met = rows.join(per, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left")
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column("text"), batch.column("found")):
                data, runs = text.as_py().encode(), []
                for x in found.as_py() or []:
                    if runs and x["first"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["last"] + length)
                    else:
                        runs.append([x["first"], x["last"] + length])
                rest = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)]))
                sizes.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in runs])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)),
                                              pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                                             ["id", "th", "n_bytes", "spans", "kept_sha256", "kept"])
    return met.select("id", "th", "text", "found").mapInArrow(
        run, f"id {kind}, th long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
