"""SimHash near-dedup: fingerprints, a binary trie self-join within a Hamming budget, components.

The trie of all different fingerprints is traversed as pairs of nodes. A pair carries the bits in
which its paths differ and is dropped as soon as they exceed the budget. The upper part of the
traversal is a Spark loop over tables of node counts: a node with more than ``LEAF`` fingerprints
is opened two bits further, whatever its share, so dense regions go deeper and each leaf stays
small. Pairs of leaves are then traversed in tasks of bounded size, each of which returns a
spanning star of the links it finds, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.llm.common import join_groups, keyed, stash
from casestory.llm.components import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
LEAF = 4096
#: Bits per step of the traversal in Spark and in a task; node pairs expanded at once in a task.
STEP, TASK_STEP, BLOCK = 2, 4, 1 << 20


def simhash(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits over the shingles' XXH64, repeats counted; 0 without words."""
    if not words:
        return 0
    line = b" ".join(words)
    size = min(size, len(words))
    end = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(end[:-1] + 1).tolist()][:len(words) - size + 1]
    ends = end[size - 1:].tolist()
    ones, n = np.zeros(64, dtype=np.int64), len(starts)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, 1 << 15):
        h = np.array([digest(line[s:e], seed) for s, e in zip(starts[k:k + (1 << 15)], ends[k:k + (1 << 15)])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(rows: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``id, th, fp`` of ``keyed`` rows; fp as a signed long."""
    def run(batches):
        for batch in batches:
            fps = [simhash((t.as_py() or "").encode().lower().split(), size, seed) for t in batch.column("text")]
            fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), fps], ["id", "th", "fp"])
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, th long, fp long")


# ---- the traversal in Spark ---------------------------------------------------------------------

def _prefix(depth: int):
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned("fp", 64 - depth)


def leaf_pairs(fps: DataFrame, budget: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """``du, pu, dv, pv``: pairs of trie leaves (depth, prefix) that may hold links, u <= v."""
    n = fps.count()
    pairs = fps.sparkSession.createDataFrame(
        [(0, 0, n <= leaf, 0, 0, n <= leaf, 0)] if n else [],
        "du int, pu long, lu boolean, dv int, pv long, lv boolean, diff int")
    done = pairs.where("lu and lv")
    depth = 0
    while depth < 64:
        todo = pairs.where("not (lu and lv)")
        if todo.isEmpty():
            break
        depth += STEP
        kids = (fps.groupBy(_prefix(depth).alias("kid")).agg(F.count("*").alias("n"))
                .select(F.shiftrightunsigned("kid", STEP).alias("parent") if depth < 64 else F.shiftrightunsigned("kid", STEP).alias("parent"),
                        "kid", ((F.col("n") <= leaf) | F.lit(depth >= 64)).alias("leaf")))
        kids = stash(kids, "nodes")

        def opened(d, side):
            """Replace the open nodes of one side by their children."""
            other = "v" if side == "u" else "u"
            k = kids.select(F.col("parent").alias("__p"), F.col("kid").alias("__k"), F.col("leaf").alias("__l"))
            old = d.where(f"l{side}").withColumn(f"was_{side}", F.lit(False))
            new = (d.where(f"not l{side}").join(k, F.col(f"p{side}") == F.col("__p"))
                   .withColumn(f"d{side}", F.lit(depth)).withColumn(f"p{side}", F.col("__k")).withColumn(f"l{side}", F.col("__l"))
                   .withColumn(f"was_{side}", F.lit(True)).drop("__p", "__k", "__l"))
            return old.unionByName(new), other
        both = todo.withColumn("same", (F.col("du") == F.col("dv")) & (F.col("pu") == F.col("pv")))
        both, _ = opened(both, "u")
        both, _ = opened(both, "v")
        step = F.bit_count(F.col("pu").bitwiseXOR(F.col("pv")).bitwiseAND(F.lit((1 << STEP) - 1)))
        both = (both.withColumn("diff", F.col("diff") + F.when(F.col("was_u") & F.col("was_v"), step).otherwise(F.lit(0)))
                .where((F.col("diff") <= budget) & (~F.col("same") | (F.col("pu") <= F.col("pv")))))
        pairs = stash(both.select(pairs.columns), "pairs")
        done = done.unionByName(pairs.where("lu and lv"))
    return done.select("du", "pu", "dv", "pv")


# ---- the traversal in a task --------------------------------------------------------------------

class Trie:
    """Nodes of the trie of sorted fingerprints, level by level: where each starts, its children."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.levels = fps, {0: np.array([0, len(fps)])}

    def starts(self, depth: int) -> np.ndarray:
        if depth not in self.levels:
            p = self.fps >> np.uint64(64 - depth)
            self.levels[depth] = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(p)]])
        return self.levels[depth]

    def children(self, depth: int, step: int):
        """For nodes at ``depth``: first child, number of children; digits of the children."""
        here, below = self.starts(depth), self.starts(depth + step)
        first = np.searchsorted(below, here)
        digits = (self.fps[below[:-1]] >> np.uint64(64 - depth - step)) & np.uint64((1 << step) - 1)
        return first[:-1], np.diff(first), digits.astype(np.int64)


def links(a: np.ndarray, b: np.ndarray, same: bool, budget: int = MAX_BITS, step: int = TASK_STEP, block: int = BLOCK):
    """Blocks of (i, j) with at most ``budget`` differing bits between a[i] and b[j]; i < j if same."""
    ta, tb = Trie(a), Trie(b)
    popcount = np.array([bin(x).count("1") for x in range(1 << step)])
    zero = np.zeros(1, dtype=np.int64)
    stack = [(0, zero, zero, zero)]
    while stack:
        depth, i, j, diff = stack.pop()
        # pairs of single fingerprints need no further levels
        sa, sb = ta.starts(depth), tb.starts(depth)
        single = (sa[i + 1] - sa[i] == 1) & (sb[j + 1] - sb[j] == 1)
        if single.any():
            x, y = sa[i[single]], sb[j[single]]
            ok = np.bitwise_count(a[x] ^ b[y]) <= budget
            if same:
                ok &= x < y
            if ok.any():
                yield x[ok], y[ok]
            i, j, diff = i[~single], j[~single], diff[~single]
        if not len(i) or depth >= 64:
            continue
        (fa, na, da), (fb, nb, db) = ta.children(depth, step), tb.children(depth, step)
        count = na[i] * nb[j]
        if count.sum() > block and len(i) > 1:
            half = len(i) // 2
            stack += [(depth, i[half:], j[half:], diff[half:]), (depth, i[:half], j[:half], diff[:half])]
            continue
        at = np.repeat(np.arange(len(i)), count)
        off = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        width = nb[j][at]
        ci, cj = fa[i][at] + off // width, fb[j][at] + off % width
        left = diff[at] + popcount[da[ci] ^ db[cj]]
        keep = left <= budget
        if same:
            keep &= ci <= cj
        if keep.any():
            stack.append((depth + step, ci[keep], cj[keep], left[keep]))


def stars(a: np.ndarray, b: np.ndarray, same: bool, budget: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links between two leaves as (fingerprint, least fingerprint that it reaches in them)."""
    fps = a if same else np.concatenate([a, b])
    label = np.arange(len(fps))
    for i, j in links(a, b, same, budget):
        j = j if same else j + len(a)
        while True:
            li, lj = label[i], label[j]
            low = np.minimum(li, lj)
            if (li == lj).all():
                break
            np.minimum.at(label, li, low)
            np.minimum.at(label, lj, low)
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fps[moved], fps[label[moved]]


def link_table(fps: DataFrame, budget: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """``u, v``: edges that connect exactly the fingerprints linked within ``budget`` bits."""
    pairs = stash(leaf_pairs(fps, budget, leaf), "leaf-pairs")
    leaves = stash(pairs.select(F.col("du").alias("d"), F.col("pu").alias("p")).union(pairs.select("dv", "pv")).distinct(), "leaves")
    depths = [r[0] for r in leaves.select("d").distinct().collect()]  # at most 33
    placed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), _prefix(d).alias("p")) for d in depths or [0]))).alias("at"))
    blobs = (placed.select("fp", "at.d", "at.p").join(leaves, ["d", "p"])
             .groupBy("d", "p").agg(F.collect_list("fp").alias("fps")))  # a leaf has at most ``leaf``
    blobs = stash(blobs, "blobs")
    left = blobs.select(F.col("d").alias("du"), F.col("p").alias("pu"), F.col("fps").alias("a"))
    right = blobs.select(F.col("d").alias("dv"), F.col("p").alias("pv"), F.col("fps").alias("b"))
    units = pairs.join(left, ["du", "pu"]).join(right, ["dv", "pv"])
    units = units.select(((F.col("du") == F.col("dv")) & (F.col("pu") == F.col("pv"))).alias("same"), "a", "b",
                         F.xxhash64("du", "pu", "dv", "pv").alias("unit")).repartition("unit")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("same")[k].as_py()
                a, b = (np.sort(batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in "ab")
                u, v = stars(a, b, same, budget)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
    return units.select("same", "a", "b").mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                budget: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: ``id, th, fp, component, first_id, first_th``.

    Texts link when their fingerprints differ in at most ``budget`` bits. ``component`` is the
    smallest id reachable (null only if all ids are), ``first`` the row that stays (smallest id,
    null last, then smallest text hash). Null and empty texts have the fingerprint 0 and link
    like any other; an empty table gives no rows.
    """
    rows = stash(fingerprints(keyed(docs, id_col, text_col), size), "simhash")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least")
    nodes = stash(rows.groupBy("fp").agg(F.count("*").alias("n"), least), "fingerprints")
    edges = stash(link_table(nodes.select("fp"), budget, leaf), "links")
    roots = components(edges)
    nodes = stash(nodes.join(roots, nodes.fp == roots.node, "left")
                  .select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "roots")
    firsts = stash(nodes.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("m")), "firsts")
    named = stash(join_groups(nodes.select("fp", "n", "root"), firsts, ["root"], "m").select("fp", "n", "first"), "named")
    return join_groups(rows, named, ["fp"], "n").select(
        "id", "th", "fp", F.col("first.id").alias("component"), F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of linked texts, with all columns."""
    kept = near_groups(docs, id_col, text_col).where("id <=> first_id and th = first_th").groupBy(
        F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.count("*").alias("__n"))
    kept = stash(kept, "kept")
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn("__t", th).join(
        kept.drop("__n"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th")), "left_semi")
    if not kept.where("__n > 1").isEmpty():
        rows = rows.dropDuplicates([id_col, "__t"])
    return rows.select(*docs.columns)
