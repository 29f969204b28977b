"""Multinomial logistic regression on term frequencies with its coefficients as a table (M4), any
number of folds in one pass (M5).

Neither the vocabulary nor a coefficient stands on the driver. Terms are dealt to *shards* by hash, a
shard row holds the parameters of its terms; documents are packed into *blocks*, a block row holds
its term frequencies and labels. One evaluation is one scan of the blocks:

* every shard sends each block the coefficients of the terms that stand in it,
* a block computes margins, losses and residuals of its documents and returns a gradient per shard,
* the gradients of a shard are added up, in groups of ``FAN`` at a time, and update its parameters.

So what travels is the distinct terms of a block, not its postings, and every row, message and
group has a bounded size. A parameter is an array (fold, class): the k models of a k-fold training
share blocks, messages and scans, each with its own step length and history, and a document counts in
all models but that of its own fold. The margins of that model are its out-of-fold scores. Only differences
of classes matter for a loss, and the gradients of the classes add up to zero, so the last class is
neither sent nor answered. Blocks are cached in their order, so an evaluation does not sort them again.

The optimiser is L-BFGS in its vector-free form: the direction is a combination of the history, whose
coefficients follow from the dot products of all history vectors. Shards return these, a few
numbers per fold, and the driver combines them.

Memory: a row holds at most about ``ROW_BYTES`` of parameters or ``BLOCK_POSTINGS`` postings, and rows pass
between JVM and Python, and into files, a few megabytes at a time. Else several vectors of many shards wait in
one Arrow batch or one Parquet page, outside the heap or in it. Blocks are cached on disk.

The objective is that of Spark ML's ``LogisticRegression`` (family multinomial, standardised, L2) on
CountVectorizer x IDF features: a standardised feature does not depend on its IDF, so a term
counts as its frequency over the weighted standard deviation of it; a term without variation or
in every training document has coefficient 0; intercepts are not penalised.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casestory.operators.metrics import confusion, summary_metrics
from casestory.session import scratch_path

register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Postings and documents of a block, terms of a shard, messages that meet in one group; at most about.
BLOCK_POSTINGS, BLOCK_DOCS, SHARD_TERMS, FAN = 2_000_000, 32_768, 8_192, 64
#: Bytes of a shard's parameters and history; at most about.
ROW_BYTES = 2 << 20
#: Vectors that L-BFGS remembers.
MEMORY = 6
#: Shuffle files of a finished evaluation go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings while a model is fitted; Arrow batches of large rows are cut by their bytes.
SETTINGS = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Written tables: rows are large, so their bytes are looked at after each one, not after a hundred.
FILES = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
#: The term of the intercept, which no text has.
INTERCEPT = ""


def _stash(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: the lineage ends here."""
    import uuid
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**FILES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def _discard(df: DataFrame) -> None:
    """Delete a table that ``_stash`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def terms(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and underscores, as Spark ML's RegexTokenizer cuts at ``\\W+``."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")


# ---- blocks of documents ------------------------------------------------------------------------

def _blocks(rows: DataFrame, shards: int, kind: str) -> DataFrame:
    """Per block one row with its documents (shard null) and one row per shard with its terms."""
    schema = ("block long, shard int, terms array<string>, ends binary, col binary, tf binary, "
              f"ids array<{kind}>, label binary, fold binary")

    def run(batches):
        import xxhash
        find = re.compile(r"[0-9a-z_]+").findall
        names = ["block", "shard", "terms", "ends", "col", "tf", "ids", "label", "fold"]
        base, made, id_type = TaskContext.get().partitionId() << 24, 0, None
        empty = lambda: ({}, array("i"), array("i"), array("I"), [], array("i"), array("i"))
        number, ends, col, tf, ids, label, fold = empty()

        def rows_of():
            held = list(number)
            shard = np.fromiter((xxhash.xxh64_intdigest(t.encode(), 42) % shards for t in held), dtype=np.int64, count=len(held))
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(held), dtype=np.int32)
            place[order] = np.arange(len(held))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            used = np.flatnonzero(np.diff(cuts))
            parts = [[held[k] for k in order[cuts[s]:cuts[s + 1]]] for s in used]
            n, none = len(used) + 1, [None] * len(used)
            small = np.min_scalar_type(max(tf)).newbyteorder("<")  # as few bytes as the largest count needs
            columns = [[base | made] * n, [None, *used.tolist()], [None, *parts], [np.asarray(ends, "<i4").tobytes(), *none],
                       [place[np.asarray(col)].astype("<i4").tobytes(), *none], [np.asarray(tf).astype(small).tobytes(), *none],
                       [ids, *none], [np.asarray(label, "<i4").tobytes(), *none], [np.asarray(fold, "<i4").tobytes(), *none]]
            types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            id_type = batch.column("id").type
            for i, text, y, f in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("label").to_pylist(), batch.column("fold").to_pylist()):
                counts = Counter(find(text.as_py() or ""))
                counts[INTERCEPT] = 1
                col.extend(number.setdefault(t, len(number)) for t in counts)
                tf.extend(counts.values())
                ends.append(len(col))
                ids.append(i)
                label.append(-1 if y is None else y)
                fold.append(-1 if f is None else f)
                if len(col) >= BLOCK_POSTINGS or len(ids) >= BLOCK_DOCS:
                    yield rows_of()
                    made += 1
                    number, ends, col, tf, ids, label, fold = empty()
        if ids:
            yield rows_of()
    return rows.mapInArrow(run, schema)


def _shard_terms(held: DataFrame) -> DataFrame:
    """``shard, terms``: the sorted different terms of every shard, about SHARD_TERMS of them."""
    each = held.where("shard is not null").select("shard", F.explode("terms").alias("term")).distinct()
    return each.groupBy("shard").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def _links(held: DataFrame, vocabulary: DataFrame, groups: int) -> DataFrame:
    """``group, shard, block, pos``: places in the shard of the terms that the block has of it."""
    of_group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")
    asked = held.where("shard is not null").select(of_group, "shard", "block", "terms")
    spread = vocabulary.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("group", "shard", "terms")

    def run(asked: pa.Table, spread: pa.Table) -> pa.Table:
        if not asked.num_rows or not spread.num_rows:
            return asked.slice(0, 0).drop_columns(["terms"]).append_column("pos", pa.array([], pa.binary()))
        place = {t: i for i, t in enumerate(spread["terms"][0].as_py())}
        pos = [np.array([place[t] for t in row.as_py()], "<i4").tobytes() for row in asked["terms"]]
        return asked.drop_columns(["terms"]).append_column("pos", pa.array(pos, pa.binary()))
    return asked.groupBy("group", "shard").cogroup(spread.groupBy("group", "shard")).applyInArrow(run, "group int, shard int, block long, pos binary")


# ---- the optimiser's few numbers on the driver --------------------------------------------------

def direction(gram: np.ndarray, n: int) -> np.ndarray:
    """Coefficients of the L-BFGS direction over the vectors s_1..s_n, y_1..y_n, g (oldest first),
    from their dot products (two-loop recursion on coefficients)."""
    s, y, g = range(n), range(n, 2 * n), 2 * n
    d, alpha = np.zeros(2 * n + 1), np.zeros(n)
    d[g] = -1.0
    for i in reversed(range(n)):
        alpha[i] = d @ gram[:, s[i]] / gram[s[i], y[i]]
        d[y[i]] -= alpha[i]
    if n:
        d *= gram[s[-1], y[-1]] / gram[y[-1], y[-1]]
    for i in range(n):
        d[s[i]] += alpha[i] - d @ gram[:, y[i]] / gram[s[i], y[i]]
    return d


class Fold:
    """Step control of one model: its loss, its history's dot products and the step being tried."""

    def __init__(self):
        self.loss, self.n, self.step, self.iterations, self.tries, self.done = np.inf, 0, 0.0, 0, 0, False
        self.gram = self.penalty = self.mix = None

    def vectors(self) -> list[int]:
        """Places of the used history vectors and the gradient among s x MEMORY, y x MEMORY, g, theta."""
        return [*range(MEMORY - self.n, MEMORY), *range(2 * MEMORY - self.n, 2 * MEMORY), 2 * MEMORY]

    def aim(self, gram: np.ndarray, penalty: np.ndarray) -> None:
        """A new direction from the dot products at the current point."""
        self.gram, self.penalty = gram, penalty
        used = self.vectors()
        d = direction(gram[np.ix_(used, used)], self.n)
        self.mix = np.zeros(2 * MEMORY + 2)
        self.mix[used] = d
        length = np.sqrt(max(self.mix @ gram @ self.mix, 0.0))
        self.step = 1.0 if self.n else 1.0 / max(length, 1e-300)
        self.slope = float(self.mix @ gram[:, 2 * MEMORY])
        if self.slope >= 0 or length == 0:
            self.done = True

    def penalised(self, step: float) -> float:
        """Squared length, without intercepts, of the point a step ahead."""
        at = self.mix * step
        at[-1] += 1.0
        return float(at @ self.penalty @ at)

    def judge(self, loss: float, max_iter: int, tol: float) -> bool:
        """Whether the step is taken (enough decrease); shortens it to the minimum of the parabola
        through what is known otherwise, and gives up where no step helps any more."""
        if not loss <= self.loss + 1e-4 * self.step * self.slope:
            rise = loss - self.loss - self.slope * self.step
            self.step *= min(0.5, max(0.1, -self.slope * self.step / (2 * rise))) if np.isfinite(rise) else 0.1
            self.tries += 1
            self.done = self.tries > 12
            return False
        self.done = self.loss - loss <= tol * self.first
        self.loss, self.iterations, self.tries = loss, self.iterations + 1, 0
        self.done |= self.iterations >= max_iter
        return True


# ---- one evaluation -----------------------------------------------------------------------------

#: ``bias``: the first term of the shard is the intercept (the empty term sorts first).
_STATE = "shard int, n int, bias boolean, scale binary, vectors binary, gram array<double>"


def _sent(classes: int) -> int:
    """Classes that a state keeps and that travel in an evaluation: all but the last."""
    return max(classes - 1, 1)


def _all_classes(w: np.ndarray, classes: int) -> np.ndarray:
    """With the last class, whose parameters and gradients are what the others' lack to zero."""
    return w if w.shape[-1] == classes else np.concatenate([w, -w.sum(axis=-1, keepdims=True)], axis=-1)


def _messages(state: DataFrame, links: DataFrame, groups: int, shape, mixes, steps, whole: bool = False) -> DataFrame:
    """``block, shard, pos, values``: coefficients per frequency, at the points being tried; less those of the
    last class, unless they are wanted ``whole``."""
    folds, classes = shape
    sent = classes if whole else _sent(classes)

    def points(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                w = _all_classes(_point(row, folds, classes, mixes, steps) * _scale(row, folds)[:, :, None], classes)
                if sent < classes:
                    w = np.ascontiguousarray(w[:, :, :-1] - w[:, :, -1:])
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(k, 1), pa.array([w.astype("<f8").tobytes()], pa.binary())], ["shard", "w"])
    at = state.select("shard", "scale", "vectors").mapInArrow(points, "shard int, w binary")
    spread = at.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(links: pa.Table, spread: pa.Table) -> pa.Table:
        names, types = ["block", "shard", "pos", "values"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        if not links.num_rows or not spread.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        w = np.frombuffer(spread["w"][0].as_py(), "<f8").reshape(-1, folds * sent)
        values = [w[np.frombuffer(p.as_py(), "<i4")].tobytes() for p in links["pos"]]
        return pa.table([links["block"], links["shard"], links["pos"], pa.array(values, pa.binary())], names=names)
    return links.groupBy("group", "shard").cogroup(spread.groupBy("group", "shard")).applyInArrow(run, "block long, shard int, pos binary, values binary")


def _vectors(row: pa.Table, folds: int, classes: int) -> np.ndarray:
    """(s x MEMORY, y x MEMORY, g, theta) x term x fold x class but the last."""
    return np.frombuffer(row["vectors"][0].as_py(), "<f8").reshape(2 * MEMORY + 2, -1, folds, _sent(classes))


def _scale(row: pa.Table, folds: int) -> np.ndarray:
    return np.frombuffer(row["scale"][0].as_py(), "<f8").reshape(-1, folds)


def _point(row, folds, classes, mixes, steps) -> np.ndarray:
    v = _vectors(row, folds, classes)
    return v[-1] + np.einsum("vf,vnfk,f->nfk", np.array(mixes).T, v, np.array(steps))


class BlockRows:
    """Documents of a block: postings, labels and, per fold, weights."""

    def __init__(self, row: pa.Table, weights: np.ndarray):
        take = lambda name, kind: np.frombuffer(row[name][0].as_py(), kind)
        self.col, ends, tf = take("col", "<i4"), take("ends", "<i4"), row["tf"][0].as_py()
        self.row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.tf = np.frombuffer(tf, f"<u{len(tf) // len(self.col)}").astype(np.float64)
        self.label, self.fold, self.n = take("label", "<i4"), take("fold", "<i4"), len(row["ids"][0])
        folds = len(weights)
        own = self.fold[:, None] == np.arange(folds)
        self.weight = np.where((self.label < 0)[:, None] | own, 0.0, weights[:, np.maximum(self.label, 0)].T)

    def margins(self, w: np.ndarray) -> np.ndarray:
        """document x fold x class."""
        flat = w.reshape(len(w), -1)
        out = np.empty((self.n, flat.shape[1]))
        for c in range(flat.shape[1]):
            out[:, c] = np.bincount(self.row, self.tf * flat[self.col, c], minlength=self.n)
        return out.reshape(self.n, *w.shape[1:])

    def sums(self, values: np.ndarray, n_terms: int, factor: np.ndarray) -> np.ndarray:
        """Per term the sum over documents of factor x values."""
        flat = values.reshape(self.n, -1)
        out = np.empty((n_terms, flat.shape[1]))
        for c in range(flat.shape[1]):
            out[:, c] = np.bincount(self.col, factor * flat[self.row, c], minlength=n_terms)
        return out

    def loss_and_residual(self, w: np.ndarray, classes: int):
        """Loss per fold, and weight x (probability - target) per document, fold and class of ``w``; a
        last class that ``w`` lacks has margins of zero."""
        z, sent = self.margins(w), w.shape[2]
        if sent < classes:
            z = np.concatenate([z, np.zeros((*z.shape[:2], 1))], axis=2)
        z -= z.max(axis=2, keepdims=True)
        logs = np.log(np.exp(z).sum(axis=2))
        hit = np.maximum(self.label, 0)
        target = np.take_along_axis(z, hit[:, None, None], axis=2)[:, :, 0]
        loss = (self.weight * (logs - target)).sum(axis=0)
        p = np.exp(z - logs[:, :, None])
        p[np.arange(self.n), :, hit] -= 1.0
        return loss, np.ascontiguousarray(p[:, :, :sent]) * self.weight[:, :, None]


def _of_block(table: pa.Table, width: int):
    """Messages of a block in the order of its terms (by shard): shards, places and values."""
    order = np.argsort(table["shard"].to_numpy())
    shards = table["shard"].to_numpy()[order]
    pos = [table["pos"][int(i)].as_py() for i in order]
    sizes = np.array([len(p) // 4 for p in pos])
    values = np.frombuffer(b"".join(table["values"][int(i)].as_py() for i in order), "<f8").reshape(-1, width) if width else None
    return shards, pos, np.concatenate([[0], np.cumsum(sizes)]), values


_GRADIENTS = "shard int, part int, pos binary, sums binary, losses array<double>"


def _answers(shards, pos, cuts, sums, losses, part) -> pa.Table:
    n = len(shards)
    return pa.table([pa.array(shards, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(pos, pa.binary()),
                     pa.array([sums[a:b].astype("<f8").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                     pa.array([losses] + [None] * (n - 1), pa.list_(pa.float64()))], names=["shard", "part", "pos", "sums", "losses"])


def _no_answers() -> pa.Table:
    return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()))],
                    names=["shard", "part", "pos", "sums", "losses"])


def _part(block: int, parts: int) -> int:
    return int((block * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 32) % parts


def _gradients(blocks: DataFrame, messages: DataFrame, shape, weights, parts: int) -> DataFrame:
    folds, classes = shape

    def run(block: pa.Table, messages: pa.Table) -> pa.Table:
        if not block.num_rows or not messages.num_rows:
            return _no_answers()
        rows = BlockRows(block, weights)
        shards, pos, cuts, values = _of_block(messages, folds * _sent(classes))
        loss, residual = rows.loss_and_residual(values.reshape(-1, folds, _sent(classes)), classes)
        return _answers(shards, pos, cuts, rows.sums(residual, len(values), rows.tf), loss.tolist(), _part(block["block"][0].as_py(), parts))
    return blocks.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(run, _GRADIENTS)


def _moments(blocks: DataFrame, links: DataFrame, shape, weights, parts: int) -> DataFrame:
    """Sums of weight x tf, weight x tf^2 and documents with the term, per term and fold."""
    folds, _ = shape

    def run(block: pa.Table, links: pa.Table) -> pa.Table:
        if not block.num_rows or not links.num_rows:
            return _no_answers()
        rows = BlockRows(block, weights)
        shards, pos, cuts, _ = _of_block(links, 0)
        n = int(cuts[-1])
        one = rows.sums(rows.weight, n, rows.tf)
        two = rows.sums(rows.weight, n, rows.tf ** 2)
        seen = rows.sums((rows.weight > 0).astype(np.float64), n, np.ones(len(rows.tf)))
        return _answers(shards, pos, cuts, np.concatenate([one, two, seen], axis=1), [0.0], _part(block["block"][0].as_py(), parts))
    return blocks.groupBy("block").cogroup(links.groupBy("block")).applyInArrow(run, _GRADIENTS)


def _added(table: pa.Table, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, width))
    for pos, sums in zip(table["pos"], table["sums"]):
        out[np.frombuffer(pos.as_py(), "<i4")] += np.frombuffer(sums.as_py(), "<f8").reshape(-1, width)
    return out


def _combined(answers: DataFrame, parts: int, width: int) -> DataFrame:
    """Answers added up until at most FAN are left per shard, FAN at a time."""
    def run(table: pa.Table) -> pa.Table:
        places = [np.frombuffer(p.as_py(), "<i4") for p in table["pos"]]
        pos, at = np.unique(np.concatenate(places), return_inverse=True)
        sums = np.frombuffer(b"".join(s.as_py() for s in table["sums"]), "<f8").reshape(-1, width)
        out = np.stack([np.bincount(at, sums[:, c], minlength=len(pos)) for c in range(width)], axis=1)
        return _answers(table["shard"][:1].to_numpy(), [pos.astype("<i4").tobytes()], [0, len(pos)], out, None, table["part"][0].as_py())
    while parts > 1:
        answers = answers.groupBy("shard", "part").applyInArrow(run, _GRADIENTS)
        parts = -(-parts // FAN)
        answers = answers.withColumn("part", F.col("part") % parts)
    return answers


# ---- training -----------------------------------------------------------------------------------

@dataclass
class Model:
    """``coefficients``: term, w (an array of classes per fold; the intercept is the empty term)."""
    coefficients: DataFrame
    scored: DataFrame
    folds: int
    classes: int
    losses: list[float]
    iterations: list[int]
    evaluations: int


def class_weights_by_fold(counts: dict, folds: int, classes: int, balanced: bool) -> np.ndarray:
    """fold x class: n / (classes seen x n of the class) over the fold's training rows, or 1."""
    out = np.zeros((folds, classes))
    for f in range(folds):
        n = np.array([sum(v for (g, y), v in counts.items() if y == c and g != f) for c in range(classes)], dtype=np.float64)
        if balanced and n.sum():
            out[f, n > 0] = n.sum() / ((n > 0).sum() * n[n > 0])
        else:
            out[f] = 1.0
    return out


@contextmanager
def _settings(spark):
    """SETTINGS hold inside, what held before holds again afterwards."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fit(rows: DataFrame, folds: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", fold_col: str | None = None,
        reg: float = 0.01, max_iter: int = 50, tol: float = 1e-4, balanced: bool = True) -> Model:
    """M4 / M5: ``folds`` models at once; model f is trained on the labelled rows whose ``fold_col`` is not f.

    Without ``fold_col``, or where it is null, a row counts in all models. Labels are 0, 1, ...; rows
    with a null label are scored but not learnt from. Null and empty texts have the intercept alone. Rows
    that repeat count each. A model is done when a step lowers its loss by at most ``tol`` of the loss
    at zero, or after ``max_iter`` steps. ``Model.scored`` has one row per row: ``id, fold, label, margins`` (an
    array of classes per fold; that of the row's own fold is out-of-fold). No labelled rows raise
    ValueError.
    """
    spark = rows.sparkSession
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(None).cast("int")
    data = rows.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
                       F.col(label_col).cast("int").alias("label"), fold.alias("fold"))
    kind = data.schema["id"].dataType.simpleString()
    counts = {(r[0], r[1]): r[2] for r in data.where("label is not null").groupBy("fold", "label").count().collect()}  # folds x classes
    if not counts:
        raise ValueError("no labelled rows")
    classes = max(y for _, y in counts) + 1
    weights = class_weights_by_fold(counts, folds, classes, balanced)
    n_train = [sum(v for (g, _), v in counts.items() if g != f) for f in range(folds)]
    totals = [(sum(v * weights[f, y] for (g, y), v in counts.items() if g != f), sum(v * weights[f, y] ** 2 for (g, y), v in counts.items() if g != f))
              for f in range(folds)]
    distinct = data.select(F.explode(terms(F.col("text"))).alias("t")).agg(F.approx_count_distinct("t", 0.05)).first()[0]
    shape = folds, classes
    shards = max(1, -(-distinct // max(1, min(SHARD_TERMS, ROW_BYTES // (8 * (2 * MEMORY + 2) * folds * _sent(classes))))))
    with _settings(spark):
        held = _stash(_blocks(data, shards, kind), "blocks")
        n_blocks = held.where("shard is null").count()
        groups = parts = max(1, -(-n_blocks // FAN))
        blocks = held.where("shard is null").select("block", "ends", "col", "tf", "ids", "label", "fold").repartition("block").sortWithinPartitions("block")
        blocks.persist(StorageLevel.DISK_ONLY)
        try:
            vocabulary = _stash(_shard_terms(held), "terms")
            links = _stash(_links(held, vocabulary, groups), "links")
            state = _stash(_start(vocabulary, _combined(_moments(blocks, links.drop("group"), shape, weights, parts), parts, 3 * folds), shape, totals, n_train), "state")
            models, evaluations = [Fold() for _ in range(folds)], 0
            mixes, steps = np.zeros((folds, 2 * MEMORY + 2)), np.zeros(folds)
            while True:
                messages = _messages(state, links, groups, shape, mixes, steps)
                found = _stash(_gradients(blocks, messages, shape, weights, parts), "gradients")
                evaluations += 1
                sums = [F.sum(F.get("losses", F.lit(f))).alias(f"l{f}") for f in range(folds)]
                losses = [x / total for x, (total, _) in zip(found.agg(*sums).first(), totals)]
                taken = []
                for m, loss, step in zip(models, losses, steps):
                    if evaluations == 1:
                        m.loss = m.first = loss  # at zero, where nothing is penalised
                        taken.append(True)
                    else:
                        taken.append(not m.done and m.judge(loss + reg / 2 * m.penalised(step), max_iter, tol))
                last = state
                state = _stash(_updated(last, _combined(found, parts, folds * _sent(classes)), shape, mixes, steps, taken, [t for t, _ in totals], reg, evaluations > 1), "state")
                _discard(last)
                _discard(found)
                grams = _grams(state, folds)
                for f, m in enumerate(models):
                    if taken[f] and not m.done:
                        gram, penalty = grams[f]
                        if evaluations > 1:
                            m.n = int(sum(gram[i, MEMORY + i] > 0 for i in range(MEMORY)))
                        m.aim(gram, penalty)
                if all(m.done for m in models):
                    break
                mixes = np.stack([np.zeros(2 * MEMORY + 2) if m.done else m.mix for m in models])
                steps = np.array([0.0 if m.done else m.step for m in models])
            still = np.zeros(folds)
            scored = _stash(_scored(blocks, _messages(state, links, groups, shape, mixes * 0, still, whole=True), shape, kind), "scored")
        finally:
            blocks.unpersist()
    return Model(_coefficients(state.join(vocabulary, "shard"), shape), scored, folds, classes, [m.loss for m in models], [m.iterations for m in models], evaluations)


def _start(vocabulary: DataFrame, moments: DataFrame, shape, totals, n_train) -> DataFrame:
    """State at zero: scale = 1 / weighted standard deviation of tf, 0 for terms without use."""
    folds, classes = shape

    def run(vocabulary: pa.Table, moments: pa.Table) -> pa.Table:
        held = vocabulary["terms"][0].as_py()
        n = len(held)
        one, two, seen = np.split(_added(moments, n, 3 * folds), 3, axis=1)
        total, squares = np.array(totals, dtype=np.float64).T
        with np.errstate(divide="ignore", invalid="ignore"):
            var = (two - one ** 2 / total) / (total - squares / total)
            scale = np.where((var > 1e-12 * np.maximum(two / total, 1e-300)) & (seen < np.array(n_train)), 1 / np.sqrt(np.maximum(var, 1e-300)), 0.0)
        bias = held[0] == INTERCEPT
        if bias:
            scale[0] = 1.0
        zero = np.zeros((2 * MEMORY + 2, n, folds, _sent(classes)))
        return pa.table([vocabulary["shard"], pa.array([n], pa.int32()), pa.array([bias]), pa.array([scale.astype("<f8").tobytes()], pa.binary()),
                         pa.array([zero.tobytes()], pa.binary()), pa.array([[]], pa.list_(pa.float64()))], names=["shard", "n", "bias", "scale", "vectors", "gram"])
    return vocabulary.groupBy("shard").cogroup(moments.groupBy("shard")).applyInArrow(run, _STATE)


def _updated(state: DataFrame, found: DataFrame, shape, mixes, steps, taken, totals, reg: float, history: bool) -> DataFrame:
    """The state after the step: folds that take it move on and remember it, the others stay."""
    folds, classes = shape

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        n = state["n"][0].as_py()
        v, scale = _vectors(state, folds, classes).copy(), _scale(state, folds)
        theta = _point(state, folds, classes, mixes, steps)
        gradient = _added(found, n, folds * _sent(classes)).reshape(n, folds, _sent(classes)) / np.array(totals)[:, None]
        punished = np.full(n, reg)
        if state["bias"][0].as_py():
            punished[0] = 0.0
        gradient = gradient * scale[:, :, None] + punished[:, None, None] * theta
        for f in np.flatnonzero(taken):
            own = v[:, :, f]
            if history:
                own[:MEMORY - 1] = own[1:MEMORY].copy()
                own[MEMORY:2 * MEMORY - 1] = own[MEMORY + 1:2 * MEMORY].copy()
                own[MEMORY - 1] = theta[:, f] - own[-1]
                own[2 * MEMORY - 1] = gradient[:, f] - own[2 * MEMORY]
            own[2 * MEMORY], own[-1] = gradient[:, f], theta[:, f]
        grams = []
        for f in range(folds):
            flat = _all_classes(v[:, :, f], classes)
            free = flat[:, :1 if state["bias"][0].as_py() else 0].reshape(2 * MEMORY + 2, -1)
            flat = flat.reshape(2 * MEMORY + 2, -1)
            whole = flat @ flat.T
            grams += [whole.ravel(), (whole - free @ free.T).ravel()]
        return pa.table([state["shard"], state["n"], state["bias"], state["scale"], pa.array([v.astype("<f8").tobytes()], pa.binary()),
                         pa.array([np.concatenate(grams).tolist()], pa.list_(pa.float64()))], names=["shard", "n", "bias", "scale", "vectors", "gram"])
    return state.groupBy("shard").cogroup(found.select("shard", "pos", "sums").groupBy("shard")).applyInArrow(run, _STATE)


def _grams(state: DataFrame, folds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Dot products of each fold's vectors, and without the intercept, summed over shards."""
    size = 2 * MEMORY + 2
    sums = state.select(F.posexplode("gram").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    both = np.array([r["x"] for r in sorted(sums, key=lambda r: r["at"])]).reshape(folds, 2, size, size)
    return [(a, b) for a, b in both]


def _scored(blocks: DataFrame, messages: DataFrame, shape, kind: str) -> DataFrame:
    folds, classes = shape

    def run(block: pa.Table, messages: pa.Table) -> pa.Table:
        rows = BlockRows(block, np.ones((folds, classes)))
        *_, values = _of_block(messages, folds * classes)
        z = rows.margins(values.reshape(-1, folds, classes))
        absent = lambda a: pa.array(a, pa.int32(), mask=a < 0)
        return pa.table([block["ids"].combine_chunks().flatten(), absent(rows.fold), absent(rows.label), pa.array(z.tolist(), pa.list_(pa.list_(pa.float64())))],
                        names=["id", "fold", "label", "margins"])
    return blocks.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(run, f"id {kind}, fold int, label int, margins array<array<double>>")


def _coefficients(state: DataFrame, shape) -> DataFrame:
    folds, classes = shape

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                w = _all_classes(_vectors(row, folds, classes)[-1], classes) * _scale(row, folds)[:, :, None]
                yield pa.RecordBatch.from_arrays([row["terms"].combine_chunks().flatten(), pa.array(w.tolist(), pa.list_(pa.list_(pa.float64())))], ["term", "w"])
    return state.select("terms", "scale", "vectors").mapInArrow(run, "term string, w array<array<double>>")


# ---- scores -------------------------------------------------------------------------------------

def _softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def probabilities(model: Model, fold: Column) -> DataFrame:
    """M2 over the rows that were given to ``fit``, by the model of ``fold``:
    ``doc_id, fold, y_true, probs, y_pred``."""
    z = F.get("margins", fold)
    out = model.scored.select(F.col("id").alias("doc_id"), "fold", F.col("label").alias("y_true"), _softmax(z).alias("probs"))
    return out.withColumn("y_pred", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))


def score(model: Model, docs: DataFrame, fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """M2 for any documents: ``doc_id, probs, y_pred`` by a join of their terms with the coefficients.

    Terms that the model does not know count nothing; null and empty texts have the intercept
    alone. Rows are told apart by a number of their own, so repeated ids get a row each.
    """
    rows = _stash(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                              F.concat(F.array(F.lit(INTERCEPT)), F.coalesce(terms(F.col(text_col)), F.array().cast("array<string>"))).alias("terms")), "to-score")
    each = rows.select("rid", F.explode("terms").alias("term")).groupBy("rid", "term").agg(F.count("*").alias("tf"))
    w = F.get("w", F.lit(fold))
    sums = [F.sum(F.col("tf") * F.get(w, F.lit(c))) for c in range(model.classes)]
    z = each.join(model.coefficients, "term").groupBy("rid").agg(F.array(*sums).alias("z"))
    out = rows.select("rid", "doc_id").join(z, "rid").select("doc_id", _softmax(F.col("z")).alias("probs"))
    return out.withColumn("y_pred", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))


def token_weights(model: Model, fold: int = 0) -> tuple[DataFrame, list[float]]:
    """Weights ``(token, w)`` and bias of one model, for attribution."""
    own = model.coefficients.select(F.col("term").alias("token"), F.get("w", F.lit(fold)).alias("w"))
    bias = own.where(F.col("token") == INTERCEPT).first()
    return own.where(F.col("token") != INTERCEPT), [float(x) for x in bias["w"]]


def kfold_train(folded: DataFrame, k: int, **options) -> tuple[DataFrame, Model]:
    """M5: the k models of a k-fold training in one pass; per fold the metrics of its out-of-fold
    scores (``fold`` 0 .. k - 1) and its sizes, and the model."""
    model = fit(folded, k, fold_col="fold", **options)
    scored = _stash(probabilities(model, F.col("fold")).select("fold", "y_true", "y_pred"), "out-of-fold")
    sizes = {r["fold"]: r["count"] for r in model.scored.where("label is not null").groupBy("fold").count().collect()}  # k rows
    total, rows = sum(sizes.values()), None
    for f in range(k):
        m = summary_metrics(confusion(scored.where(F.col("fold") == f)), "macro").withColumn("fold", F.lit(f))
        m = m.withColumn("n_train", F.lit(total - sizes.get(f, 0))).withColumn("n_val", F.lit(sizes.get(f, 0)))
        rows = m if rows is None else rows.unionByName(m)
    return rows, model
