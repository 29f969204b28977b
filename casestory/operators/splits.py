"""Seeded stratified splits, k-fold assignment and label encoding.

Random order is ``md5(id || '-' || seed)`` so both engines agree. Positions inside a
class never use a window over the whole class: rows are bucketed by the first four hex
digits of the hash, ranked inside ``(class, bucket)`` and offset by the running count
of earlier buckets (``scan_by_key``). Class-level arithmetic runs on the per-class
count table (a handful of rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestory.functions.seq import global_position, scan_by_key


def hash_order(id_col: str, seed: int, salt: str = "") -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}{salt}")))


def class_ranks(df: DataFrame, id_col: str, label_col: str, seed: int, salt: str = "") -> DataFrame:
    """1-based rank of each row inside its class in hash order (``rank_in_class``)."""
    d = df.withColumn("__h", hash_order(id_col, seed, salt))
    r = scan_by_key(d, [label_col], ["__h", id_col], F.substring("__h", 1, 4), rownum="rank_in_class")
    return r.drop("__h")


def _join_by_class(rows: DataFrame, per_class: DataFrame, label_col: str) -> DataFrame:
    """Rows with their class's entry; rows without a label are a class of their own."""
    right = per_class.withColumnRenamed(label_col, "__label")
    return rows.join(right, rows[label_col].eqNullSafe(F.col("__label"))).drop("__label")


def allocate(counts: DataFrame, label_col: str, total_take: Column | int) -> DataFrame:
    """Per-class take counts summing to ``total_take``: floor of the proportional share,
    the remainder to the classes with the largest remainders (ties: lower class first).

    ``counts`` is the per-class count table (one row per class).
    """
    n = F.sum("n_c").over(Window.partitionBy())
    take = F.lit(total_take) if isinstance(total_take, int) else total_take
    # as decimals: a product of two counts outgrows a long
    c = counts.withColumn("__n", n.cast("decimal(19,0)")).withColumn("__num", F.col("n_c").cast("decimal(19,0)") * take.cast("decimal(19,0)"))
    c = c.withColumn("__base", F.floor((F.col("__num") - F.col("__num") % F.col("__n")) / F.col("__n")).cast("long")) \
         .withColumn("__rem", F.col("__num") % F.col("__n"))
    left = take - F.sum("__base").over(Window.partitionBy())
    w = Window.orderBy(F.col("__rem").desc(), F.col(label_col))
    c = c.withColumn("__r", F.row_number().over(w))
    return c.select(label_col, "n_c", (F.col("__base") + F.when(F.col("__r") <= left, 1).otherwise(0))
                    .alias("take"))


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2,
                     seed: int = 42, salt: str = "") -> DataFrame:
    """Adds ``split`` ('train'/'test'); n_test = ceil(n * test_size), per-class test
    counts by largest remainder, members by hash order inside the class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))  # one row per class
    n = df.select(F.count(F.lit(1))).scalar()
    n_test = F.ceil(n * F.lit(test_size)).cast("long")
    alloc = allocate(counts, label_col, n_test).select(label_col, "take")
    r = _join_by_class(class_ranks(df, id_col, label_col, seed, salt), alloc, label_col)
    return r.withColumn("split", F.when(F.col("rank_in_class") <= F.col("take"), "test").otherwise("train")) \
            .drop("take", "rank_in_class")


def train_val_test_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2,
                         val_size: float = 0.1, seed: int = 42) -> DataFrame:
    """D3: test first, then validation at val/(1-test) of the rest."""
    s1 = stratified_split(df, id_col, label_col, test_size, seed)
    rest = s1.filter(F.col("split") == "train").drop("split")
    s2 = stratified_split(rest, id_col, label_col, val_size / (1 - test_size), seed, salt="v")
    s2 = s2.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return s1.filter(F.col("split") == "test").unionByName(s2)


def stratified_kfold(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` per row = (rows of earlier classes + rank in class - 1) mod k, i.e.
    dealing out the class-sorted, hash-shuffled rows; per-fold class counts differ by
    at most one."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    offs = counts.withColumn("__off", F.coalesce(F.sum("n_c").over(
        Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = _join_by_class(class_ranks(df, id_col, label_col, seed), offs.select(label_col, "__off"), label_col)
    return r.withColumn("fold", ((F.col("__off") + F.col("rank_in_class") - 1) % k).cast("int")) \
            .drop("__off", "rank_in_class")


def kfold(df: DataFrame, id_col: str, k: int = 5, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Plain k-fold; contiguous blocks in id order (hash order when shuffled), the
    first n mod k folds one row larger. Requires 2 <= k <= n; ids may have any orderable type."""
    n = df.count()
    if not 2 <= k <= n:
        raise ValueError(f"k must be between 2 and n={n}, got {k}")
    d = df.withColumn("__h", hash_order(id_col, seed)) if shuffle else df
    r = global_position(d, ["__h", id_col] if shuffle else [id_col], "__pos")
    q, rem = n // k, n % k
    big = (q + 1) * rem
    pos0 = F.col("__pos") - 1
    fold = F.when(pos0 < big, F.floor(pos0 / (q + 1))).otherwise(rem + F.floor((pos0 - big) / q))
    return r.withColumn("fold", fold.cast("int")).drop("__h", "__pos")


def train_val_folds(split: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """K-fold over the rows of train and validation together; the test rows stay out."""
    return stratified_kfold(split.filter(F.col("split") != "test").drop("split"), id_col, label_col, k, seed)


def fold_sets(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Train (fold <> k) and validation (fold = k) rows of one fold."""
    return folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)


def encode_labels(train: DataFrame, test: DataFrame | None, label_col: str = "label",
                  out: str = "label_id") -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Sorted distinct train labels -> 0..n-1, applied to train and test; a test label
    not seen in train fails the job. Returns (train, test, mapping)."""
    labels = train.select(label_col).distinct()  # one row per label
    mapping = labels.withColumn(out, (F.row_number().over(Window.orderBy(label_col)) - 1).cast("int"))
    m = mapping
    tr = train.join(m, label_col, "left")
    te = None
    if test is not None:
        te = test.join(m, label_col, "left").withColumn(out, F.when(F.col(out).isNotNull(), F.col(out)).otherwise(
            F.raise_error(F.concat(F.lit("label not seen in training: "), F.col(label_col).cast("string"))).cast("int")))
    return tr, te, mapping
