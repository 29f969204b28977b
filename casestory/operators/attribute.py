"""Integrated-Gradients attribution re-aimed on a linear softmax model over token
features (X1-X3, X5-X11), see SURVEY §2.9.

Model: for a document with token occurrences i (one-hot per position), the class-k
logit is ``z_k(alpha) = b_k + alpha * s_k`` with ``s_k = sum_i w_k(token_i)`` along the
straight path from the zero baseline (alpha = 0) to the input (alpha = 1). For the
target class c,

    attr_i = sum_k m_k * w_k(token_i),   m_k = mean_alpha[ p_c (1[k = c] - p_k) ]

so a document needs only K scalars ``m_k`` from a step loop over alpha (trapezoid
rule, ``aggregate`` over ``sequence(0, n)``) -- no per-step rows -- and every token
score is one multiplication. Completeness (X5) follows from the per-document sums:
``sum_i attr_i = sum_k m_k s_k``.

Weights come from a weights table ``(token, w array<double>)`` (e.g. a fitted model's
coefficients, joined with a size-checked broadcast) or from a column function of the
token (``weight_fn``).

Tokens have two forms. In *rows* (``doc_id, pos, token``) they can meet a weights table. As
*documents* (``doc_id, tokens``: the array of a text's tokens, one row per text, ids unique) everything
up to the word scores is worked out inside the row, so no token is shuffled; the operators that
take documents keep their other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestory.functions.quantile import exact_medians, stash
from casestory.functions.seq import let, scan_by_key

SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[PAD]"]
NUMERICAL_THRESHOLD = 1e-4
CONVERGED_REL_ERROR = 0.05


# ------------------------------------------------------------------ tokens

def wordpiece_tokens(docs: DataFrame, text: str = "text", piece: int = 4, max_len: int | None = None,
                     side: str = "right") -> DataFrame:
    """M1-style tokens: whitespace words cut into ``piece``-character pieces ('##' marks
    a continuation), framed by [CLS] ... [SEP]. ``pos`` is 0-based over the frame; null and
    empty texts have the frame alone.

    ``max_len`` keeps a window of tokens (side 'right' = first, 'left' = last) as a
    model input would; None keeps the whole text. Pieces are cut and numbered inside the row,
    so there is no shuffle.
    """
    frame = F.concat(F.array(F.lit("[CLS]")), pieces_of(F.col(text), piece), F.array(F.lit("[SEP]")))
    rows = docs.select("doc_id", F.posexplode_outer(frame).alias("__p", "token"), F.size(frame).alias("__n"))
    if max_len is not None:
        rows = rows.filter((F.col("__p") < max_len) if side == "right" else (F.col("__p") >= F.col("__n") - max_len))
    return rows.select("doc_id", F.col("__p").cast("long").alias("pos"), "token")


def pieces_of(text: Column, piece: int = 4) -> Column:
    """The word pieces of a text as an array: a mark is set between the pieces, then the text is split."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(\S{{{piece}}})(?=\S)", "$1 ##")
    return F.array_remove(F.split(marked, r"\s+"), "")


def document_tokens(docs: DataFrame, text: str = "text", piece: int = 4) -> DataFrame:
    """The tokens of ``wordpiece_tokens`` as documents: one row per text with the array ``tokens``, and
    the other columns of ``docs``. Rows without an id are left out, as by the joins on ids."""
    frame = F.concat(F.array(F.lit("[CLS]")), pieces_of(F.col(text), piece), F.array(F.lit("[SEP]")))
    return docs.where(F.col("doc_id").isNotNull()).withColumn("tokens", frame).drop(text)


def _as_documents(tokens: DataFrame) -> bool:
    return "tokens" in tokens.columns


def explode_late(array: Column | str) -> Column:
    """``explode`` for arrays that cost work. The optimizer puts a filter on empty arrays below a plain
    ``explode`` and works them out twice; an outer one leaves a null for them, which the caller drops."""
    return F.explode_outer(array)


def model_input(docs: DataFrame, max_len: int, text: str = "text", piece: int = 4, side: str = "right",
                label: str | None = None) -> DataFrame:
    """M1: one row per text with ``tokens`` of exactly ``max_len`` entries, ``mask`` (1 token, 0
    padding) and the label; longer texts lose the start (side 'left') or the end of the body, as a
    truncating tokenizer does, and keep the frame."""
    body = pieces_of(F.col(text), piece)
    room = max_len - 2
    start = F.when(F.lit(side == "left"), F.greatest(F.size(body) - room, F.lit(0)) + 1).otherwise(F.lit(1))
    frame = F.concat(F.array(F.lit("[CLS]")), F.slice(body, start, F.lit(room)), F.array(F.lit("[SEP]")))
    d = docs.withColumn("__f", frame)
    padded = F.concat("__f", F.array_repeat(F.lit("[PAD]"), max_len - F.size("__f")))
    mask = F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: (i <= F.size("__f")).cast("int"))
    return d.select("doc_id", padded.alias("tokens"), mask.alias("mask"), *([F.col(label).alias("label")] if label else []))


def token_weights_expr(token: Column, fold: int = 0) -> Column:
    """A deterministic two-class weight vector of a token (demo model; both engines can
    compute it): small integers from the first character code and the length."""
    a, n = F.ascii(token), F.length(token)
    # eighths: sums stay exact binary fractions, so the argmax is engine-independent
    w0 = ((a + 3 * n + fold) % 17 - 8) / 8.0
    w1 = ((a * 3 + n + 2 * fold) % 19 - 9) / 8.0
    return F.array(w0.cast("double"), w1.cast("double"))


def with_weights(tokens: DataFrame, weights: DataFrame | None = None,
                 weight_fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Attach ``w array<double>`` to every token (table join or column function); documents get an array
    of these, by a column function only."""
    if _as_documents(tokens):
        if weight_fn is None:
            raise ValueError("a weights table needs tokens in rows")
        return tokens.withColumn("w", F.transform("tokens", lambda t: weight_fn(t)))
    if weight_fn is not None:
        return tokens.withColumn("w", weight_fn(F.col("token")))
    return tokens.join(weights.select("token", "w"), "token", "left") \
                 .withColumn("w", F.coalesce("w", F.array(F.lit(0.0), F.lit(0.0))))


def centred_weights(tw: DataFrame, bias: list[float], k: int = 2) -> tuple[DataFrame, list[float]]:
    """X1 with the corpus mean as baseline: the mean class sums of all documents, spread evenly over
    a document's tokens, are taken from its weights and added to the bias, so the path starts at
    the mean document and ends at the text."""
    sums = tw.groupBy("doc_id").agg(*[F.sum(F.element_at("w", j + 1)).alias(f"s{j}") for j in range(k)],
                                    F.count(F.lit(1)).alias("__n"))
    mean = sums.agg(*[F.avg(f"s{j}") for j in range(k)]).first()  # k numbers
    shift = F.array(*[F.lit(float(x or 0.0)) for x in mean])
    moved = tw.join(sums.select("doc_id", "__n"), "doc_id").withColumn(
        "w", F.zip_with("w", shift, lambda x, y: x - y / F.col("__n"))).drop("__n")
    return moved, [b + float(x or 0.0) for b, x in zip(bias, mean)]


# ------------------------------------------------------------------ X1 / X3

def _class_sums(tw: DataFrame, k: int, weight_fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """``s``: the class sums of every document; documents keep their other columns. With ``weight_fn`` they
    need no ``w``: the weights are numbers inside the sums, no arrays."""
    if weight_fn is not None:
        def total(j):
            return F.aggregate("tokens", F.lit(0.0), lambda acc, t: acc + weight_fn(t)[j])
        return tw.withColumn("s", F.array(*[total(j) for j in range(k)]))
    if _as_documents(tw):
        zero = F.array(*[F.lit(0.0)] * k)
        return tw.withColumn("s", F.aggregate("w", zero, lambda acc, w: F.array(*[acc[j] + w[j] for j in range(k)])))
    s = tw.groupBy("doc_id").agg(*[F.sum(F.element_at("w", j + 1)).alias(f"s{j}") for j in range(k)])
    return s.withColumn("s", F.array(*[F.col(f"s{j}") for j in range(k)])).drop(*[f"s{j}" for j in range(k)])


def doc_path_summary(tw: DataFrame, bias: list[float], n_steps: int | Column, target: Column | None = None,
                     k: int = 2, weight_fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per document: s_k, predicted class, target, m_k (trapezoid over n steps), f(x),
    f(baseline), sum of attributions (= sum_k m_k s_k). The baseline is the empty text; for the
    corpus mean pass weights that are centred (``centred_weights``) and the bias at the mean. Documents
    come with ``w`` or with a ``weight_fn``."""
    s = _class_sums(tw, k, weight_fn)
    b = F.array(*[F.lit(float(x)) for x in bias])
    z1 = F.zip_with(b, F.col("s"), lambda x, y: x + y)
    s = s.withColumn("y_pred", (F.array_position(z1, F.array_max(z1)) - 1).cast("int"))
    s = s.withColumn("target", target if target is not None else F.col("y_pred"))
    s = s.withColumn("n_steps", n_steps if isinstance(n_steps, Column) else F.lit(n_steps))
    return _path_terms(s, b, k)


def _path(s: Column, c: Column, n: Column, b: Column, k: int) -> Column:
    """``m, f_x, f_baseline, sum_attributions`` of class sums ``s`` for class ``c`` over ``n`` steps."""
    def at_point(alpha, then):
        """``then`` of the exponentials of the logits at ``alpha`` and of their sum."""
        def exps(z):
            top = F.greatest(*[z[j] for j in range(k)])
            return let(F.array(*[F.exp(z[j] - top) for j in range(k)]), lambda e: then(e, sum((e[j] for j in range(1, k)), e[0])))
        return let(F.array(*[b[j] + alpha * s[j] for j in range(k)]), exps)

    def step(acc, j):
        tw_ = F.when((j == 0) | (j == n), F.lit(0.5)).otherwise(F.lit(1.0))
        return at_point(j.cast("double") / n, lambda e, total: F.array(*[
            acc[kk] + tw_ * (e[c] / total * (F.when(c == kk, 1.0).otherwise(0.0) - e[kk] / total)) for kk in range(k)]))

    def target(alpha):
        return at_point(F.lit(alpha), lambda e, total: e[c] / total)
    zero = F.array(*[F.lit(0.0) for _ in range(k)])
    m = F.transform(F.aggregate(F.sequence(F.lit(0), n), zero, step), lambda x: x / n)
    return let(m, lambda m: F.struct(m.alias("m"), target(1.0).alias("f_x"), target(0.0).alias("f_baseline"),
                                      _weighted(m, s).alias("sum_attributions")))


def _path_terms(s: DataFrame, b: Column, k: int) -> DataFrame:
    d = s.withColumn("__path", _path(F.col("s"), F.col("target"), F.col("n_steps"), b, k))
    return d.select(*s.columns, "__path.m", "__path.f_x", "__path.f_baseline", "__path.sum_attributions")


def _weighted(m: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(m, w, lambda a, x: a * x), F.lit(0.0), lambda a, x: a + x)


def _dot(m: Column, w: Column, k: int) -> Column:
    """As ``_weighted`` for ``k`` classes, without a loop."""
    return sum((m[j] * w[j] for j in range(k)), F.lit(0.0))


def token_attributions(tw: DataFrame, summary: DataFrame) -> DataFrame:
    """Per token score = sum_k m_k w_k (token rows joined to their document's m)."""
    j = tw.join(summary.select("doc_id", "m", "target"), "doc_id")
    return j.select("doc_id", "pos", "token", "target", _weighted(F.col("m"), F.col("w")).alias("score"))


def document_attributions(summary: DataFrame, k: int = 2, weight_fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """X1 for documents with their path terms (``doc_path_summary`` of documents): ``tokens`` becomes
    the array of ``pos, token, score``."""
    if weight_fn is not None:
        scored = let(F.col("m"), lambda m: F.transform("tokens", lambda t, i: F.struct(
            i.cast("long").alias("pos"), t.alias("token"), _dot(m, weight_fn(t), k).alias("score"))))
        return summary.withColumn("tokens", scored)
    words = F.arrays_zip("tokens", "w")
    numbered = let(F.col("m"), lambda m: F.transform(words, lambda x, i: F.struct(
        i.cast("long").alias("pos"), x["tokens"].alias("token"), _dot(m, x["w"], k).alias("score"))))
    return summary.withColumn("tokens", numbered).drop("w")


def token_rows(attributed: DataFrame) -> DataFrame:
    """The rows of ``token_attributions`` from documents."""
    return attributed.select("doc_id", "target", explode_late("tokens").alias("t")).select("doc_id", "t.pos", "t.token", "target", "t.score")


# ------------------------------------------------------------------ X2

def word_attributions(token_attr: DataFrame) -> DataFrame:
    """Drop [CLS]/[SEP]/[PAD], glue '##' pieces to the previous word, sum scores; a
    repeated word keeps its **last** occurrence's score and its first position.

    word_id comes from a per-document running count of word starts (bucketed scan).
    """
    t = token_attr.filter(~F.col("token").isin(*SPECIAL_TOKENS))
    t = t.withColumn("__start", (~F.col("token").startswith("##")).cast("long"))
    t = scan_by_key(t, ["doc_id"], ["pos"], F.floor(F.col("pos") / 4096), cumsums={"word_id": F.col("__start")})
    piece = F.when(F.col("token").startswith("##"), F.expr("substring(token, 3)")).otherwise(F.col("token"))
    words = t.groupBy("doc_id", "word_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", piece.alias("p")))),
                                 lambda x: x["p"]), "").alias("word"),
        F.sum("score").alias("score"))
    words = words.filter(F.col("word") != "")
    return words.groupBy("doc_id", "word").agg(F.max_by("score", "word_id").alias("score"),
                                               F.min("word_id").alias("first_word_id"))


def _runs(ordered: Column, key: str, last: str, first: str) -> Column:
    """From structs in the order of ``key``: per run of equal keys the ``last`` struct, named so, and the ``first``."""
    def ends(s):
        lasts = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)[key] != x[key], F.lit(True)))
        firsts = F.filter(s, lambda x, i: F.when(i == 0, F.lit(True)).otherwise(F.get(s, i - 1)[key] != x[key]))
        return F.zip_with(lasts, firsts, lambda x, y: F.struct(x.alias(last), y.alias(first)))
    return let(ordered, ends)


def document_words(attributed: DataFrame) -> DataFrame:
    """X2 for documents with scored tokens: ``words``, the array of ``word, score, first_word_id`` in
    the order of the words. A word's pieces are a slice of the tokens; repeated words meet by sorting."""
    kept = F.filter("tokens", lambda x: ~x["token"].isin(*SPECIAL_TOKENS))

    def piece(x):
        return F.when(x["token"].startswith("##"), F.substring(x["token"], 3, 2147483647)).otherwise(x["token"])

    def words(t):
        starts = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | ~x["token"].startswith("##"), i)), lambda i: i.isNotNull())
        # pieces before the first start have the number 0
        base = F.when(F.get(t, F.lit(0))["token"].startswith("##"), 0).otherwise(1)

        def word(at):
            def of(i, no):
                return let(F.slice(t, i + 1, F.coalesce(F.get(at, no + 1), F.size(t)) - i), lambda x: F.struct(
                    F.array_join(F.transform(x, piece), "").alias("word"), (no + base).cast("long").alias("word_id"),
                    F.aggregate(x, F.lit(0.0), lambda a, y: a + y["score"]).alias("score")))
            return F.filter(F.transform(at, of), lambda x: x["word"] != "")
        return let(starts, word)
    runs = _runs(F.sort_array(let(kept, words)), "word", "l", "f")
    return attributed.withColumn("words", F.transform(runs, lambda x: F.struct(
        x["l"]["word"].alias("word"), x["l"]["score"].alias("score"), x["f"]["word_id"].alias("first_word_id")))).drop("tokens")


def word_rows(documents: DataFrame, *keep: str) -> DataFrame:
    """The rows of ``word_attributions`` from documents, with the columns ``keep``."""
    return documents.select("doc_id", *keep, explode_late("words").alias("x")).where("x is not null").select("doc_id", "x.word", "x.score", "x.first_word_id", *keep)


# ------------------------------------------------------------------ X4 / W16

def top_k(df: DataFrame, part: list[str], score: str, name: str, k: int, salt_buckets: int = 64) -> DataFrame:
    """Top-k by score per partition, ties by name ascending.

    Two rounds so no window holds a whole large partition: top-k inside
    ``(part, hash(name) mod salt_buckets)``, then top-k of those candidates.
    """
    order = [F.col(score).desc(), F.col(name).asc()]
    salted = df.withColumn("__salt", F.abs(F.xxhash64(F.col(name))) % salt_buckets)
    w1 = Window.partitionBy(*part, "__salt").orderBy(*order)
    cand = salted.withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= k)
    w2 = Window.partitionBy(*part).orderBy(*order)
    return cand.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k).drop("__salt", "__r")


def top_words(word_attr: DataFrame, preds: DataFrame | None, k: int = 25, by_class: bool = True) -> DataFrame:
    """Mean |score| per word over texts, per predicted class (0 vs all others) or
    over all; top k. Without ``preds`` the words bring ``y_pred``."""
    j = word_attr if preds is None else word_attr.join(preds.select("doc_id", "y_pred"), "doc_id")
    cls = (F.when(F.col("y_pred") == 0, "class_0").otherwise("class_1") if by_class else F.lit("all"))
    g = j.groupBy(cls.alias("class"), "word").agg(F.avg(F.abs("score")).alias("mean_abs_score"))
    return top_k(g, ["class"], "mean_abs_score", "word", k)


# ------------------------------------------------------------------ X5-X9

def completeness(summary: DataFrame) -> DataFrame:
    """delta = f(x) - f(b) - sum(attr); relative error with the 1e-4 rule:
    |f(x)-f(b)| < 1e-4 -> 0 if abs error < 1e-4 else +inf (unstable);
    converged = rel < 0.05 and not unstable."""
    d = summary.withColumn("delta", F.col("f_x") - F.col("f_baseline") - F.col("sum_attributions"))
    d = d.withColumn("abs_error", F.abs("delta")).withColumn("denominator", F.abs(F.col("f_x") - F.col("f_baseline")))
    small = F.col("denominator") < NUMERICAL_THRESHOLD
    rel = (F.when(small & (F.col("abs_error") < NUMERICAL_THRESHOLD), F.lit(0.0))
           .when(small, F.lit(float("inf")))
           .otherwise(F.col("abs_error") / F.col("denominator")))
    d = d.withColumn("rel_error", rel).withColumn("numerical_instability", small)
    return d.withColumn("converged", (F.col("rel_error") < CONVERGED_REL_ERROR) & ~small)


def step_ladder(initial: int = 50, max_steps: int = 1000, max_attempts: int = 5) -> list[int]:
    """X6 rungs: initial * 2^i below ``max_steps`` for i < ``max_attempts``; the first rung always
    (``max_steps`` itself is never tried)."""
    return [initial] + [initial << i for i in range(1, max_attempts) if initial << i < max_steps]


def optimal_steps(tw: DataFrame, bias: list[float], rungs: list[int], target_rel_error: float = 0.01,
                  k: int = 2) -> DataFrame:
    """The first rung that meets the target, else the last rung. One row per document with its
    diagnostics.

    A rung is evaluated for the documents that all earlier rungs left above the target and no others;
    what is left after a rung is written to the shared folder, and the next rung starts from there.
    """
    s = _class_sums(tw, k)
    b = F.array(*[F.lit(float(x)) for x in bias])
    z1 = F.zip_with(b, F.col("s"), lambda x, y: x + y)
    s = s.withColumn("target", (F.array_position(z1, F.array_max(z1)) - 1).cast("int"))
    open_, parts = stash(s.select("doc_id", "s", "target"), "open-paths"), []
    for no, steps in enumerate(rungs):
        tried = open_.withColumn("rung_no", F.lit(no)).withColumn("n_steps", F.lit(steps))
        tried = stash(completeness(_path_terms(tried, b, k)), "tried-paths")
        met = F.coalesce(F.col("rel_error") <= target_rel_error, F.lit(False))
        parts.append(tried if no == len(rungs) - 1 else tried.where(met))
        open_ = tried.where(~met).select("doc_id", "s", "target")
        if no < len(rungs) - 1 and open_.isEmpty():
            break
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def adaptive(tw: DataFrame, bias: list[float], low: int = 1500, high: int = 5500,
             threshold: float = 0.05, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """All documents at ``low`` steps; those above ``threshold`` relative error are
    recomputed at ``high`` and replace their low rows. Returns (diagnostics, report)
    where the report has the upgraded share and the estimated saving against all at ``high``:
    the share that stays low times the steps saved per text."""
    lo = completeness(doc_path_summary(tw, bias, low, k=k)).withColumn("upgraded", F.lit(False))
    need = lo.filter(~(F.coalesce(F.col("rel_error"), F.lit(float("inf"))) <= threshold)).select("doc_id")
    tw_hi = tw.join(need, "doc_id", "left_semi")
    hi = completeness(doc_path_summary(tw_hi, bias, high, k=k)).withColumn("upgraded", F.lit(True))
    out = lo.join(need, "doc_id", "left_anti").unionByName(hi)
    rep = out.agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("upgraded").cast("int")).alias("n_upgraded"),
                  F.avg(F.col("upgraded").cast("double")).alias("upgrade_share"))
    rep = rep.withColumn("estimated_saving", (1 - F.col("upgrade_share")) * (high - low) / high)
    return out, rep


def fold_summaries(tokens: DataFrame, bias: list[float], grid: list[int], folds: list[int], k: int = 2,
                   weight_fn=token_weights_expr) -> DataFrame:
    """Path terms of every document for every fold model and step count, from one aggregate over
    the tokens (the class sums of all folds together)."""
    sums = [F.sum(F.element_at(weight_fn(F.col("token"), f), j + 1)) for f in folds for j in range(k)]
    s = tokens.groupBy("doc_id").agg(F.array(*sums).alias("__all"))
    b = F.array(*[F.lit(float(x)) for x in bias])
    each = F.array(*[F.struct(F.lit(f).alias("fold"), F.slice("__all", i * k + 1, k).alias("s")) for i, f in enumerate(folds)])
    s = s.select("doc_id", explode_late(each).alias("e")).select("doc_id", "e.fold", "e.s")
    z1 = F.zip_with(b, F.col("s"), lambda x, y: x + y)
    s = s.withColumn("target", (F.array_position(z1, F.array_max(z1)) - 1).cast("int"))
    s = s.withColumn("n_steps", F.explode(F.array(*[F.lit(n) for n in grid])))
    return _path_terms(s, b, k)


def _fold_sums(tokens: Column, folds: list[int], k: int, weight_fn) -> Column:
    """The class sums of all folds, one fold after the other, over an array of tokens."""
    def total(f, j):
        return F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + weight_fn(t, f)[j])
    return F.array(*[total(f, j) for f in folds for j in range(k)])


def document_fold_scores(tokens: DataFrame, bias: list[float], n_steps: int, folds: list[int], k: int = 2,
                         weight_fn=token_weights_expr) -> DataFrame:
    """X8, token side, for documents: ``doc_id, pos, token, score`` with the mean over folds of each
    token's score; a document's fold terms stand beside its tokens."""
    b = F.array(*[F.lit(float(x)) for x in bias])

    def terms(s):
        z1 = F.zip_with(b, s, lambda x, y: x + y)
        target = let(z1, lambda z: (F.array_position(z, F.array_max(z)) - 1).cast("int"))
        return let(target, lambda c: _path(s, c, F.lit(n_steps), b, k)["m"])
    d = tokens.withColumn("__all", _fold_sums(F.col("tokens"), folds, k, weight_fn))
    d = d.withColumn("__m", F.transform(F.array(*[F.slice("__all", i * k + 1, k) for i in range(len(folds))]), terms))
    each = d.select("doc_id", "__m", F.posexplode_outer("tokens").alias("__p", "token"))

    scores = [_dot(F.col("__m")[i], weight_fn(F.col("token"), f), k) for i, f in enumerate(folds)]
    return each.select("doc_id", F.col("__p").cast("long").alias("pos"), "token", (sum(scores[1:], scores[0]) / len(folds)).alias("score"))


def fold_token_scores(tokens: DataFrame, summaries: DataFrame, folds: list[int], k: int = 2,
                      weight_fn=token_weights_expr) -> DataFrame:
    """X8, token side: mean over folds of each token's score; documents meet their fold terms once."""
    per = summaries.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("fold", "m"))).alias("m"))
    each = [F.aggregate(F.zip_with(F.col("m")[F.lit(f)], weight_fn(F.col("token"), f), lambda x, y: x * y), F.lit(0.0),
                        lambda acc, x: acc + x) for f in folds]
    return tokens.join(per, "doc_id").select("doc_id", "pos", "token", (sum(each[1:], each[0]) / len(folds)).alias("score"))


def fold_errors(diag: DataFrame) -> DataFrame:
    """X8, document side: average relative error (an infinite error keeps it infinite), converged
    and total folds."""
    return diag.groupBy("doc_id").agg(F.avg("rel_error").alias("avg_rel_error"),
                                      F.sum(F.col("converged").cast("int")).alias("converged_folds"),
                                      F.count(F.lit(1)).alias("total_folds"))


def classify_samples(diag: DataFrame) -> DataFrame:
    """Per document: any unstable fold -> numerical; else max finite error > 1 ->
    algorithmic; else all folds converged -> converged; else none."""
    inf = F.lit(float("inf"))
    g = diag.groupBy("doc_id").agg(
        F.bool_or("numerical_instability").alias("any_unstable"),
        F.max(F.when(F.col("rel_error") != inf, F.col("rel_error"))).alias("max_finite_error"),
        F.bool_and("converged").alias("all_converged"))
    return g.withColumn("category", F.when(F.col("any_unstable"), "numerical")
                        .when(F.col("max_finite_error") > 1, "algorithmic")
                        .when(F.col("all_converged"), "converged").otherwise("none"))


def worst_samples(diag: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` documents of each category with the largest finite error (ties by id)."""
    c = classify_samples(diag).filter(F.col("category") != "none")
    return top_k(c.select("category", "doc_id", F.coalesce("max_finite_error", F.lit(-1.0)).alias("max_finite_error")),
                 ["category"], "max_finite_error", "doc_id", k)


# ------------------------------------------------------------------ X10 / X11

def step_grid(tokens: DataFrame, bias: list[float], grid: list[int], folds: list[int], k: int = 2,
              weight_fn=token_weights_expr) -> DataFrame:
    """Diagnostics for every sample x fold x n_steps (grid and folds are parameter
    lists; each fold has its own weights)."""
    return completeness(fold_summaries(tokens, bias, grid, folds, k, weight_fn))


def grid_summary(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X11: per n_steps: mean / median / sample std / max of the relative error, mean and
    median abs error, converged count and total, rounded to 6; recommendation, from the
    unrounded values: first
    n_steps with rate >= 0.95 and mean error <= 0.01, else first with rate >= 0.80,
    else the lowest mean error."""
    grid = stash(grid.select("n_steps", "rel_error", "abs_error", "converged"), "grid")
    medians = exact_medians(grid, "n_steps", ["rel_error", "abs_error"]).withColumnsRenamed(
        {"n_steps": "__n", "rel_error": "median_rel_error", "abs_error": "median_abs_error"})
    mean_rel = F.avg("rel_error").alias("__mean")
    g = grid.groupBy("n_steps").agg(
        mean_rel, F.stddev_samp("rel_error").alias("std_rel_error"),
        F.max("rel_error").alias("max_rel_error"), F.avg("abs_error").alias("mean_abs_error"),
        F.sum(F.col("converged").cast("int")).alias("converged"),
        F.count(F.lit(1)).alias("total")).withColumn("convergence_rate", F.col("converged") / F.col("total"))
    g = g.join(medians, F.col("n_steps").eqNullSafe(F.col("__n")))
    rec = g.agg(F.coalesce(
        F.min(F.when((F.col("convergence_rate") >= 0.95) & (F.col("__mean") <= 0.01), F.col("n_steps"))),
        F.min(F.when(F.col("convergence_rate") >= 0.80, F.col("n_steps"))),
        F.min_by("n_steps", F.struct("__mean", "n_steps"))).alias("recommended_n_steps"))
    six = ("median_rel_error", "std_rel_error", "max_rel_error", "mean_abs_error", "median_abs_error")
    s = g.select("n_steps", F.bround("__mean", 6).alias("mean_rel_error"), *[F.bround(c, 6).alias(c) for c in six],
                 "converged", "total", "convergence_rate")
    return s, rec
