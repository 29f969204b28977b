"""Toxicity by maximum-scoring segments.

Tokens are scored by their log-odds between toxic and clean documents under an informative
Dirichlet prior (the rate over both classes); a token that was too rare is scored by its longest
known prefix, so inflected forms share evidence. A linear scan (Ruzzo and Tompa) lists every
maximal segment of a text's score sequence. With the scores' distribution in clean text as
background, a segment of score S in a text of n tokens has the expected count
E = K n exp(-lambda S) (Karlin and Altschul); a document's evidence is the sum of
-ln E over its significant segments, and a logistic curve turns it into a probability.

The model is fitted on at most ``max_rows`` labelled rows (a documented parameter, the rows with
the smallest id hash); scoring covers every row and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.llm.common import held_out, keyed, stash

MAX_ROWS = 50_000
#: A feature enters the lexicon with this share of all occurrences in toxic rows, so at most
#: LEXICON features do; and with three toxic rows at least.
LEXICON, LEAST_ROWS = 200_000, 3
PRIOR, SIGNIFICANT_ROOT = 10.0, 3.5
SIGNIFICANT_E = 0.05
PREFIXES = (6, 5, 4)
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")


def features(word: str):
    """A word and its prefixes, longest first."""
    yield word
    for k in PREFIXES:
        if len(word) > k:
            yield f"{word[:k]}*"


class TokenScores(dict):
    """Word -> score; a word that is not there yet is looked up by its longest known feature."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        found = self[word] = next((self.lexicon[f] for f in features(word) if f in self.lexicon), 0.0)
        return found


class Scorer:
    """Token scores from a lexicon feature -> log-odds, less a drift."""

    def __init__(self, lexicon: dict[str, float], drift: float, most: int = 500_000):
        self.scores, self.drift, self.most = TokenScores(lexicon), drift, most

    def raw(self, text: str) -> np.ndarray:
        if len(self.scores) > self.most:  # words seen so far are only kept for speed
            self.scores.clear()
        words = WORD.findall((text or "").lower())
        return np.fromiter(map(self.scores.__getitem__, words), dtype=np.float64, count=len(words))

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        s = self.raw(text)
        return len(s), maximal_segments(s - self.drift)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score) in one pass over the scores.

    A kept segment knows the nearest earlier one that starts lower; the search for such a one follows
    these links, so a segment once passed over is not met again and the scan is linear.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum through, link
    for k in np.flatnonzero(scores > 0).tolist():
        start, low, high = k, total[k], total[k + 1]
        j = len(out) - 1
        while j >= 0 and out[j][2] >= low:
            j = out[j][4]
        while j >= 0 and out[j][3] < high:
            start, _, low, _, link = out[j]
            del out[j:]
            j = link
        out.append((start, k + 1, low, high, j))
    return [(s, e, float(high - low)) for s, e, low, high, _ in out]


def evidence(n: int, scores: list[float], lam: float, k: float) -> float:
    """Sum of -ln(E / SIGNIFICANT_E) over the significant segments; else that of the best, at least -10."""
    if not n or not scores:
        return -10.0
    each = [lam * s - math.log(k * n) + math.log(SIGNIFICANT_E) for s in scores]
    above = [x for x in each if x > 0]
    return float(min(sum(above), 200.0)) if above else float(max(max(each), -10.0))


def _count_features(texts, lexicon=None) -> Counter:
    out: Counter = Counter()
    for text in texts:
        found = {f for w in set(WORD.findall((text or "").lower())) for f in features(w)}
        out.update(found if lexicon is None else found & lexicon)
    return out


def _feature_table(rows: DataFrame, lexicon=None) -> DataFrame:
    """``feature, n``: the number of rows whose text has each feature."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                c = _count_features(texts[k:k + 256], None if lexicon is None else lexicon.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["feature", "n"])
    return rows.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def log_odds(a: int, b: int, toxic: int, clean: int, prior: float = PRIOR) -> tuple[float, float]:
    """Log-odds ratio of a feature's rates under a Dirichlet prior of ``prior`` rows at its common
    rate, and its significance: the root of the likelihood ratio of two rates against one."""
    q = (a + b + 0.5) / (toxic + clean + 1) * prior  # under the prior even where every row has the feature
    d = math.log((a + q) / (toxic + prior - a - q)) - math.log((b + q) / (clean + prior - b - q))
    share = toxic / (toxic + clean)
    g = sum(2 * x * math.log(x / ((a + b) * s)) for x, s in ((a, share), (b, 1 - share)) if x)
    return d, math.sqrt(max(g, 0.0))


def background(histogram: dict[float, int]) -> tuple[float, float]:
    """Drift and lambda from the token scores of clean text: the drift makes the mean score negative,
    lambda solves sum p exp(lambda s) = 1 (bisection; the positive root exists as some score is positive)."""
    values = np.array([*histogram, 1.0], dtype=float)  # one pseudo token of score 1 keeps the root finite
    p = np.array([*histogram.values(), 1.0], dtype=float)
    p /= p.sum()
    drift = max(0.02, 2.0 * float((np.maximum(values, 0) * p).sum()))
    s = values - drift
    low, high = 1e-6, 1.0
    excess = lambda t: float((p * np.exp(np.minimum(t * s, 700))).sum()) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return drift, min(high, 4.0)


def logistic(rows: list[tuple[float, int, int]], ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of P(1 | x) from (x, n of 1, n of 0) by damped Newton steps with a ridge."""
    if not rows or not sum(r[1] for r in rows) or not sum(r[2] for r in rows):
        share = (sum(r[1] for r in rows) + 0.5) / (sum(r[1] + r[2] for r in rows) + 1.0) if rows else 0.5
        return math.log(share / (1 - share)), 0.0
    x, y, z = (np.array(c, dtype=float) for c in zip(*rows))
    w = np.zeros(2)
    xs = np.stack([np.ones_like(x), x / 10], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        g = xs.T @ (y - (y + z) * p) - ridge * w
        h = (xs * ((y + z) * p * (1 - p))[:, None]).T @ xs + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / 10)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = MAX_ROWS, mod: int = 4) -> dict:
    """Model from labelled rows outside the held-out fold (crc32 of the id mod ``mod`` is 2).

    Null ids and null labels are no training rows; an id labelled twice is toxic if one label says
    so. Without rows of both classes every document gets the share of label 1 (a half if none).
    """
    spark = docs.sparkSession
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, mod))
              .groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).alias("label"))
              .orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows))
    chosen = stash(chosen, "labels")  # at most max_rows rows of an id and a label: broadcast
    rows = stash(keyed(docs, id_col, text_col).join(F.broadcast(chosen), F.col("id") == F.col("l_id")).select("label", "text"), "training")
    toxic, clean = rows.where("label = 1"), rows.where("label = 0")
    n_toxic, n_clean = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    model = {"lexicon": {}, "drift": 0.02, "lam": 1.0, "k": 1.0, "curve": logistic([(0.0, n_toxic, n_clean)] if n_toxic + n_clean else [])}
    if not n_toxic or not n_clean:
        return model
    a = _feature_table(toxic)
    a = stash(a, "toxic-features")
    least = max(LEAST_ROWS, -(-a.agg(F.sum("n")).first()[0] // LEXICON))
    a = {f: n for f, n in a.where(F.col("n") >= least).collect()}  # at most LEXICON
    names = spark.sparkContext.broadcast(frozenset(a))
    b = {f: n for f, n in _feature_table(clean, names).collect()}
    lexicon = {}
    for f, n in a.items():
        d, root = log_odds(n, b.get(f, 0), n_toxic, n_clean)
        lexicon[f] = d if root >= SIGNIFICANT_ROOT else 0.0
    lex = spark.sparkContext.broadcast(lexicon)

    def token_scores(batches):
        scorer = Scorer(lex.value, 0.0)
        for batch in batches:
            c: Counter = Counter()
            for text in batch.column("text"):
                v, n = np.unique(np.round(scorer.raw(text.as_py()), 1), return_counts=True)
                c.update(dict(zip(v.tolist(), n.tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64()), pa.array(list(c.values()), pa.int64())], ["score", "n"])
    histogram = dict(clean.select("text").mapInArrow(token_scores, "score double, n long").groupBy("score").agg(F.sum("n")).collect())
    drift, lam = background(histogram)

    def scan(batches):
        scorer = Scorer(lex.value, drift)
        for batch in batches:
            found = [scorer.segments(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([[s[2] for s in segs] for _, segs in found], pa.list_(pa.float64()))], ["label", "n", "scores"])
    scanned = stash(rows.select("label", "text").mapInArrow(scan, "label int, n long, scores array<double>"), "segments")
    # K: clean segments above a floor, against the tokens they were drawn from
    floor = 1.0
    n_tokens, n_segments = scanned.where("label = 0").agg(
        F.sum("n"), F.sum(F.size(F.filter("scores", lambda s: s >= F.lit(floor))))).first()
    k = min(1.0, (n_segments + 1) / ((n_tokens or 0) + 1) * math.exp(lam * floor))

    def weigh(batches):
        for batch in batches:
            x = [round(evidence(n, s, lam, k), 1) for n, s in zip(batch.column("n").to_pylist(), batch.column("scores").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.float64())], ["label", "x"])
    bins = (scanned.mapInArrow(weigh, "label int, x double").groupBy("x")
            .agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).orderBy("x").collect())  # at most 2,101
    return {"lexicon": lexicon, "drift": drift, "lam": lam, "k": k, "curve": logistic([tuple(r) for r in bins])}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, th, score, segments`` with every significant passage as
    (start, end, score) in tokens. Null and empty texts have no passage and get the curve's low end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    seg = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        m = shared.value
        scorer, (c0, c1) = Scorer(m["lexicon"], m["drift"]), m["curve"]
        for batch in batches:
            p, kept = [], []
            for text in batch.column("text"):
                n, segs = scorer.segments(text.as_py())
                x = evidence(n, [s[2] for s in segs], m["lam"], m["k"])
                p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c0 + c1 * x)))))
                kept.append([{"start": s, "end": e, "score": v} for s, e, v in segs
                             if n and m["k"] * n * math.exp(-m["lam"] * v) < SIGNIFICANT_E])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(p, pa.float64()), pa.array(kept, pa.list_(seg))],
                                             ["id", "th", "score", "segments"])
    return rows.mapInArrow(run, f"id {kind}, th long, score double, segments array<struct<start:long,end:long,score:double>>")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    bad = stash(scored.where(F.col("score") >= threshold).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct(), "toxic")
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left_anti")
