"""Batch scoring with a caller's own model (M2 and the model hook).

A scorer is made once per task by ``factory()`` and called with a list of at most ``batch`` texts; it
returns one row of numbers per text, logits or probabilities. Texts travel in Arrow batches and never
meet the driver. A model that is large is loaded by the factory from a path that all executors
read, or from a broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

Scorer = Callable[[list[str]], Sequence[Sequence[float]]]


def softmax(rows: np.ndarray) -> np.ndarray:
    e = np.exp(rows - rows.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_with(docs: DataFrame, factory: Callable[[], Scorer], classes: int, batch: int = 32, logits: bool = True,
               id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """``doc_id, y_true, probs, y_pred`` per row of ``docs``; the class of the highest score, the lowest of ties.

    Null texts are scored as empty ones. Without ``label_col`` targets are null. Repeated rows are
    scored each. A scorer that returns another number of rows or classes, or a number that is not
    finite, fails with ValueError. An empty table gives no rows and makes no scorer.
    """
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), label.alias("y_true"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        score = None
        for given in batches:
            for begin in range(0, given.num_rows, batch):
                part = given.slice(begin, batch)
                score = score or factory()
                out = np.asarray(score(part.column("text").to_pylist()), dtype=np.float64)
                if out.shape != (part.num_rows, classes):
                    raise ValueError(f"the scorer returned {out.shape} for {part.num_rows} texts and {classes} classes")
                if not np.isfinite(out).all():
                    raise ValueError("the scorer returned a number that is not finite")
                best = out.argmax(axis=1).astype(np.int32)
                probs = softmax(out) if logits else out
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y_true"), pa.array(probs.tolist(), pa.list_(pa.float64())), pa.array(best)],
                                                 ["doc_id", "y_true", "probs", "y_pred"])
    return rows.mapInArrow(run, f"doc_id {kind}, y_true int, probs array<double>, y_pred int")


def linear_scorer(weights: dict[str, Sequence[float]], bias: Sequence[float]) -> Callable[[], Scorer]:
    """Factory of a scorer that adds up the weights of a text's lower-case ASCII words (a small model,
    such as the strongest terms of a trained one)."""
    def factory() -> Scorer:
        import re
        find = re.compile(r"[0-9a-z_]+").findall
        table = {t: np.asarray(w, dtype=np.float64) for t, w in weights.items()}

        def score(texts):
            start = np.asarray(bias, dtype=np.float64)
            return [sum((table[t] for t in find(text.lower()) if t in table), start) for text in texts]
        return score
    return factory
