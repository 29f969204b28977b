"""License scans by patience alignment.

A text is compared with each template in windows of one and a half template lengths, every half
length. In a window the words that are unique to both sides anchor the alignment: their longest
increasing subsequence is taken, and the gaps between anchors are aligned in the same way, where
more words are unique. Coverage is the share of the template's words that are aligned. Windows in
which too few words belong to the template cannot reach the threshold and are not aligned.

In a one-line notice the words that tell licenses apart would fall inside the slack, so its name and
version must stand in the text as a whole. Longer notices of sibling licenses are templates too, and
the one with the most aligned words wins.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.llm.common import keyed
from casestory.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
#: Templates of up to so many words must have their key, the license's name and version, whole.
SHORT = 20
UNTELLING = frozenset(("the", "a", "version", "v", "gpl", "international"))
WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by the first, in which the second increases (patience piles)."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back[k] = ends[pile - 1] if pile else -1
        tops[pile:pile + 1] = [b]
        ends[pile:pile + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned places of equal words, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal ends need no anchors
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if cb[w] == 1 and ca.get(w) == 1}
        anchors = increasing([(k, place[a[k]]) for k in range(a0, a1) if a[k] in place])
        for (p, q), (x, y) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]) if anchors else ():
            todo.append((p + 1, x, q + 1, y))
        out += anchors
    return sorted(out)


def plain(words: list[str]) -> list[str]:
    """Words of a license's name without those that do not tell licenses apart; v3 is 3, licence license."""
    words = [w[1:] if w[0] == "v" and w[1:].isdigit() else "license" if w == "licence" else w for w in words]
    return [w for w in words if w not in UNTELLING]


def key_of(template: list[str]) -> list[str]:
    """The words after "under" of a short template: the license's name and version."""
    if len(template) > SHORT or "under" not in template:
        return []
    key = plain(template[template.index("under") + 1:])
    return key[:-1] if key[-1] == "license" and any(w.isdigit() for w in key) else key


def holds(words: list[str], key: list[str]) -> bool:
    """Whether the key stands in the words, without other words in it."""
    told = plain(words)
    return any(told[k:k + len(key)] == key for k in range(len(told) - len(key) + 1))


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.templates = [(name, words_of(text)) for name, text in templates]
        self.keys = [key_of(w) for _, w in self.templates]
        self.sets = [Counter(w) for _, w in self.templates]
        self.vocabulary = frozenset(w for _, ws in self.templates for w in ws)
        self.threshold = threshold

    def matches(self, words: list[str]) -> list[tuple[str, int, int, float]]:
        """(license, first word, end word, coverage) of the best non-overlapping windows."""
        present = self.vocabulary.intersection(words)
        found = []
        for (name, template), own, key in zip(self.templates, self.sets, self.keys):
            size = len(template)
            least = self.threshold * size
            if sum(own[w] for w in present if w in own) < least:
                continue
            member = np.fromiter((w in own for w in words), dtype=np.int64, count=len(words))
            total = np.concatenate([[0], np.cumsum(member)])
            width, step = size + (size + 1) // 2, max(1, size // 2)
            starts = np.arange(0, max(1, len(words) - width + step), step)
            ends = np.minimum(starts + width, len(words))
            for s, e in zip(starts[total[ends] - total[starts] >= least], ends[total[ends] - total[starts] >= least]):
                pairs = align(words[s:e], template)
                # a name's last word may be written otherwise (v3), just after the aligned ones
                if len(pairs) >= least and holds(words[s + pairs[0][0]:s + pairs[-1][0] + 3], key):
                    found.append((len(pairs) / size, len(pairs), name, int(s + pairs[0][0]), int(s + pairs[-1][0]) + 1))
        out: list[tuple[str, int, int, float]] = []
        for coverage, _, name, s, e in sorted(found, key=lambda f: (-f[1], -f[0], f[4] - f[3], f[3], f[2])):  # most aligned words first
            if all(e <= x or y <= s for _, x, y, _ in out):
                out.append((name, s, e, coverage))
        return sorted(out, key=lambda m: m[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``id, th, n_words, matches`` (license, start, end, coverage; places in words).

    Null and empty texts match nothing; an empty table gives no rows; a map-only job. A template
    that starts a longer one (a short and a long notice) counts only where the longer does not cover it.
    """
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    match = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def run(batches):
        scanner = Scanner(templates, threshold)
        for batch in batches:
            sizes, out = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                sizes.append(len(words))
                out.append([{"license": n, "start": s, "end": e, "coverage": c} for n, s, e, c in scanner.matches(words)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(match))],
                                             ["id", "th", "n_words", "matches"])
    return rows.mapInArrow(run, f"id {kind}, th long, n_words long, matches array<struct<license:string,start:long,end:long,coverage:double>>")


def best(matches):
    """The match with the most coverage, then the first."""
    return F.element_at(F.array_sort(matches, lambda x, y: F.when(x["coverage"] > y["coverage"], -1).when(x["coverage"] < y["coverage"], 1)
                                     .otherwise((x["start"] - y["start"]).cast("int"))), 1)
