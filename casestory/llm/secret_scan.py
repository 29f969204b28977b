"""Secret scans in DataFrame functions only: known forms, and sliding-window Shannon entropy.

Known forms are found by their patterns. Besides, runs of one character class (hexadecimal digits,
base64 letters) are candidate strings: a window slides over each, and one pass keeps the counts of
the characters in it and the sum of c log2 c, both changed only by the character that enters and
the one that leaves. Windows at or above the class's threshold merge into spans.

Suppressed are candidates that match the allow-list as a whole, and spans inside a known form. A
marker of examples inside a candidate cuts it there, so it hides itself and not the bytes beside it.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: kind, pattern, cheap test for texts that cannot match, length rule.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_TEST = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Character classes: kind, characters, class as a pattern, window length, least bits per character.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", "[0-9A-Fa-f]", 24, 3.2),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "[A-Za-z0-9+/_=-]", 20, 3.8),
)
#: Candidates that are no secrets: words and paths of words, numbers, separators, UUIDs.
ALLOW_LIST = (
    "[A-Z]?[a-z]+|[A-Z]+", "=*+(?:[A-Z]?[a-z]++[-_/=]++)++[A-Z]?[a-z]*+", "[0-9]+", "[-_=+/]+",
    "[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
)
#: Parts of a candidate that are no secrets: published example keys, marks of examples, counting strings.
MARKERS = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|AKIA[A-Z0-9]{9}EXAMPLE|EXAMPLE|example|0123456789|abcdefgh"
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))

SPAN = "struct<start:int,kind:int,end:int,size:int,found:string>"
#: Running values are built in chunks of this many, as appending to an array copies it.
CHUNK = 512
#: Window starts per pass over a candidate.
PIECE = 4096
#: Counts of a window are kept in 5 bits each, 12 to a number; c log2 c in units of 2^-40.
COUNT_BITS, PER_WORD, SCALE = 5, 12, 2**40


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op, zero: int) -> Column:
    """Running ``op`` over an integer array, each value included: within chunks, then over chunks."""
    def along(array):
        return F.slice(F.aggregate(array, F.array(F.lit(zero)), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x))),
                       F.lit(2), F.size(array))

    def joined(chunks):
        before = F.concat(F.array(F.lit(zero)), along(F.transform(chunks, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(zero)))))
        return _let(before, lambda b: F.flatten(F.transform(chunks, lambda c, k: F.transform(c, lambda x: op(F.get(b, k), x)))))

    def chunked(v):
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / CHUNK).cast("int")), lambda k: along(F.slice(v, k * CHUNK + 1, F.lit(CHUNK))))
    return _let(values, lambda v: _let(chunked(v), joined))


def _matches(text: Column, pattern: str, kind: int, sized_by: int = 0) -> Column:
    """All leftmost non-overlapping matches as spans with the length of group ``sized_by``.

    The text between matches, from split, alternates with the matches; running lengths place them.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(sized_by)) if sized_by else found
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda f, g: F.struct(f.alias("found"), (F.length(g) + F.length(f)).alias("step")))
    ends = _running(F.transform(pairs, lambda p: p["step"]), lambda a, b: a + b, 0)

    def span(f, x):
        return F.struct((x["end"] - F.length(f)).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.length(x["sized"]).alias("size"), f.alias("found"))
    return F.zip_with(found, F.zip_with(ends, sized, lambda e, z: F.struct(e.alias("end"), z.alias("sized"))), span)


def _at_least(spans: Column, size: int) -> Column:
    return F.filter(spans, lambda s: s["size"] >= size)


def _windows_of_piece(piece: Column, alphabet: str, window: int, bits: float) -> Column:
    """Merged windows [start, end) of ``piece`` whose entropy log2(window) - s / window is at least
    ``bits``; s, the sum of c log2 c, and the counts change by the two characters that move only.

    The window starts full of a sign that is no character (code 0) and counts once it is left.
    """
    words = len(alphabet) // PER_WORD + 1
    g = F.array(*(F.lit(round(c * math.log2(c) * SCALE) if c else 0).cast("long") for c in range(window + 2)))
    most = math.floor((math.log2(window) - bits + 1e-9) * window * SCALE)
    zero = F.struct(*(F.lit(window if k == 0 else 0).cast("long").alias(f"w{k}") for k in range(words)),
                    F.lit(round(window * math.log2(window) * SCALE)).cast("long").alias("s"), F.lit(0).alias("i"),
                    F.lit(-1).alias("open"), F.lit(-1).alias("close"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def one(code):
        return F.call_function("shiftleft", F.lit(1).cast("long"), (code % PER_WORD * COUNT_BITS).cast("int"))

    def count(acc, code):
        word = acc["w0"]
        for k in range(1, words):
            word = F.when(code >= k * PER_WORD, acc[f"w{k}"]).otherwise(word)
        return F.call_function("shiftright", word, (code % PER_WORD * COUNT_BITS).cast("int")).bitwiseAND(F.lit(2**COUNT_BITS - 1)).cast("int")

    def step(acc, move):
        enter, leave = move["enter"], move["leave"]
        up, down = count(acc, enter), count(acc, leave)
        s = acc["s"] + F.when(enter == leave, F.lit(0).cast("long")).otherwise(
            F.get(g, up + 1) - F.get(g, up) + F.get(g, down - 1) - F.get(g, down))
        counts = [acc[f"w{k}"] + F.when(F.floor(enter / PER_WORD) == k, one(enter)).otherwise(F.lit(0).cast("long"))
                  - F.when(F.floor(leave / PER_WORD) == k, one(leave)).otherwise(F.lit(0).cast("long")) for k in range(words)]
        i = acc["i"] + 1
        return _let(F.struct(s.alias("s"), i.alias("i"), ((i >= window) & (s <= most)).alias("hit")), lambda x: _moved(acc, counts, x))

    def _moved(acc, counts, x):
        joins = x["hit"] & (x["i"] - window <= acc["close"])
        starts = x["hit"] & ~joins
        last = F.struct(acc["open"].alias("start"), acc["close"].alias("end"))
        return F.struct(*(c.alias(f"w{k}") for k, c in enumerate(counts)), x["s"].alias("s"), x["i"].alias("i"),
                        F.when(starts, x["i"] - window).otherwise(acc["open"]).alias("open"),
                        F.when(x["hit"], x["i"]).otherwise(acc["close"]).alias("close"),
                        F.when(starts & (acc["open"] >= 0), F.array_append(acc["out"], last)).otherwise(acc["out"]).alias("out"))

    codes = F.transform(F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c))
    moves = _let(codes, lambda v: F.zip_with(v, F.slice(F.concat(F.array_repeat(F.lit(0), window), v), F.lit(1), F.size(v)),
                                             lambda a, b: F.struct(a.alias("enter"), b.alias("leave"))))
    return F.aggregate(moves, zero, step, lambda acc: F.when(
        acc["open"] >= 0, F.array_append(acc["out"], F.struct(acc["open"].alias("start"), acc["close"].alias("end")))).otherwise(acc["out"]))


def windows_above(candidate: Column, alphabet: str, window: int, bits: float, piece: int = PIECE) -> Column:
    """Merged windows [start, end) of ``candidate`` whose entropy is at least ``bits``.

    The windows that begin in one piece are looked at together; spans that meet at a border join.
    """
    def over(pieces):
        return F.flatten(F.transform(pieces, lambda p, k: F.transform(
            _windows_of_piece(F.concat(p, F.coalesce(F.left(F.get(pieces, k + 1), F.lit(window - 1)), F.lit(""))), alphabet, window, bits),
            lambda s: F.struct((s["start"] + k * piece).alias("start"), (s["end"] + k * piece).alias("end")))))

    def merged(spans):
        first = F.filter(spans, lambda s, k: (k == 0) | (s["start"] > F.get(spans, k - 1)["end"]))
        last = F.filter(spans, lambda s, k: (k == F.size(spans) - 1) | (F.get(spans, k + 1)["start"] > s["end"]))
        return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))
    return _let(F.regexp_extract_all(candidate, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda pieces: _let(over(pieces), merged))


def allowed(candidate: Column, allow_list=ALLOW_LIST) -> Column:
    """Whether a candidate as a whole matches an entry of the allow-list."""
    out = F.lit(False)
    for pattern in allow_list:
        out = out | candidate.rlike(f"^(?:{pattern})$")
    return out


def _parts(run: Column, window: int, markers: str) -> Column:
    """(start, found): what markers leave of a run, as far as a window fits in."""
    whole = F.array(F.struct(run["start"].alias("start"), run["found"].alias("found")))

    def cut(marks):
        ends = F.concat(F.array(F.lit(0)), F.transform(marks, lambda m: m["end"]))
        return F.zip_with(ends, F.split(run["found"], markers, -1), lambda at, gap: F.struct((run["start"] + at).alias("start"), gap.alias("found")))
    parts = F.when(run["found"].rlike(markers), _let(_matches(run["found"], markers, 0), cut)).otherwise(whole)
    return F.filter(parts, lambda p: F.length(p["found"]) >= window)


def _outside(base: Column, added: Column) -> Column:
    """The spans of ``added`` that lie in no span of ``base``: in order of starts, base first, no
    base span so far ends behind them."""
    def ordered(spans, rank):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    def free(spans):
        reach = _running(F.transform(spans, lambda s: F.when(s["rank"] == 0, s["end"]).otherwise(F.lit(-1))), F.greatest, -1)
        left = F.filter(F.zip_with(spans, reach, lambda s, r: F.struct(s.alias("s"), r.alias("reach"))), lambda x: (x["s"]["rank"] == 1) & (x["reach"] < x["s"]["end"]))
        return F.transform(left, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end")))
    return _let(F.array_sort(F.concat(ordered(base, 0), ordered(added, 1))), free)


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allow_list=ALLOW_LIST,
         markers: str = MARKERS) -> DataFrame:
    """One row per row of ``docs``: ``id, base, spans``, arrays of (start, kind, end) in order.

    ``base`` has the known forms, ``spans`` these and the entropy spans; ``kind`` numbers ``KINDS``.
    Null and empty texts have none; an empty table gives no rows; a map-only job, so copies and hot
    sources cost no more than their rows.
    """
    text = F.col("text")
    none = F.array().cast(f"array<{SPAN}>")
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("base", F.concat(
        F.when(text.rlike(ASSIGN_TEST), _at_least(_matches(text, ASSIGN, 0, 2), LEAST_ASSIGN)).otherwise(none),
        F.when(text.contains("AKIA"), _at_least(_matches(text, ACCESS, 1), LEAST_ACCESS)).otherwise(none),
        # a maximal run is the whole match, so only long runs need be listed
        F.when(text.rlike(f"[0-9a-f]{{{LEAST_HEX}}}"), _matches(text, f"[0-9a-f]{{{LEAST_HEX},}}", 2)).otherwise(none)))
    added = []
    for k, (_, alphabet, chars, window, bits) in enumerate(classes):
        runs = F.when(text.rlike(f"{chars}{{{window}}}"), _matches(text, f"{chars}{{{window},}}", 3 + k)).otherwise(none)
        runs = F.filter(runs, lambda r: ~allowed(r["found"], allow_list))
        parts = F.filter(F.flatten(F.transform(runs, lambda r: _parts(r, window, markers))), lambda p: ~allowed(p["found"], allow_list))

        def spans_of(part):
            return F.transform(windows_above(part["found"], alphabet, window, bits), lambda s: F.struct(
                (part["start"] + s["start"]).alias("start"), F.lit(3 + k).alias("kind"), (part["start"] + s["end"]).alias("end")))
        added.append(F.flatten(F.transform(parts, spans_of)))
    d = d.withColumn("base", F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    d = d.withColumn("added", F.concat(*added))
    d = d.withColumn("added", F.when(F.size("added") > 0, _outside(F.col("base"), F.col("added"))).otherwise(F.col("added")))
    return d.select("id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
