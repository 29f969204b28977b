import hashlib
import random
from collections import defaultdict

import pytest

from casestory.llm import queries
from casestory.llm import repeats as op
from tests.llm.helpers import frame, prose, rows_of


def brute(rows, length):
    seen = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, data in texts:
        for k in range(len(data) - length + 1):
            seen[data[k:k + length]] += 1
    out = []
    for i, data in texts:
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen[data[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(data)))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in df.collect()), key=repr)


def sample(seed):
    rng = random.Random(seed)
    passages = [prose(rng, 30, 2000) + " é " for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (None, passages[0]), (4, passages[0]), (4, passages[0]), (5, "a" * 300), (6, "xyz" * 90 + "a" * 90), (7, "long line " * 500)]
    for k in range(70):
        body = prose(rng, rng.randint(5, 60), 2000)
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p)), 2))
            body += (p if rng.random() < 0.5 else p[a:b]) + prose(rng, rng.randint(0, 9), 2000)
        rows.append((10 + k, body))
        if rng.random() < 0.3:
            near = list(body)
            near[rng.randrange(len(near))] = "#"
            rows.append((200 + k, "".join(near)))
    # one hot passage in many different surroundings
    rows += [(300 + k, prose(rng, 4) + passages[1] + prose(rng, 4)) for k in range(60)]
    return [(i, t, "s") for i, t in rows]


@pytest.mark.parametrize("most", [4096, 3])
def test_against_brute_force(spark, most):
    """With classes as they are, and with every class of more than three contexts split."""
    rows = sample(most)
    found = op.without_repeats(frame(spark, rows), length=80, gram=40, most=most)
    assert got(found) == brute([r[:2] for r in rows], 80)


def brute_maximal(members, length):
    """(l, r, who) by trying every l and r of every member."""
    found = {}
    for before, after in members:
        for l in range(len(before) + 1):
            for r in range(max(0, length - l), len(after) + 1):
                part = before[len(before) - l:], after[:r]
                if part not in found:
                    found[part] = frozenset(k for k, (b, a) in enumerate(members) if len(b) >= l and b[len(b) - l:] == part[0] and a[:r] == part[1])
    best = {}
    for (b, a), who in found.items():
        if len(who) > 1:
            wide = best.setdefault(who, [0, 0])
            wide[:] = max(wide[0], len(b)), max(wide[1], len(a))
    return sorted((l, r, sorted(who)) for who, (l, r) in best.items())


def test_maximal_repeats_of_a_class():
    """Sets of members that share a string are closed by their longest left and right extensions."""
    rng = random.Random(5)
    letters = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    seen = 0
    for _ in range(300):
        members = sorted({(letters(rng.randint(0, 5)), b"x" + letters(rng.randint(1, 6))) for _ in range(rng.randint(2, 14))})
        if len(members) < 2:
            continue
        got = sorted((l, r, sorted(who.tolist())) for l, r, who in op.maximal_repeats(members, 5))
        assert got == brute_maximal(members, 5)
        seen += len(got)
    assert seen > 500


@pytest.mark.parametrize("most", [4096, 3])
def test_repeat_groups(spark, most):
    """Equal bytes, every occurrence, left and right diverse or at the reach of the anchor, and each
    repeated window in a group that occurs as often as the window does."""
    length, gram, rows = 80, 40, sample(7)
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    texts = {k: (t or "").encode() for k, t, _ in rows}
    groups = defaultdict(set)
    count = 0
    for r in op.repeat_groups(frame(spark, rows), length=length, gram=gram, most=most).collect():
        groups[r["grp"]].add((r["id"], r["start"], r["end"]))
        count += 1
    assert count == sum(map(len, groups.values()))  # no row twice
    places, where = defaultdict(set), {}
    for k, data in texts.items():
        for p in range(len(data) - length + 1):
            places[data[p:p + length]].add((k, p))
        where[k] = {w: (f, e) for _, first, last, _ in op.anchors(data, op.ByteHash(), length, gram)
                    for f, e in zip(first.tolist(), last.tolist()) for w in range(f, e + 1)}
    covers = set()
    for spans in groups.values():
        (word,) = {texts[k][a:b] for k, a, b in spans}
        k, a, b = min(spans)
        same = {(j, p) for j, p in places[word[:length]] if texts[j][p:p + len(word)] == word}
        assert {(j, p) for j, p, _ in spans} == same and len(same) > 1
        before = {texts[j][p - 1:p] if p else None for j, p, _ in spans}
        behind = {texts[j][e:e + 1] or None for j, _, e in spans}
        if most > 100:
            at_left = any(where[j][p][0] == p for j, p, _ in spans)
            at_right = any(where[j][e - length][1] == e - length for j, _, e in spans)
            assert (len(before) > 1 or None in before or at_left) and (len(behind) > 1 or None in behind or at_right)
        covers |= {(word[p:p + length], len(spans)) for p in range(len(word) - length + 1)}
    repeated = {(w, len(at)) for w, at in places.items() if len(at) > 1}
    assert repeated <= covers and {w for w, _ in covers} == {w for w, _ in repeated}


def test_repeat_groups_of_copies_and_nothing(spark):
    text = prose(random.Random(4), 120)
    rows = [(1, text, "s"), (1, text, "s"), (None, text, "s"), (2, None, "s"), (3, "", "s"), (4, "short", "s")]
    found = op.repeat_groups(frame(spark, rows), length=80, gram=40).collect()
    per = defaultdict(list)
    for r in found:
        per[r["grp"]].append((r["id"], r["start"], r["end"]))
    assert per and all(sorted(i is None for i, _, _ in v) == [False, False, True] and len({x[1:] for x in v}) == 1 for v in per.values())
    assert op.repeat_groups(frame(spark, [])).count() == 0


def test_intervals():
    """Each interval of the tree once: all its suffixes share r, its neighbours do not."""
    rng = random.Random(1)
    for _ in range(200):
        lcp = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        want = set()
        for a in range(len(lcp)):
            for b in range(a, len(lcp)):
                r = min(lcp[a:b + 1])
                outside = max([0, *lcp[a - 1:a] * bool(a), *lcp[b + 1:b + 2]])
                if r and r > outside:
                    want.add((r, outside, a, b + 1))
        assert sorted(op.intervals(lcp)) == sorted(want)


def test_windows_of_long_texts_meet_at_blocks(monkeypatch):
    from casestory.llm.common import ByteHash
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(5000)) + b"z" * 700
    monkeypatch.setattr(op, "BLOCK", 512)
    seen = [w for at, first, last, _ in op.anchors(data, ByteHash()) for a, f, e in zip(at, first, last) for w in range(f, e + 1) if f <= e and e <= a <= f + 200]
    assert seen == list(range(len(data) - 399))
    places = [a for at, *_ in op.anchors(data, ByteHash()) for a in at.tolist()]
    monkeypatch.setattr(op, "BLOCK", 1 << 19)
    assert places == [a for at, *_ in op.anchors(data, ByteHash()) for a in at.tolist()]


def test_empty_table(spark):
    assert op.without_repeats(frame(spark, [])).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op7_repeats(spark, d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(docs, 400)
