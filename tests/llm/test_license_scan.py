import random
from itertools import combinations

from casestory.llm import license_scan as op
from casestory.llm import queries
from casestory.llm.license_texts import TEMPLATES
from tests.llm.helpers import frame, prose


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(0, 8)
        pairs = list(zip(sorted(rng.sample(range(30), n)), rng.sample(range(30), n)))
        longest = max((k for k in range(n + 1) for c in combinations(pairs, k) if all(x[1] < y[1] for x, y in zip(c, c[1:]))), default=0)
        got = op.increasing(pairs)
        assert len(got) == longest and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for k, y in enumerate(b, 1):
            row[k] = last[k - 1] + 1 if x == y else max(last[k], row[k - 1])
    return row[-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(100):
        a, b = (prose(rng, rng.randint(0, 30), 12).split() for _ in range(2))
        pairs = op.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= common(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    for _, text in TEMPLATES:  # a few edits cost about as many words
        words = op.words_of(text)
        if len(words) > 20:
            edited = list(words)
            for k in rng.sample(range(len(words)), 3):
                edited[k] = "edit"
            assert len(op.align(edited, words)) >= len(words) - 5


def test_planted_notices(spark):
    rng = random.Random(3)
    rows, want = [(1, None, "s"), (2, "", "s"), (3, "the license of the work is under version 3", "s"), (None, TEMPLATES[0][1], None)], {1: [], 2: [], 3: [], None: ["Apache-2.0"]}
    for k in range(80):
        name, text = rng.choice(TEMPLATES)
        words = text.split()
        if len(words) > 20 and k % 2:
            words[rng.randrange(len(words))] = "changed"
        times = rng.choice([0, 1, 1, 2])
        parts = [prose(rng, rng.randint(0, 200))]
        for _ in range(times):
            parts += [" ".join(words).upper() if k % 3 else "\n * ".join(words), prose(rng, rng.randint(0, 200))]
        rows.append((10 + k, " ".join(parts), "s"))
        want[10 + k] = [name] * times
    rows.append((500, "the of and to " * 50_000 + TEMPLATES[3][1], "hot"))
    want[500] = ["MIT"]
    got = {r["id"]: [m["license"] for m in r["matches"]] for r in op.scan(frame(spark, rows)).collect()}
    assert got == want
    assert op.scan(frame(spark, [])).count() == 0


def test_siblings_are_told_apart():
    """Notices that differ in a word or two from a template are their own license, or none."""
    scanner = op.Scanner()
    lines = {"Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-SA 4.0": None, "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
             "Licensed under CC BY-NC 3.0.": None, "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the BSD License": None, "Released under the MIT License": "MIT",
             "Released under the MIT-0 License": None, "Licensed under the Apache License, Version 1.1.": None, "Licensed under the Apache License 2.0": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "This work is licensed under the GNU General Public License v3": "GPL-3.0",
             "This work is licensed under the GNU General Public License (GPL), version 3": "GPL-3.0", "This work is licensed under the GNU General Public License, version 1.": None,
             "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
             "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
             "This work is licensed under a Creative Commons Attribution 4.0 International Licence": "CC-BY-4.0",
             "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License": None}
    rng = random.Random(5)
    for line, name in lines.items():
        for before, after in ((0, 0), (7, 0), (0, 9), (30, 40)):
            words = op.words_of(f"{prose(rng, before)} {line} {prose(rng, after)}")
            assert [m[0] for m in scanner.matches(words)] == ([name] if name else []), line
    for name, text in TEMPLATES:
        assert [(m[0], m[3]) for m in scanner.matches(op.words_of(text))] == [(name, 1.0)]


def test_windows_cover_every_place():
    """Against alignment at every start: whatever reaches the threshold there is found."""
    rng = random.Random(4)
    scanner = op.Scanner((("x", "one two three four five six seven eight"),))
    for _ in range(60):
        words = prose(rng, rng.randint(0, 30)).split()
        words[rng.randint(0, len(words)):0] = rng.choice(["one two three four five six seven eight", "two three four five six seven eight", "one two three four five six seven"]).split()
        assert [m[0] for m in scanner.matches(words)] == ["x"]


def test_query(spark):
    df = queries.op8_license_scan(spark, "/root/testdata/sf0.01")
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(docs) and sum(r["n_matches"] > 0 for r in got.values()) > 10
    for i, text in docs.items():
        assert {n for line, n in lines.items() if line in text} <= set(got[i]["licenses"].split(","))
        assert not got[i]["n_matches"] or "icens" in text
