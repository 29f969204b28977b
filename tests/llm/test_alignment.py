import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from casestory.llm import alignment as op
from casestory.llm import queries
from tests.llm.helpers import frame, rows_of

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    """Per side: text -> [(id, bytes)], by the public libraries alone."""
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    with open(A_FILE) as f:
        vocab = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    alphabet = op.byte_alphabet()
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)

    def of_a(text):
        return [(i, bytes(alphabet[c] for c in vocab[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text):
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return of_a, of_b


def brute(docs, sides):
    per = []
    for i, text, *_ in docs:
        rows = []
        if text:
            a, b = (side(text) for side in sides)
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends = [set(np.cumsum([len(x) for _, x in s]).tolist()) for s in (a, b)]
                at, pos = [0, 0], [0, 0]
                for cut in sorted(ends[0] & ends[1]):
                    group = []
                    for k, s in enumerate((a, b)):
                        own = []
                        while pos[k] < cut:
                            own.append(s[at[k]][0])
                            pos[k] += len(s[at[k]][1])
                            at[k] += 1
                        group.append(own)
                    rows.append(group)
        per.append((i, rows))
    count = Counter()
    for _, rows in per:
        count.update({(x, y) for a, b in rows for x in a for y in b})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for i, rows in per:
        links = [(x, y) for a, b in rows for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in rows)
        out.append((i, sum(len(a) for a, _ in rows), sum(len(b) for _, b in rows), len(rows), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if rows else ""))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(8)
    words = ["Hello", "world", "straße", "ñandú", "don't", "中文字", "12345", "a.b,c", "naïve", "日本", "x_y", "<|endoftext|>", "</s>", "<0x41>", "🙂", "<s>", "​", "क्षि"]
    docs = [(1, None, "s"), (2, "", "s"), (3, " ", "s"), (4, "   two  spaces   ", "s"), (5, "tab\tand\n\nlines \n x", "s"), (6, "▁ mark", "s"), (7, "mid▁dle", "s"),
            (None, "null id", "s"), (8, "copy of this", "s"), (8, "copy of this", "s"), (9, "\x00 zero \x1c sep\x85nel   line", "s"), (11, "<|endoftext|>", "s"), (12, " lead", "s"), (13, "trail ", "s")]
    docs += [(100 + k, rng.choice([" ", " ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 60))), "s") for k in range(120)]
    docs += [(400 + k, "the same hot text", "hot") for k in range(80)]
    docs += [(900, "word " * 5000 + "end", "s"), (901, "a" * 3000 + "é" * 900, "s"), (902, "".join(chr(0x4e00 + rng.randint(0, 9000)) for _ in range(700)), "s")]
    return docs


def test_against_brute_force(spark, sides):
    docs = sample()
    found = op.align(frame(spark, docs), A_FILE, B_FILE)
    assert rows_of(found, *COLUMNS) == brute(docs, sides)


def test_small_batches_give_the_same_rows(spark, sides, monkeypatch):
    docs = sample()
    for name, value in (("BATCH", 300), ("PART", 50), ("KNOWN", 40), ("PAIRS", 200), ("LONG", 6)):
        monkeypatch.setattr(op, name, value)
    found = op.align(frame(spark, docs), A_FILE, B_FILE)
    assert rows_of(found, *COLUMNS) == brute(docs, sides)


def test_both_ways_of_the_first_tokenizer_agree():
    """The rank encoder against the library that reads the file, one text per code point."""
    with open(A_FILE, "rb") as f, open(B_FILE, "rb") as g:
        both = op.Tokenizers(f.read(), g.read())
    assert both.quick is not None and both.apart
    for c in [*range(0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x1F700), 0x20000, 0xE0001, 0x10FFFF]:
        text = f" a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}\n{chr(c)}'s"
        assert both.quick.encode_ordinary(text) == both.slow.encode(text, add_special_tokens=False).ids
        assert sum((both.quick.encode_ordinary(x) for x in both.chunks(text)), []) == both.quick.encode_ordinary(" " + text)


def test_overlaps_of_both_directions():
    import pandas as pd
    a = pd.DataFrame({"at": [0, 3, 4, 9], "doc": [0, 0, 0, 1]})   # ends 3 4 9 | 12
    b = pd.DataFrame({"at": [0, 2, 9, 10], "doc": [0, 0, 1, 1]})  # ends 2 9 | 10 12
    over_a, over_b = op.overlaps(a, b)
    assert over_a.tolist() == [0, 1, 1, 2] and over_b.tolist() == [0, 0, 3, 3]
    ga, gb = op.groups([0, 0, 0, 1], [3, 1, 5, 3], [0, 0, 1, 1], [2, 7, 1, 2])
    assert ga.tolist() == [0, 0, 0, 1] and gb.tolist() == [0, 0, 1, 1]


def test_empty_table(spark):
    assert op.align(frame(spark, []), A_FILE, B_FILE).collect() == []


def test_query(spark, sides):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op13_token_alignment(spark, sf)
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    assert rows_of(out, "doc_id", *COLUMNS[1:]) == brute(docs, sides)
