import hashlib
import random
import re

from pyspark.sql import functions as F

from casestory.llm import queries
from casestory.llm import winnowing as op
from tests.llm.helpers import ascii_lower, frame, prose, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    """(id, n_words, n_hit, items) by looking every window up at every place."""
    windows = {}
    for item, text in items:
        w = WORD.findall(ascii_lower(text))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, text, *_ in docs:
        w = WORD.findall(ascii_lower(text))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (who := windows.get(tuple(w[k:k + size]))):
                    hit.update(range(k, k + size))
                    found |= who
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(5)
    items = [(k, prose(rng, 25)) for k in range(12)] + [(100, "Short item here"), (101, "w1 w2"), (102, None), (103, " .,"), (104, "one"), (12, prose(rng, 10))]
    items += [(200, items[0][1]), (None, items[1][1]), (201, "Über été straße a1 b2 c3 d4 e5 f6 g7 h8")]
    docs = [(1, None, "s"), (2, "", "s"), (3, "...", None), (None, "x " + items[1][1], "s"), (4, items[0][1], "s"), (4, items[0][1], "s")]
    for k in range(60):
        body = prose(rng, rng.randint(0, 120)).split()
        src = rng.choice(items[:12])[1].split()
        at = rng.randint(0, len(body))
        n, s = rng.choice([9, 10, 11, 25]), rng.randint(0, 10)
        body[at:at] = src[s:s + n]
        docs.append((10 + k, ("-".join(body) if k % 3 else " ".join(body).upper()), "s"))
    docs += [(90, "see a SHORT; item\there and one", "s"), (91, "Über été, straße a1 b2 c3 d4 e5 f6 g7 h8", "s"), (92, "the same " * 20_000 + items[2][1], "s")]
    docs += [(300 + k, f"n{k} " + items[3][1] + f" m{k}", "hot") for k in range(150)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("size", F.lit("clash"))
    found = op.contamination(frame(spark, docs), bench)
    assert rows_of(found, "id", "n_words", "n_hit", "items") == brute(docs, items)
    spans = {r["id"]: r["hits"] for r in found.where("id = 4").collect()}
    assert [tuple(s) for s in spans[4]] == [(0, 25)]


def test_every_long_shared_span_shares_a_fingerprint():
    """The guarantee itself: any window of 10 words holds a fingerprint chosen from the window alone."""
    from casestory.llm.common import ByteHash
    rng = random.Random(6)
    hasher = ByteHash()
    for _ in range(30):
        shared = prose(rng, 10, 5).encode().split()
        marks = []
        for _ in range(2):
            words = prose(rng, rng.randint(0, 40), 5).encode().split() + shared + prose(rng, 20, 5).encode().split()
            g = op.Grams(words, hasher)
            marks.append(set(g.hashes(5)[g.winnowed(5, 10)].tolist()))
        assert marks[0] & marks[1]


def test_empty_tables_and_stage(spark):
    docs, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert op.contamination(frame(spark, []), bench).count() == 0
    none = op.contamination(frame(spark, docs), bench.limit(0))
    assert none.where("n_hit > 0 or size(items) > 0").count() == 0 and none.count() == len(docs)
    kept = op.decontaminated(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in brute(docs, items) if not r[2]), key=repr)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = rows_of(queries.op9_winnowing(spark, d), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == sorted(((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in brute(docs, items)), key=repr)
