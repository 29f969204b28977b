import hashlib
import random

from casestory.llm import exact_dedup as op
from casestory.llm import queries
from tests.llm.helpers import SPACE, frame, rows_of


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        first = True
        for i, t in sorted(members, key=lambda m: m != keep):
            out.append((i, keep[0], len(members), (i, t) == keep and first, hashlib.sha256(norm.encode()).hexdigest()))
            first = False
    return sorted(out, key=repr)


def sample():
    rng = random.Random(1)
    rows = [(1, "a b c", "s"), (2, "a  b\tc", "s"), (3, "abc", "s"), (4, "ABC", "s"), (5, None, "s"), (6, "", "s"), (7, " \n", None),
            (None, "a b c", "s"), (8, "a b c", "s"), (9, "é ü", "s"), (9, "éü", "s"), (1, "a b c", "s"), (1, "a b c", "t")]
    long = "".join(rng.choice("abc \n") for _ in range(300_000))
    rows += [(20, long, "s"), (21, long + " ", "s"), (22, long[:-1] + "z", "s"), (23, long.replace(" ", ""), "s")]
    rows += [(100 + k, "same copy of a line", "hot") for k in range(200)]
    return rows


def query_rows(df):
    from pyspark.sql import functions as F
    each = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = each.withColumn("kept", F.col("kept") & (F.col("copy") == 1))
    return rows_of(each, "id", "keep_id", "group_size", "kept", "sha")


def test_against_brute_force(spark):
    rows = sample()
    assert query_rows(op.exact_groups(frame(spark, rows), chunk=4096)) == brute(rows)


def test_fingerprint_collisions_are_told_apart(spark):
    """With one possible fingerprint per length, the chunkwise comparison decides."""
    rows = [(k, t, "s") for k, t in enumerate(["ab", "ba", "a b", "cc", "abcdef", "abcdeg", "abc def", "x"])]
    assert query_rows(op.exact_groups(frame(spark, rows), primes=(1, 1), chunk=2)) == brute(rows)


def test_combine_equals_whole():
    rng = random.Random(3)
    tables = [op.power_table(b, p, 64) for b, p in zip(op.BASES, op.PRIMES)]
    big = [op.power_table(b, p, 1024) for b, p in zip(op.BASES, op.PRIMES)]
    for _ in range(50):
        data = rng.randbytes(rng.randint(0, 900))
        cut = rng.randint(0, len(data))
        whole = op.fingerprint(data, big, chunk=1024)
        assert op.fingerprint(data, tables, chunk=64) == whole
        assert op.combine(op.fingerprint(data[:cut], tables, chunk=64), op.fingerprint(data[cut:], tables, chunk=64)) == whole


def test_empty_table_and_stage(spark):
    empty = frame(spark, [])
    assert op.exact_groups(empty).count() == 0 and op.deduplicated(empty).count() == 0
    rows = sample()
    kept = op.deduplicated(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    expected = sorted((r[0] for r in brute(rows) if r[3]), key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == expected


def test_query(spark):
    df = queries.op2_exact_dedup(spark, "/root/testdata/sf0.001")
    docs = [(r["doc_id"], r["text"], "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows_of(df, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute(docs)
