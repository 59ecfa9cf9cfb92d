import random
import re

from timelake.llm import substring


def brute(rows, n):
    split = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, w in split:
        if k is not None:
            for i in range(len(w) - n + 1):
                key = tuple(w[i : i + n])
                first[key] = min(first.get(key, k), k)
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if k is not None and first[tuple(w[i : i + n])] < k:
                gone |= set(range(i, i + n))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def got(spark, rows, n):
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n int").repartition(3)
    out = substring.dedup_substrings(df, n).collect()
    assert all(r.n == 7 and sum(s.end - s.start for s in r.removed_spans) == r.n_removed for r in out)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out), key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    words = ["a", "bb", "é", "a\x1cb", "ccc", " d", "x\ty"]
    passage = " ".join(r.choice(words) for _ in range(30))
    rows = []
    for k in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        if k % 3 == 0:
            t += "\n" + passage + " " + t
        rows.append((k * 2, t))
    rows += [(4, rows[5][1]), (4, rows[5][1]), (1000, None), (1001, ""), (None, passage), (None, passage), (1002, rows[0][1]), (1003, rows[0][1])]
    for n in (3, 5, 13):
        assert got(spark, rows, n) == brute(rows, n)


def test_empty_and_long(spark):
    assert got(spark, [], 13) == []
    long = " ".join(str(i) for i in range(60000))
    assert [x[:3] for x in got(spark, [(1, long), (2, "q " + long)], 13)] == [(1, 60000, 0), (2, 60001, 60000)]


def test_clashing_columns_and_null_keys(spark):
    rows = [(1, "a b c d", "x", 5, 6), (2, "q a b c d", "y", 7, 8), (None, "a b c d", None, None, None)] + [(None, "z%d" % i, "n", 0, 0) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _bucket string, N_WORDS int, row int")
    out = substring.dedup_substrings(df, 3)
    assert out.columns == ["doc_id", "text", "_bucket", "row", *substring.OUTPUTS]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert got[2, "q a b c d"].n_removed == 4 and got[2, "q a b c d"]["_bucket"] == "y" and got[2, "q a b c d"].row == 8
    assert got[None, "a b c d"].n_removed == 0 and len(got) == 53
