import hashlib
import random
import re

from pyspark.sql import functions as F

from timelake.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0]))


def texts():
    r = random.Random(4)
    bits = ["a.b@c.de", "a@b", "@", "x@y.z_q@r.s", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111111111111111", "1234567890123456", "+1 (961) 555-6946", "+49.30.1234", "+1", "+1234567890123456789", "é𝕏", " ", "\n", "-", "555-123-4567", "7"]
    return ["".join(r.choice(bits) + r.choice(["", " ", ", "]) for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, "", "a@b.c" * 200, "a" * 100000, "1." * 2000, "9" * 60000, "x@y" + ".a" * 40000, "+1 " * 3000]


def test_base_spans_and_redaction(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    model = pii.fit(docs)
    found = pii.find(docs, model)
    got = {r.doc_id: r for r in found.select("doc_id", "text", "kind", pii.notation(F.filter("spans", lambda s: s["base"])).alias("b"), "spans", pii.redacted(F.col("text"), F.col("spans")).alias("red")).collect()}
    for i, t, _ in rows:
        assert got[i].b == brute(t), t[:200]
        want, pos = "", 0
        for s in sorted((s.start, s.end, s.kind) for s in got[i].spans):
            if s[0] >= pos:
                want += t[pos : s[0]] + f"[{pii.KINDS[s[2]].upper()}]"
            pos = max(pos, s[1])
        assert got[i].red == (None if t is None else want + t[pos:])


GOOD = [
    ("please call 555-123-4567 now", ["phone"]), ("phone (555) 123-4567", ["phone"]), ("mail joe (at) site (dot) com", ["email"]), ("tel +1 (961) 555-6946 x", ["phone"]), ("call +1 (961) 555-6946", ["phone"]), ("contact a@b.com", ["email"]), ("card 4111 1111 1111 1111", ["card"]), ("version 10 of 20", []),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', ["secret"]), ("my password: hunter2hunter2Zq8Rt55 yes", ["secret"]), ("IBAN DE89 3704 0044 0532 0130 00 ok", ["account"]), ("signed by Mary Shelley today", ["name"]), ("contact Dr. John Watson", ["name"]), ("lives at 221 Baker Street now", ["address"]), ("wohnt Lindenstraße 12 dort", ["address"]), ("adresse 12 rue de Rivoli", ["address"]),
]


def test_candidates_are_added(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOOD * 20)], "doc_id long, text string")
    found = pii.detect(docs)
    got = {r.doc_id: [pii.KINDS[s.kind] for s in r.spans] for r in found.where(F.col("doc_id") < len(GOOD)).collect()}
    assert [got[i] for i in range(len(GOOD))] == [k for _, k in GOOD]
    assert pii.detect(docs.limit(0)).count() == 0
    for df in (found, pii.find(docs, pii.fit(docs))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_wrong_accounts_and_plain_words_stay(spark):
    bad = ["IBAN DE88 3704 0044 0532 0130 00 ok", "Donaudampfschifffahrtsgesellschaftskapitän", "commit aaaaaaaaaaaaaaaaaaaaaaaa1", "in 2024 Main things"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in GOOD] * 20 + bad * 20)], "doc_id long, text string")
    got = [len(r.spans) for r in pii.detect(docs).where(F.col("doc_id") >= 20 * len(GOOD)).collect()]
    assert sum(got) == 0


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a@b.de", "x", "y", "z", 5)], "doc_id long, text string, _pii_text string, _found string, _PII_found string, spans int")
    r = pii.detect(docs).first()
    assert (r["_pii_text"], r["_found"], r["_PII_found"]) == ("x", "y", "z") and [tuple(s) for s in r["spans"]] == [(0, 0, 6, True)]


def test_em_prefers_reliable_labelers():
    patterns = [(0, (1, 1, 1, 1, 1), 100), (0, (0, -1, -1, 0, -1), 100), (0, (0, 1, 1, 0, 1), 10)]
    _, chance, post = pii.estimate(patterns)
    assert post[0] > 0.9 and post[1] < 0.1 and post[2] > 0.5
    odds = pii.vote_odds(chance)
    assert all(o[2] > 0 > o[0] and o[1] == 0 for o in odds[1:3])


def test_added_spans_have_no_length_limit(spark):
    r = random.Random(8)
    token = lambda n: "4f" + "".join(r.choice("0123456789abcdef") for _ in range(n - 2))
    name = "Mary " + "S" + "h" * 60 + "y"
    mail = "j" * 90 + " (at) site (dot) com"
    docs = [f"token = {token(500)} x", f"token = {token(600)} x", f"token = {token(60_000)} x", "token = " + "a" * 300 + token(100) + " x", "key " + "a" * 400 + " x", f"signed by {name} today", f"mail {mail} now", "." * 50_000 + " (at) "]
    df = spark.createDataFrame(list(enumerate(docs + [t for t, _ in GOOD] * 20)), "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.detect(df).select("doc_id", pii.notation(F.col("spans")).alias("s")).collect()}
    assert [found[i] for i in range(8)] == ["secret:8:508", "secret:8:608", "secret:8:60008", "secret:8:408", "", f"name:10:{10 + len(name)}", f"email:5:{5 + len(mail)}", ""]


def test_query_counts_each_kind_by_itself(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*texts(), "a@b.de", "+1 (961) 555-6946", "a@b.de c@d.fr 1.2.3.4 4111 1111 1111 1111 +1 (961) 555-6946"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    for i, t in rows:
        want = brute(t)
        kinds = [s.split(":")[0] for s in want.split(",")]
        assert [got[i][f"n_{k}"] for k in BASE] == [kinds.count(k) for k in BASE], t
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
