import random

import pytest
from pyspark.sql import functions as F

from timelake.llm import bpe
from timelake.llm.queries import vocab_path

tokenizers = pytest.importorskip("tokenizers")
PATH = vocab_path()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def same(library, texts):
    ours = bpe.codec(PATH).encode_batch(texts)
    theirs = library.encode_batch(texts, add_special_tokens=False)
    for text, a, b in zip(texts, ours, theirs, strict=True):
        assert a.tolist() == b.ids, text
        assert bpe.codec(PATH).decode(a.tolist()) == library.decode(b.ids, skip_special_tokens=False)


def test_random_texts(library):
    r = random.Random(1)
    alphabet = "ab '\n\t  .,1<|>é中'sLL\x1c\x85　𝕏²½٣_"
    same(library, ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) + r.choice(["", "<|endoftext|>", " <|endoftext|> x"]) for _ in range(4000)])


def test_every_code_point(library):
    chars = [chr(i) for i in range(0, 0x30000, 1) if not 0xD800 <= i < 0xE000]
    same(library, ["a1 " + c + "  b" + c + c + " 1" + c for c in chars])


def test_long_tokens(library):
    r = random.Random(2)
    same(library, ["ab" * 9000, "".join(r.choice("etaoinshr") for _ in range(5000)), " " * 3000 + "x", "=" * 2000, "", "é" * 1500])


def test_forced_cuts_are_boundaries():
    c = bpe.codec(PATH)
    text = b" onninting\x00zq"
    cuts = [i + 1 for i in range(len(text) - 1) if not c.joined[text[i], text[i + 1]]]
    ends, at = set(), 0
    for i in c.encode_batch([text.decode()])[0].tolist():
        at += len(c.tokens[i])
        ends.add(at)
    assert set(cuts) <= ends


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, None, 2), (2, None, 2), (3, "", None)], "doc_id long, text string, `ids x` int")
    got = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in got] == [(1, [64, 275], "a b"), (2, [], ""), (2, [], ""), (3, [], "")]
    both = bpe.encode(df.withColumn("IDS", F.lit("old")).withColumn("back", F.lit(1)), PATH, decoded="Back").orderBy("doc_id")
    assert both.columns == ["doc_id", "text", "ids x", "ids", "Back"] and [r.Back for r in both.collect()] == ["a b", "", "", ""]
    assert bpe.encode(df.filter(F.lit(False)), PATH).count() == 0
