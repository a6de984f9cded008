import json
import os
import random

import pytest
from pastglass.llm.automaton import Automaton, compile_tables, printable_bytes
from pastglass.llm.encoding import VOCABULARY, decode, encode, token_count
from pyspark.sql import functions as F

TEXTS = [
    None, "", " ", "   \n\n\t x", "<|endoftext|> is ordinary", "it's don't WE'LL 12,345.67", "한국어 투수 😀🇰🇷 naïve Ünïcödé", "a" * 20_000, "ab" * 5_000, " " * 3_000, "```py\n```", "\u0000​﻿", "é" * 501, "\r\n\r\n", "=*" * 777,
]


def vocabulary(tmp_path, merges):
    """A small vocabulary file in the public JSON form."""
    letters = {b: c for c, b in printable_bytes().items()}
    vocab = {letters[b]: b for b in range(256)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [[a, b] for a, b in merges]}}))
    return str(path), vocab


def by_merging(word, merges, vocab):
    """Byte-pair encoding as defined: the first merge in rank that occurs, everywhere from the left, again and again."""
    parts = list(word)
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}
    while True:
        pairs = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not pairs:
            return [vocab[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_small_vocabularies_against_the_definition(tmp_path):
    rng = random.Random(9)
    for _ in range(60):
        pieces, merges = list("abc"), []
        for _ in range(rng.randrange(1, 14)):
            a, b = rng.choice(pieces), rng.choice(pieces)
            if (a, b) not in merges and a + b not in pieces:
                merges.append((a, b))
                pieces.append(a + b)
        path, vocab = vocabulary(tmp_path, merges)
        a = Automaton(compile_tables(path))
        for _ in range(60):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            assert a.word(w.encode()) == by_merging(w, merges, vocab), (merges, w)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")
def test_public_vocabulary_against_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    a = Automaton(compile_tables(VOCABULARY))
    rng = random.Random(1)
    letters = "aabcdeeehiiilnoorst  \n'.,!?-_0123456789가나다éñü😀"
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        got = a.encode(text)
        assert got == want.ids, text[:50]
        assert a.decode(got) == text and a.count(text) == len(got)
    b = Automaton(compile_tables(VOCABULARY.replace(".json", ".tiktoken")))
    assert all(a.encode(x) == b.encode(x) for x in texts)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")
def test_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id long, text string, ids string")
    out = df.withColumn("ids_", encode(spark, F.col("text"))).withColumn("n", token_count(spark, F.col("text"))).withColumn("back", decode(spark, F.col("ids_"))).collect()
    for r in out:
        assert r["ids_"] is not None and r["n"] == len(r["ids_"]) and r["back"] == (r["text"] or "")
    assert out[0]["ids_"] == [] == out[1]["ids_"]
    assert df.limit(0).withColumn("i", encode(spark, F.col("text"))).count() == 0
