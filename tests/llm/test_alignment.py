"""Alignment against whole-text encoding with the tokenizers' own libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from heddle.llm import alignment, queries

from .conftest import SF

A, B = (f"{alignment.TOKENIZERS}/{n}" for n in (alignment.NAME_A, alignment.NAME_B))


@pytest.fixture(scope="module")
def pair():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, pair):
    a, b = pair
    letter = {v: k for k, v in alignment._byte_letters().items()}
    byte_of = {v: k for k, v in letter.items()}
    out, held, kept = [], defaultdict(set), []
    for n, (doc, text) in enumerate(rows):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            kept.append((doc, None, None, None, ""))
            continue
        cut = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ends_a, ends_b = cut(bytes_a), cut(bytes_b)
        links, j = [], 0
        for i, e in enumerate(ends_a):
            s = e - len(bytes_a[i])
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(ends_b) and ends_b[k] - len(bytes_b[k]) < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        both, groups, at = sorted(set(ends_a) & set(ends_b)), [], 0
        for e in both:
            part = lambda ends, ids: ",".join(str(x) for x, y in zip(ids, ends, strict=True) if at < y <= e)  # noqa: E731, B023
            groups.append(part(ends_a, ids_a) + "|" + part(ends_b, ids_b))
            at = e
        for x in set(links):
            held[x].add(n)
        kept.append((doc, (len(ids_a), len(ids_b), len(both)), links, None, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (x, _), docs in held.items():
        best[x] = max(best[x], len(docs))
    for doc, n, links, _, digest in kept:
        if n is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc, *n, len(links), sum(len(held[x]) == best[x[0]] for x in links), sum(len(held[x]) for x in links), digest))
    return sorted(out, key=str)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "\n", "a  b   c", "tab\tand\nline \n  end", "<|endoftext|> is text", "<s></s><unk>", "it's we'll they've I'M", "▁ is U+2581", "naïve café ĳ ﬁ",
    "日本語 の 文章です。", " x   y　z", "é a ́", "<0x0A> \x00 \x7f", "🙂🙂 🙂", "1234567 89 0", "a" * 3000, " " * 700, "word " * 900, "x y" * 600, "​﻿", "Ж" * 600 + " Ж",
]


def got(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_same_as_brute_force(spark, pair):
    rng = random.Random(4)
    rows = list(enumerate(ODD + ODD[:6]))
    rows += [(100 + i, "".join(rng.choice([" ", "  ", "a", "the", "é", "\n", "'s", "Ж", ".", "0", " the"]) for _ in range(rng.randrange(1500)))) for i in range(30)]
    rows += [(100, "of a repeated id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit(1)).withColumn("block", F.lit("x")).repartition(3)
    want = brute(rows, pair)
    assert got(alignment.alignment(df)) == want
    # small blocks give the same counts
    assert got(alignment.alignment(df, block_bytes=500)) == want


def test_query_same_as_brute_force(spark, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_lockstep_alignment(spark, SF)) == brute(rows, pair)


def test_nothing_and_long_texts(spark):
    schema = "doc_id string, text string"
    assert alignment.alignment(spark.createDataFrame([], schema)).count() == 0
    assert got(alignment.alignment(spark.createDataFrame([("a", None)], schema))) == [("a", 0, 0, 0, 0, 0, 0, "")]
    long = "some words of a very long text, " * 100_000
    one, two = got(alignment.alignment(spark.createDataFrame([("l", long), ("s", "some words")], schema)))
    assert one[0] == "l" and one[3] > 600_000 and two[1:4] == (2, 2, 2)


def test_steps_are_those_of_the_longest_lane(monkeypatch):
    sides = [f(s) for f, s in zip((alignment.byte_bpe, alignment.piece_bpe), alignment.sources(), strict=True)]
    texts = pa.array(["word of it " * n for n in range(1, 400)])
    seen = []
    real = alignment.lockstep
    monkeypatch.setattr(alignment, "lockstep", lambda *a: seen.append(len(a[1]) - 1) or real(*a))
    cut = alignment.align(texts, *sides)
    monkeypatch.setattr(alignment, "LANE", 1 << 40)
    whole = alignment.align(texts, *sides)
    assert seen[0] > seen[1] == len(texts)
    assert all(np.array_equal(cut[k], whole[k]) for k in cut)


def test_other_order_of_ids_takes_the_slow_way():
    import json

    a = alignment.sources()[0]
    told = json.loads(a)
    told["model"]["merges"] = told["model"]["merges"][::-1]
    side = alignment.byte_bpe(json.dumps(told).encode())
    slow = tokenizers.Tokenizer.from_str(json.dumps(told))
    assert side.encode([" the words"])[0].tolist() == slow.encode(" the words", add_special_tokens=False).ids
