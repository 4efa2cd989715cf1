"""Language identification counted and decoded in plain Python."""

import math
import unicodedata
import zlib
from collections import Counter

from heddle.llm import language, queries

from .conftest import SF

ODD = ((0x2545F491,), (0x27D4EB2F, 0x165667B1), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def frequencies(text):
    raw = b" " + bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()) + b" "
    count = Counter()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            h = 0
            for j in range(n):
                h ^= raw[i + j] * ODD[n - 1][j] & 0xFFFFFFFF
            count[(h ^ h >> 15) & language.BUCKETS - 1] += 1
    total = sum(count.values())
    return {b: c / total for b, c in count.items()}


def has_letter(text):
    return any(unicodedata.category(c)[0] == "L" for c in text or "")


def plain(rows):
    fold = {d: zlib.crc32(str(d).encode()) % 4 for d, _, _ in rows}
    told = {d: frequencies(t) for d, t, _ in rows if has_letter(t)}
    taught = [(lang, told[d]) for d, _, lang in rows if fold[d] != 2 and lang is not None and d in told]
    names = sorted({lang for lang, _ in taught})
    codes = language.codewords(len(names))
    bits, size = codes.shape[1], language.BUCKETS
    held = []
    for name in names:
        mine, s = [f for lang, f in taught if lang == name], [0.0] * size
        for f in mine:
            for b, x in f.items():
                s[b] += x
        held.append([(x / len(mine) + 1e-6) / (1 + 1e-6 * size) for x in s])
    weights, bias, scale, trust = [], [], [], []
    for k in range(bits):
        up, down = ([h for h, c in zip(held, codes[:, k], strict=True) if c * sign > 0] for sign in (1, -1))
        mean = lambda side, b: (sum(h[b] for h in side) + 1e-9) / (len(side) + 1e-9 * size)
        w = [math.log(mean(up, b) / mean(down, b)) for b in range(size)]
        own = [sum(x * y for x, y in zip(h, w, strict=True)) for h in held]
        bias.append(-(min(o for o, c in zip(own, codes[:, k], strict=True) if c > 0) + max(o for o, c in zip(own, codes[:, k], strict=True) if c < 0)) / 2)
        scale.append(max(sum(abs(o + bias[k]) for o in own) / len(own), 1e-9))
        trust.append(max(min((o + bias[k]) * c / scale[k] for o, c in zip(own, codes[:, k], strict=True)), 1e-3))
        weights.append(w)
    trust = [t / sum(trust) for t in trust]
    out = {}
    for d, _, _ in rows:
        if d not in told:
            out[d] = ("und", 0.0)
            continue
        margins = [(sum(x * weights[k][b] for b, x in told[d].items()) + bias[k]) / scale[k] for k in range(bits)]
        loss = [sum(max(0.0, 1 - m * c) * t for m, c, t in zip(margins, code, trust, strict=True)) for code in codes]
        best = loss.index(min(loss))
        out[d] = (names[best], 1 / sum(math.exp(-4 * (x - loss[best])) for x in loss))
    return out, fold


def test_query_same_as_plain_counts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want, fold = plain(rows)
    got = {r["doc_id"]: r for r in queries.op9_ecoc_language(spark, SF).collect()}
    assert set(got) == set(want)
    for d, (lang, score) in want.items():
        assert (got[d]["lang_pred"], got[d]["held_out"]) == (lang, fold[d] == 2) and abs(got[d]["score"] - score) < 1e-3
