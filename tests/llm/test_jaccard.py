import random
import re

import numpy as np

from heddle.llm import jaccard

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted((d, len(s), find(d)) for d, s in sets)


def mine(spark, docs):
    return sorted(tuple(r) for r in jaccard.components(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = mine(spark, docs)
    assert got == brute(docs)
    assert any(c != d for d, _, c in got)


def test_drifting_copies_and_common_passages(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(900)}"
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(25)]
    docs, at = [], list(base)
    for i in range(60):  # each copy differs from the one before
        at[rng.randrange(60)] = word()
        docs.append((1000 - i, " ".join(at)))
    docs += [(i, " ".join([word() for _ in range(rng.choice((3, 20, 40)))] + passage)) for i in range(40)]
    docs += [(100 + i, " ".join(passage)) for i in range(3)] + [(200, "one two"), (201, "One  TWO"), (202, "")]
    rng.shuffle(docs)
    assert mine(spark, docs) == brute(docs)


def test_versions_of_one_document(spark):
    rng = random.Random(6)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    a, b = text(40), text(60)
    near = [*b[:-1], "other"]
    docs = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join(near))]
    assert [c for _, _, c in mine(spark, docs)] == [3] * 4 and mine(spark, docs) == brute(docs)
    pool = [text(rng.choice((8, 30, 60))) for _ in range(40)]
    for _ in range(150):
        t = list(rng.choice(pool))
        if rng.random() < 0.6:
            t[rng.randrange(len(t))] = f"x{rng.randrange(3)}"
        docs.append((rng.randrange(100, 300), " ".join(t)))
        if rng.random() < 0.2:
            docs.append((docs[-1][0], docs[rng.randrange(len(docs))][1]))
    rng.shuffle(docs)
    assert mine(spark, docs) == brute(docs)


def test_edges(spark):
    assert mine(spark, []) == []
    got = jaccard.components(spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n", 5), (None, "a b", 5), (4, "a b", 5), (4, "a b", 5)], "doc_id long, text string, component int"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (4, 1, 4), (4, 1, 4)], key=repr)


def test_keep_one(spark):
    kept = jaccard.keep_one(spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, None, "z")], "doc_id long, text string, source string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c", "x"), (3, None, "z")]


def test_unlike_words_with_equal_polynomials(spark):
    # Thue-Morse words cancel out in any polynomial with an odd base modulo 2^64
    a = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"{a} one two"), (2, f"{b} one two"), (3, f"{a} one two")]
    assert mine(spark, docs) == brute(docs)


def test_counter_is_bounded(monkeypatch):
    monkeypatch.setattr(jaccard, "_SLOTS", 64)
    monkeypatch.setattr(jaccard, "_FRESH", 100)
    rng = np.random.default_rng(2)
    seen = jaccard._Counter()
    for _ in range(200):
        seen.add(np.unique(np.append(rng.integers(100, 1 << 40, 20), [7, 8])).astype(np.uint64))
        assert len(seen.keys) == 64 and seen.held <= 200
    keys, counts = seen.most()
    assert set(keys[:2].tolist()) == {7, 8} and all(50 < c <= 200 for c in counts[:2])
    again = jaccard._Counter()
    again.add(np.array([3, 3, 5], np.uint64))
    assert dict(zip(*again.most(), strict=True)) == {3: 2}


def test_commonest_stay_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 10)
    held = spark.createDataFrame([(i, 2 + i // 4) for i in range(40)], "shingle long, held long")
    keys = jaccard._commonest(held)
    assert 0 < len(keys) <= 10 and keys.tolist() == sorted(keys.tolist(), key=lambda k: (-(k // 4), k))


def test_further_orders_drop_candidates_and_no_link(spark):
    rng = random.Random(9)
    texts = []
    for g in range(40):  # groups of texts that are alike by about a half to nine tenths
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(12):
            own = list(base)
            for i in rng.sample(range(150), rng.randrange(2, 16)):
                own[i] = f"x{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(own)))
    sets = [shingles(t) for _, t in texts]
    pairs = [(12 * g + i, 12 * g + j) for g in range(40) for j in range(12) for i in range(j)]
    linked = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    hashed = list(jaccard.shingle_sets(jaccard.words(jaccard.pa.array([t for _, t in texts]), jaccard.SOLID), 5))
    names = jaccard._FURTHER
    rows = [(d, len(s), *[jaccard._longs(jaccard.prefix(s, j)) for j in jaccard.FURTHER]) for d, s in enumerate(hashed)]
    held = spark.createDataFrame(rows, "doc_id long, n long, " + ", ".join(f"{n} array<long>" for n in names))
    asked = spark.createDataFrame(pairs, "a long, b long")
    left = {o: {tuple(r) for r in jaccard.meet_under(asked, held, o).collect()} for o in ((), names[:1], names[1:], names)}
    assert all(linked <= x for x in left.values()) and left[names] == left[names[:1]] & left[names[1:]]
    # each order drops unlike pairs, and each drops some that the other lets through
    unlike = {o: len(x - linked) for o, x in left.items()}
    print("unlike candidates left:", unlike, "links:", len(linked))
    assert unlike[()] > max(unlike[names[:1]], unlike[names[1:]]) and min(unlike[names[:1]], unlike[names[1:]]) > unlike[names] > 0
    assert mine(spark, texts) == brute(texts)
