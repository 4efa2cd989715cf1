"""Filter audit and line rules against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heddle.llm import filter_audit, line_rules, transducer
from heddle.llm.bytewords import utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = ["a", "The", "of", "word", "é", "日本", "#", "x" * 60, "AB", "$5", "it's", "aB", "ab", "🙂"]
ODD = [None, "", " ", "\n", "\n\n", "a", " a ", "A" * 9, "é", " ", "  x", "a\x00b", "&", "\r\n x\r\n x\r\n", "x\nx\n x\nx ", "no end\n", "\tA b\nA b\n\na b\nA  b"]


def some_texts(n, seed, longest=140):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = rng.randrange(1, len(WORDS))
        out.append("".join(rng.choice(WORDS[:k]) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(longest))))
    return out


def test_transducer_counts_as_regular_expressions_do():
    texts = ODD + some_texts(200, 1)
    raw, at = utf8(pa.array(texts))
    found = transducer.run(raw, at, transducer.classes("#$%&*|"))
    new = transducer.first_of_kind(raw, found)
    for d, t in enumerate(texts):
        t = t or ""
        words = [raw[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)][found.first[d] : found.first[d + 1]]
        assert words == WORD.findall(t)
        assert (found.points[d], found.capitals[d], found.symbols[d]) == (len(t), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)))
        assert found.blanks[d] == len(t) - sum(map(len, words))
        assert int(new[found.first[d] : found.first[d + 1]].sum()) == len(set(words))


def test_words_of_one_hash_stay_apart(monkeypatch):
    # all words meet in one slot and have one key; bytes alone tell them apart
    monkeypatch.setattr(transducer, "hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(transducer, "mix", lambda h: h * np.uint64(0))
    texts = ["b a b aa a", "a b", "ab ba ab"]
    raw, at = utf8(pa.array(texts))
    found = transducer.run(raw, at, transducer.classes("#"))
    new = transducer.first_of_kind(raw, found)
    assert [int(new[found.first[d] : found.first[d + 1]].sum()) for d in range(3)] == [3, 2, 2]


# --- filter audit ---


def brute_audit(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    of_part = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        f += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (d is not None and d > first[t])
        of_part[s or ""].append((f, any(q == 1 for i, q, _ in labels if i == d and d is not None), any(x == 1 for i, _, x in labels if i == d and d is not None)))
    out = []
    for part, docs in of_part.items():
        total, of = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                here = [y for y in left if x in y[0]]
                left = [y for y in left if x not in y[0]]
                fails = sum(x in y[0] for y in docs)
                total[x] += len(here)
                of.append((x, part, "".join(order), step, len(left), len(here), fails - len(here), sum(y[0] == x for y in docs), sum(y[1] for y in here), sum(y[2] for y in here)))
        out += [(*r[1:], total[r[0]]) for r in of]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_same_as_brute_force(spark):
    texts = ODD + some_texts(60, 2, 200)
    rows = [(i, t, ["s", "t", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(900 + i, t, "hot") for i, t in enumerate(texts[::3] + texts[:5] * 8)]
    rows += [(3, texts[3], "t"), (3, texts[3], "t"), (None, texts[20], "t"), (None, None, None), (-5, texts[30], None)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 70, 2)] + [(2, 1, 1), (None, 1, 1), (77777, 1, 1), (900, None, 1), (901, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    # other columns of clashing names change nothing
    odd = docs.withColumns({c: F.lit("x") for c in ("part", "digest", "failed", "good", "toxic", "_first", "quality")}).repartition(5)
    got = filter_audit.audit(odd, known.withColumns({"text": F.lit(1), "part": F.lit(2)}))
    assert sorted(tuple(r[c] for c in AUDIT) for r in got.collect()) == brute_audit(rows, labels)


def test_audit_of_nothing_and_of_a_long_text(spark):
    docs = "doc_id long, text string, source string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], docs), labels).count() == 0
    long = " ".join(f"w{i}" for i in range(400_000))
    got = filter_audit.audit(spark.createDataFrame([(1, long, "s"), (2, long, "s")], docs), labels).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [r["removed"] for r in got] == [0, 0, 0, 0, 1]


# --- line rules ---


def brute_rules(rows):
    norm = lambda line: " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    docs_of, hosts = defaultdict(set), defaultdict(set)
    for n, (d, t, h) in enumerate(rows):
        who = ("row", n) if d is None else d
        hosts[h or ""].add(who)
        for line in (t or "").split("\n"):
            if WORD.search(line):
                docs_of[h or "", norm(line)].add(who)
    out = []
    for d, t, h in rows:
        t, h = t or "", h or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        held = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        gone = sum(len(WORD.findall(x)) for x in lines if len(docs_of[h, norm(x)]) > 20 and 100 * len(docs_of[h, norm(x)]) > len(hosts[h]))
        failed = len(w) < 20 or 100 * len(held) > 30 * len(w)
        left = len(w) - gone
        kept = not failed and left >= 20 and 100 * left >= 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(held), failed, kept, gone))
    return sorted(out, key=str)


RULES = ["doc_id", *line_rules.COUNTS, "base_failed", "kept", "n_removed"]
SCHEMA = "doc_id long, text string, source string"


def many_rows():
    rng = random.Random(5)
    rows = [(i, t, ["s", None, ""][i % 3]) for i, t in enumerate(ODD + some_texts(60, 3))]
    common = ["Follow us ON the web", "All rights reserved by the one who wrote it", "short"]
    own = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    for i in range(120):
        lines = [own(rng.choice([4, 30])) for _ in range(rng.randrange(4))] + [c if i % 2 else f"  {c.lower()} " for c in common[: rng.randrange(4)]]
        rng.shuffle(lines)
        rows.append((1000 + i, "\n".join(lines), "hot" if i % 3 else "cold"))
    # one document in many rows is one document: its line is no frequent one
    rows += [(5000, "a line that only\none document has " + own(25), "hot")] * 40
    rows += [(5001, f"a second line of one document\n{own(40)}", "hot") for _ in range(30)]
    rows += [(None, f"a line of documents without id\n{own(21)}", "hot") for _ in range(25)]
    return rows


def got(df):
    return sorted((tuple(r[c] for c in RULES) for r in df.collect()), key=str)


def test_rules_same_as_brute_force(spark):
    rows = many_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("host", "version", "row", "lines", "kept")}).repartition(5)
    want = brute_rules(rows)
    assert got(line_rules.rules(docs)) == want
    assert any(r[-1] and r[-2] for r in want) and any(r[-1] and not r[-2] and not r[-3] for r in want)


def test_hot_host_and_hot_line(spark):
    # one host has all rows and one line is in each of them; 1 % of the host is more than twenty
    rows = [(i, f"the line in all\nthe line in {i % 100}\n" + " ".join(f"w{i}x{j}" for j in range(30)), "hot") for i in range(2500)]
    out = line_rules.rules(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    # 25 documents are 1 %, not more than it
    assert {r["n_removed"] for r in out} == {4} and all(r["kept"] for r in out)


def test_clean_drops_the_lines(spark):
    rows = many_rows()
    norm = lambda line: " ".join(WORD.findall(line.lower()))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_gone", F.lit(1)).drop("_gone")
    out = line_rules.clean(docs).collect()
    judged = {(r[0]): r[-2] for r in brute_rules(rows)}
    before = {d: t for d, t, _ in rows}
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 5000:
            assert judged[r["doc_id"]]
            lines = before[r["doc_id"]].split("\n")
            left = r["text"].split("\n")
            assert [x for x in lines if x in left] == left
    assert not any(norm(x) == "all rights reserved by the one who wrote it" for r in out if r["source"] == "hot" for x in (r["text"] or "").split("\n"))


def test_rules_of_nothing_and_of_a_long_text(spark):
    assert line_rules.rules(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(60_000))
    out = line_rules.rules(spark.createDataFrame([(1, long, None)], SCHEMA)).collect()[0]
    assert (out["n_words"], out["n_repeat_words"], out["kept"]) == (540_000, 0, True)
