import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from heddle.llm import decontaminate, queries

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, lang string", "item_id long, text string"


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                x = windows.get(tuple(w[a : a + n]))
                if x:
                    hit.update(range(a, a + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def mine(spark, docs, items):
    out = decontaminate.report(spark.createDataFrame([(d, t, "en") for d, t in docs], DOCS), spark.createDataFrame(items, ITEMS))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op2_winnowed_decontamination(spark, SF).collect()), key=repr)
    assert got == brute(docs, items)
    assert any(r[-1] for r in got)


def test_edges(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    docs = [(1, None), (2, ""), (3, "..."), (4, f"x {ten} y {ten}"), (4, f"x {ten} y {ten}"), (5, ten.upper()), (None, f"z {ten}"), (6, "tiny one here"), (7, "a " * 50), (8, "ß straße über")]
    items = [(10, ten), (2, ten + " more words"), (3, None), (4, "..."), (5, "Tiny one"), (6, "a a a"), (6, "a a a"), (7, "über")]
    assert mine(spark, docs, items) == brute(docs, items)
    assert mine(spark, docs, []) == brute(docs, [])
    assert mine(spark, [], items) == []


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab ", max_size=60), min_size=1, max_size=8), st.lists(st.text("ab ", max_size=40), min_size=1, max_size=4))
def test_few_words_many_ties(spark, docs, items):
    docs, items = list(enumerate(docs)), list(enumerate(items))
    assert mine(spark, docs, items) == brute(docs, items)
