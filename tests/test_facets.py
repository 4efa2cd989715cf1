"""Bitmap facets against plain counting, over several bitmaps a value."""

from collections import Counter

from pyspark.sql import functions as F

from heddle.operators import facets, search


def test_drill_down_over_several_buckets(spark):
    n = 70_000
    rows = spark.range(n).select(
        "id", F.array(F.concat(F.lit("C"), F.col("id") % 3), F.lit(" Every ")).alias("categories"), F.array(F.concat(F.lit("f"), F.col("id") % 2)).alias("formats"), F.array(F.when(F.col("id") == 40_000, "rare").otherwise("p")).alias("providers"),
        F.when(F.col("id") % 4 > 0, 2000 + F.col("id") % 4).alias("year"), (F.col("id") % 5 == 0).alias("has_password"),
    )
    definitions = {"categories": spark.createDataFrame([("c0", "Zero", False), ("c1", "One", True)], "id string, label string, hidden boolean")}
    index = facets.build_index(rows.repartition(1), definitions)
    assert index.bits.filter("facet = 'formats'").count() == 2 * 3
    none = (None,) * 5
    asked = [(1, *none), (2, ["c0", "c2"], [], None, [2001, 2002], None), (3, None, None, [" RARE"], None, True), (4, [" ", ""], ["F1"], None, None, False), (5, ["no such"], None, None, None, None)]
    requests = spark.createDataFrame(asked, "request_id int, categories array<string>, formats array<string>, providers array<string>, years array<int>, has_password boolean")
    docs = [({"categories": {f"c{i % 3}", "every"}, "formats": {f"f{i % 2}"}, "providers": {"rare" if i == 40_000 else "p"}, "year": {str(2000 + i % 4)} if i % 4 else set(), "has_password": {str(i % 5 == 0).lower()}}) for i in range(n)]
    got = {}
    for r in facets.drill_down(requests, index).collect():
        got.setdefault((r["request_id"], r["facet"]), []).append((r["position"], r["value"], r["label"], r["count"]))
    for key, *asked_for in asked:
        names = ("categories", "formats", "providers", "year")
        filters = {f: {str(v).strip().lower() for v in x or []} - {""} for f, x in zip(names, asked_for, strict=False)} | {"has_password": set() if asked_for[4] is None else {str(asked_for[4]).lower()}}
        for facet in facets.FACETS:
            count = Counter(v for d in docs if all(not w or d[f] & w for f, w in filters.items() if f != facet) for v in d[facet] if v != "c1")
            if facet == "has_password":
                count = {v: count.get(v, 0) for v in ("true", "false")}
            mine = sorted(got.get((key, facet), []))
            assert {v: c for _, v, _, c in mine} == dict(count), (key, facet)
            assert [p for p, *_ in mine] == list(range(1, len(mine) + 1))
    assert [x[1:3] for x in sorted(got[1, "categories"])] == [("c2", "c2"), ("every", "every"), ("c0", "Zero")] and [x[1] for x in sorted(got[1, "year"])] == ["2003", "2002", "2001"]


def test_nothing_is_indexed_or_asked(spark):
    rows = spark.createDataFrame([], "categories array<string>, formats array<string>, providers array<string>, year int, has_password boolean")
    kinds = "request_id int, categories array<string>, formats array<string>, providers array<string>, years array<int>, has_password boolean"
    index = facets.build_index(rows, {"formats": spark.createDataFrame([], "id string, label string, hidden boolean")})
    got = facets.drill_down(spark.createDataFrame([(1, None, None, None, None, None)], kinds), index).collect()
    assert sorted((r["facet"], r["value"], r["count"]) for r in got) == [("has_password", "false", 0), ("has_password", "true", 0)]
    assert facets.drill_down(spark.createDataFrame([], kinds), index).count() == 0


def test_filters_and_visibility_are_normalized(spark):
    rows = spark.createDataFrame([(1, [" SERVICE"], "x"), (2, ["x"], "Service "), (3, ["Ёлка"], "x"), (4, None, None)], "id int, categories array<string>, primary_category string")
    assert [r["id"] for r in search.visible(rows).collect()] == [3, 4]
    found = lambda *v: [r["id"] for r in rows.filter(search.matches_filters({"categories": F.array(*[F.lit(x) for x in v])}, F.array().cast("array<int>"), F.lit(1), F.lit(None).cast("boolean"), F.lit(True))).collect()]
    assert found("ЕЛКА ") == [3] and found("service", "X") == [1, 2] and found(" ") == [1, 2, 3, 4]
    links = [("http://h.test/", None, " Shop"), ("", "own.host", "shop"), ("http://Z.test/", None, None)]
    labels = search.provider_labels(spark.createDataFrame([("2", links), ("1", links[1:])], "id string, links array<struct<url:string,host:string,provider:string>>"))
    assert {r["value"]: r["label"] for r in labels.collect()} == {"shop": "own.host", "z.test": "z.test"}


def test_equal_filters_are_united_and_intersected_once(spark, monkeypatch):
    rows = spark.range(100).select(F.array(F.concat(F.lit("c"), F.col("id") % 3)).alias("categories"), F.array(F.lit("f")).alias("formats"), F.array(F.lit("p")).alias("providers"), F.lit(2000).alias("year"), (F.col("id") % 2 == 0).alias("has_password"))
    index = facets.build_index(rows.repartition(1), {"formats": spark.createDataFrame([], "id string, label string, hidden boolean")})
    asked = spark.range(60).select(F.col("id").alias("request_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit("C0"), F.lit("c1"))).otherwise(F.array(F.lit("c1 "), F.lit("c0"))).alias("categories"), F.array().cast("array<string>").alias("formats"), F.lit(None).cast("array<string>").alias("providers"), F.lit(None).cast("array<int>").alias("years"), F.lit(True).alias("has_password"))
    kept, written = {}, facets.written
    monkeypatch.setattr(facets, "written", lambda df, tag: kept.setdefault(tag, written(df, tag)))
    got = facets.drill_down(asked, index)
    counts = {(r["facet"], r["value"]): r["count"] for r in got.filter("request_id = 7").collect()}
    assert counts == {("categories", "c0"): 17, ("categories", "c1"): 16, ("categories", "c2"): 17, ("formats", "f"): 33, ("providers", "p"): 33, ("year", "2000"): 33, ("has_password", "true"): 33, ("has_password", "false"): 34}
    assert got.count() == 60 * 8 and kept["filters"].count() == 2 and kept["answers"].count() == 8
