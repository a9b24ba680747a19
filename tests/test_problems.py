"""The general problems 2, 4, 5 and 7 against brute force and on odd inputs."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.functions import bloom
from citeloom.operators import nested, orphans, packed, skew
from citeloom.plans import problems

T = lambda n: datetime(2020, 1, n)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    "text, want",
    [("12", 12), (" 0012 ", 12), ("PMID:12", 12), ("pmid=12", 12), ("PMID 12", 12), ("PubMed ID: 12", 12), ("12.0", 12), ("1,012", 1012), ("1.2e1", 12), (" 12​", 12)]
    + [(t, None) for t in (None, "", "  ", "n/a", "doi:10.1/12", "12.5", "-12", "12a", "PMID:", "9" * 30)],
)
def test_whole_number_id(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(orphans.whole_number_id(F.col("s"))).first()[0] == want


def parents(spark, articles, core=()):
    return orphans.parent_states(
        spark.createDataFrame(articles, "id long, record_state string, deleted_at timestamp, ingested_at timestamp"),
        spark.createDataFrame(list(core), "id long, ingested_at timestamp"),
    )


def test_orphan_kinds(spark):
    par = parents(
        spark,
        [(1, "active", None, T(1)), (2, "Deleted ", None, T(1)), (3, "active", None, T(1)), (3, "active", T(5), T(4)), (4, "withdrawn", None, T(1)), (4, None, None, T(3))]
        + [(5, None, None, T(9)), (6, "active", None, T(2)), (None, "active", None, T(1))],
        [(7, T(1))],
    )
    refs = spark.createDataFrame(
        [("s", 10, 2000, r, T(2)) for r in (1, 2, 3, 4, 5, 6, 7, 99, None)] + [("s", 10, 2000, 5, T(3)), ("s", 11, None, 99, T(2)), ("s", 12, 2001, 5, T(9)), ("s", 12, 2001, 99, None)],
        "src string, id long, year int, ref_id long, ingested_at timestamp",
    )
    got = rows(orphans.find_orphans(refs, par), "id", "year", "ref_id", "kind")
    assert got == [(10, 2000, 2, "deleted"), (10, 2000, 3, "deleted"), (10, 2000, 5, "late"), (10, 2000, 99, "missing"), (11, -1, 99, "missing"), (12, 2001, 99, "missing")]
    report = rows(orphans.orphan_report(orphans.find_orphans(refs, par)), "src", "year", "kind", "n_refs", "n_records")
    assert ("s", 2000, "deleted", 2, 1) in report


def test_orphans_of_empty_tables(spark):
    none = parents(spark, [])
    refs = spark.createDataFrame([("s", 1, 2000, 5, T(1))], "src string, id long, year int, ref_id long, ingested_at timestamp")
    assert rows(orphans.find_orphans(refs, none), "ref_id", "kind") == [(5, "missing")]
    assert orphans.find_orphans(refs.limit(0), none).count() == 0


@pytest.mark.parametrize("bits, filters", [(1 << 26, 8), (1024, 8), (1024, 1)])
@pytest.mark.parametrize("small", [500_000, 10])
def test_orphans_by_any_filter_and_join(spark, monkeypatch, bits, filters, small):
    par = parents(spark, [(i, "deleted" if i % 10 == 0 else None, None, T(3)) for i in range(0, 4000, 2)])
    refs = spark.range(8000).select(
        F.lit("s").alias("src"), F.col("id"), F.lit(1).alias("year"), F.when(F.col("id") < 4000, F.col("id")).otherwise(F.pmod("id", F.lit(5))).alias("ref_id"), F.lit(T(3)).alias("ingested_at")
    )
    refs = refs.unionByName(refs.filter("id % 3 = 0").withColumn("ingested_at", F.lit(T(1))))
    monkeypatch.setattr(orphans, "bloom_filters", lambda df, key, n: bloom.bloom_filters(df, key, n, bits, filters))
    got = rows(orphans.find_orphans(refs, par, small, 8), "id", "year", "ref_id", "kind")
    want = []
    for k in range(8000):
        ref = k if k < 4000 else k % 5
        kind = "missing" if ref % 2 else "deleted" if ref % 10 == 0 else "late" if k % 3 == 0 else None
        want += [(k, 1, ref, kind)] if kind else []
    assert got == want


def test_bloom_filters_hold_every_key(spark):
    df = spark.range(0, 20000, 2)
    made = bloom.bloom_filters(df, "id", 10000, max_bits=1 << 14)
    assert len(made) == 7
    probed = spark.range(20000).withColumn("maybe", bloom.might_contain(df, made, F.col("id")))
    assert probed.filter("id % 2 = 0 and not maybe").count() == 0 and probed.filter("id % 2 = 1 and maybe").count() < 300


def test_eager_aggregate_equals_plain_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 7 else None, i % 2, float(i) if i % 5 else None) for i in range(60)], "k long, g long, x double")
    right = spark.createDataFrame([(i % 4, i) for i in range(9)] + [(None, 1)], "k long, y long")
    for how in ("inner", "left"):
        got = skew.eager_join_aggregate(left, right, ["k"], ["g"], {"x": F.col("x")}, {"y": F.col("y")}, {"y": F.col("y")}, how=how)
        want = left.join(right, "k", how).groupBy("g").agg(F.count("*"), F.count("y"), F.sum("x"), F.sum("y"), F.min("y"), F.max("y"))
        assert rows(got, "g", "n_rows", "n_matched", "sum_x", "sum_y", "min_y", "max_y") == sorted(map(tuple, want.collect()))
    assert skew.eager_join_aggregate(left.limit(0), right, ["k"], ["g"]).count() == 0
    with pytest.raises(ValueError):
        skew.eager_join_aggregate(left, right, ["k"], ["g"], how="full")


def test_weighted_rows_and_heavy_keys(spark):
    left = spark.createDataFrame([(1, 98), (2, 2), (3, 0)], "k long, n int")
    got = skew.eager_join_aggregate(left, left.select("k"), ["k"], ["k"], left_weight=F.col("n"))
    assert rows(skew.heavy_keys(got, "k", "n_rows", 0.02), "k") == [(1,), (2,)]
    assert skew.heavy_keys(got.limit(0), "k", "n_rows", 0.02).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ('A. 1990;1:2-3; "B; Part 2. 1991;5(1):7-9"', ["A. 1990;1:2-3", "B; Part 2. 1991;5(1):7-9"]),
        ('"A ""New"" S; 1. 1990"||B. 1991||', ['A "New" S; 1. 1990', "B. 1991"]),
        ('[1] "A. 1990" [2] B. 1991;2(3):4', ["A. 1990", "B. 1991;2(3):4"]),
        ("1) A. 1990\n2) B. 1991", ["A. 1990", "B. 1991"]),
        ("A. 1990; ;  B. 1991 // C. 1992\tD. 1993\r\nE. 1994 |  | F. 1995;", ["A. 1990", "B. 1991", "C. 1992", "D. 1993", "E. 1994", "F. 1995"]),
        ('unclosed "A. 1990; B. 1991', ['unclosed "A. 1990', "B. 1991"]),
        ('see "A; B" in C. 1990|D. 1991', ['see "A; B" in C. 1990', "D. 1991"]),
        ("0 x. 1990|0. 1991", ["0 x. 1990", "0. 1991"]),
        ("A. 1990;1:2", ["A. 1990;1:2"]),
        ("", []),
        (" ; | ", []),
    ],
)
def test_packed_values(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(packed.packed_values(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("text, n", [('"' + "a" * 200_000 + '"; B. 1990', 2), ('"' + 'a""b' * 50_000 + '"; B. 1990', 2), ('"A. 1990"; ' * 20_000, 20_000), ('"' * 100_001, 1), ("; " * 100_000, 0)])
def test_very_long_packed_texts(spark, text, n):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(F.size(packed.packed_values(F.col("s")))).first()[0] == n


def test_split_packed_rows(spark):
    df = spark.createDataFrame([(1, "A. 1990; note; B. 1991", "x"), (2, None, "y"), (3, "A. 1990", "z"), (4, "x;" * 40_000, "w")], "row_id long, t string, val string")
    assert rows(packed.split_packed(df, "row_id", "t", packed.CITATION, 2), "row_id", "pos", "val") == [(1, 1, "A. 1990"), (1, 2, "B. 1991")]
    assert packed.split_packed(df, "row_id", "t").count() == 40_004
    assert packed.split_packed(df.limit(0), "row_id", "t").count() == 0


def scan(text):
    """Character by character: an independent reading of the same rules."""
    out, cur, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            quoted = not quoted
        if not quoted and (c in "|\n\r\t" or text[i : i + 2] == "//" or (c == ";" and not text[i + 1 : i + 2].isdigit())):
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    values = []
    for v in [*out, cur]:
        v = v.strip(" ;/")
        head = v.split(" ", 1)
        while len(head) == 2 and (head[0].rstrip(")").isdigit() or head[0].strip("[]").isdigit()):
            v = head[1].strip()
            head = v.split(" ", 1)
        if v.startswith('"') and v.endswith('"') and len(v) > 1:
            v = v[1:-1].replace('""', '"')
        if v:
            values.append(v)
    return values


def test_p5_against_a_scanner(spark):
    root = "/root/testdata/sf0.01"
    got = {}
    for r in problems.p5_found(spark, root).collect():
        got.setdefault(r.row_id, {})[r.pos] = r.val
    stored = {r.row_id: r.refcitation for r in spark.read.parquet(f"{root}/reference.parquet").collect()}
    n = 0
    for k, text in stored.items():
        # list numbers within one line are the one thing the scanner can't see
        if text and not any(m in text for m in (" [2] ", " 2) ")):
            want = [v for v in scan(text) if ". " in v and v.split(". ", 1)[1][:4].isdigit()]
            n += len(want) > 1
            assert (got.get(k) is not None) == (len(want) > 1), text
            if len(want) > 1:
                assert [v for _, v in sorted(got[k].items())] == want
    assert n > 200


def walk(value, cats, outs):
    if isinstance(value, dict):
        for k, v in value.items():
            if k == "Mesh_year_category":
                for i, e in enumerate(v if isinstance(v, list) else [v]):
                    c = e.get("category") if isinstance(e, dict) else None
                    for j, x in enumerate(c if isinstance(c, list) else [c]):
                        x = x.get("tree") if isinstance(x, dict) else x
                        if x is not None:
                            cats.append((i, j, x))
            if k == "disruptiveness" and v is not None:
                found = v.get("runs", [v]) if isinstance(v, dict) else [x.get("score", {}) for x in v]
                for i, x in enumerate(found):
                    try:
                        y = float(x.get("DI1"))
                        if not math.isnan(y):
                            outs.append((i, 0, str(round(y * 10000))))
                    except (TypeError, ValueError):
                        pass
            walk(v, cats, outs)
    elif isinstance(value, list):
        for v in value:
            walk(v, cats, outs)


def test_p7_against_a_walk(spark):
    root = "/root/testdata/sf0.01"
    want = []
    for r in spark.read.parquet(f"{root}/result_records.parquet").collect():
        try:
            value = json.loads(r.payload)
        except (TypeError, ValueError):
            continue
        cats, outs = [], []
        walk(value, cats, outs)
        want += [(r.rec_id, "category", *x) for x in cats] + [(r.rec_id, "di1", *x) for x in outs]
    assert rows(problems.p7_found(spark, root), "rec_id", "branch", "pos1", "pos2", "item") == sorted(want)


def test_levels_follow_the_paper(spark):
    # the two documents and levels of the published description of columnar shredding
    doc = {"Links": {"Forward": [20, 40, 60]}, "Name": [{"Language": [{"Code": "en-us", "Country": "us"}, {"Code": "en"}], "Url": "A"}, {"Url": "B"}, {"Language": [{"Code": "en-gb", "Country": "gb"}]}]}
    got = nested.shred(doc)
    assert [x[0] for x in got[".Links.Forward[]"]] == [0, 1, 1]
    code = got[".Name[].Language[].Code"]
    assert [(r, v) for r, _, v in code] == [(0, "en-us"), (2, "en"), (1, None), (1, "en-gb")]
    assert nested.places([r for r, _, _ in code], 2) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert [(r, v) for r, _, v in got[".Name[].Language[].Country"]] == [(0, "us"), (2, None), (1, None), (1, "gb")]


def test_entries_that_are_null_are_no_entries(spark):
    docs = [(1, '{"m": [null, {"a": 1}, {}, "x", {"a": null}]}'), (2, '{"m": {"a": "y"}}'), (3, '{"k": [{"m": []}, {"m": [null]}]}'), (4, '{"m": null}')]
    got = nested.entry_rows(spark.createDataFrame(docs, "rec long, payload string"), "rec", "payload", "m", {"a": "a"})
    assert rows(got.na.fill("-"), "rec", "parent_no", "a") == [(1, 1, "1"), (1, 2, "-"), (1, 4, "-"), (2, 0, "y")]
    levels = [[(r, d) for r, d, _ in nested.shred(json.loads(t))[".m[].a"]] for t in ('{"m": [null, {"a": 1}]}', '{"m": [{}, {"a": 1}]}')]
    assert levels == [[(0, 2), (1, 5)], [(0, 3), (1, 5)]]


def test_any_depth(spark):
    n = 20_000
    deep = '{"a":' * n + '{"disruptiveness": [{"DI1": 0.5}, {"DI1": 1e305}], "x": [1, "\\u00e9", -2.5e3, true, null, [], {}]}' + "}" * n
    broken = [deep[:-1], deep + "}", deep.replace("true", "truth"), "[" * n + "1," + "]" * n, '{"a":' * n, '{"a" 1}' * n, "{1:" * n]
    df = spark.createDataFrame([(k, p) for k, p in enumerate([deep, deep[:60_000].replace('{"a":', "[") + "]" * 12_000, *broken])], "rec long, payload string")
    assert rows(nested.numbers_below(df, "rec", "payload", "disruptiveness", "DI1"), "rec", "output_no", "value") == [(0, 0, 0.5), (0, 1, 1e305)]
    assert [r[0] for r in rows(nested.record_rows(df, "rec", "payload", {}), "state")].count("complete") == 2
    for text in ('{"a": [1, {"b": "c\\n"}, null], "d": {}}', " [ ] ", "3.5", '"x"', "-Infinity", '{"a": 1, "a": 2}'):
        assert nested.loads(text) == json.loads(text)
    for text in ("", "{", "[1,]", '{"a": 1,}', "{]", "[1 2]", "01", "nul", '{"a"}', "[1]]", '"x'):
        with pytest.raises(ValueError):
            nested.loads(text)
        with pytest.raises(ValueError):
            json.loads(text)
    huge = spark.createDataFrame([(1, '{"disruptiveness": {"DI1": 1e303}}'), (2, '{"disruptiveness": {"DI1": 1e15}}')], "rec_id long, payload string")
    assert rows(problems.disruption_items(huge), "rec_id", "item") == [(1, "1" + "0" * 307), (2, "1" + "0" * 19)]


def test_list_numbers_of_any_length(spark):
    df = spark.createDataFrame([(1, "1000) J A. 1999;1:2 1001) J B. 2000;2:3")], "row_id long, t string")
    assert [r[1] for r in rows(packed.split_packed(df, "row_id", "t", packed.CITATION, 2), "pos", "val")] == ["J A. 1999;1:2", "J B. 2000;2:3"]


def test_nested_edges(spark):
    deep = "[" * 100_000 + "]" * 100_000
    docs = [(1, None), (2, ""), (3, "{"), (4, "[]"), (5, "null"), (6, deep), (7, '{"Mesh_year_category": [null, {"category": [[], {"tree": "A"}, null, "B"]}], "disruptiveness": {"runs": [null, {"DI1": "1e-2"}, {"DI1": true}, {"DI1": "nan"}]}}')]
    docs += [(None, "{}"), (8, '{"Mesh_year_category": {"category": "\\ud800x"}, "disruptiveness": {"DI1": 1e999, "x": {"DI1": ' + "9" * 400 + "}}}")]
    df = spark.createDataFrame(docs, "rec long, payload string")
    got = rows(nested.repeated_values(df, "rec", "payload", "Mesh_year_category", "category"), "rec", "parent_no", "item_no", "value")
    assert got == [(7, 1, 1, "A"), (7, 1, 3, "B"), (8, 0, 0, "?x")]
    assert rows(nested.numbers_below(df, "rec", "payload", "disruptiveness", "DI1"), "rec", "output_no", "value") == [(7, 1, 0.01)]
    assert [r[1] for r in rows(nested.record_rows(df, "rec", "payload", {"pmid": "PMID"}), "rec", "state")][:5] == ["empty", "empty", "broken", "complete", "complete"]
    assert nested.shredded_levels(df.limit(0), "rec", "payload").count() == 0
