"""Problems 8, 9 and 10 against brute force and on odd inputs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import leaks, packing, queries, stuffing, text

# ---- words


@pytest.mark.parametrize(
    "raw, want",
    [
        ("A <b>Cat</b>&nbsp;sat,\r\nquiet-\n> ly [12] on_the (ibid.) mat¹.", "a cat sat quietly on the mat"),
        ("ｋｉｂｒｏｎａｌ ｉｓ", "kibronal is"),
        ("dul­boose dis​plex naïve naïve", "dulboose displex naive naive"),
        ("rарid мир", "rapid мир"),
        ("", ""),
        ("  -- []", ""),
    ],
)
def test_words(raw, want):
    assert " ".join(text.words(raw)) == want


# ---- packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 12), st.integers(1, 5))
def test_packer_keeps_capacity_and_items(sizes, capacity, windows):
    packer, out = packing.Packer(capacity, windows), []
    items = [p for k, n in enumerate(sizes) for p in packing.pieces(k, n, capacity)]
    for item in items:
        out += list(packer.place(item))
        assert len(packer.rooms) <= windows
    out += list(packer.rest())
    assert all(sum(i[3] for i in c) <= capacity for c in out)
    assert sorted(i for c in out for i in c) == sorted(items)
    whole = defaultdict(int)
    for key, _, start, n in items:
        assert start == whole[key]
        whole[key] += n
    assert dict(whole) == dict(enumerate(sizes))


@pytest.mark.parametrize("parts, fan_in", [(1, 2), (7, 2), (7, 32)])
def test_pack_leaves_little_room(spark, parts, fan_in):
    rng = random.Random(5)
    sizes = [(k, min(2000, int(rng.lognormvariate(5.2, 1)))) for k in range(3000)] + [(5000, 9000), (5001, 4096), (5002, 0)]
    plan = packing.pack(spark.createDataFrame(sizes, "key long, n_tokens long").repartition(parts), 2048, 16, fan_in).collect()
    load, got, slots = Counter(), Counter(), defaultdict(list)
    for r in plan:
        load[r.container] += r.n_tokens
        got[r.key] += r.n_tokens
        slots[r.container].append(r.slot)
        assert r.container >= 0 and (r.n_tokens == 2048 or r.piece == 0 or r.key in (5000, 5001))
    assert max(load.values()) <= 2048 and dict(got) == dict(sizes)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(load.values()) / (2048 * len(load)) > 0.97
    assert sum(1 for r in plan if r.key == 5000) == 5 and sum(1 for r in plan if r.key == 5001) == 2


def test_pack_edges(spark):
    empty = spark.createDataFrame([], "key long, n_tokens long")
    assert packing.pack(empty).count() == 0
    same = spark.createDataFrame([(1, 5), (1, 5), (2, 5)], "key long, n_tokens long")
    plan = packing.pack(same, 10)
    assert sorted((r.n_items, r.n_tokens, r.unused) for r in packing.container_fill(plan, 10).collect()) == [(1, 5, 5), (2, 10, 0)]
    with pytest.raises(ValueError):
        packing.pack(same, 0)


def test_token_counts(spark):
    texts = [(1, "a plain text"), (2, ""), (3, None), (None, "x"), (4, "<|endoftext|> " * 2000), (5, "ü" * 30_000)]
    got = {r.key: r.n_tokens for r in packing.token_counts(spark.createDataFrame(texts, "id long, t string"), "id", "t").collect()}
    encode = packing.encoder(packing.vocabulary_bytes()).encode_ordinary
    assert got == {k: len(encode(t)) for k, t in texts if k is not None and t is not None}
    assert got[2] == 0


# ---- leaks

WORDS = [f"{a}{b}{c}" for a in ("bra", "klo", "mir", "sna", "tvu") for b in ("den", "fol", "gip", "hux") for c in ("al", "ex", "io", "um", "yr")]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=3), st.lists(st.integers(0, 4), max_size=60))
def test_longest_matches_and_their_places(items, shard):
    made = leaks.Items([(k, " ".join(f"w{x}" for x in codes)) for k, codes in enumerate(items)])
    flat = np.array([made.vocabulary.get(f"w{x}", 0) for x in shard] + [0], np.int64)
    p, array, lo, hi, size = leaks.longest(flat, made)
    f = made.flat

    def same(p, q):
        n = 0
        while f[p + n] == flat[q + n] > 0:
            n += 1
        return n

    want = {i: max(n) for i in range(len(f)) if (n := [same(i, q) for q in range(len(flat))]) and max(n) >= made.seed}
    assert dict(zip(p.tolist(), size.tolist())) == want
    for i, s, e in zip(p.tolist(), lo.tolist(), hi.tolist()):
        assert {*array[s:e].tolist()} == {q for q in range(len(flat)) if same(i, q) >= made.seed}
    suffix = [flat[q : q + np.flatnonzero(flat[q:] == 0)[0]].tolist() for q in array.tolist()]
    assert suffix == sorted(suffix)
    for least in (5, 6):
        a, b = (leaks.bound(made, p, flat, array, lo, hi, least, after) for after in (False, True))
        for i, s, e in zip(p.tolist(), a.tolist(), b.tolist()):
            if want[i] >= least:
                assert {*array[s:e].tolist()} == {q for q in range(len(flat)) if same(i, q) >= least}


def altered(rng, words_, one_in):
    """A copy with exactly every `one_in`-th word changed, dropped or followed by another."""
    out = []
    for k, w in enumerate(words_):
        if k % one_in == one_in - 1 and k < len(words_) - 1:
            out += rng.choice([["zzz"], [], [w, "zzz"]])
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_copies_are_found_and_phrases_are_not(spark, seed, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD", 700)
    rng = random.Random(seed)
    items = {k: passage(rng, rng.randint(25, 90)) for k in range(12)}
    docs, want = [], set()
    for d in range(60):
        body = passage(rng, rng.randint(5, 200))
        k = rng.randrange(12)
        kind = d % 6
        if kind == 0:
            part = items[k]
        elif kind == 1:
            part = altered(rng, items[k], 6)
        elif kind == 2:
            at = rng.randrange(len(items[k]) - 24)
            part = items[k][at : at + 24]
        elif kind == 3:
            at = rng.randrange(len(items[k]) - 14)
            part = items[k][at : at + 12]
        elif kind == 4:
            part = rng.sample(items[k], len(items[k]))
        else:
            part = []
        if kind < 3:
            want.add((d, k))
        cut = rng.randrange(len(body) + 1)
        joined = " ".join(body[:cut]) + ". " + rng.choice([" ", ", ", "  "]).join(part).upper() + "; " + " ".join(body[cut:])
        docs.append((d, joined, 0))
    docs += [(None, "a b c", 0), (900, None, 0), (901, "", 0), (902, " ".join(passage(rng, 20_000)), 0)]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string, item long")
    items_df = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(50, None), (51, "short one"), (None, " ".join(items[0]))], "item_id long, text string")
    cases = leaks.leaked(docs_df, "doc_id", "text", items_df, "item_id", "text")
    got = {(r.key, r.item) for r in cases.collect()}
    assert got == want
    assert {r.item: r.n_docs for r in leaks.item_report(cases).collect()} == Counter(k for _, k in want)
    assert leaks.without_leaks(docs_df, "doc_id", cases).count() == len(docs) - len({d for d, _ in want})  # the one without a key stays
    assert leaks.leaked(docs_df.limit(0), "doc_id", "text", items_df, "item_id", "text").count() == 0
    assert leaks.leaked(docs_df, "doc_id", "text", items_df.limit(0), "item_id", "text").count() == 0


# ---- stuffing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40))
def test_automaton_counts_every_run(codes):
    runs, starts = stuffing.repeated_runs(codes, Counter(codes))
    am = stuffing.Automaton(runs)
    want = Counter(tuple(codes[i:j]) for i in range(len(codes)) for j in range(i + 1, len(codes) + 1))
    for run, n in want.items():
        state = 0
        for c in run:
            state = am.follow[state].get(c) if state is not None else None
        if n > 1:
            assert state is not None and am.times[state] == n
    for start, run in zip(starts, runs):
        assert codes[start : start + len(run)] == run


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=30))
def test_repeat_coverage(tokens):
    repeated = stuffing.repeat_coverage([tokens])
    want = [0] * len(tokens)
    for i in range(len(tokens) - 1):
        for j in range(i + 2, len(tokens) + 1):
            if sum(tokens[k : k + j - i] == tokens[i:j] for k in range(len(tokens))) > 1:
                want[i:j] = [1] * (j - i)
    assert list(repeated) == want


PROSE = "We measured the texture of the samples in winter. None of them had changed by the end of the second run, which is why we repeated it. The results are shown in the last table of this report. "
SPAM = [
    "cheap kit\ncheap kit\nCHEAP KIT\ncheap kit\ncheap kit",
    "alpha, bravo, charlie, delta, echo, foxtrot, golf, hotel, india, juliet",
    "Read more alpha | Home bravo list | Next charlie (3) | See all delta pdf | Top 10 echo",
    "Looking for kit? kit here, cheap kit, kit now! Our kit is kit of kit and top kit 2019. Best kit for kit authors, kit today. Looking for kit? kit now kit.",
    "Our samples were measured in the winter.\n" + "https://www.kit45.example/alpha?id=1\n" * 30,
    '<ul><li><a href="http://x.test/1">alpha kit</a></li><li><a href="http://x.test/2">bravo kit</a></li></ul>',
    "tag:kit cat:alpha brand:Bravo, tag:offer cat:delta brand:Echo, tag:new cat:golf brand:Hotel",
]
CLEAN = [
    PROSE,
    PROSE * 60,
    PROSE + "\nReferences\n1. Alpha B. Notes on kits. 1993;13:16.\n2. Bravo C. Measuring kits. 1998;18:169.",
    PROSE + "\nKeywords: alpha, bravo, charlie",
    "Según estos resultados, alpha no explica por sí solo la variación. " * 3 + "El grupo de Bravo revisó 12 registros y no halló diferencias año tras año.",
    "Eine schwächere Bindung von alpha erklärt die Streuung größtenteils. " * 5,
]


def test_pages(spark):
    rows = [(k, t) for k, t in enumerate(SPAM)] + [(100 + k, t) for k, t in enumerate(CLEAN)] + [(None, PROSE), (200, None), (201, ""), (202, "--- ***"), (203, "kit " * 50_000), (204, PROSE * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    measured = stuffing.page_measures(df, "doc_id", "text").cache()
    assert measured.count() == len(rows) - 2
    assert {r.key for r in stuffing.stuffed_pages(measured).collect()} == {*range(len(SPAM)), 203}
    assert measured.filter("key in (201, 202)").agg(F.max("stuffing")).first()[0] == 0
    assert stuffing.page_measures(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_values", "p1_candidates", "p1_unmatched", "p8_plan", "p8_fill", "p9_found", "p9_items", "p9_kept", "p10_found", "p10_measures"])
def test_queries_run(spark, root, name):
    df = queries.queries()[name](spark, root)
    got = [tuple(map(str, r)) for r in df.collect()]
    keys = {"p8_plan": ["container", "slot"], "p8_fill": ["container"], "p9_items": ["item_id"], "p9_kept": ["doc_id"], "p10_found": ["doc_id"], "p10_measures": ["doc_id"], "p1_found": ["id", "pos"], "p1_values": ["value"], "p1_unmatched": ["value"]}
    places = [df.columns.index(c) for c in keys.get(name, df.columns)]
    assert got and len({tuple(r[k] for k in places) for r in got}) == len(got)


def test_p8_against_the_texts(spark, root):
    encode = packing.encoder(packing.vocabulary_bytes()).encode_ordinary
    sizes = {r.doc_id: len(encode(r.text)) for r in spark.read.parquet(f"{root}/documents.parquet").filter("text is not null").collect()}
    plan = queries.p8_plan(spark, root).collect()
    got, load, pieces = Counter(), Counter(), Counter()
    for r in plan:
        got[r.doc_id] += r.n_tokens
        load[r.container] += r.n_tokens
        pieces[r.doc_id] += 1
    assert dict(got) == sizes and max(load.values()) <= queries.CAPACITY
    assert all(n == max(1, -(-sizes[d] // queries.CAPACITY)) for d, n in pieces.items())


def test_p9_against_every_document(spark, root):
    """Verbatim runs of 20 words by plain sets; every altered copy that comes out is within the edit rule by the plain table."""
    items = {r.item_id: text.words(r.text) for r in spark.read.parquet(f"{root}/eval_items.parquet").collect()}
    docs = {r.doc_id: text.words(r.text) for r in spark.read.parquet(f"{root}/documents.parquet").filter("text is not null").collect()}
    runs = {}
    for k, w in items.items():
        for s in range(len(w) - 19):
            runs.setdefault(tuple(w[s : s + 20]), set()).add(k)
    whole = {(d, k) for d, w in docs.items() for s in range(len(w) - 19) for k in runs.get(tuple(w[s : s + 20]), ())}
    got = {tuple(r) for r in queries.p9_found(spark, root).collect()}
    assert whole <= got
    for d, k in got - whole:
        assert len({*zip(items[k], items[k][1:])} & {*zip(docs[d], docs[d][1:])}) >= 11


def test_p1_against_the_plain_table(spark, root):
    """Every typed value that is mapped is as near to a form of its journal as the walk says, and none is nearer to another's title."""
    from citeloom.llm import canonical

    listed = queries._listed(spark, root)
    titles = {j: {canonical.normal(t), canonical.normal(s)} for j, s, t in listed}
    by_form = {}
    for j, forms in titles.items():
        for f in forms:
            by_form.setdefault(f, set()).add(j)
    for r in queries.p1_values(spark, root).collect():
        exact = by_form.get(canonical.normal(r.value), set())
        if len(exact) == 1:
            assert (r.jcr_id, r.distance) == (next(iter(exact)), 0)
