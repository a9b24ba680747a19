"""Copies and stuffing that shorter searches miss."""

import random
import time

import numpy as np
import pytest

from citeloom.llm import leaks, stuffing, text


def leak(item, copy):
    made = leaks.Items([(0, " ".join(item))])
    body = [made.vocabulary.get(w, 0) for w in ["x"] * 9 + copy + ["y"] * 9] + [0]
    return leaks.cases(np.array(body, np.int64), [0, len(body)], made, 20, 6) == {(0, 0)}


I36, I38 = [f"w{k}" for k in range(36)], [f"w{k}" for k in range(38)]


@pytest.mark.parametrize(
    "item, copy, want",
    [
        (I36, I36[:15] + I36[20:], True),  # five words dropped
        (I38, I38[:19] + ["z"] * 5 + I38[19:], True),  # five added
        (I38, I38[:19] + ["z"] * 6 + I38[19:], True),
        (I38, I38[:19] + ["z"] * 7 + I38[19:], False),
        (I36, I36[:8] + ["z", I36[9], "z"] + I36[11:20], True),  # two changed words around a kept one
        (I36, I36[:19], False),
        (I36, I36[:19] + ["z"] * 17, False),  # a copy ends with an equal word
    ],
)
def test_edits_may_lie_together(item, copy, want):
    assert leak(item, copy) == want


@pytest.mark.parametrize("seed", range(3))
def test_copies_at_the_limit(seed):
    rng = random.Random(seed)
    for _ in range(100):
        item = [f"w{k}" for k in range(rng.randint(20, 400))]
        copy, keep = list(item), {0, len(item) - 1}
        for at in sorted(rng.sample(range(1, len(item) - 1), len(item) // 6), reverse=True):
            if at not in keep:
                copy[at : at + 1] = rng.choice([["z"], [], [copy[at], "z"]])
        assert leak(item, copy)


@pytest.mark.parametrize("size, edits", [(30, 5), (36, 6), (42, 7)])
@pytest.mark.parametrize("kind", ["changed", "dropped", "added"])
def test_clustered_edits(size, edits, kind):
    item = [f"w{k}" for k in range(size)]
    at = (size - edits) // 2
    copy = {"changed": item[:at] + ["z"] * edits + item[at + edits :], "dropped": item[:at] + item[at + edits :], "added": item[:at] + ["z"] * edits + item[at:]}[kind]
    assert leak(item, copy)
    if kind == "added":
        assert not leak(item, item[: size // 2] + ["z"] * (edits + 1) + item[size // 2 :]) or size // 2 >= 20


def plain_distance_rule(item, doc, least, one_in):
    """By every stretch of the item on its own: the least edits against any stretch of the document."""
    for s in range(len(item) - least + 1):
        row = np.zeros(len(doc) + 1, int)
        for k in range(s, len(item)):
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (doc != item[k]))
            for j in range(1, len(new)):
                new[j] = min(new[j], new[j - 1] + 1)
            row = new
            if k - s + 1 >= least and row.min() * one_in <= k - s + 1:
                return True
    return False


@pytest.mark.parametrize("seed", range(3))
def test_alignment_equals_plain_edit_distance(seed):
    rng = np.random.default_rng(seed)
    hits = 0
    for _ in range(60):
        item = rng.integers(1, 30, rng.integers(6, 26))
        doc = np.r_[rng.integers(1, 30, 4), item.copy(), rng.integers(1, 30, 4)]
        for _ in range(rng.integers(0, 7)):
            at = rng.integers(4, len(doc) - 4)
            doc = [np.r_[doc[:at], 99, doc[at + 1 :]], np.delete(doc, at), np.insert(doc, at, 99)][rng.integers(3)]
        want = plain_distance_rule(item, doc, 8, 4)
        hits += want
        assert leaks.carries(item, doc, 8, 4) == want
    assert 5 < hits < 55


def test_templates_do_not_multiply(spark):
    """2 000 items that begin alike against documents that are full of that beginning."""
    template = "which of the following is the best answer to this".split()
    items = leaks.Items([(k, template + [f"own{k}x{j}" for j in range(25)]) for k in range(2000)])
    code = items.vocabulary.get
    docs = [template * 1000, template + [f"own7x{j}" for j in range(25)], template + ["other"] * 30]
    flat = np.array([c for d in docs for c in [*(code(w, 0) for w in d), 0]], np.int64)
    began = time.process_time()
    got = leaks.cases(flat, [0, *np.cumsum([len(d) + 1 for d in docs]).tolist()], items, 20, 6)
    assert got == {(1, 7)} and time.process_time() - began < 20


def test_items_in_several_passes(spark, monkeypatch):
    rng = random.Random(1)
    long = [f"w{rng.randrange(900)}" for _ in range(3000)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(f"v{k}" for k in range(60))), (3, "too short"), (4, None)], "item_id long, text string")
    docs = [(k, " ".join(["x"] * 5 + long[s : s + 30] + ["y"] * 5)) for k, s in enumerate(range(0, 2970, 11))] + [(900, " ".join(f"v{k}" for k in range(20, 45)))]
    monkeypatch.setattr(leaks, "PASS_WORDS", 400)
    assert len(list(leaks.item_passes([(1, " ".join(long))], 80, 400))) > 5
    got = {(r.key, r.item) for r in leaks.leaked(spark.createDataFrame(docs, "key long, text string"), "key", "text", items, "item_id", "text").collect()}
    assert got == {(k, 1) for k in range(270)} | {(900, 2)}


def test_long_reference_marks_are_no_words():
    assert text.words("one [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15-99, 100] two") == ["one", "two"]


def test_long_markup_is_no_words():
    assert text.words(f'one <span style="{"color: red; " * 60}">two</span> <!-- {"note " * 200} --> three') == ["one", "two", "three"]
    assert text.words("a <b " + "so on " * 100 + "> c").count("so") == 100


def dressed(*phrases):
    """Two clauses for each phrase, which names it twice, in words that no other sentence has."""
    return " ".join(f"We sold {p} in the q{k}a and the {p} was q{k}b. The {p} of q{k}c is not {p} for q{k}d." for k, p in enumerate(phrases))


PLAIN = " ".join(f"We measured the p{k} of the s{k} in winter and the t{k} was not u{k}." for k in range(9))


@pytest.mark.parametrize(
    "page",
    [
        dressed(*["cheap blue garden kit deals"] * 6),  # a phrase of five words that always recurs whole
        dressed(*["alphakit", "bravokit", "charliekit", "deltakit", "echokit", "foxtrotkit", "golfkit"]),  # none has 15 % of the page
        dressed(*["alphakit", "bravokit", "charliekit", "deltakit"] * 5) + " " + PLAIN,  # beside other text
    ],
)
def test_keywords_count_together_at_any_length(page):
    assert stuffing.measures(page)[3] > 0.5


def test_plain_text_is_no_stuffing():
    assert stuffing.measures(PLAIN)[3] == 0 and stuffing.measures(PLAIN * 20)[3] == 0


def test_long_repeats_stay_cheap():
    began = time.process_time()
    for page in ("the kit " * 30_000, "we sell a blue kit in the shop of the town " * 5_000, PLAIN * 300):
        stuffing.measures(page)
    assert time.process_time() - began < 60


OTHER_LANGUAGES = {
    "pl": "Badania prowadzono w trzech ośrodkach przez dwa lata. Wyniki nie potwierdzają hipotezy, że temperatura ma wpływ na tempo wzrostu. W kolejnym etapie zbadamy większą liczbę próbek i porównamy je z danymi z archiwum.",
    "it": "Abbiamo misurato la temperatura del campione ogni ora. I risultati non confermano l'ipotesi che il calore acceleri la crescita. Nella prossima fase confronteremo questi dati con quelli dell'archivio.",
    "nl": "Wij hebben de monsters gedurende twee winters gemeten. De resultaten laten zien dat de groei niet van de temperatuur afhangt. In een volgende studie vergelijken wij deze gegevens met het archief.",
    "pt": "Medimos a temperatura das amostras durante dois invernos. Os resultados não confirmam a hipótese de que o calor acelera o crescimento. Na próxima fase vamos comparar estes dados com os do arquivo.",
    "zh": "我们在两个冬天里测量了样品的温度。结果并不支持温度影响生长的假设。在下一阶段，我们将把这些数据与档案中的数据进行比较。",
    "ru": "Мы измеряли температуру образцов в течение двух зим. Результаты не подтверждают гипотезу о том, что тепло ускоряет рост. На следующем этапе мы сравним эти данные с архивом.",
    "cs": "Teplotu vzorků jsme měřili po dvě zimy. Výsledky nepotvrzují hypotézu, že teplo urychluje růst. V další fázi porovnáme tato data s údaji z archivu a popíšeme je v nové zprávě.",
    "sv": "Vi mätte provernas temperatur under två vintrar. Resultaten visar att tillväxten inte beror på värmen. I nästa steg jämför vi dessa data med dem i arkivet.",
    "tr": "Örneklerin sıcaklığını iki kış boyunca ölçtük. Sonuçlar, bu sıcaklığın büyümeyi hızlandırdığı savını desteklemiyor. Bir sonraki aşamada bu verileri arşiv ile karşılaştıracağız.",
}


@pytest.mark.parametrize("language", OTHER_LANGUAGES)
def test_prose_in_other_languages_is_no_stuffing(language):
    assert stuffing.measures(OTHER_LANGUAGES[language])[3] < 0.5
    assert stuffing.measures("\n\n".join([OTHER_LANGUAGES[language]] * 5))[3] < 0.5


@pytest.mark.parametrize("many", range(1, 9))
@pytest.mark.parametrize("join", [", ", " | ", "\n", " ", ". "])
def test_keyword_pages_of_any_phrase_length(many, join):
    phrase = " ".join("cheap blue garden kit deals online store today".split()[:many])
    assert stuffing.measures(join.join([phrase] * 40))[3] > 0.5
    assert stuffing.measures(dressed(*[phrase] * 8))[3] > 0.5


def test_long_tags_are_no_segments():
    assert stuffing.segments(f'one<li class="{"x " * 400}">two') == [["one"], ["two"]]
