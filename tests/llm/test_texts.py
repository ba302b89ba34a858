import random

import numpy as np
import pytest

from sievework.llm import leaks, mixing, reading
from sievework.llm.reading import reading_levels

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch from the hill"


def test_leaks(spark):
    words = ITEM.split()
    docs = [
        (1, "Before. " + ITEM.upper().replace(" ", ", ") + " after"), (2, " ".join(words[:11])), (3, "x " + " ".join(words[2:14]) + " y"), (4, "<p>" + "</p><p>".join([ITEM[:40], ITEM[40:]]) + "</p>"), (5, None), (6, ""), (7, "a b c"), (8, "a b"),
        (9, "pad " * 100_000 + ITEM), (9, ITEM), (None, ITEM), (10, " ".join(words[:11] + ["gap"] + words[11:])),
    ]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, at int")
    items = spark.createDataFrame([(1, ITEM), (2, "A b, c!"), (3, None), (4, "***")], "item_id bigint, text string")
    assert sorted(tuple(r) for r in leaks.leaks(d, items).collect()) == [(1, 1), (3, 1), (4, 1), (7, 2), (9, 1)]
    cut = {r.doc_id: r for r in leaks.decontaminated(d.where("doc_id in (1, 3)"), items, drop_share=0.95).collect()}
    assert cut[1].action == "cut" and cut[1].text.split() == ["Before.", "after"] and cut[3].text.split() == ["x", "y"]
    assert leaks.leaks(d.limit(0), items).count() == 0 and leaks.leaks(d, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaks.leak_windows(d, items, "doc_id", "item_id", limit=5)


def test_windows():
    flat = np.arange(20, dtype=np.uint64)
    h = leaks.windows(flat, 12)
    assert len(h) == 9 and len(set(h.tolist())) == 9 and len(leaks.windows(flat[:5], 12)) == 0


def test_flow_plan():
    patterns = [(("a",), 100), (("a", "b"), 50), (("b",), 10)]
    size, flows = mixing.plan(patterns, [("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.0, 5)], None)
    reached = {s: sum(n for (k, x), n in flows.items() if x == s) for s in "ab"}
    assert abs(reached["a"] - reached["b"]) <= 1 and size >= 220 and flows.get((0, "a"), 0) <= 100 and flows.get((2, "b"), 0) <= 20
    size, flows = mixing.plan(patterns, [("b", 1.0, 2)], 65)
    assert sum(flows.values()) == 65 and sum(flows.values()) == flows[1, "b"] + flows[2, "b"]  # first uses of all come before second uses


def test_mixture(spark):
    P = pytest.importorskip("public_tokenizers")
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["red", "blue", "green", "house", "tree"]) for _ in range(n))
    docs = [(k, s, text(r.randint(5, 60))) for k, s in enumerate(["a"] * 200 + ["b"] * 20 + ["other"] * 5)]
    docs += [(900, "a", docs[210][2]), (901, "b", None), (902, None, "x"), (903, "b", "")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, source string, text string, tokens int")
    goal = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mixture(d, goal, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = mixed.collect()
    caps = {"a": 1, "b": 3}
    assert rows and all(1 <= x.copies <= caps[x.source] for x in rows) and len({(x.doc_id, x.source) for x in rows}) == len(rows)
    s = {x.source: x for x in shares.collect()}
    # a text that several sources hold is used no more often in all than the most generous of them allows
    used = {}
    for x in rows:
        held = next(t for k, _, t in docs if k == x.doc_id)
        used[held] = used.get(held, 0) + x.copies
    assert max(used.values()) <= 3
    assert abs(s["a"].reached_share - 2 / 3) < 0.05 and abs(s["b"].reached_share - 1 / 3) < 0.05 and s["none"].mixed_tokens == 0
    assert {tuple(x) for x in mixing.mixture(d.repartition(7), goal, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)[0].collect()} == {tuple(x) for x in rows}
    empty, none = mixing.mixture(d.limit(0), goal, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert empty.count() == 0 and {x.mixed_tokens for x in none.collect()} == {0}


def test_levels(spark):
    r = random.Random(2)
    easy = ["You meet the boss at the shop.", "The job is good and kind.", "Take a pen to the big store.", "We like to sit and talk each day."]
    middle = ["The better applicants describe the training budget openly and never hide that several people apply.", "Some teams organise the working hours every spring, even if the deadline is close.", "Keep the contract draft ready, since the recruiter may want to review it after the trial week."]
    hard = ["The methodological competency frameworks presuppose a considerable nondiscrimination, notwithstanding the supplementary jurisdictional interpretation of organisational responsibilities.", "In these circumstances institutional stakeholders are to retrospectively evaluate the algorithmic determinations of proportionate remuneration arrangements."]
    docs, want = [], {}
    for k in range(240):
        band = k % 3 + 1
        pool = (easy, middle, hard)[band - 1]
        noise = (middle, easy, middle)[band - 1]
        lines = [r.choice(pool) if r.random() < 0.8 else r.choice(noise) for _ in range(14)]
        docs.append((k, "\n".join(f"- {x.rstrip('.')}" for x in lines) if k % 2 else " ".join(lines)))
        want[k] = band
    run_on = " and ".join(x.rstrip(".").lower() for x in easy * 4)
    docs += [(500, run_on + "."), (501, None), (502, ""), (503, "too short"), (504, "Der Bewerber bespricht heute die Stelle und das Gehalt mit dem Team. " * 8), (505, " ".join(easy * 20_000))]
    d = spark.createDataFrame([(*x, "en", 1) for x in docs], "doc_id bigint, text string, lang string, words int")
    got = {x.doc_id: x.band for x in reading_levels(d).collect()}
    assert not {501, 502, 503, 504} & set(got) and got[500] == 3 and got[505] == 1  # easy words in one endless sentence are hard to read
    assert sum(got[k] == b for k, b in want.items()) >= 0.95 * len(want)
    assert reading_levels(d.limit(0)).count() == 0
    # a table of graded texts: every word of "a" texts is worth 4 years, of "b" texts 14, whatever their sentences
    lessons = [(f"the {w} of a {w} is in the {w} and {w} to {w}. " * 3, g) for g, ws in ((4.0, ("pen", "cup", "hat")), (14.0, ("quoin", "parol", "estop"))) for w in ws for _ in range(4)]
    told = spark.createDataFrame([(1, lessons[0][0] * 3), (2, lessons[-1][0] * 3)], "doc_id bigint, text string")
    graded = {x.doc_id: x.grade for x in reading_levels(told.union(told.selectExpr("doc_id + 10", "text")), graded=spark.createDataFrame(lessons, "text string, grade double"), least_count=1).collect()}
    assert abs(graded[1] - 4) < 0.5 and abs(graded[2] - 14) < 0.5


def test_grades_come_from_all_graded_texts(spark):
    line = "the quoin of a quoin is in "
    lessons = [(f"{line}x{k}.", 1008.0 if k % 500 == 0 else 8.0) for k in range(20_000)]  # rare ones, of which a sample holds too many or too few
    told = spark.createDataFrame([(1, " ".join(f"{line}z{k}." for k in range(8)))], "doc_id bigint, text string")
    got = reading_levels(told, graded=spark.createDataFrame(lessons, "text string, grade double"), least_count=2).first()
    assert abs(got.grade - 10) < 0.01


def test_fit_solves_the_equations(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [([int(x) for x in r.zipf(1.3, r.integers(0, 30)) if x <= 40], float(r.uniform(5, 30)), float(r.uniform(1, 15))) for _ in range(900)]
    rows = [([x - 1 for x in w], length, y) for w, length, y in rows]
    x = np.array([[*np.bincount(w, minlength=40) / max(1, len(w)), length / 10, 1.0] if w else [0.0] * 42 for w, length, _ in rows])
    want = np.linalg.solve(x.T @ x + 1e-3 * np.eye(42), x.T @ [y for *_, y in rows])
    coded, passes = spark.createDataFrame(rows, "codes array<int>, length double, formula double").repartition(3), []
    totals = reading._totals
    monkeypatch.setattr(reading, "_totals", lambda *a: passes.append(1) or totals(*a))
    for block, most in ((1022, 1), (30, 30)):
        monkeypatch.setattr(reading, "BLOCK", block)
        passes.clear()
        grades, per_word, constant = reading.fitted_grades(coded, 40)
        assert np.allclose([*grades, per_word * 10, constant], want, atol=1e-2) and len(passes) <= most, (block, len(passes))
    assert reading.fitted_grades(coded.limit(0), 40)[1] == 0.39
