import datetime as dt
import random

from sievework.llm import names
from sievework.llm.canonical import canonical_fields
from sievework.llm.fusion import fused_values, survivors


def test_variants(spark):
    same = ["Gelsamfa Fotgelge Motors", "FOTGELGE & GELSAMFA MOTORS LTD", "Gelsam. Fötgelge Motors", "GelsamfaFotgelge Motors (Careers)", "gelsamfotgel motors", "Motors, Gelsamfa-Fotgelge", "Gelsamfa Fotgelge", "Gelsamfa Fotgegle Motors - Hiring Team"]
    other = ["Gelsamfa Firrurte Logistics", "Vorballo Gelrurpe Staffing"]
    df = spark.createDataFrame([(n, "x") for n in [*same * 3, *other, None, " ", "***"]], "company string, cluster string")
    stop = f"{names.LEGAL} {names.HIRING} motors logistics staffing"  # too few names to find frequent words
    got = {r.name: r.cluster for r in names.name_variants(df, stop=stop).collect()}
    assert len({got[n] for n in same}) == 1 and len({got[n] for n in [*same, *other]}) == 3 and "***" in got and None not in got
    pairs = names.variant_pairs(names.name_variants(df, stop=stop)).collect()
    assert len(pairs) == len(same) * (len(same) - 1) // 2 and all(p.name_a.encode() < p.name_b.encode() for p in pairs)
    assert names.name_variants(df.limit(0)).count() == 0


def test_frequent_words_are_found(spark):
    parts = [f"{a}{b}{c}o" for a in ("bal", "ten", "vix", "sor") for b in ("lum", "nis", "gor") for c in ("t", "r", "m")]
    rows = [(f"{parts[k % 36].title()} {parts[(k * 7 + 5) % 36].title()} {line}{form}",) for k in range(36) for line in ("Foods", "Software Works", "Insurance") for form in ("", " Ltd")]
    rows += [("Ballumto Nothere Fds",), ("3M",), ("GE Health",)]
    df = spark.createDataFrame(rows, "name string").distinct()
    found = names.frequent_words(df, 0.05)
    assert found == {"foods", "software", "works", "insurance", "ltd"} | {w for w in found if w in parts} and not {"3m", "ge"} & found
    g = names.Generic(frozenset(["ltd"]), frozenset(["foods", "software", "works"]))
    assert g.lines("sw") == ["software"] and g.lines("fds") == ["foods"] and g.lines("ltd") == [] and "ltd" in g and "ge" not in g and "ballumto" not in g
    assert names.words_in("Ab S/W & Co. (HR)") == ["ab", "sw", "co"] and names.proper_words(["3m"], g) == ["3m"] and names.proper_words(["foods", "ltd"], g) == ["foods", "ltd"]


def test_curve_and_similarity():
    b = names.bands_for(0.4, 0.97, 3)
    assert 1 - (1 - 0.4**3) ** b >= 0.97 > 1 - (1 - 0.4**3) ** (b - 1)
    assert names.monge_elkan(["gelsamfa", "fotgelge"], ["fotgelge", "gelsam"]) > 0.95 > names.monge_elkan(["gelsamfa", "fotgelge"], ["gelsamfa", "vorballo"]) + 0.3
    assert names.monge_elkan([], ["a"]) == 0.0


def test_star_clusters(spark):
    # a path 1-2-3-4-5: the best node takes its neighbours, then the rest
    nodes = spark.createDataFrame([(f"{k}", p) for k, p in zip("123456", (1, 5, 2, 4, 3, 0))], "v string, prio int")
    edges = spark.createDataFrame([("1", "2", 1.0), ("2", "3", 1.0), ("3", "4", 1.0), ("4", "5", 1.0)], "a string, b string, sim double")
    assert {r.v: r.center for r in names.star_clusters(nodes, edges).collect()} == {"1": "2", "2": "2", "3": "2", "4": "4", "5": "4", "6": "6"}


def test_canonical(spark):
    titles = ["Data Engineer", "Senior Data Engineer", "Site Reliability Engineer", "UX Designer", "Full Stack Developer", "Database Administrator", "Junior Technical Writer"]
    ref_t = spark.createDataFrame(list(enumerate(titles, 1)), "ref_id bigint, title string")
    ref_l = spark.createDataFrame([(1, "Pune, India", "Pune", "India", ["Poona"]), (2, "Cambridge, United Kingdom", "Cambridge", "United Kingdom", []), (3, "Cambridge, United States", "Cambridge", "United States", None), (4, "New Delhi, India", "New Delhi", "India", ["Delhi"]), (5, "Austin, United States", "Austin", "United States", [])], "ref_id bigint, label string, city string, country string, also_known_as array<string>")
    cases = {
        "Data Engineer": None, "Engineer - Data (Snr)": 2, "Hiring: DATA Enginer #77": 1, "SRE - Site Relblty Eng.": 3, "UX_Dsgnr [Remote]": 4, "Fullstack Dev": 5, "DB Admin": 6, "Barista": 0, "": 0, "Jr Tech. Writer": 7, "x" * 50_000: 0,
    }
    places = {"Poona (Hybrid)": 1, "Cambridge, USA": 3, "UK - Cambrdge": 2, "NeweDelhi - 3 days in office": 4, "Austin - 3 days in office": 5, "Remote (India)": 0, "Pune, India": None, "Anywhere": 0}
    rows = [(k, t, None, "e") for k, t in enumerate(cases)] + [(100 + k, None, p, "e") for k, p in enumerate(places)]
    df = spark.createDataFrame(rows, "id bigint, title string, location string, value string")
    got = {(r.id, r.field_name): r.ref_id for r in canonical_fields(df, ref_t, ref_l).collect()}
    for k, (t, want) in enumerate(cases.items()):
        assert got.get((k, "title")) == want, (t, want, got.get((k, "title")))
    for k, (p, want) in enumerate(places.items()):
        assert got.get((100 + k, "location")) == want, (p, want, got.get((100 + k, "location")))
    assert canonical_fields(df.limit(0), ref_t, ref_l).count() == 0


T = dt.datetime(2026, 5, 1)


def test_survivors(spark):
    rows = [
        (1, "a", "F", "one two", T, T), (2, "b", " f", "one two three", T + dt.timedelta(1), T), (3, "c", "f", "three two one", T - dt.timedelta(1), T), (4, "a", "g", None, dt.datetime(1970, 1, 1), T), (5, "zz", "G", None, None, None),
        (6, "a", None, "x", T, T), (7, None, "", "x", T, T), (8, "a", "single", "x", T, T),
    ]
    jobs = spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, source string, fingerprint string, description string, posted_at timestamp_ntz, last_seen_at timestamp_ntz, g string")
    trust = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "source string, trust_rank int")
    paid = spark.createDataFrame([(1,), (2,), (5,)], "id bigint")
    got = sorted(tuple(r) for r in survivors(jobs, paid, trust).collect())
    assert got == [(1, 2, 2, 1), (4, 4, 5, 0)]
    assert survivors(jobs.limit(0), paid, trust).count() == 0


def test_fusion_discounts_copies(spark):
    rows = []
    for g in range(300):
        true, wrong = 7, 100 + g % 15
        a = wrong if g % 3 == 0 else true  # a is often wrong, b and c copy it
        rows += [(g, "f", "a", a, g * 10), (g, "f", "b", a, g * 10 + 1), (g, "f", "c", a, g * 10 + 2)]
        rows += [(g, "f", s, 50 + g % 13 if (g + k) % 7 == 0 else true, g * 10 + 3 + k) for k, s in enumerate("de")]
    rows += [(999, "f", "a", None, 1), (998, "f", "a", 3, 5), (998, "f", "a", 3, 4)]
    claims = spark.createDataFrame([(*r, 0) for r in rows], "g int, field string, source string, value bigint, id bigint, n int")
    claims = claims.selectExpr("struct(cast(g as bigint) as x, 0L as y) as g", "field", "source", "value", "id", "n")
    values, learned = fused_values(claims)
    got = {r.x: (r.value, r.id, r.n_claims) for r in values.select("g.x", "value", "id", "n_claims").collect()}
    assert got[998] == (3, 4, 1) and 999 not in got and set(learned["source"]) == set("abcde")
    assert sum(v[0] == 7 for k, v in got.items() if k < 300) >= 250  # three votes of one source count little
    acc = dict(zip(learned["source"], learned["accuracy"]))
    dep = dict(zip(learned["source"], learned["dependence"]))
    assert acc["d"] > acc["a"] and dep["b"] > 0.9 > dep["d"]
    # b and c, which are later, copy a; a itself copies nobody, d and e neither
    told = dict(zip(learned["source"], learned["copied_from"]))
    assert told["a"] is None and told["b"] == "a" and told["c"] in ("a", "b") and told["d"] is None and told["e"] is None
    # accuracies near the planted ones
    assert abs(acc["a"] - 2 / 3) < 0.05 and abs(acc["d"] - 6 / 7) < 0.05


def test_fusion_takes_near_equal_texts_for_one(spark):
    sketch = lambda ks: list(ks)
    rows = [(1, "t", s, v, k, k, sk) for k, (s, v, sk) in enumerate([("a", 10, sketch(range(40))), ("b", 11, sketch(range(1, 39))), ("c", 12, sketch(range(100, 140))), ("d", 13, sketch(range(20)))])]
    claims = spark.createDataFrame(rows, "g long, field string, source string, value long, id long, at long, sketch array<long>").selectExpr("struct(g as x, 0L as y) as g", "field", "source", "value", "id", "at", "sketch")
    got = fused_values(claims)[0].first()
    assert (got.value, got.id) == (10, 0) and got.probability > 0.9
    assert fused_values(claims.limit(0))[0].count() == 0


def sent_rows(spark, job):
    """The most rows that a step of the job sends to every worker."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    job()
    most = 0
    for k in range(before, store.executionsCount()):
        number = store.executionsList(k, 1).head().executionId()
        values = store.executionMetrics(number)
        nodes = store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_variants_send_no_bands(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(4))
    df = spark.createDataFrame([(f"{word()} {word()}",) for _ in range(400)], "company string").repartition(2)
    # 54 rows of each name would be sent
    assert sent_rows(spark, lambda: names.variant_pairs(names.name_variants(df)).collect()) < 4000


def test_canonical_sends_no_values(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(9)) for _ in range(60)]
    df = spark.createDataFrame([(60 * k + j, f"{a} {b}", None) for k, a in enumerate(words) for j, b in enumerate(words)], "id bigint, title string, location string")
    ref_t = spark.createDataFrame([(1, "Data Engineer"), (2, "Senior Gardener")], "ref_id bigint, title string")
    ref_l = spark.createDataFrame([(1, "Pune, India", "Pune", "India", None)], "ref_id bigint, label string, city string, country string, also_known_as array<string>")
    # 10,800 tokens of 3,600 values would be sent, and the variants of each
    assert sent_rows(spark, lambda: canonical_fields(df, ref_t, ref_l).collect()) < 5000
