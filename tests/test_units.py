from sievework.operators.units import annual_pay, measured

PAY = "currency string, min double, max double, period string, raw string"


def pay(spark, rows):
    jobs = spark.createDataFrame([(k, s, p, "x") for k, (s, p) in enumerate(rows)], f"id bigint, source string, salary struct<{PAY.replace(' string', ':string').replace(' double', ':double')}>, currency string")
    boards = spark.createDataFrame(
        [("inr", "INR", "Pay is printed in full."), ("lakh", "INR", "Pay fields hold lakh rupees per year unless the text says otherwise."), ("k", "USD", "Figures without a unit are thousands of dollars per year."), ("hour", "USD", "pay fields without a period are per hour."), ("none", None, None)],
        "source string, default_currency string, pay_note string",
    )
    fx = spark.createDataFrame([("INR", 1), ("USD", 84), ("EUR", 91), ("GBP", 107)], "currency string, inr_per_unit int")
    per = spark.createDataFrame([("YEARLY", 1), ("MONTHLY", 12), ("WEEKLY", 52), ("DAILY", 260), ("HOURLY", 2080)], "period_code string, per_year int")
    return {r.id: (r.inr_min, r.inr_max) for r in annual_pay(jobs, boards, fx, per).collect()}


def test_text_and_fields(spark):
    cases = [
        (("inr", (None, None, None, None, "Rs. 10,30,000 – 15,40,000/year")), (1030000, 1540000)),
        (("inr", ("INR", 76000.0, 109000.0, "YEARLY", "₹76,000-1,09,000 p.m. plus bonus")), (912000, 1308000)),
        (("inr", (None, 20.0, 24.0, None, "twenty to twenty-four lakh rupees a year + health cover")), (2000000, 2400000)),
        (("inr", (None, None, None, None, "₹1.1 to 1.9 crore")), (11000000, 19000000)),
        (("none", ("EUR", 160000.0, 128000.0, "YEARLY", "128.000 to 160.000 € brutto/Jahr (5+ yrs)")), (11648000, 14560000)),
        (("none", (None, None, None, None, "20 to 23,50 €/Std. + 10% variable")), (20 * 91 * 2080, int(23.5 * 91 * 2080))),
        (("lakh", ("INR", 8.0, 20.0, "YEARLY", "8 – 20")), (800000, 2000000)),
        (("lakh", (None, 3.5, None, None, None)), (350000, 350000)),
        (("k", ("USD", 155.0, 173.0, "YEARLY", None)), (13020000, 14532000)),
        (("hour", (None, 30.0, 40.0, None, None)), (30 * 84 * 2080, 40 * 84 * 2080)),
        (("none", (None, None, None, None, "approx. £375 - 400 per day, 24 days leave")), (375 * 107 * 260, 400 * 107 * 260)),
        (("k", (None, None, None, None, "$112k + 10% variable")), (9408000, 9408000)),
        (("inr", (None, None, None, None, "Grade 7")), None),
        (("inr", (None, None, None, None, "0")), None),
        (("none", (None, None, None, None, "35")), None),
        (("inr", (None, None, None, None, "Competitive")), None),
        (("inr", (None, None, None, None, None)), None),
        (("inr", None), None),
        ((None, ("USD", 10.0, None, "HOURLY", None)), (10 * 84 * 2080, 10 * 84 * 2080)),
        (("inr", ("INR", 500000.0, None, "YEARLY", "words " * 20000)), (500000, 500000)),
        (("nowhere", ("INR", 500000.0, None, "YEARLY", "")), (500000, 500000)),
    ]
    got = pay(spark, [c[0] for c in cases])
    for k, (row, want) in enumerate(cases):
        assert got.get(k) == want, (row, want, got.get(k))


def test_empty(spark):
    assert pay(spark, []) == {}


def test_brackets_commas_and_number_words(spark):
    raws = ["(INR) 12,00,000 per annum", "INR 12,00,000, per annum", "Rs 50,000 (per month)", "12,00,000 INR per annum", "(urgent) 12 LPA (plus bonus)", "usd forty an hour", "forty lakh per annum, 20 days leave"]
    got = pay(spark, [("none", (None, None, None, None, r)) for r in raws])
    assert [got.get(k, (None,))[0] for k in range(len(raws))] == [1200000, 1200000, 600000, 1200000, 1200000, 40 * 84 * 2080, 4000000]


def test_notes_are_read_in_any_wording(spark):
    from pyspark.sql import functions as F

    from sievework.operators.units import noted_units

    notes = ["Numbers mean thousands of euros a year.", "Amounts are monthly.", "By the day or by the week.", "In full.", None, "lakhs, annually"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(notes)], "k int, n string").select("k", noted_units(F.col("n")).alias("u")).orderBy("k").collect()
    assert [r.u and (r.u.period, r.u.scale) for r in rows] == [("YEARLY", 1000.0), ("MONTHLY", None), None, None, None, ("YEARLY", 1e5)]


def test_units_with_offset(spark):
    rows = spark.createDataFrame([(1, "21.5 °C", None, "a"), (2, "about 70", "f", "b"), (3, "-40", None, "b"), (4, "300 K", "c", None), (5, "cold", "c", "a"), (6, None, None, "a"), (7, "5 parsec", None, None), (7, "5 parsec", None, None)], "id int, text string, unit_of string, source string")
    rows = rows.withColumn("factor", rows["id"])  # a clashing name
    aliases = spark.createDataFrame([("°c", "C", 1.0, 0.0), ("c", "C", 1.0, 0.0), ("f", "C", 5 / 9, -160 / 9), ("k", "C", 1.0, -273.15)], "alias string, unit string, factor double, offset double")
    defaults = spark.createDataFrame([("b", "F")], "source string, alias string")
    got = measured(rows.drop("factor"), "text", "unit_of", "source", aliases, defaults).orderBy("id").collect()
    assert [r.value and round(r.value, 2) for r in got] == [21.5, 21.11, -40.0, 26.85, None, None, None, None] and got[0].unit == "C"
    assert measured(rows.drop("factor").limit(0), "text", None, "source", aliases, defaults).count() == 0
