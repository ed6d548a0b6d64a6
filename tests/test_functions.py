import datetime as dt

from pyspark.sql import functions as F

from tallywork.functions import classify as K
from tallywork.functions import cols as C
from tallywork.functions import extract as E
from tallywork.functions import text as T


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return tuple(df.select(*cols).first())


def test_company_city_and_band(spark):
    assert one(spark, C.company_key(F.col("c")), C.company_key(F.lit("")), c="  Mega   Corp ") == ("mega corp", None)
    assert one(spark, C.city_norm(F.lit(" rahim-yar ")), C.city_norm(F.lit("  ")), C.city_norm(F.lit("d'lo"))) == ("Rahim-Yar", None, "D'Lo")
    got = [one(spark, C.experience_band(F.lit(x)))[0] for x in ("Fresh", "international", "1 Year", "3 Years", "6", "10+", None, "some")]
    assert got == ["Entry (0-1 yrs)", "Entry (0-1 yrs)", "Entry (0-1 yrs)", "Junior (2-3 yrs)", "Mid (4-6 yrs)", "Senior (7+ yrs)", "Unspecified", "Unspecified"]


def test_skills_raw_shapes(spark):
    shapes = [None, "[]", '["sql","etl"]', "{}", '{"required_skills_text": "sql, etl"}', "plain text", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(shapes)], "i int, r string")
    rows = df.select("i", C.skills_raw_empty(F.col("r")).alias("e"), C.skills_raw_text(F.col("r")).alias("t")).orderBy("i").collect()
    assert [r.e for r in rows] == [True, True, False, True, False, False, True]
    assert [r.t for r in rows] == ["", "", "sql etl", "", "sql, etl", "plain text", ""]


def test_weeks(spark):
    ts = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, C.pkt_week(ts("2024-01-07 18:59:59")), C.pkt_week(ts("2024-01-07 19:00:00")), C.utc_week(ts("2024-01-07 19:00:00"))) == (dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 1))


def test_matcher_boundaries(spark):
    vocab = [("cpp", ["c++"]), ("r", ["r"]), ("ml", ["machine learning"]), ("ar", ["برمجة"]), ("empty", [])]
    found = lambda x: one(spark, T.matched(T.matching_text(F.lit(x)), vocab))[0]
    assert found("Knows C++. and Machine\n Learning") == ["cpp", "ml"]
    assert found("R, not sqlér or Rust") == ["r"]
    assert found("خبرة في برمجة") == ["ar"]
    assert found("") == []


def test_text_helpers(spark):
    assert one(spark, T.money_range(F.lit("25K - 40K")), T.money_range(F.lit("1.5M")), T.money_range(F.lit("50,000")), T.money_range(F.lit(""))) == ((25000, 40000), (1500000, 1500000), (50000, 50000), (None, None))
    dates = [one(spark, T.posting_date(F.lit(x)))[0] for x in ("2026-07-05T10:00:00Z", "Jul 5, 2026", "July 5, 2026", "2026-07-05", "junk", None)]
    assert dates == [dt.date(2026, 7, 5)] * 4 + [None, None]
    assert one(spark, T.html_to_text(F.lit("a<br>b<ul><li>x</li><li> y &amp; z</li></ul><p> </p>")))[0] == "a\nb\n- x\n- y & z"
    assert one(spark, T.strip_prefixes(F.lit("Senior / Head of: Data Engineer"), ["senior", "head of"]))[0] == "Data Engineer"
    assert one(spark, T.snippet(F.lit("x" * 60 + " needle " + "y" * 60), F.lit("NEEDLE"), 5))[0] == "…xxxx needle yyyy…"
    assert one(spark, T.numerals(F.lit("1,200 of -3.50 and 7.0")))[0] == ["1200", "3.5", "7"]
    assert one(spark, T.names_in(F.lit("The team met Lahore. Karachi won with Python."), ["Python"]))[0] == ["Lahore"]
    assert one(spark, T.resolves_to(F.lit("Karāchi, Sindh"), ["pakistan", "pk"], ["karachi"]), T.resolves_to(F.lit("Dubai, UAE"), ["pakistan", "pk"], ["karachi"])) == (True, False)
    assert one(spark, T.normal_url(F.lit(" //x.y/z")), T.first_place(F.lit("Lahore, PK")), T.first_place(F.lit(" "))) == ("https://x.y/z", "Lahore", None)


def test_classification(spark):
    vocab = [("it", ["python", "sql", "etl", "java"]), ("fin", ["audit", "tax"]), ("other", [])]
    rows = [(1, "Python developer", ""), (2, "Python audit", "sql etl java stack"), (3, "Clerk", "audit python"), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, description string")
    got = {r.id: (r.domain, r.domain_method, r.domain_confidence) for r in K.classify_domains(df, vocab).collect()}
    assert got == {1: ("it", "rule_title", 1.0), 2: ("it", "rule_description", 1.0), 3: ("other", "unclassified", None), 4: ("other", "unclassified", None)}

    def ask(batches):
        for b in batches:
            yield b.assign(said="fin", sure=0.9)[["id", "said", "sure"]]

    got = {r.id: (r.domain, r.domain_method, r.domain_confidence) for r in K.classify_domains(df, vocab, ask).collect()}
    assert got[3] == ("fin", "llm", 0.9) and got[4] == ("fin", "llm_title_only", 0.6)
    fam = [("dev", "it", ["developer"]), ("sales", None, ["sales"]), ("lead", "fin", ["lead"])]
    assert one(spark, K.classify_family(F.lit("Sales developer"), F.lit("it"), fam), K.classify_family(F.lit("team lead"), F.lit("it"), fam)) == (None, "lead")


def test_degrees():
    f = E.degree_level
    assert f("BS degree in Computer Science required") == "bachelors" and f("MS in Economics") == "masters"
    assert f("MS Office and MS Excel") is None and f("you will be part of BA team") is None
    assert f("Fresh graduates welcome") is None and f("must be a graduate in engineering") == "bachelors"
    assert f("Intermediate level Excel") is None and f("Qualifications:\nIntermediate") == "intermediate"
    assert f("Master’s or Bachelor's") == "bachelors" and f("PhD") == "phd" and f("DAE civil") == "diploma" and f("") is None
    assert E.degree_field("Bachelor's degree in Computer   Science, or similar") == "computer science"


def test_years_and_levels():
    y = E.experience_years
    assert y("5-3 years experience", None) == (3, 5) and y("minimum 2 years experience", None) == (2, None)
    assert y("4+ years of experience", None) == (4, None) and y("our company is 20 years old", None) == (None, None)
    assert y("16 years of education", None) == (None, None) and y("x", "3 Years") == (3, 3)
    assert E.experience_level("Senior developer", 1, None) == "senior" and E.experience_level("supporting our very senior staff", 1, 1) == "junior"
    assert E.experience_level("a senior account manager", 1, 1) == "junior" and E.experience_level("You will be reporting to a senior lead", 1, 1) == "junior" and E.experience_level("a senior leadership role", 1, 1) == "senior"
    assert E.experience_level("fresh graduates welcome", None, None) is None and E.experience_level("Fresh  graduate", 4, None) == "fresh" and E.experience_level("entry level", None, None) == "fresh"
    assert E.experience_level("", 4, None) == "mid" and E.experience_level("", None, None) is None and E.experience_level("", 0, 1) == "fresh" and E.experience_level("", None, 2) == "junior" and E.experience_level("", 6, None) == "senior"


def test_structured_udf(spark):
    df = spark.createDataFrame([("BS degree. Minimum 2 years experience. Certification", None), (None, None)], "d string, r string")
    a, b = [r[0] for r in df.select(E.extracted(F.col("d"), F.col("r"))).collect()]
    assert (a.degree_level, a.has_certification, a.experience_min_years, a.experience_level) == ("bachelors", True, 2, "junior")
    assert (b.degree_level, b.has_certification, b.experience_min_years) == (None, False, None)
