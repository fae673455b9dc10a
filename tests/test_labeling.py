from pyspark.sql import functions as F

from adsift.functions import parsing, text
from adsift.operators import labeling
from conftest import column, posting_rows


def test_label_salary(spark):
    cases = {
        "5-8 LPA": (5, 8), "20+ LPA": (20, 40), "12 LPA": (12, 12), "30 - 45 LPA": (30, 45),
        "₹5-8 LPA": (None, None), "5-6-7 LPA": (None, None), "5+-8 LPA": (None, None),
        "INR 500000": (500000, 500000), "3 to 6": (3, 6), "5 8": (58, 58),
        "Negotiable": (None, None), None: (None, None), "५-८ LPA": (5, 8), "5-x LPA": (None, None),
        "-5+ LPA": (-5, -10),
    }
    df = posting_rows(spark, [{"salary_range": s} for s in cases])
    assert column(parsing.add_label_salary(df, "a", "b"), "a", "b") == list(cases.values())


def test_experience_size_domain_applicants(spark):
    years = {"5 - 9 yrs": 5, "2.5 years": 2, "Fresher": None, None: None, "9" * 30: None}
    df = posting_rows(spark, [{"experience_required": s} for s in years])
    assert column(
        df.withColumn("y", parsing.years_of_experience(F.col("experience_required"))), "y"
    ) == list(years.values())

    sizes = {
        "Small (1-50)": "Small", "1-50": "Small", "11-49": "Small", "51-200": "Medium",
        "Medium": "Medium", "50-500": "Large", "500+": "Large", "1000+": "Large",
        "51-500": "Small", "1001-5000": "Small", "150": "Small", "Startup": "Unknown",
        None: "Unknown", "9" * 30: "Large", "49": "Small",
    }
    df = posting_rows(spark, [{"company_size": s} for s in sizes])
    got = df.withColumn("b", parsing.company_size_bucket(F.col("company_size")))
    assert column(got, "b") == list(sizes.values())

    domains = {
        "hr@gmail.com": "gmail.com", " a@YAHOO.com ": "yahoo.com", "\ta@x.y ": "x.y",
        "a@b@rediffmail.com": "rediffmail.com", "no-at-sign": "", None: "",
    }
    df = posting_rows(spark, [{"recruiter_email": s} for s in domains])
    got = df.withColumn("d", parsing.email_domain(F.col("recruiter_email")))
    assert column(got, "d") == list(domains.values())

    numbers = {"12": 12, " 7.5 ": 7.5, "abc": None, "5d": None, "NaN": None, None: None, "1e3": 1000}
    df = posting_rows(spark, [{"number_of_applicants": s} for s in numbers])
    got = df.withColumn("n", parsing.to_number(F.col("number_of_applicants")))
    assert column(got, "n") == list(numbers.values())


def test_blank_separated_words(spark):
    texts = ["a-b c", None, " x y z ", "", "one\x1ctwo"]
    df = posting_rows(spark, [{"job_description": t} for t in texts])
    count = text.count_blank_separated(text.text_of(F.col("job_description")))
    assert column(df.withColumn("n", count), "n") == [2, 1, 3, 0, 2]
    for limit in range(4):
        more = F.coalesce(text.has_more_tokens(F.col("job_description"), limit), F.lit(False))
        expected = [len((t or "").split()) > limit for t in texts]
        assert column(df.withColumn("m", more), "m") == expected


def flags(spark, rows):
    df = labeling.label_postings(posting_rows(spark, rows))
    return column(df, "triggered_rules")


LONG = " ".join(["word"] * 16)
PLAIN = {"company_name": "Infosys", "job_location": "Pune", "job_description": LONG}


def test_rules(spark):
    cases = [
        ({}, "none"),
        ({"recruiter_email": "x@Gmail.com"}, "email_suspicious"),
        ({"job_description": " ".join(["w"] * 15)}, "missing_description"),
        ({"job_description": None}, "missing_description"),
        ({"company_name": "XY"}, "vague_company"),
        ({"company_name": None}, "vague_company"),
        ({"company_name": "Chrome Labs"}, "vague_company"),
        ({"company_name": "Acme Consulting"}, "vague_company"),
        ({"salary_range": "0.3 LPA"}, "salary_unrealistic"),
        ({"salary_range": "61 LPA"}, "salary_unrealistic"),
        ({"job_location": None}, "location_missing"),
        ({"job_location": "India"}, "location_missing"),
        ({"job_location": " India "}, "none"),
        (
            {"job_location": "Multiple", "remote_onsite": "OnSite"},
            "location_multiple_inconsistent",
        ),
        ({"number_of_applicants": "1001"}, "applicants_anomaly"),
        ({"number_of_applicants": "1000"}, "none"),
        ({"company_size": "1-50", "salary_range": "20+ LPA"}, "company_salary_mismatch"),
        ({"company_size": "1-50", "salary_range": "30 LPA"}, "none"),
        ({"job_description": LONG + " APPLY NOW"}, "trigger_keyword"),
        (
            {"recruiter_email": "a@ymail.com", "job_description": LONG + " whatsapp"},
            "email_suspicious,trigger_keyword",
        ),
    ]
    got = flags(spark, [{**PLAIN, **fields} for fields, _ in cases])
    assert got == [expected for _, expected in cases]


def test_existing_flags_count_and_lead_the_trace(spark):
    df = posting_rows(spark, [PLAIN, PLAIN]).withColumn("flag_manual", F.col("job_id") == 1)
    got = labeling.label_postings(df)
    assert column(got, "num_flags", "fake_label", "triggered_rules") == [
        (0, 0, "none"), (1, 1, "manual"),
    ]


def test_min_flags_and_tuned_label(spark):
    rows = [
        {**PLAIN, "recruiter_email": "a@gmail.com", "job_location": None},
        {**PLAIN, "job_description": "short"},
        {**PLAIN, "company_name": "XY"},
        PLAIN,
    ]
    df = labeling.label_postings(posting_rows(spark, rows), min_flags=2)
    assert column(df, "fake_label") == [1, 0, 0, 0]
    assert column(labeling.tune_label(df), "fake_label_tuned") == [1, 0, 1, 0]
    without = df.drop("num_flags")
    assert column(labeling.tune_label(without), "fake_label_tuned") == [1, 0, 1, 0]


def test_statistics(spark):
    rows = [{**PLAIN, "company_name": "XY"}, {**PLAIN, "company_name": "XY"}, PLAIN]
    df = labeling.label_postings(posting_rows(spark, rows))
    counts = [tuple(r) for r in labeling.rule_trigger_counts(df).collect()]
    assert counts[0] == ("flag_vague_company", 2) and len(counts) == 9
    assert counts[1:] == sorted(counts[1:])
    summary = labeling.label_summary(df).first()
    assert summary[:2] == (3, 2) and abs(summary[2] - 200 / 3) < 1e-9
    empty = labeling.label_summary(df.where("false")).first()
    assert tuple(empty) == (0, 0, 0.0)
    spread = labeling.label_distribution(labeling.tune_label(df)).collect()
    assert [tuple(r) for r in spread] == [(1, 2), (0, 1)]
