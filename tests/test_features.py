import random
import re

import pytest
from pyspark.sql import functions as F

from adsift.functions import parsing, text
from adsift.operators import features
from conftest import column, posting_rows


def test_dates(spark):
    rows = [
        ("2024-01-01", None), ("2024-01-01", "2024-02-01"), ("2024-01-01", "2024-01-31"),
        (None, "2024-01-01"), ("junk", "2024-01-05"), ("2024-01-05", "2024-01-01"),
        ("2024-01-01 12:00:00", "2024-01-02"), ("12/25/2024", "2024-12-31"),
        ("25/12/2024", "2024-12-31"), ("5 Mar 2024", "2024-03-12"), ("2024-02-30", "2024-03-12"),
    ]
    df = posting_rows(spark, [{"posted_date": a, "application_deadline": b} for a, b in rows])
    got = column(
        features.add_date_features(df), "posted_year", "posted_month", "posted_dayofweek",
        "days_to_deadline", "is_urgent", "is_long_term",
    )
    assert got == [
        (2024, 1, 0, -1, 1, 0), (2024, 1, 0, 31, 0, 1), (2024, 1, 0, 30, 0, 0),
        (0, 0, 0, -1, 1, 0), (0, 0, 0, -1, 1, 0), (2024, 1, 4, -4, 1, 0),
        (2024, 1, 0, 0, 1, 0), (2024, 12, 2, 6, 1, 0), (2024, 12, 2, 6, 1, 0),
        (2024, 3, 1, 7, 1, 0), (0, 0, 0, -1, 1, 0),
    ]


def test_column_format_is_taken_from_the_first_value(spark):
    rows = [None, "2024-01-03", "01/04/2024"]
    df = posting_rows(spark, [{"posted_date": d, "application_deadline": "x"} for d in rows])
    formats = features.fit_date_formats(df)
    assert formats["application_deadline"] is None
    assert column(features.add_date_features(df, formats), "posted_month") == [0, 1, 0]
    assert column(features.add_date_features(df), "posted_month") == [0, 1, 1]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_elapsed_days_do_not_depend_on_the_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = posting_rows(
            spark, [{"posted_date": "2024-03-09", "application_deadline": "2024-03-11"}]
        )
        assert column(features.add_date_features(df), "days_to_deadline") == [2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_salary_and_experience(spark):
    salaries = {
        "5-8 LPA": (5, 8), "20+ LPA": (20, 20), "₹5-8 LPA": (5, 8), "1,20,000": (1, 20),
        "Negotiable": (None, None), None: (None, None),
    }
    df = posting_rows(spark, [{"salary_range": s} for s in salaries])
    got = features.add_salary_category(features.add_salary_features(df))
    assert column(got, "min_salary", "max_salary") == list(salaries.values())
    assert column(got, "avg_salary") == [6.5, 20, 6.5, 10.5, 0, 0]
    assert column(got, "salary_category") == [
        "Medium", "Very High", "Medium", "Medium", "Unknown", "Unknown",
    ]
    spans = {
        "3+ years": (3, 5), "5 - 9 yrs": (5, 9), "2.5 years": (2.5, 4.5), "Fresher": (None, None),
        None: (None, None),
    }
    df = posting_rows(spark, [{"experience_required": s} for s in spans])
    got = features.add_experience_category(features.add_experience_features(df))
    assert column(got, "min_experience", "max_experience") == list(spans.values())
    assert column(got, "experience_category") == ["Mid", "Senior", "Mid", "Unknown", "Unknown"]


def test_skills(spark):
    rows = ["JavaScript, C++", "Machine Learning, UI/UX, , AWS", None, "excellent"]
    df = features.add_skill_features(posting_rows(spark, [{"skills_required": s} for s in rows]))
    assert column(df, "has_java", "has_c++", "has_python", "has_ui/ux", "has_excel") == [
        (1, 1, 0, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 1),
    ]
    assert column(df, "total_skills", "technical_skills_count") == [(2, 2), (3, 3), (0, 0), (1, 1)]


def clean_by_steps(value):
    if value is None:
        return ""
    value = value.lower()
    for pattern in (r"http\S+|www\S+", r"\S+@\S+", r"\d{4,}", r"\d+", r"[^\w\s]", r"\s+"):
        value = re.sub(pattern, " ", value)
    return value.strip()


def test_clean_text_equals_the_six_steps(spark):
    pieces = [
        "http", "https://x.y/z", "www", "www.a.b", "@", "a@b", "@@", "a@", "@a", "x@@y", "12",
        "12345", "½", "²", "é", "É", "ß", "_", "-", "!", "…", " ", " ", "\n", "\t", " ",
        "  ", "\x1c", "क्या", "१२", "word", "Word", "don't", "́", "İ", "http://a@b", "日本",
    ]
    draw = random.Random(7)
    texts = [None, "", "Earn Rs. 50k!", "Mail a.b@c.com or see http://x.example/1."]
    texts += ["".join(draw.choices(pieces, k=draw.randint(1, 14))) for _ in range(1500)]
    df = posting_rows(spark, [{"job_description": t} for t in texts])
    got = column(features.add_clean_text(df), "desc_clean")
    assert got[2:4] == ["earn rs k", "mail or see"]
    wrong = [(t, g) for t, g in zip(texts, got) if g != clean_by_steps(t)]
    assert not wrong, wrong[:3]
    counted = features.add_clean_text(df).select(
        "job_id", text.count_clean_words(F.col("desc_clean")).alias("n")
    )
    assert column(counted, "n") == [len(re.findall(r"\w+", clean_by_steps(t))) for t in texts]


def test_long_token_is_cleaned_in_linear_time(spark):
    df = posting_rows(spark, [{"job_description": "x" * 2_000_000 + "@"}])
    assert column(features.add_clean_text(df), "desc_clean") == ["x" * 2_000_000]


def test_keyword_flags(spark):
    texts = ["coffee and feedback", "a fee, now", "Work from home", "urgently", "URGENT!", None]
    df = posting_rows(spark, [{"job_description": t} for t in texts])
    second = features.add_keyword_flags(features.add_clean_text(df))
    first = features.add_keyword_flags(df, version=1)
    assert column(second, "has_fee", "has_remote", "has_urgent") == [
        (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0),
    ]
    assert column(first, "has_fee", "has_remote", "has_urgent") == [
        (1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1), (0, 0, 0),
    ]
    raw = posting_rows(spark, [{"job_description": t} for t in ("a-b c", "a1 b2", None)])
    assert column(features.add_keyword_flags(raw, version=1), "desc_wordcount") == [3, 2, 0]
    cleaned = features.add_keyword_flags(features.add_clean_text(raw))
    assert column(cleaned, "desc_wordcount") == [3, 2, 0]


def test_india_signals_and_index(spark):
    rows = [
        {"job_description": "Earn Rs. 50k weekly payout, apply through whatsapp"},
        {"recruiter_email": "x@yahoo.co.in", "company_name": "Bluepeak Private Limited"},
        {"recruiter_email": "a@YAHOO.com", "company_name": "Nagpur Mills"},
        {"recruiter_email": "x@outlook.com", "company_name": "Zoomly (GST 29ABC)"},
        {"salary_range": "20 LPA", "company_name": "gst29"},
    ]
    df = features.add_salary_features(features.add_clean_text(posting_rows(spark, rows)))
    df = features.add_fraud_trigger_raw(features.add_india_signals(features.add_keyword_flags(df)))
    assert column(
        df, "india_scam_keyword_count", "has_india_scam_kw", "mentions_whatsapp",
        "mentions_gmail_or_free_email", "mentions_confidential", "has_gst_hint",
    ) == [
        (3, 1, 1, 0, 0, 0), (0, 0, 0, 1, 1, 0), (0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 1),
        (0, 0, 0, 0, 0, 0),
    ]
    got = column(df, "fraud_trigger_index_raw")
    assert got == pytest.approx([1.55, 0.2, 0.2, 0.2, 0.1])


def test_places_companies_portals(spark):
    rows = [
        {"company_name": "Google India", "job_location": "Multiple remote", "job_portal": "LinkedIn"},
        {"company_name": "Infosys", "job_location": "Remote, Pune", "job_portal": "Naukri.com"},
        {"company_name": None, "job_location": "New Delhi", "job_portal": "indeed jobs"},
        {"company_name": " NA ", "job_location": None, "job_portal": None},
        {"company_name": "Orbit Works", "job_location": "Kochi", "job_portal": "own site"},
    ]
    df = posting_rows(spark, rows)
    df = features.add_portal_features(
        features.add_company_features(features.add_location_features(df))
    )
    assert column(df, "location_category", "company_tier", "portal_category") == [
        ("Multiple", "Premium", "LinkedIn"), ("Remote", "Established", "Naukri"),
        ("Major", "Private", "Indeed"), ("Other", "Private", "Other"), ("Other", "Other", "Other"),
    ]
    assert column(df, "is_popular_portal") == [1, 1, 1, 0, 0]
    assert column(df, "is_major_city", "is_remote_location")[1] == (1, 1)


def test_composites(spark):
    rows = [{"number_of_applicants": "10"}, {"number_of_applicants": "abc"}]
    df = features.row_features(posting_rows(spark, rows))
    assert column(df, "competition_index", "salary_exp_ratio", "skill_demand_score") == [
        (10.0, 0.0, 0.0), (0.0, 0.0, 0.0),
    ]
    assert column(df, "job_attractiveness")[1] == 30.0
    taught = posting_rows(spark, [{"skills_required": "sql, java"}]).withColumn(
        "education_level", F.lit(3.0)
    )
    assert column(features.row_features(taught), "skill_demand_score") == [6.0]


def test_row_features_compute_the_cleaned_text_once(spark):
    df = features.row_features(posting_rows(spark, [{}])).drop("desc_clean")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_replace") <= 9


def test_digits_of_other_scripts(spark):
    df = posting_rows(spark, [{"salary_range": "१२ LPA"}])
    got = df.withColumn("d", parsing.ascii_digits(F.col("salary_range")))
    assert column(got, "d") == ["12 LPA"]


@pytest.mark.parametrize(
    "text",
    ["2024-01-05", "2024-01-05 10:20:30", "2024-01-05T10:20:30.123", "2024-01-05T10:20:30Z",
     "2024-01-05 10:20:30+05:30", "2024-01-05 10:20:30.5", "05-Jan-2024", "Jan 5 2024", "20240105", "2024-1-5",
     "January 5 2024", "5 Jan 2024", "2024/01/05", "Jan 5, 2024"],
)
def test_date_forms(spark, text):
    df = posting_rows(spark, [{"posted_date": text}])
    names = "posted_year", "posted_month", "posted_dayofweek"
    assert column(features.add_date_features(df), *names) == [(2024, 1, 4)]


def test_constants_against_golden_texts(spark):
    """Literal cases, so that a constant changed by mistake shows without the oracle."""
    rows = [
        ({"job_description": "Earn Rs. 50k weekly payout, apply through whatsapp. "}, 3),
        ({"job_description": "Coffee and feedback culture."}, 0),
    ]
    df = features.add_clean_text(posting_rows(spark, [r for r, _ in rows]))
    got = features.add_india_signals(df)
    assert column(got, "india_scam_keyword_count") == [n for _, n in rows]
    assert column(df, "desc_clean")[0] == "earn rs k weekly payout apply through whatsapp"
    mails = ["x@yahoo.co.in", "a@YAHOO.com", "x@outlook.com"]
    got = features.add_india_signals(
        features.add_clean_text(posting_rows(spark, [{"recruiter_email": m} for m in mails]))
    )
    assert column(got, "mentions_gmail_or_free_email") == [1, 0, 0]
