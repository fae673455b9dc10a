"""Row features of a posting, one function per family.

Each adds columns from the posting alone, so any selection of families is one
projection over the scan and reads only the fields it needs.  Version 2 is the
default; ``version=1`` switches where the meaning differs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.functions import fixed_values as fixed
from adsift.functions import parsing, text


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def _lower(name: str) -> Column:
    return F.coalesce(F.lower(F.col(name)), F.lit(""))


def _mean_of_bounds(low: str, high: str) -> Column:
    zero = F.lit(0.0)
    return (F.coalesce(F.col(low), zero) + F.coalesce(F.col(high), zero)) / 2


def _category(value: Column, steps, top: str) -> Column:
    named = F.when(value.isNull() | (value == 0), fixed.UNKNOWN_CATEGORY)
    for limit, name in steps:
        named = named.when(value < limit, name)
    return named.otherwise(top)


# --- dates --------------------------------------------------------------------


def fit_date_formats(df: DataFrame, columns=("posted_date", "application_deadline")):
    """Format of each date column, taken from its first value (version 2).

    One pass over the narrow columns.  Where the first value fits no format the
    column keeps them all, that is, each cell is read on its own.
    """
    firsts = df.agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("job_id"))).alias(c) for c in columns])
    fitted = firsts.select(
        *[
            F.coalesce(
                *[
                    F.when(parsing.parse_date(F.col(c), [fmt]).isNotNull(), F.lit(i))
                    for i, fmt in enumerate(parsing.DATE_FORMATS)
                ]
            ).alias(c)
            for c in columns
        ]
    ).first()
    return {
        c: None if fitted[c] is None else [parsing.DATE_FORMATS[fitted[c]]] for c in columns
    }


def _second_of_day(col: Column) -> Column:
    return F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)


def _elapsed_days(start: Column, end: Column) -> Column:
    """Floor of the elapsed days by wall clock, whatever the session zone."""
    short = _second_of_day(end) < _second_of_day(start)
    return F.datediff(end, start) - short.cast("int")


def add_date_features(df: DataFrame, formats: dict | None = None) -> DataFrame:
    formats = formats or {}
    posted, deadline = F.col("_posted"), F.col("_deadline")
    zero = F.lit(0)
    days = F.col("days_to_deadline")
    return (
        df.withColumns(
            {
                "_posted": parsing.parse_date(
                    F.col("posted_date"), formats.get("posted_date")
                ),
                "_deadline": parsing.parse_date(
                    F.col("application_deadline"), formats.get("application_deadline")
                ),
            }
        )
        .withColumns(
            {
                "posted_year": F.coalesce(F.year(posted), zero),
                "posted_month": F.coalesce(F.month(posted), zero),
                "posted_dayofweek": F.coalesce(F.weekday(posted), zero),
                "days_to_deadline": F.coalesce(_elapsed_days(posted, deadline), F.lit(-1)),
            }
        )
        .withColumns({"is_urgent": _flag(days <= 7), "is_long_term": _flag(days > 30)})
        .drop("_posted", "_deadline")
    )


# --- salary, experience, skills -----------------------------------------------


def add_salary_features(df: DataFrame) -> DataFrame:
    return parsing.add_feature_salary(df, "min_salary", "max_salary").withColumn(
        "avg_salary", _mean_of_bounds("min_salary", "max_salary")
    )


def add_salary_category(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "salary_category",
        _category(F.col("avg_salary"), fixed.SALARY_CATEGORIES, fixed.SALARY_TOP_CATEGORY),
    )


def add_experience_features(df: DataFrame) -> DataFrame:
    return parsing.add_experience(df, "min_experience", "max_experience").withColumn(
        "avg_experience", _mean_of_bounds("min_experience", "max_experience")
    )


def add_experience_category(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "experience_category",
        _category(
            F.col("avg_experience"),
            fixed.EXPERIENCE_CATEGORIES,
            fixed.EXPERIENCE_TOP_CATEGORY,
        ),
    )


def skill_column(skill: str) -> str:
    return "has_" + skill.replace(" ", "_")


def add_skill_features(df: DataFrame, skills=fixed.SKILLS) -> DataFrame:
    """Substring flags by skill, number of listed and of known skills."""
    listed = _lower("skills_required")
    parts = F.filter(F.split(listed, ","), lambda part: text.strip(part) != "")
    flags = {skill_column(s): _flag(listed.contains(s)) for s in skills}
    known = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in flags], F.lit(0))
    return df.withColumns({**flags, "total_skills": F.size(parts)}).withColumn(
        "technical_skills_count", known
    )


# --- description --------------------------------------------------------------


def add_clean_text(df: DataFrame) -> DataFrame:
    return text.add_clean_text(df, "job_description", "desc_clean")


def add_keyword_flags(df: DataFrame, version: int = 2) -> DataFrame:
    """Word count and remote / urgent / fee flags.

    Version 2 matches whole words of the cleaned text, version 1 substrings of
    the raw one.
    """
    phrases = {
        "has_remote": fixed.REMOTE_PHRASES,
        "has_urgent": fixed.URGENT_PHRASES,
        "has_fee": fixed.FEE_PHRASES,
    }
    if version == 1:
        raw = _lower("job_description")
        count = text.count_words(F.col("job_description"))
        flags = {c: _flag(text.contains_any(raw, p)) for c, p in phrases.items()}
    else:
        count = text.count_clean_words(F.col("desc_clean"))
        flags = {
            c: _flag(text.has_words(F.col("desc_clean"), p)) for c, p in phrases.items()
        }
    return df.withColumns({"desc_wordcount": count, **flags})


def add_india_signals(df: DataFrame, phrases=fixed.INDIA_SCAM_PHRASES) -> DataFrame:
    clean = F.col("desc_clean")
    company = text.text_of(F.col("company_name"))
    return df.withColumns(
        {
            "india_scam_keyword_count": text.count_phrases(clean, phrases),
            "mentions_whatsapp": _flag(text.has_words(clean, ["whatsapp"])),
            "mentions_gmail_or_free_email": _flag(
                F.col("recruiter_email").rlike(fixed.FREE_EMAIL_PATTERN)
            ),
            "mentions_confidential": _flag(
                text.matches_word(F.lower(company), fixed.CONFIDENTIAL_WORDS)
            ),
            "has_gst_hint": _flag(text.matches_word(F.lower(company), ["gst"])),
        }
    ).withColumn("has_india_scam_kw", _flag(F.col("india_scam_keyword_count") > 0))


def add_fraud_trigger_raw(df: DataFrame) -> DataFrame:
    low, high = fixed.INDEX_SALARY_RANGE
    odd_salary = (F.col("avg_salary") < low) | (F.col("avg_salary") > high)
    short = F.col("desc_wordcount") < fixed.INDEX_SHORT_TEXT_WORDS
    return df.withColumn(
        "fraud_trigger_index_raw",
        F.col("india_scam_keyword_count") * F.lit(fixed.INDEX_KEYWORD_WEIGHT)
        + F.col("has_fee") * F.lit(fixed.INDEX_FEE_WEIGHT)
        + F.col("mentions_whatsapp") * F.lit(fixed.INDEX_WHATSAPP_WEIGHT)
        + _flag(short) * F.lit(fixed.INDEX_SHORT_TEXT_WEIGHT)
        + _flag(odd_salary) * F.lit(fixed.INDEX_SALARY_WEIGHT),
    )


# --- location, company, portal ------------------------------------------------


def add_location_features(df: DataFrame, cities=fixed.MAJOR_CITIES) -> DataFrame:
    place = _lower("job_location")
    multiple = F.col("is_multiple_locations") == 1
    remote = F.col("is_remote_location") == 1
    return df.withColumns(
        {
            "is_multiple_locations": _flag(place.contains("multiple")),
            "is_remote_location": _flag(place.contains("remote")),
            "is_major_city": _flag(text.contains_any(place, cities)),
        }
    ).withColumn(
        "location_category",
        F.when(multiple, "Multiple")
        .when(remote, "Remote")
        .when(F.col("is_major_city") == 1, "Major")
        .otherwise("Other"),
    )


def add_company_features(df: DataFrame) -> DataFrame:
    name = _lower("company_name")
    return df.withColumns(
        {
            "is_premium_company": _flag(text.contains_any(name, fixed.PREMIUM_COMPANIES)),
            "is_established_company": _flag(
                text.contains_any(name, fixed.ESTABLISHED_COMPANIES)
            ),
        }
    ).withColumn(
        "company_tier",
        F.when(F.col("is_premium_company") == 1, "Premium")
        .when(F.col("is_established_company") == 1, "Established")
        .when(text.strip(name).isin(fixed.PRIVATE_NAMES), "Private")
        .otherwise("Other"),
    )


def add_portal_features(df: DataFrame) -> DataFrame:
    portal = _lower("job_portal")
    named = reduce(
        lambda case, item: case.when(portal.contains(item[0]), item[1]),
        fixed.PORTALS.items(),
        F,
    )
    return df.withColumns(
        {
            "is_popular_portal": _flag(text.contains_any(portal, fixed.PORTALS)),
            "portal_category": named.otherwise("Other"),
        }
    )


# --- composites ---------------------------------------------------------------


def add_composites(df: DataFrame) -> DataFrame:
    """Competition, pay per experience, skill demand and attractiveness."""
    zero = F.lit(0.0)
    applicants = F.col("number_of_applicants")
    if dict(df.dtypes)["number_of_applicants"] == "string":
        applicants = parsing.to_number(parsing.ascii_digits(applicants))
    education = F.col("education_level") if "education_level" in df.columns else zero
    days = F.greatest(F.col("days_to_deadline"), F.lit(0))
    return (
        df.withColumn("number_of_applicants", F.coalesce(applicants, zero))
        .withColumns(
            {
                "competition_index": F.col("number_of_applicants") / (days + 1),
                "salary_exp_ratio": F.col("avg_salary") / (F.col("avg_experience") + 1),
                "skill_demand_score": F.col("technical_skills_count") * education,
            }
        )
        .withColumn(
            "job_attractiveness",
            F.col("avg_salary") * 0.3
            + F.col("is_popular_portal") * 10
            + F.col("is_premium_company") * 20
            + (1 / (F.col("competition_index") + 1)) * 30
            + F.col("has_remote") * 15,
        )
    )


def row_features(
    df: DataFrame, version: int = 2, date_formats: dict | None = None
) -> DataFrame:
    """All row features of a posting, still a single projection over the scan."""
    df = add_date_features(df, date_formats)
    df = add_experience_features(add_salary_features(df))
    df = add_skill_features(df)
    if version == 1:
        df = add_experience_category(add_salary_category(df))
        df = add_keyword_flags(df, version=1)
    else:
        df = add_keyword_flags(add_clean_text(df))
        df = add_fraud_trigger_raw(add_india_signals(df))
    df = add_portal_features(add_company_features(add_location_features(df)))
    return add_composites(df)
