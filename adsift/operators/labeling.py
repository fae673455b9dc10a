"""Weak labels: derived fields, nine rule flags, label, trace and statistics.

Everything up to the statistics is row-local: one projection over the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.functions import fixed_values as fixed
from adsift.functions import parsing, text

FLAG_PREFIX = "flag_"


def derive_fields(df: DataFrame) -> DataFrame:
    """Salary bounds, experience, word count, size bucket, domain, applicants."""
    df = parsing.add_label_salary(df, "salary_lower_lpa", "salary_upper_lpa")
    return df.withColumns(
        {
            "exp_years": parsing.years_of_experience(F.col("experience_required")),
            "desc_wordcount_ws": text.count_blank_separated(
                text.text_of(F.col("job_description"))
            ),
            "company_size_bucket": parsing.company_size_bucket(F.col("company_size")),
            "email_domain": parsing.email_domain(F.col("recruiter_email")),
            "number_of_applicants": parsing.to_number(
                parsing.ascii_digits(F.col("number_of_applicants").cast("string"))
            ),
        }
    )


def rule_flags(
    df: DataFrame,
    desc_threshold: int = fixed.DESC_THRESHOLD,
    email_domains=fixed.SUSPICIOUS_EMAIL_DOMAINS,
    vague_keywords=fixed.VAGUE_COMPANY_KEYWORDS,
    trigger_keywords=fixed.TRIGGER_KEYWORDS,
) -> DataFrame:
    """The nine flags, from the derived fields."""
    description = F.col("job_description")
    company = F.lower(text.text_of(F.col("company_name")))
    location = F.lower(F.col("job_location"))
    lower, upper = F.col("salary_lower_lpa"), F.col("salary_upper_lpa")
    predicates = {
        "email_suspicious": F.col("email_domain").isin(list(email_domains)),
        "missing_description": description.isNull()
        | ~text.has_more_tokens(description, desc_threshold),
        "vague_company": text.contains_any(company, vague_keywords)
        | (F.length(text.strip(company)) < 3),
        "salary_unrealistic": (lower < fixed.MIN_LOWER_LPA)
        | (upper > fixed.MAX_UPPER_LPA),
        "location_missing": location.isNull() | location.isin(fixed.MISSING_LOCATIONS),
        "location_multiple_inconsistent": location.contains("multiple")
        & F.lower(F.col("remote_onsite")).contains("onsite"),
        "applicants_anomaly": F.col("number_of_applicants") > fixed.MAX_APPLICANTS,
        "company_salary_mismatch": (F.col("company_size_bucket") == "Small")
        & (upper > fixed.SMALL_COMPANY_MAX_LPA),
        "trigger_keyword": text.contains_any(F.lower(description), trigger_keywords),
    }
    return df.withColumns(
        {
            FLAG_PREFIX + rule: F.coalesce(predicates[rule], F.lit(False))
            for rule in fixed.RULES
        }
    )


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(FLAG_PREFIX)]


def _count_flags(df: DataFrame) -> Column:
    ones = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flag_columns(df)]
    return reduce(lambda a, b: a + b, ones, F.lit(0))


def fold_flags(df: DataFrame, min_flags: int = fixed.MIN_FLAGS) -> DataFrame:
    """Flag count, weak label and rule trace over every flag of the table."""
    names = [
        F.when(F.col(c).cast("boolean"), F.lit(c.replace(FLAG_PREFIX, "")))
        for c in flag_columns(df)
    ]
    trace = F.concat_ws(",", *names)
    counted = df.withColumn("num_flags", _count_flags(df))
    return counted.withColumns(
        {
            "fake_label": (F.col("num_flags") >= min_flags).cast("int"),
            "triggered_rules": F.when(trace == "", "none").otherwise(trace),
        }
    )


def label_postings(
    df: DataFrame,
    desc_threshold: int = fixed.DESC_THRESHOLD,
    min_flags: int = fixed.MIN_FLAGS,
) -> DataFrame:
    return fold_flags(rule_flags(derive_fields(df), desc_threshold), min_flags)


def tune_label(df: DataFrame) -> DataFrame:
    """Second, stricter label: a short description alone is no fraud."""
    if "num_flags" not in df.columns:
        df = df.withColumn("num_flags", _count_flags(df))
    trace = F.coalesce(F.col("triggered_rules"), F.lit(fixed.MISSING_TEXT))
    rules = F.filter(
        F.transform(F.split(trace, ","), text.strip), lambda rule: rule != ""
    )
    only_short = (F.size(rules) == 1) & (F.get(rules, F.lit(0)) == "missing_description")
    tuned = (
        F.when(F.col("num_flags") >= 2, 1)
        .when(F.col("num_flags") == 1, F.when(only_short, 0).otherwise(1))
        .otherwise(0)
    )
    return df.withColumn("fake_label_tuned", tuned)


def use_tuned_label(df: DataFrame) -> DataFrame:
    """Let the features carry the tuned label as ``fake_label``."""
    return df.drop("fake_label").withColumnRenamed("fake_label_tuned", "fake_label")


def compact_labelled(df: DataFrame) -> DataFrame:
    wanted = [*fixed.COMPACT_COLUMNS, "fake_label", "triggered_rules"]
    return df.select(*[c for c in wanted if c in df.columns])


def compact_tuned(df: DataFrame) -> DataFrame:
    wanted = [*fixed.COMPACT_COLUMNS, "fake_label_tuned", "triggered_rules", "num_flags"]
    return df.select(*[c for c in wanted if c in df.columns])


def rule_trigger_counts(df: DataFrame) -> DataFrame:
    """How often each rule fired, most frequent first; a single pass."""
    flags = flag_columns(df)
    totals = df.agg(
        *[F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(c) for c in flags]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("rule"), F.col(c).alias("count")) for c in flags]
    )
    return totals.select(F.inline(rows)).orderBy(F.desc("count"), "rule")


def label_summary(df: DataFrame, label: str = "fake_label") -> DataFrame:
    total, flagged = F.col("total_rows"), F.col("flagged_rows")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.sum(label), F.lit(0)).alias("flagged_rows"),
    ).withColumn(
        "flagged_percent", F.lit(100.0) * flagged / F.greatest(total, F.lit(1))
    )


def label_distribution(df: DataFrame, label: str = "fake_label_tuned") -> DataFrame:
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), label)
    )
