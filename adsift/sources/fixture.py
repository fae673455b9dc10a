"""A ``job_postings`` view over the supplied ``documents`` table.

Written in SQL that Spark and DuckDB share, so both engines see the same rows.
Every document gives one posting; its whole text is the description.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _pick(values, modulus=None):
    modulus = modulus or len(values)
    cases = " ".join(
        f"WHEN {i} THEN '{value}'" for i, value in enumerate(values) if value is not None
    )
    return f"CASE doc_id % {modulus} {cases} END"


def _day(offset):
    return f"CAST(date '2024-01-01' + CAST({offset} AS INT) AS STRING)"


# --- fixed values: the texts of the fixture ----------------------------------
_TITLES = ["Data Analyst", "Java Developer", "HR Executive", "Field Sales", "SQL Engineer"]
_COMPANIES = [
    "Google India", "Infosys", "Confidential", " NA ", "Acme Consulting",
    "Bluepeak Private Limited", "TCS", "Zoomly (GST 29ABC)", None, "XY",
    "Microsoft", "Wipro", "Orbit Works",
]
_LOCATIONS = [
    "Bangalore", "Multiple Cities", "Remote", "India", None, "Pune, Mumbai",
    "Kochi", "", "New Delhi",
]
_SALARIES = [
    "5-8 LPA", "20+ LPA", "12 LPA", "30 - 45 LPA", "0.3-0.4 LPA", "35+ lpa",
    "INR 500000", "₹5-8 LPA", None, "Negotiable", "3 to 6",
]
_EXPERIENCE = [
    "0-2 years", "3+ years", "5 - 9 yrs", None, "Fresher", "10-15 Years", "2.5 years",
]
_JOB_TYPES = ["Full-Time", "Contract", "Internship", None]
_MODES = ["Onsite", "Remote", "Hybrid"]
_SIZES = [
    "Small (1-50)", "51-200", "50-500", "Large (500+)", "Medium", "1001-5000",
    None, "11-49", "1000+", "Startup",
]
_PORTALS = ["LinkedIn", "Naukri.com", "Indeed", "Company Site", None, "linkedin jobs"]
_EMAILS = [
    "hr@gmail.com", "Jobs@Infosys.com", "x@yahoo.co.in", " a@YAHOO.com ", None,
    "no-at-sign", "a@b@rediffmail.com", "talent@orbit.io",
]
_SKILLS = [
    "Python, SQL,  Excel", "JavaScript, C++", None,
    "Machine Learning, UI/UX, , AWS", "Communication",
]
_MONTHS = ["Jan", "May", "Aug", "Dec"]
_PHRASES = [
    "Registration fee applies. ", "Contact WhatsApp 98765 now! ",
    "Earn Rs. 50k weekly payout, apply through whatsapp. ",
    "Coffee and feedback culture. ", "Urgent hiring, immediate joining. ",
    "Work from home. ", "Mail a.b@c.com or see http://x.example/1. ",
    "Anywhere in India; no interview. ", "", "", "", "",
]

POSTINGS_SQL = f"""
SELECT
  doc_id AS job_id,
  {_pick(_TITLES)} AS job_title,
  {_pick(_COMPANIES)} AS company_name,
  {_pick(_LOCATIONS)} AS job_location,
  {_pick(_SALARIES)} AS salary_range,
  {_pick(_EXPERIENCE)} AS experience_required,
  {_pick(_JOB_TYPES)} AS job_type,
  {_pick(_MODES)} AS remote_onsite,
  {_pick(_SIZES)} AS company_size,
  {_pick(_PORTALS)} AS job_portal,
  {_pick(_EMAILS)} AS recruiter_email,
  CASE doc_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'abc'
       ELSE CAST((doc_id * 37) % 1400 AS STRING) END AS number_of_applicants,
  CASE doc_id % 19 WHEN 1 THEN NULL WHEN 2 THEN 'not a date'
       WHEN 3 THEN CAST(doc_id % 28 + 1 AS STRING) || ' ' || {_pick(_MONTHS)} || ' 2024'
       WHEN 4 THEN replace({_day('doc_id % 200')}, '-', '/')
       ELSE {_day('doc_id % 200')} END AS posted_date,
  CASE doc_id % 23 WHEN 0 THEN NULL
       ELSE {_day('doc_id % 200 + (doc_id * 7) % 50 - 3')} END AS application_deadline,
  {_pick(_SKILLS)} AS skills_required,
  CASE doc_id % 29 WHEN 0 THEN NULL
       ELSE {_pick(_PHRASES)} || text END AS job_description
FROM documents
"""


def job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(POSTINGS_SQL.replace("FROM documents", "FROM {documents}"), documents=documents)
