"""Equivalent DuckDB SQL for the registered queries, written independently.

Each statement is a chain of common table expressions over the supplied tables.
"""

from __future__ import annotations

import math

from adsift.functions import fixed_values as fixed
from adsift.sources.fixture import POSTINGS_SQL

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
TOKEN = rf"[^{SPACE}]+"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
NUMBER = r"[0-9]+\.?[0-9]*"
WHOLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _listed(values) -> str:
    return ", ".join(_quote(v) for v in values)


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quote(p)})" for p in phrases) + ")"


def _count(column: str, phrases) -> str:
    return " + ".join(f"CAST(contains({column}, {_quote(p)}) AS INT)" for p in phrases)


def _words(column: str, phrases) -> str:
    pattern = f"(^|{NOT_WORD})({'|'.join(phrases)})($|{NOT_WORD})"
    return f"coalesce(CAST(regexp_matches({column}, '{pattern}') AS INT), 0)"


def _number(column: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({column}), '{WHOLE}') "
        f"THEN TRY_CAST(trim({column}) AS DOUBLE) END"
    )


def _flag(condition: str) -> str:
    return f"coalesce(CAST(({condition}) AS INT), 0)"


def _chain(select: str, *steps: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n" + select


_TEXT_COLUMNS = [c for c in fixed.SOURCE_COLUMNS.values() if c != "job_id"]

RAW = f"raw AS ({POSTINGS_SQL})"
P = "p AS (SELECT job_id, " + ", ".join(
    f"CASE WHEN {c} NOT IN ({_listed(fixed.NULL_TOKENS)}) THEN {c} END AS {c}"
    for c in _TEXT_COLUMNS
) + " FROM raw)"
BASE = (RAW, P)

REPEATED = """rep AS (SELECT * EXCLUDE (t) FROM (
  SELECT *, unnest(range(0, greatest(job_id % 5 - 1, 1))) AS t FROM p))"""

# --- labels -----------------------------------------------------------------------

SALARY_TEXT = """sal AS (SELECT *, replace(lower(salary_range), ' ', '') AS s,
  replace(replace(lower(salary_range), ' ', ''), 'lpa', '') AS a FROM p)"""
_END_1 = _number("string_split(a, '-')[1]")
_END_2 = _number("string_split(a, '-')[2]")
_OPEN = _number("replace(a, '+', '')")
_PAIR = f"len(string_split(a, '-')) = 2 AND ({_END_1}) IS NOT NULL AND ({_END_2}) IS NOT NULL"
_FREE = f"regexp_extract_all(s, '{NUMBER}')"


def _salary_end(free: str, opened: str, end: str) -> str:
    return f"""CASE WHEN s IS NULL THEN NULL
      WHEN NOT contains(s, 'lpa') THEN {free}
      WHEN contains(a, '+') THEN {opened}
      WHEN contains(a, '-') THEN CASE WHEN {_PAIR} THEN {end} END
      ELSE {_number('a')} END"""


_FIRST = f"TRY_CAST({_FREE}[1] AS DOUBLE)"
_LOWER = _salary_end(_FIRST, f"({_OPEN})", _END_1)
_UPPER = _salary_end(
    f"coalesce(TRY_CAST({_FREE}[2] AS DOUBLE), {_FIRST})", f"({_OPEN}) * 2", _END_2
)
_DIGITS = "regexp_extract(lower(coalesce(company_size, 'nan')), '[0-9]+')"
_SIZE_TEXT = "lower(coalesce(company_size, 'nan'))"
_BUCKET = f"""CASE
    WHEN {_SIZE_TEXT} LIKE '%small%' OR ({_SIZE_TEXT} LIKE '%1%' AND {_SIZE_TEXT} LIKE '%50%')
      THEN 'Small'
    WHEN {_SIZE_TEXT} LIKE '%large%' OR {_SIZE_TEXT} LIKE '%500%' THEN 'Large'
    WHEN {_SIZE_TEXT} LIKE '%medium%' THEN 'Medium'
    WHEN {_DIGITS} = '' THEN 'Unknown'
    WHEN TRY_CAST({_DIGITS} AS BIGINT) <= 50 THEN 'Small'
    WHEN TRY_CAST({_DIGITS} AS BIGINT) <= 500 THEN 'Medium'
    ELSE 'Large' END"""
_MAIL = "lower(trim(coalesce(recruiter_email, 'nan')))"
_DOMAIN = (
    f"CASE WHEN contains({_MAIL}, '@') THEN string_split({_MAIL}, '@')[-1] ELSE '' END"
)
_YEARS = "TRY_CAST(nullif(regexp_extract(experience_required, '[0-9]+'), '') AS BIGINT)"
_BLANK_WORDS = f"CAST(len(regexp_extract_all(coalesce(job_description, 'nan'), '{TOKEN}')) AS INT)"

DERIVED = f"""d AS (SELECT * REPLACE ({_number('number_of_applicants')} AS number_of_applicants),
  {_LOWER} AS salary_lower_lpa, {_UPPER} AS salary_upper_lpa, {_YEARS} AS exp_years,
  {_BLANK_WORDS} AS desc_wordcount_ws, {_BUCKET} AS company_size_bucket,
  {_DOMAIN} AS email_domain FROM sal)"""

_COMPANY = "lower(coalesce(company_name, 'nan'))"
_RULE_SQL = {
    "email_suspicious": f"email_domain IN ({_listed(fixed.SUSPICIOUS_EMAIL_DOMAINS)})",
    "missing_description": "job_description IS NULL OR desc_wordcount_ws <= 15",
    "vague_company": _any(_COMPANY, fixed.VAGUE_COMPANY_KEYWORDS)
    + f" OR length(trim({_COMPANY})) < 3",
    "salary_unrealistic": "coalesce(salary_lower_lpa < 0.5, false)"
    " OR coalesce(salary_upper_lpa > 60, false)",
    "location_missing": "job_location IS NULL"
    " OR lower(job_location) IN ('', 'nan', 'none', 'india')",
    "location_multiple_inconsistent": "coalesce(lower(job_location) LIKE '%multiple%', false)"
    " AND coalesce(lower(remote_onsite) LIKE '%onsite%', false)",
    "applicants_anomaly": "coalesce(number_of_applicants > 1000, false)",
    "company_salary_mismatch": "company_size_bucket = 'Small'"
    " AND coalesce(salary_upper_lpa > 30, false)",
    "trigger_keyword": f"coalesce({_any('lower(job_description)', fixed.TRIGGER_KEYWORDS)}, false)",
}
FLAGS = "f AS (SELECT *, " + ", ".join(
    f"({_RULE_SQL[r]}) AS flag_{r}" for r in fixed.RULES
) + " FROM d)"
_SUM = " + ".join(f"CAST(flag_{r} AS INT)" for r in fixed.RULES)
_TRACE = "concat_ws(',', " + ", ".join(
    f"CASE WHEN flag_{r} THEN '{r}' END" for r in fixed.RULES
) + ")"
LABELS = f"""l AS (SELECT *, {_SUM} AS num_flags, CAST({_SUM} >= 1 AS INT) AS fake_label,
  coalesce(nullif({_TRACE}, ''), 'none') AS triggered_rules,
  CASE WHEN {_SUM} >= 2 THEN 1 WHEN {_SUM} = 1 AND NOT flag_missing_description THEN 1
       ELSE 0 END AS fake_label_tuned FROM f)"""
TO_LABELS = (*BASE, SALARY_TEXT, DERIVED, FLAGS, LABELS)
_COMPACT = ", ".join(fixed.COMPACT_COLUMNS)

# --- row features -----------------------------------------------------------------

_NUMS = (
    f"regexp_extract_all(replace(replace(replace(lower(salary_range), 'lpa', ''), 'inr', ''),"
    f" '₹', ''), '{NUMBER}')"
)
_EXPS = f"regexp_extract_all(experience_required, '{NUMBER}')"
_CLEAN_STEPS = [
    rf"http[^{SPACE}]+|www[^{SPACE}]+",
    rf"[^{SPACE}]+@[^{SPACE}]+",
    r"\p{Nd}{4,}",
    r"\p{Nd}+",
    rf"[^\p{{L}}\p{{N}}_{SPACE}]",
    rf"[{SPACE}]+",
]
_CLEAN = "lower(coalesce(job_description, ''))"
for _step in _CLEAN_STEPS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_step}', ' ', 'g')"
_CLEAN = f"trim({_CLEAN})"


def _category(value: str, steps, top: str) -> str:
    cases = " ".join(f"WHEN {value} < {limit} THEN '{name}'" for limit, name in steps)
    return f"CASE WHEN {value} = 0 THEN 'Unknown' {cases} ELSE '{top}' END"


_PLACE = "lower(coalesce(job_location, ''))"
_NAME = "lower(coalesce(company_name, ''))"
_PORTAL = "lower(coalesce(job_portal, ''))"
_SKILLS = "lower(coalesce(skills_required, ''))"
_SKILL_NAMES = {s: "has_" + s.replace(" ", "_") for s in fixed.SKILLS}

# Version 2 reads a column by one format, which its first value sets: ISO dates here.
_ISO_DATE = """CASE WHEN regexp_matches(posted_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
    THEN TRY_CAST(posted_date AS DATE) END"""

# Dates, numbers and categories of one posting.
FIELDS = f"""x AS (SELECT *,
  {_ISO_DATE} AS posted, TRY_CAST(application_deadline AS DATE) AS deadline,
  TRY_CAST({_NUMS}[1] AS DOUBLE) AS min_salary,
  TRY_CAST(coalesce({_NUMS}[2], {_NUMS}[1]) AS DOUBLE) AS max_salary,
  TRY_CAST({_EXPS}[1] AS DOUBLE) AS min_experience,
  coalesce(TRY_CAST({_EXPS}[2] AS DOUBLE), TRY_CAST({_EXPS}[1] AS DOUBLE) + 2) AS max_experience,
  {', '.join(f'{_flag(f"contains({_SKILLS}, {_quote(s)})")} AS "{n}"' for s, n in _SKILL_NAMES.items())},
  CAST(len(list_filter(string_split({_SKILLS}, ','), lambda t: trim(t) <> '')) AS INT)
    AS total_skills,
  {_flag(f"contains({_PLACE}, 'multiple')")} AS is_multiple_locations,
  {_flag(f"contains({_PLACE}, 'remote')")} AS is_remote_location,
  {_flag(_any(_PLACE, fixed.MAJOR_CITIES))} AS is_major_city,
  CASE WHEN contains({_PLACE}, 'multiple') THEN 'Multiple'
       WHEN contains({_PLACE}, 'remote') THEN 'Remote'
       WHEN {_any(_PLACE, fixed.MAJOR_CITIES)} THEN 'Major' ELSE 'Other' END AS location_category,
  {_flag(_any(_NAME, fixed.PREMIUM_COMPANIES))} AS is_premium_company,
  {_flag(_any(_NAME, fixed.ESTABLISHED_COMPANIES))} AS is_established_company,
  CASE WHEN {_any(_NAME, fixed.PREMIUM_COMPANIES)} THEN 'Premium'
       WHEN {_any(_NAME, fixed.ESTABLISHED_COMPANIES)} THEN 'Established'
       WHEN trim({_NAME}) IN ({_listed(fixed.PRIVATE_NAMES)}) THEN 'Private'
       ELSE 'Other' END AS company_tier,
  {_flag(_any(_PORTAL, fixed.PORTALS))} AS is_popular_portal,
  CASE WHEN contains({_PORTAL}, 'linkedin') THEN 'LinkedIn'
       WHEN contains({_PORTAL}, 'naukri') THEN 'Naukri'
       WHEN contains({_PORTAL}, 'indeed') THEN 'Indeed' ELSE 'Other' END AS portal_category
  FROM {{source}})"""

MORE_FIELDS = f"""y AS (SELECT *,
  coalesce(year(posted), 0) AS posted_year, coalesce(month(posted), 0) AS posted_month,
  coalesce(isodow(posted) - 1, 0) AS posted_dayofweek,
  coalesce(date_diff('day', posted, deadline), -1) AS days_to_deadline,
  (coalesce(min_salary, 0e0) + coalesce(max_salary, 0e0)) / 2 AS avg_salary,
  (coalesce(min_experience, 0e0) + coalesce(max_experience, 0e0)) / 2 AS avg_experience,
  {' + '.join(f'"{n}"' for n in _SKILL_NAMES.values())} AS technical_skills_count FROM x)"""

CATEGORIES = f"""z AS (SELECT *, CAST(days_to_deadline <= 7 AS INT) AS is_urgent,
  CAST(days_to_deadline > 30 AS INT) AS is_long_term,
  {_category('avg_salary', fixed.SALARY_CATEGORIES, fixed.SALARY_TOP_CATEGORY)}
    AS salary_category,
  {_category('avg_experience', fixed.EXPERIENCE_CATEGORIES, fixed.EXPERIENCE_TOP_CATEGORY)}
    AS experience_category FROM y)"""

CLEANED = f"c AS (SELECT *, {_CLEAN} AS desc_clean FROM {{source}})"

_WORDS_OF_CLEAN = f"CAST(len(regexp_extract_all(desc_clean, '{WORD}+')) AS INT)"
_KEYWORDS = f"""{_WORDS_OF_CLEAN} AS desc_wordcount,
  {_words('desc_clean', fixed.REMOTE_PHRASES)} AS has_remote,
  {_words('desc_clean', fixed.URGENT_PHRASES)} AS has_urgent,
  {_words('desc_clean', fixed.FEE_PHRASES)} AS has_fee"""
_RAW_TEXT = "lower(coalesce(job_description, ''))"
_KEYWORDS_V1 = f"""CAST(len(regexp_extract_all(coalesce(job_description, ''), '{WORD}+')) AS INT)
    AS desc_wordcount,
  CAST({_any(_RAW_TEXT, fixed.REMOTE_PHRASES)} AS INT) AS has_remote,
  CAST({_any(_RAW_TEXT, fixed.URGENT_PHRASES)} AS INT) AS has_urgent,
  CAST({_any(_RAW_TEXT, fixed.FEE_PHRASES)} AS INT) AS has_fee"""
_INDIA = f"""{_count('desc_clean', fixed.INDIA_SCAM_PHRASES)} AS india_scam_keyword_count,
  CAST(({_count('desc_clean', fixed.INDIA_SCAM_PHRASES)}) > 0 AS INT) AS has_india_scam_kw,
  {_words('desc_clean', ['whatsapp'])} AS mentions_whatsapp,
  {_flag(f"regexp_matches(recruiter_email, '{fixed.FREE_EMAIL_PATTERN}')")}
    AS mentions_gmail_or_free_email,
  {_words(_COMPANY, fixed.CONFIDENTIAL_WORDS)} AS mentions_confidential,
  {_words(_COMPANY, ['gst'])} AS has_gst_hint"""

SIGNALS = f"k AS (SELECT *, {_KEYWORDS}, {_INDIA} FROM c)"

COMPOSITES = f"""q AS (SELECT * REPLACE (applicants AS number_of_applicants),
    avg_salary / (avg_experience + 1) AS salary_exp_ratio,
    technical_skills_count * 0e0 AS skill_demand_score,
    avg_salary * 0.3e0 + is_popular_portal * 10 + is_premium_company * 20
      + (1 / (competition_index + 1)) * 30 + has_remote * 15 AS job_attractiveness,
    india_scam_keyword_count * 0.4e0 + has_fee * 0.25e0 + mentions_whatsapp * 0.15e0
      + CAST(desc_wordcount < 15 AS INT) * 0.1e0
      + CAST(avg_salary < 1 OR avg_salary > 50 AS INT) * 0.1e0 AS fraud_trigger_index_raw
  FROM (SELECT *, applicants / (greatest(days_to_deadline, 0) + 1) AS competition_index
    FROM (SELECT *, {{applicants}} AS applicants FROM k)))"""


def _features(source: str = "p", applicants: str | None = None) -> tuple[str, ...]:
    """Steps from postings (or labelled postings) to all row features, as ``q``."""
    number = applicants or f"coalesce({_number('number_of_applicants')}, 0e0)"
    return (
        FIELDS.replace("{source}", source),
        MORE_FIELDS,
        CATEGORIES,
        CLEANED.replace("{source}", "z"),
        SIGNALS,
        COMPOSITES.replace("{applicants}", number),
    )


FEATURES = (*BASE, *_features())
LABEL_FEATURES = (*TO_LABELS, *_features("l", "coalesce(number_of_applicants, 0e0)"))
FIELD_STEPS = (*BASE, FIELDS.replace("{source}", "p"), MORE_FIELDS, CATEGORIES)
CLEAN_STEPS = (*BASE, CLEANED.replace("{source}", "p"))

# Each cell by its own format: those that the fixture has.
_ANY_DATE = """coalesce(TRY_CAST(posted_date AS DATE),
    CAST(try_strptime(posted_date, '%d %b %Y') AS DATE),
    CAST(try_strptime(posted_date, '%Y/%m/%d') AS DATE))"""
_DATES = (
    "job_id, posted_year, posted_month, posted_dayofweek, days_to_deadline, is_urgent,"
    " is_long_term"
)
_INDEX = """CASE WHEN max(fraud_trigger_index_raw) OVER () > 0
    THEN round_even(fraud_trigger_index_raw / max(fraud_trigger_index_raw) OVER () * 10000, 0)
      / 10000
    ELSE round_even(fraud_trigger_index_raw * 10000, 0) / 10000 END"""


def _code(column: str) -> str:
    value = f"coalesce({column}, 'Unknown')"
    return f"CAST(dense_rank() OVER (ORDER BY {value}) - 1 AS INT) AS {column}_enc"


_CODES = ", ".join(_code(c) for c in fixed.ENCODED_COLUMNS)
_CODES_V1 = ", ".join(_code(c) for c in fixed.ENCODED_COLUMNS_V1)
_SCALED = [c for c in fixed.SCALED_COLUMNS if c != "education_level"]


def _scaled(column: str) -> str:
    value = f"coalesce(CAST({column} AS DOUBLE), 0e0)"
    spread = f"stddev_pop({value}) OVER ()"
    return (
        f"round(({value} - avg({value}) OVER ()) / CASE WHEN {spread} > 0 THEN {spread}"
        f" ELSE 1 END, 6) AS {column}_scaled"
    )


_SCALES = ", ".join(_scaled(c) for c in _SCALED)

# --- text model -------------------------------------------------------------------

WORDS = rf"""w AS (SELECT job_id,
  regexp_extract_all(strip_accents(desc_clean), '{WORD}{{2,}}') AS words FROM c)"""
WORDS_V1 = rf"""w AS (SELECT job_id,
  regexp_extract_all(lower(coalesce(job_description, '')), '{WORD}{{2,}}') AS words FROM p)"""
PAIRS = """g AS (SELECT job_id, words,
  list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs
  FROM w)"""
TERMS = """t AS (SELECT job_id, term, count(*) AS n FROM (
    SELECT job_id, unnest(list_concat(words, pairs)) AS term FROM g) GROUP BY ALL)"""
VOCABULARY = f"""v AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS term_id,
  df, tf FROM (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM t GROUP BY term
    HAVING count(*) >= {fixed.MIN_DF} ORDER BY tf DESC, term LIMIT {fixed.MAX_FEATURES}))"""
WEIGHTS = """tw AS (SELECT job_id, term_id,
    weight / sqrt(sum(weight * weight) OVER (PARTITION BY job_id)) AS weight
  FROM (SELECT job_id, term_id,
    n * (ln((1 + (SELECT count(*) FROM p)) / (1e0 + df)) + 1) AS weight FROM t JOIN v USING (term)))"""
TEXT_STEPS = (*CLEAN_STEPS, WORDS, PAIRS, TERMS, VOCABULARY)
_TOKENS = """SELECT job_id, term, count(*) AS n FROM (
  SELECT job_id, unnest(list_concat(words, pairs)) AS term FROM g) GROUP BY ALL"""

# --- split and evaluation ---------------------------------------------------------

LABEL_ROWS = "lr AS (SELECT job_id, fake_label_tuned AS label FROM l)"
QUOTAS = f"""cls AS (SELECT label, count(*) AS n FROM lr GROUP BY label),
share AS (SELECT label, n, ceil({fixed.TEST_SIZE}e0 * sum(n) OVER ()) AS wanted,
  ceil({fixed.TEST_SIZE}e0 * sum(n) OVER ()) * n / CAST(sum(n) OVER () AS DOUBLE) AS exact
  FROM cls),
quota AS (SELECT label, floor(exact) + CASE WHEN
    row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
      <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM share)"""
DRAWN = f"""drawn AS (SELECT lr.*, row_number() OVER (PARTITION BY label
    ORDER BY md5(CAST(job_id AS VARCHAR) || ':{fixed.SEED}'), job_id) AS place FROM lr)"""

# Rows that lr_balance fits on.
FIT_ROWS = 300
# Rows that the other model queries fit on: the whole training part.
TRAINED_ON = "fit AS (SELECT job_id, label FROM drawn JOIN quota USING (label) WHERE place > quota)"

# The chance of a Poisson number below 0, 1, 2 ... with mean 1; what a bootstrap draws.
_POISSON = ", ".join(
    f"({sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r}e0)" for k in range(15)
)

SCORES = """sc AS (
  SELECT job_id, fake_label_tuned AS label, 'TriggerIndex' AS model,
    round(fraud_trigger_index_raw, 4) AS score FROM q
  UNION ALL
  SELECT job_id, fake_label_tuned, 'Competition', round(1 / (competition_index + 1), 4) FROM q)"""
CURVE = """cv AS (SELECT model, score, n_pos, n_neg,
    sum(n_pos) OVER above AS tp, sum(n_neg) OVER above AS fp,
    sum(n_pos) OVER (PARTITION BY model) AS pos, sum(n_neg) OVER (PARTITION BY model) AS neg
  FROM (SELECT model, score, count(*) FILTER (label = 1) AS n_pos,
          count(*) FILTER (label <> 1) AS n_neg FROM sc GROUP BY model, score)
  WINDOW above AS (PARTITION BY model ORDER BY score DESC)),
pr AS (SELECT *, tp / (tp + fp) AS prec,
    CASE WHEN pos = 0 THEN 1e0 ELSE tp / pos END AS rec FROM cv),
fs AS (SELECT *, 2 * (prec * rec) / (prec + rec + 1e-12) AS f1 FROM pr),
best AS (SELECT model, score AS threshold, f1 FROM fs
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) = 1)"""
SCORE_STEPS = (*LABEL_FEATURES, SCORES)
CURVE_STEPS = (*SCORE_STEPS, CURVE)
# The area by comparing ranks, not by the curve.
_AUC = """SELECT model, round(CASE WHEN np * nn = 0 THEN 0e0
    ELSE (rank_sum - np * (np + 1) / 2e0) / (np * nn) END, 6) AS roc_auc
  FROM (SELECT model, count(*) FILTER (label = 1) AS np, count(*) FILTER (label <> 1) AS nn,
    sum(CASE WHEN label = 1 THEN mid ELSE 0 END) AS rank_sum
    FROM (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score)
        + (count(*) OVER (PARTITION BY model, score) - 1) / 2e0 AS mid FROM sc)
    GROUP BY model)"""
_CELLS = """count(*) FILTER (label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label <> 1 AND prediction = 0) AS tn"""
_METRICS = """round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""
_REPORT = f"""SELECT {_METRICS}, roc_auc, name AS model, threshold FROM (
  SELECT name, threshold, roc_auc, {_CELLS} FROM (
    SELECT sc.label, u.name, u.threshold, auc.roc_auc,
      CAST(sc.score >= u.threshold AS INT) AS prediction
    FROM sc JOIN (SELECT DISTINCT model, model AS name, 0.5e0 AS threshold FROM sc
      UNION ALL SELECT model, model || '_Tuned', threshold FROM best) u USING (model)
    JOIN auc USING (model)) GROUP BY ALL)"""

_META = [c for c in fixed.META_COLUMNS if c not in ("job_id", "fake_label")]
_META_DOUBLES = {
    "number_of_applicants", "competition_index", "job_attractiveness", "fraud_trigger_index",
}
_META_SELECT = ", ".join(
    f"round({c}, 6) AS {c}" if c in _META_DOUBLES else c for c in _META
)

_META_RAW = ", ".join(_META)
_RAW_SCALES = _SCALES.replace("round(", "").replace(", 6) AS", " AS")
_DENSE_SUM = " + ".join(
    f"coalesce(CAST({c} AS DOUBLE), 0e0)"
    for c in [*_META, *[f"{c}_enc" for c in fixed.ENCODED_COLUMNS], *[f"{c}_scaled" for c in _SCALED]]
)

_PROFILE = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, count(*) AS row_count,"
    f" count(*) FILTER ({c} IS NULL) AS null_count FROM p"
    for i, c in enumerate(["job_id", *_TEXT_COLUMNS])
)

# Features in the groups, in the names of the input and feature columns.
_HAS = [
    *_SKILL_NAMES.values(), "has_remote", "has_urgent", "has_fee", "has_gst_hint",
    "has_india_scam_kw",
]
_GROUPS = [(g, f) for g, members in fixed.FEATURE_GROUPS.items() for f in members]
_GROUPS += [("skills", f) for f in _HAS]
_GROUP_ROWS = " UNION ALL ".join(
    f"SELECT {_quote(g)} AS feature_group, {_quote(f)} AS feature, "
    + ("0 * count(*)" if f == "education_level" else f'count("{f}")')
    + " AS n_values FROM m"
    for g, f in _GROUPS
)

META_SQL = _chain(
    f"SELECT job_id, fake_label, {_META_SELECT}, {_CODES}, {_SCALES} FROM m",
    *LABEL_FEATURES,
    f"m AS (SELECT * REPLACE (fake_label_tuned AS fake_label),"
    f" {_INDEX} AS fraud_trigger_index FROM q)",
)

ORACLES = {
    "input_profile": _chain(_PROFILE, *BASE),
    "description_samples": _chain(
        f"""SELECT job_id, {_BLANK_WORDS} AS word_count,
        substr(coalesce(job_description, 'nan'), 1, 1000) AS sample
        FROM p ORDER BY job_id LIMIT 2""",
        *BASE,
    ),
    "null_tokens": _chain("SELECT job_id, job_location, company_name, job_type FROM p", *BASE),
    "scan_csv": _chain(
        r"""SELECT job_id, job_title, company_name, salary_range,
        md5(regexp_replace(trim(job_description), '\s+', ' ', 'g')) AS text_md5 FROM p""",
        *BASE,
    ),
    "absent_columns": "SELECT doc_id AS job_id, 'Unknown' AS company_size, '' AS skills_required,"
    " '' AS job_portal, CAST(NULL AS VARCHAR) AS salary_range FROM documents",
    "surrogate_key": "SELECT count(*) AS n_rows, 1 AS first_id, count(*) AS last_id,"
    " count(*) AS n_ids FROM documents",
    "file_order_keys": _chain(
        """SELECT row_number() OVER (ORDER BY first_id) AS job_id, job_title, company_name,
        md5(coalesce(job_description, '')) AS text_md5
        FROM (SELECT * EXCLUDE (job_id), min(job_id) AS first_id FROM p GROUP BY ALL)""",
        *BASE,
    ),
    "default_label": "SELECT doc_id AS job_id, 0 AS fake_label FROM documents",
    "dedup_postings": _chain("SELECT DISTINCT * FROM rep", *BASE, REPEATED),
    "dedup_counts": _chain(
        """SELECT (SELECT count(*) FROM rep) AS rows_loaded,
        (SELECT count(*) FROM (SELECT DISTINCT * FROM rep)) AS rows_after_dedup""",
        *BASE, REPEATED,
    ),
    "label_job_keyless": _chain(
        """SELECT md5(coalesce(job_description, '')) AS text_md5, company_name, job_title,
        salary_range, num_flags, fake_label, fake_label_tuned, triggered_rules,
        count(*) OVER () AS last_id, count(*) OVER () AS n_ids FROM l""",
        *BASE, REPEATED, "once AS (SELECT DISTINCT * EXCLUDE (job_id) FROM rep)",
        SALARY_TEXT.replace("FROM p", "FROM once"), DERIVED, FLAGS, LABELS,
    ),
    "label_job_text_ids": _chain(
        """SELECT job_id, triggered_rules, label,
        CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
        FROM drawn JOIN quota USING (label)""",
        *TO_LABELS,
        "lr AS (SELECT 'JOB-' || job_id AS job_id, triggered_rules, fake_label_tuned AS label FROM l)",
        QUOTAS, DRAWN,
    ),
    "salary_bounds_label": _chain(
        "SELECT job_id, salary_lower_lpa, salary_upper_lpa FROM d", *BASE, SALARY_TEXT, DERIVED
    ),
    "experience_years": _chain(f"SELECT job_id, {_YEARS} AS exp_years FROM p", *BASE),
    "word_count_whitespace": _chain(
        f"SELECT job_id, {_BLANK_WORDS} AS desc_wordcount_ws FROM p", *BASE
    ),
    "company_size_bucket": _chain(
        f"SELECT job_id, {_BUCKET} AS company_size_bucket FROM p", *BASE
    ),
    "email_domain": _chain(f"SELECT job_id, {_DOMAIN} AS email_domain FROM p", *BASE),
    "applicants_number": _chain(
        f"SELECT job_id, {_number('number_of_applicants')} AS number_of_applicants FROM p", *BASE
    ),
    "rule_flags": _chain(
        "SELECT job_id, " + ", ".join(f"flag_{r}" for r in fixed.RULES) + " FROM l", *TO_LABELS
    ),
    "rule_trace": _chain(
        "SELECT job_id, num_flags, fake_label, triggered_rules FROM l", *TO_LABELS
    ),
    "rule_trigger_counts": _chain(
        " UNION ALL ".join(
            f'SELECT \'flag_{r}\' AS rule, count(*) FILTER (flag_{r}) AS "count" FROM l'
            for r in fixed.RULES
        ),
        *TO_LABELS,
    ),
    "label_summary": _chain(
        """SELECT count(*) AS total_rows, sum(fake_label) AS flagged_rows,
        round(100e0 * sum(fake_label) / greatest(count(*), 1), 6) AS flagged_percent FROM l""",
        *TO_LABELS,
    ),
    "tuned_label": _chain("SELECT job_id, num_flags, fake_label_tuned FROM l", *TO_LABELS),
    "label_distribution": _chain(
        'SELECT fake_label_tuned, count(*) AS "count" FROM l GROUP BY 1', *TO_LABELS
    ),
    "labelled_compact": _chain(
        f"SELECT {_COMPACT}, fake_label, triggered_rules FROM l", *TO_LABELS
    ),
    "tuned_compact": _chain(
        f"SELECT {_COMPACT}, fake_label_tuned, triggered_rules, num_flags FROM l", *TO_LABELS
    ),
    "date_features": _chain(f"SELECT {_DATES} FROM z", *FIELD_STEPS),
    "date_features_v1": _chain(
        f"SELECT {_DATES} FROM z", *BASE, FIELDS.replace("{source}", "p").replace(
            _ISO_DATE, _ANY_DATE), MORE_FIELDS, CATEGORIES
    ),
    "salary_features": _chain(
        "SELECT job_id, min_salary, max_salary, avg_salary, salary_category FROM z", *FIELD_STEPS
    ),
    "experience_features": _chain(
        "SELECT job_id, min_experience, max_experience, avg_experience, experience_category FROM z",
        *FIELD_STEPS,
    ),
    "skill_features": _chain(
        "SELECT job_id, " + ", ".join(f'"{n}"' for n in _SKILL_NAMES.values())
        + ", total_skills, technical_skills_count FROM z",
        *FIELD_STEPS,
    ),
    "clean_text": _chain("SELECT job_id, desc_clean FROM c", *CLEAN_STEPS),
    "keyword_flags_v1": _chain(f"SELECT job_id, {_KEYWORDS_V1} FROM p", *BASE),
    "keyword_flags_v2": _chain(f"SELECT job_id, {_KEYWORDS} FROM c", *CLEAN_STEPS),
    "india_signals": _chain(f"SELECT job_id, {_INDIA} FROM c", *CLEAN_STEPS),
    "fraud_trigger_index": _chain(
        f"""SELECT job_id, round(fraud_trigger_index_raw, 6) AS fraud_trigger_index_raw,
        {_INDEX} AS fraud_trigger_index FROM q""",
        *FEATURES,
    ),
    "location_features": _chain(
        "SELECT job_id, is_multiple_locations, is_remote_location, is_major_city,"
        " location_category FROM z",
        *FIELD_STEPS,
    ),
    "company_features": _chain(
        "SELECT job_id, is_premium_company, is_established_company, company_tier FROM z",
        *FIELD_STEPS,
    ),
    "portal_features": _chain(
        "SELECT job_id, is_popular_portal, portal_category FROM z", *FIELD_STEPS
    ),
    "composite_features": _chain(
        """SELECT job_id, number_of_applicants, round(competition_index, 6) AS competition_index,
        round(salary_exp_ratio, 6) AS salary_exp_ratio,
        round(skill_demand_score, 6) AS skill_demand_score,
        round(job_attractiveness, 6) AS job_attractiveness FROM q""",
        *FEATURES,
    ),
    "category_encode": _chain(f"SELECT job_id, {_CODES} FROM z", *FIELD_STEPS),
    "category_encode_v1": _chain(f"SELECT job_id, {_CODES_V1} FROM z", *FIELD_STEPS),
    "standardize": _chain(f"SELECT job_id, {_SCALES} FROM q", *FEATURES),
    "meta_features": META_SQL,
    "reloaded_features": META_SQL,
    "feature_groups": _chain(
        _GROUP_ROWS, *FEATURES, "m AS (SELECT *, 0 AS fraud_trigger_index FROM q)"
    ),
    "feature_group_select": _chain(
        """SELECT job_id, min_salary, max_salary, avg_salary, min_experience, max_experience,
        round(salary_exp_ratio, 6) AS salary_exp_ratio FROM q""",
        *FEATURES,
    ),
    "tokens_ngrams": _chain(_TOKENS, *CLEAN_STEPS, WORDS, PAIRS),
    "tokens_ngrams_v1": _chain(_TOKENS, *BASE, WORDS_V1, PAIRS),
    "vocabulary": _chain("SELECT term, term_id, df, tf FROM v", *TEXT_STEPS),
    "tfidf": _chain(
        "SELECT job_id, term_id, round(weight, 6) AS weight FROM tw", *TEXT_STEPS, WEIGHTS
    ),
    "svd_energy": _chain(
        f"""SELECT round(sum(energy), 4) AS energy, round(sum(energy) FILTER (place <= {fixed.SVD_DIM}), 4)
          AS strongest_terms, true AS within_energy, true AS no_less_than_terms
        FROM (SELECT energy, row_number() OVER (ORDER BY energy DESC) AS place FROM (
          SELECT term_id, sum(weight * weight) AS energy FROM tw GROUP BY term_id))""",
        *TEXT_STEPS, WEIGHTS,
    ),
    "assembled_features": _chain(
        f"""SELECT m.job_id, m.fake_label AS label, round({_DENSE_SUM}, 4) AS dense_sum,
        coalesce(n, 0) AS text_entries, coalesce(norm, 0e0) AS text_norm
        FROM (SELECT job_id, fake_label, {_META_RAW}, {_CODES}, {_RAW_SCALES} FROM m0) m
        LEFT JOIN (SELECT job_id, CAST(count(*) AS INT) AS n,
          round(sqrt(sum(weight * weight)), 6) AS norm FROM tw GROUP BY job_id) e
        ON m.job_id = e.job_id""",
        *LABEL_FEATURES,
        f"m0 AS (SELECT * REPLACE (fake_label_tuned AS fake_label),"
        f" {_INDEX} AS fraud_trigger_index FROM q)",
        WORDS, PAIRS, TERMS, VOCABULARY, WEIGHTS,
    ),
    "lr_balance": _chain(
        f"""SELECT CAST(least({FIT_ROWS}, sum(n - quota)) AS BIGINT) AS n_fit, 1e0 AS means,
        CAST(sum(quota) AS BIGINT) AS n_test
        FROM cls JOIN quota USING (label)""",
        *TO_LABELS, LABEL_ROWS, QUOTAS,
    ),
    "calibration_balance": _chain(
        f"""SELECT fold, count(*) AS n_rows, 0e0 AS gap FROM (
          SELECT CAST(place > n // 3 AS INT) + CAST(place > n * 2 // 3 AS INT) AS fold FROM (
            SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (
              PARTITION BY label ORDER BY md5(CAST(job_id AS VARCHAR) || ':{fixed.SEED + 1}'), job_id) AS place
            FROM (SELECT job_id, label FROM fit QUALIFY row_number() OVER (
              ORDER BY md5(CAST(job_id AS VARCHAR) || ':{fixed.SEED}'), job_id)
              <= least(count(*) OVER (), greatest(100,
                floor(count(*) OVER () * {fixed.CALIBRATION_FRACTION}e0)))))) GROUP BY fold""",
        *TO_LABELS, LABEL_ROWS, QUOTAS, DRAWN, TRAINED_ON,
    ),
    "svd_certificate": f"""SELECT CAST({fixed.SVD_DIM} AS BIGINT) AS n_components, true AS orthonormal,
      true AS certified, true AS no_negative_energy""",
    "lr_stationarity": _chain(
        """SELECT CAST(sum(n - quota) AS BIGINT) AS n_fit, true AS stationary,
        true AS intercept_stationary, true AS all_weights FROM cls JOIN quota USING (label)""",
        *TO_LABELS, LABEL_ROWS, QUOTAS,
    ),
    "bootstrap_weights": _chain(
        f"""SELECT draw, label, count(*) FILTER (k > 0) AS n_rows,
          round(sum(sum(k)) OVER (PARTITION BY draw) / (2e0 * sum(k)), 6) AS class_weight,
          round(sum(sum(k)) OVER (PARTITION BY draw) / 2e0, 6) AS total
        FROM (SELECT draw, label, (SELECT count(*) FROM (VALUES {_POISSON}) v(reached)
            WHERE chance >= reached) AS k
          FROM (SELECT label, draw, CAST('0x' || substr(md5(CAST(job_id AS VARCHAR) || ':' ||
              CAST({fixed.SEED + 1000} + draw AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 AS chance
            FROM lr, range(4) r(draw)))
        GROUP BY draw, label""",
        *TO_LABELS, LABEL_ROWS,
    ),
    "importance_sums": """SELECT 'RandomForest' AS model, 1e0 AS total, false AS used_only,
        true AS each_once, true AS as_model
      UNION ALL SELECT 'GradientBoosting', 1e0, true, true, true""",
    "cross_fitted_rows": _chain(
        f"""SELECT 'LogisticRegression' AS model, count(*) AS n_rows, count(DISTINCT job_id) AS n_ids,
          count(*) FILTER (label = 1) AS positives, count(*) AS in_range FROM fit""",
        *TO_LABELS, LABEL_ROWS, QUOTAS, DRAWN, TRAINED_ON,
    ),
    "reloaded_models": _chain(
        """SELECT model, n AS n_rows, n AS n_same FROM (SELECT count(*) AS n FROM lr),
        (VALUES ('LogisticRegression'), ('RandomForest'), ('GradientBoosting')) v(model)""",
        *TO_LABELS, LABEL_ROWS,
    ),
    "score_rows": _chain(
        """SELECT model, n AS n_rows, n AS n_ids, positives, n AS in_range FROM (
          SELECT CAST(sum(quota) AS BIGINT) AS n,
            CAST(sum(quota) FILTER (label = 1) AS BIGINT) AS positives FROM quota),
        (VALUES ('LogisticRegression'), ('Calibrated'), ('RandomForest'), ('GradientBoosting')) v(model)""",
        *TO_LABELS, LABEL_ROWS, QUOTAS,
    ),
    "stratified_split": _chain(
        """SELECT job_id, label, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
        FROM drawn JOIN quota USING (label)""",
        *TO_LABELS, LABEL_ROWS, QUOTAS, DRAWN,
    ),
    "class_weights": _chain(
        """SELECT label, n, round(sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE), 6)
          AS balanced_weight,
        round(CASE WHEN label = 1 THEN (SELECT count(*) FROM lr WHERE label = 0) / CAST(n AS DOUBLE)
          ELSE 1 END, 6) AS boosting_weight FROM cls""",
        *TO_LABELS, LABEL_ROWS, QUOTAS,
    ),
    "calibration_sample": _chain(
        f"""SELECT job_id, label FROM lr QUALIFY row_number() OVER (
          ORDER BY md5(CAST(job_id AS VARCHAR) || ':{fixed.SEED}'), job_id)
          <= least(count(*) OVER (), greatest(100,
            floor(count(*) OVER () * {fixed.CALIBRATION_FRACTION}e0)))""",
        *TO_LABELS, LABEL_ROWS,
    ),
    "calibration_folds": _chain(
        f"""SELECT job_id, label, CAST(place > n // 3 AS INT) + CAST(place > n * 2 // 3 AS INT)
          AS fold FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n,
          row_number() OVER (PARTITION BY label
            ORDER BY md5(CAST(job_id AS VARCHAR) || ':{fixed.SEED + 1}'), job_id) AS place
          FROM lr)""",
        *TO_LABELS, LABEL_ROWS,
    ),
    "classification_metrics": _chain(
        f"""SELECT model, tp, fp, fn, tn, {_METRICS} FROM (SELECT model, {_CELLS} FROM
        (SELECT *, CAST(score >= 0.15e0 AS INT) AS prediction FROM sc) GROUP BY model)""",
        *SCORE_STEPS,
    ),
    "roc_auc": _chain(_AUC, *SCORE_STEPS),
    "pr_curve": _chain(
        """SELECT model, score AS threshold, round(prec, 6) AS precision, round(rec, 6) AS recall
        FROM pr""",
        *CURVE_STEPS,
    ),
    "best_threshold": _chain(
        "SELECT model, threshold, round(f1, 6) AS f1 FROM best", *CURVE_STEPS
    ),
    "threshold_report": _chain(_REPORT, *CURVE_STEPS, f"auc AS ({_AUC})"),
    "threshold_report_validation": _chain(
        _REPORT.replace("FROM sc JOIN", "FROM ts sc JOIN"),
        *SCORE_STEPS, LABEL_ROWS, QUOTAS, DRAWN,
        """parted AS (SELECT drawn.job_id, place <= quota AS test FROM drawn JOIN quota USING (label)),
        ts AS (SELECT sc.* FROM sc JOIN parted USING (job_id) WHERE test),
        vs AS (SELECT sc.* FROM sc JOIN parted USING (job_id) WHERE NOT test)""",
        CURVE.replace("FROM sc GROUP", "FROM vs GROUP"),
        f"auc AS ({_AUC.replace('FROM sc)', 'FROM ts)')})",
    ),
    "index_stats": _chain(
        f"""SELECT min(i) AS min_index, median(i) AS median_index, max(i) AS max_index
        FROM (SELECT {_INDEX} AS i FROM q)""",
        *FEATURES,
    ),
    "top_value_counts": _chain(
        f"""SELECT india_scam_keyword_count, count(*) AS "count" FROM
        (SELECT {_INDIA} FROM c) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
        *CLEAN_STEPS,
    ),
}
