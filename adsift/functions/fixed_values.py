"""Word lists, names and constants that define the results.

They are data, not logic: changing one changes what a rule or feature means.
"""

# --- fixed values: ingestion -------------------------------------------------

# Source header -> canonical column name.
SOURCE_COLUMNS = {
    "Job ID": "job_id",
    "Job Title": "job_title",
    "Company Name": "company_name",
    "Job Location": "job_location",
    "Salary Range": "salary_range",
    "Experience Required": "experience_required",
    "Job Type": "job_type",
    "Remote/Onsite": "remote_onsite",
    "Company Size": "company_size",
    "Job Portal": "job_portal",
    "Recruiter Email": "recruiter_email",
    "Number of Applicants": "number_of_applicants",
    "Posted Date": "posted_date",
    "Application Deadline": "application_deadline",
    "Skills Required": "skills_required",
    "Job Description": "job_description",
}

# Texts that the pandas readers take for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Value of a text column that the input does not have at all.
ABSENT_DEFAULTS = {
    "company_name": "",
    "job_location": "",
    "company_size": "Unknown",
    "job_portal": "",
    "recruiter_email": "",
    "skills_required": "",
    "job_description": "",
}

# A missing value turned to text.
MISSING_TEXT = "nan"

# --- fixed values: labelling rules -------------------------------------------

DESC_THRESHOLD = 15
MIN_FLAGS = 1
MIN_LOWER_LPA = 0.5
MAX_UPPER_LPA = 60
MAX_APPLICANTS = 1000
SMALL_COMPANY_MAX_LPA = 30
SMALL_COMPANY_STAFF = 50
MEDIUM_COMPANY_STAFF = 500

SUSPICIOUS_EMAIL_DOMAINS = [
    "gmail.com", "outlook.com", "yahoo.com", "hotmail.com", "rediffmail.com",
    "ymail.com",
]

VAGUE_COMPANY_KEYWORDS = [
    "confidential", "notdisclosed", "not disclosed", "unknown", "n/a", "na",
    "-", "services", "consulting", "consultancy", "hr",
]

MISSING_LOCATIONS = ["", "nan", "none", "india"]

TRIGGER_KEYWORDS = [
    "work from home fee", "registration fee", "urgent requirement",
    "limited seats", "part time earn", "without interview", "no interview",
    "no experience required", "apply now", "earn from home", "fast earning",
    "quick join", "send cv to", "whatsapp", "contact whatsapp", "cash in hand",
]

# The rules in the order in which a trace names them.
RULES = [
    "email_suspicious", "missing_description", "vague_company",
    "salary_unrealistic", "location_missing",
    "location_multiple_inconsistent", "applicants_anomaly",
    "company_salary_mismatch", "trigger_keyword",
]

COMPACT_COLUMNS = [
    "job_id", "job_title", "company_name", "job_location", "salary_range",
    "experience_required", "job_portal", "number_of_applicants",
    "company_size", "job_description", "recruiter_email",
]

# --- fixed values: features --------------------------------------------------

SKILLS = [
    "python", "java", "c++", "sql", "react", "aws", "machine learning",
    "ui/ux", "digital marketing", "excel",
]

REMOTE_PHRASES = ["remote", "work from home"]
URGENT_PHRASES = ["urgent", "immediate", "start immediately"]
FEE_PHRASES = ["registration fee", "pay to apply", "fee"]

INDIA_SCAM_PHRASES = [
    "work from home fees", "registration fee", "pay to apply", "earn rs",
    "earn ₹", "earn rs.", "earn rs/-", "earn per week", "no experience earn",
    "urgent hiring", "immediate joining", "start immediately", "earn 50k",
    "weekly payout", "join and pay", "pan india", "anywhere in india",
    "apply through whatsapp", "send money", "investment required",
]

CONFIDENTIAL_WORDS = ["confidential", "private", "na", "n/a"]
FREE_EMAIL_PATTERN = r"gmail\.com|yahoo\.|hotmail\."

# Weights of the fraud trigger index.
INDEX_KEYWORD_WEIGHT = 0.4
INDEX_FEE_WEIGHT = 0.25
INDEX_WHATSAPP_WEIGHT = 0.15
INDEX_SHORT_TEXT_WEIGHT = 0.10
INDEX_SALARY_WEIGHT = 0.10
INDEX_SHORT_TEXT_WORDS = 15
INDEX_SALARY_RANGE = (1, 50)

MAJOR_CITIES = [
    "bangalore", "mumbai", "delhi", "hyderabad", "chennai", "pune", "kolkata",
    "ahmedabad", "jaipur", "noida",
]
PREMIUM_COMPANIES = ["google", "microsoft", "amazon", "ibm"]
ESTABLISHED_COMPANIES = [
    "infosys", "tcs", "wipro", "hcl", "accenture", "deloitte",
]
PRIVATE_NAMES = ["private", "confidential", "na", "n/a", ""]
PORTALS = {"linkedin": "LinkedIn", "naukri": "Naukri", "indeed": "Indeed"}

# Upper limits (exclusive) and names of the v1 categories; 0 is Unknown.
SALARY_CATEGORIES = [(5, "Low"), (12, "Medium"), (20, "High")]
SALARY_TOP_CATEGORY = "Very High"
EXPERIENCE_CATEGORIES = [(2, "Entry"), (5, "Mid"), (10, "Senior")]
EXPERIENCE_TOP_CATEGORY = "Exec"

ENCODED_COLUMNS = [
    "job_type", "remote_onsite", "company_size", "location_category",
    "company_tier", "portal_category",
]
ENCODED_COLUMNS_V1 = [
    "job_type", "remote_onsite", "company_size", "salary_category",
    "experience_category", "location_category", "company_tier",
    "portal_category",
]
UNKNOWN_CATEGORY = "Unknown"

SCALED_COLUMNS = [
    "min_salary", "max_salary", "avg_salary", "min_experience",
    "max_experience", "avg_experience", "total_skills",
    "technical_skills_count", "desc_wordcount", "education_level",
    "competition_index", "salary_exp_ratio", "skill_demand_score",
    "job_attractiveness",
]

META_COLUMNS = [
    "job_id", "fake_label", "number_of_applicants", "desc_wordcount",
    "competition_index", "job_attractiveness", "technical_skills_count",
    "total_skills", "india_scam_keyword_count", "has_india_scam_kw",
    "mentions_whatsapp", "mentions_gmail_or_free_email",
    "mentions_confidential", "has_gst_hint", "fraud_trigger_index",
]
META_COLUMNS_V1 = [
    "job_id", "fake_label", "desc_wordcount", "number_of_applicants",
    "competition_index", "job_attractiveness", "skill_demand_score",
]

FEATURE_GROUPS = {
    "meta": [
        "number_of_applicants", "competition_index", "job_attractiveness",
        "education_level",
    ],
    "salary_experience": [
        "min_salary", "max_salary", "avg_salary", "min_experience",
        "max_experience", "salary_exp_ratio",
    ],
    "skills": ["total_skills", "technical_skills_count"],
    "india_specific": [
        "india_scam_keyword_count", "has_india_scam_kw", "mentions_whatsapp",
        "mentions_gmail_or_free_email", "mentions_confidential",
        "has_gst_hint", "fraud_trigger_index",
    ],
    "text": ["desc_wordcount"],
}
# Every column with this prefix also belongs to the skills group.
SKILL_GROUP_PREFIX = "has_"

# --- fixed values: text model ------------------------------------------------

MIN_DF = 3
MAX_FEATURES = 5000
MAX_FEATURES_V1 = 20000
SVD_DIM = 300
SVD_DIM_V1 = 200

# --- fixed values: training --------------------------------------------------

TEST_SIZE = 0.2
SEED = 42
DEFAULT_THRESHOLD = 0.5
CALIBRATION_FRACTION = 0.3
CALIBRATION_MIN_ROWS = 100
CALIBRATION_FOLDS = 3
F1_EPSILON = 1e-12
# Version 1, version 2.
LOGISTIC_COST = (1.0, 2.0)
LOGISTIC_ITERATIONS = 5000
LOGISTIC_TOLERANCE = 1e-4
FOREST_TREES = (300, 500)
FOREST_DEPTH = 15
BOOSTING_ROUNDS = (300, 400)
BOOSTING_DEPTH = (5, 6)
BOOSTING_STEP = (0.1, 0.05)
BOOSTING_ROW_SHARE = (0.8, 0.9)
BOOSTING_COLUMN_SHARE = (0.8, 0.9)
