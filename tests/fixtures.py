"""Survey-shaped hand fixtures (FIXTURES.md section 1).

Small tables with every awkward case: NULL, 'NA', "Other" texts and
prefixes, apostrophes, dotted and padded labels, dangling bridge ids,
duplicate bridge pairs, respondents without any bridge row.
"""

from __future__ import annotations

R_SCHEMA = ("ResponseId long, Industry string, DevType string, AISelect string, AIAcc string, AIThreat string, "
            "WorkExp int, `CompTotal(USD)` double, EdLevel string, YearsCodePro string")

BSC = "Bachelor’s degree (B.A., B.S., B.Eng., etc.)"
MSC = "Master’s degree (M.A., M.S., M.Eng., MBA, etc.)"
SEC = "Secondary school (e.g. American high school, German Realschule or Gymnasium, etc.)"

RESPONDENTS = [
    # id, Industry, DevType, AISelect, AIAcc, AIThreat, WorkExp, salary, EdLevel, YearsCodePro
    (1, "Fintech", "Developer, back-end", "Yes", "Highly trust", "Yes", 5, 50000.0, BSC, "2"),
    (2, "Fintech", "Developer, back-end", "No, but I plan to soon", "Somewhat trust", "No", 3, 60000.0, BSC, "10"),
    (3, "Fintech", "Developer, front-end", "No, and I don't plan to", "Somewhat trust", "I'm not sure", None, 0.01, MSC, None),
    (4, "Healthcare", "Developer, front-end", "Yes", "Neither trust nor distrust", "I'm not sure", 1, 999999.99, MSC, "2"),
    (5, "Healthcare", "Senior Executive (C-Suite, VP, etc.)", "Yes", "Somewhat distrust", "Yes", 20, 1000000.0, "Something else", "10"),
    (6, "NA", "NA", "NA", "NA", "NA", 2, -1.0, "NA", "2"),
    (7, "Other:", "Other (please specify):", "Yes", "Highly distrust", "No", 4, 0.0, SEC, "10"),
    (8, "Other: consulting", "Developer, back-end", None, "Bogus level", "Yes", 7, 70000.0, SEC, None),
    (9, None, None, "Yes", None, None, None, None, None, None),
    (10, "Healthcare", "Developer, back-end", None, "Highly trust", "Yes", 8, 80000.0, BSC, "2"),
    (11, "Fintech", "Developer, front-end", "Yes", "Highly trust", "No", 9, 90000.0, MSC, "10"),
    (12, "Healthcare", "Developer, back-end", "No, but I plan to soon", "Somewhat trust", "No", 6, 55000.0, BSC, "2"),
]

LEARN_CODE = [
    (1, "Books / Physical media"),
    (2, "School (i.e., University, College, etc)"),
    (3, "  Colleague\t"),
    (4, "Not Specified"),
    (5, "Coding Bootcamp"),
]

# (ResponseId, id): respondent 3 has none, 2 has a duplicate pair, 9 names an
# id missing from the lookup.
RESPONDENT_LEARN_CODE = [
    (1, 1), (1, 2), (2, 2), (2, 2), (2, 3), (4, 1), (5, 5), (7, 4), (8, 3), (9, 99),
    (10, 1), (10, 5), (11, 2), (12, 3),
]

LANGUAGES = [(1, "Python"), (2, "Rust"), (3, "SQL"), (4, "Go")]
RESPONDENT_LANGUAGE = [(1, 1), (1, 3), (2, 1), (4, 2), (4, 3), (4, 4), (5, 1), (8, 77), (10, 3), (11, 1), (12, 2)]
RESPONDENT_LANGUAGE_WANT = [(1, 2), (2, 2), (3, 2), (4, 2), (4, 1), (5, 3), (6, 1), (6, 1), (9, 4), (12, 4)]

DATABASES = [(1, "PostgreSQL"), (2, "SQLite")]
RESPONDENT_DATABASE = [(1, 1), (2, 1), (3, 2)]
RESPONDENT_DATABASE_WANT = [(1, 1), (4, 2), (5, 2), (6, 2), (6, 2)]


def survey_tables(spark) -> dict:
    lookup = "id long, name string"
    bridge = "ResponseId long, id long"
    t = {
        "Respondent": spark.createDataFrame(RESPONDENTS, R_SCHEMA),
        "LearnCode": spark.createDataFrame(LEARN_CODE, lookup),
        "RespondentLearnCode": spark.createDataFrame(RESPONDENT_LEARN_CODE, bridge),
        "ProgrammingLanguage": spark.createDataFrame(LANGUAGES, lookup),
        "RespondentLanguage": spark.createDataFrame(RESPONDENT_LANGUAGE, bridge),
        "RespondentLanguageWant": spark.createDataFrame(RESPONDENT_LANGUAGE_WANT, bridge),
        "Database": spark.createDataFrame(DATABASES, lookup),
        "RespondentDatabase": spark.createDataFrame(RESPONDENT_DATABASE, bridge),
        "RespondentDatabaseWant": spark.createDataFrame(RESPONDENT_DATABASE_WANT, bridge),
    }
    return t
