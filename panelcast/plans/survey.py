"""The named survey analyses as compositions of the
operators over survey-shaped tables.

``tables`` is a dict of DataFrames with the survey's table names:
``Respondent`` (one row per respondent), lookups ``LearnCode``,
``ProgrammingLanguage``, ... with ``id, name``, and bridges
``RespondentLearnCode``, ``RespondentLanguage``, ... (and ``...Want``) with
``ResponseId, id``.  Every function returns lazy DataFrames, except the
Spark ML fits (clusters, projection, sweep), which run when called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.missing import NULLS, Missing, drop_missing, relabel
from panelcast.operators.adoption import Family, adoption_families, adoption_vs_demand
from panelcast.operators.association import association_grid, top_associations
from panelcast.operators.fanout import Bridge, FanoutBase, decode, fanout_base, fanout_breakdowns, grouped_avg, histogram
from panelcast.operators.flow import flow_graph, forked_flows, label_counts, pair_flows
from panelcast.operators.profile import (
    cluster_profiles,
    indicator_long,
    indicator_vectors,
    project_2d,
    silhouette_sweep,
)
from panelcast.operators.share import breakdown, distribution, equals, group_share, pivot_share
from panelcast.sources.sinks import materialize

# ---------------------------------------------------------------------------
# Survey texts and parameters that must equal the reference's
# for its results.  Listed as the reference states them.
# ---------------------------------------------------------------------------
NA = "NA"
INDUSTRY_OTHER = "Other:"
DEVTYPE_OTHER = "Other (please specify):"
EDLEVEL_EXCLUDED = "Something else"
LEARN_CODE_EXCLUDED = "Not Specified"
AI_SELECT_VALUES = ["Yes", "No, but I plan to soon", "No, and I don't plan to"]
TRUST_LEVELS = ["Highly trust", "Somewhat trust", "Neither trust nor distrust", "Somewhat distrust", "Highly distrust"]
TRUST_UNEXPECTED_ORDER = 6
THREAT_LEVELS = ["Yes", "No", "I'm not sure"]
SMALL_CATEGORY_PERCENT = 1
OTHER_LABEL = "Other"
SALARY_LOW, SALARY_HIGH = 0, 1000000
SALARY_BINS = 100
RESPONDENT_RENAME = {
    "Associate degree (A.A., A.S., etc.)": "Associate degree",
    "Bachelor’s degree (B.A., B.S., B.Eng., etc.)": "Bachelor degree",
    "Master’s degree (M.A., M.S., M.Eng., MBA, etc.)": "Master degree",
    "Primary/elementary school": "Primary or elementary school",
    "Professional degree (JD, MD, Ph.D, Ed.D, etc.)": "Professional degree",
    "Secondary school (e.g. American high school, German Realschule or Gymnasium, etc.)": "Secondary school",
    "Some college/university study without earning a degree": "Some college or university study without earning a degree",
    "Books / Physical media": "Books or physical media",
    "Other online resources (e.g., videos, blogs, forum, online community)": "Other online resources",
    "School (i.e., University, College, etc)": "School (University or College)",
    "Senior Executive (C-Suite, VP, etc.)": "Senior Executive",
}
LEARN_CODE_RENAME = {
    "Books / Physical media": "Books or physical media",
    "Other online resources (e.g., videos, blogs, forum, online community)": "Other online resources",
    "School (i.e., University, College, etc)": "School (University or College)",
}
LEARN_CODE_FEATURES = [
    "Books or physical media", "Coding Bootcamp", "Colleague", "Friend or family member",
    "On the job training", "Online Courses or Certification", "Other online resources", "School (University or College)",
]
EDUCATION_FEATURES = [
    "Associate degree", "Bachelor degree", "Master degree", "Primary or elementary school", "Professional degree",
    "Secondary school", "Some college or university study without earning a degree",
]
INDUSTRY_TARGETS = [
    "Banking/Financial Services", "Computer Systems Design and Services", "Energy", "Fintech", "Government", "Healthcare",
    "Higher Education", "Insurance", "Internet, Telecomm or Information Services", "Manufacturing",
    "Media & Advertising Services", "Retail and Consumer Services", "Software Development", "Transportation, or Supply Chain",
]
DEV_TYPE_TARGETS = [
    "Academic researcher", "Blockchain", "Cloud infrastructure engineer", "Data engineer", "Data or business analyst", "Student", "System administrator",
    "Data scientist or machine learning specialist", "Database administrator", "Designer", "DevOps specialist", "Developer Advocate",
    "Developer Experience", "Developer, AI", "Developer, QA or test", "Developer, back-end", "Developer, desktop or enterprise applications",
    "Developer, embedded applications or devices", "Developer, front-end", "Developer, full-stack", "Developer, game or graphics",
    "Developer, mobile", "Educator", "Engineer, site reliability", "Engineering manager", "Hardware Engineer", "Marketing or sales professional",
    "Product manager", "Project manager", "Research & Development role", "Scientist", "Security professional", "Senior Executive",
]
TOP_ASSOCIATIONS = 10
CLUSTERS = 3
SWEEP_KS = range(3, 51)
SWEEP_SEED = 42
TECHNOLOGY_FAMILIES = [
    ("RespondentLanguage", "ProgrammingLanguage"),
    ("RespondentDatabase", "Database"),
    ("RespondentCloud", "Cloud"),
    ("RespondentWebFramework", "WebFramework"),
    ("RespondentEmbeddedSystem", "EmbeddedSystem"),
    ("RespondentMiscTech", "MiscTech"),
    ("RespondentDevTool", "DevTool"),
    ("RespondentIDE", "IDE"),
    ("RespondentAITool", "AITool"),
]
WANT_SUFFIX = "Want"
# ---------------------------------------------------------------------------

KEY = "ResponseId"
INDUSTRY_MISSING = Missing(values=[NA, INDUSTRY_OTHER])
DEVTYPE_MISSING = Missing(values=[NA, DEVTYPE_OTHER])
ANSWERED = Missing(values=[NA])

Tables = dict[str, DataFrame]

#: The column of answers that are not on a pivot's list.
REST = "Not listed"


# ------------------------------------------------------------------ AI adoption (Q-AI1 .. Q-AI6)

def ai_use_by_industry(t: Tables) -> DataFrame:
    """Q-AI1: AI use share per industry, wide, sorted by "Yes".  'NA' answers
    keep their column here (K2) and denominators count all answers (K1)."""
    s = group_share(t["Respondent"], "Industry", "AISelect", INDUSTRY_MISSING, NULLS)
    return pivot_share(s, "Industry", "AISelect", AI_SELECT_VALUES + [NA], sort_by="Yes", rest=REST)


def ai_use_by_devtype(t: Tables) -> DataFrame:
    """Q-AI2: the same per developer type; 'NA' answers dropped."""
    s = group_share(t["Respondent"], "DevType", "AISelect", DEVTYPE_MISSING, ANSWERED)
    return pivot_share(s, "DevType", "AISelect", AI_SELECT_VALUES, sort_by="Yes", rest=REST)


def ai_trust(t: Tables) -> DataFrame:
    """Q-AI3: trust distribution in the survey's order; needs WorkExp (K4)."""
    d = distribution(t["Respondent"], "AIAcc", ANSWERED, where=F.col("WorkExp").isNotNull(),
                     order=TRUST_LEVELS, default_ord=TRUST_UNEXPECTED_ORDER, count_col="count")
    return d.select("AIAcc", "count")


def ai_threat(t: Tables) -> DataFrame:
    """Q-AI4: threat distribution."""
    return distribution(t["Respondent"], "AIThreat", ANSWERED, count_col="count")


def _details(t: Tables, col: str, level: str) -> tuple[DataFrame, DataFrame]:
    r, where = t["Respondent"], equals(col, level)
    dev = breakdown(r, "DevType", where, DEVTYPE_MISSING, SMALL_CATEGORY_PERCENT, OTHER_LABEL, "count")
    ind = breakdown(r, "Industry", where, INDUSTRY_MISSING, SMALL_CATEGORY_PERCENT, OTHER_LABEL, "count")
    return dev, ind


def ai_trust_details(t: Tables, level: str) -> tuple[DataFrame, DataFrame]:
    """Q-AI5: developer type and industry among respondents with one trust
    level; categories under 1 % collapsed into "Other"."""
    return _details(t, "AIAcc", level)


def ai_threat_details(t: Tables, answer: str) -> tuple[DataFrame, DataFrame]:
    """Q-AI6: the same for one threat answer."""
    return _details(t, "AIThreat", answer)


# ------------------------------------------------------------------ career outcomes (Q-CO1 .. Q-CO8)

SALARY_ATTRIBUTES = ["EdLevel", "YearsCodePro", "DevType", "Industry"]


def _salary_bridges(t: Tables) -> list[Bridge]:
    return [
        Bridge("learn_code_method", t["RespondentLearnCode"], KEY, "id", t["LearnCode"], "id", "name"),
        Bridge("programming_language", t["RespondentLanguage"], KEY, "id", t["ProgrammingLanguage"], "id", "name"),
    ]


def salary_base(t: Tables) -> FanoutBase:
    """Q-CO1: respondents with a salary in (0, 1,000,000), with learning
    methods and languages as fan-out bridges (weighted, not materialised)."""
    return fanout_base(t["Respondent"], KEY, "CompTotal(USD)", measure_name="salary", attrs=SALARY_ATTRIBUTES,
                       bridges=_salary_bridges(t), lo=SALARY_LOW, hi=SALARY_HIGH)


def salary_breakdowns(t: Tables) -> DataFrame:
    """Q-CO2 to Q-CO8 as one table ``dim, value, average, cnt`` from one pass
    over the respondents and each bridge."""
    return fanout_breakdowns(
        t["Respondent"], KEY, "CompTotal(USD)", attrs=SALARY_ATTRIBUTES, bridges=_salary_bridges(t), lo=SALARY_LOW, hi=SALARY_HIGH,
        exclude={"EdLevel": [EDLEVEL_EXCLUDED], "learn_code_method": [LEARN_CODE_EXCLUDED], "DevType": [DEVTYPE_OTHER, NA],
                 "Industry": [INDUSTRY_OTHER, NA]},
        bins=(SALARY_LOW, SALARY_HIGH, SALARY_BINS))


def salary_histogram(base: FanoutBase) -> DataFrame:
    """Q-CO2: salary histogram over the fan-out rows (weighted counts)."""
    return histogram(base.entities, "salary", SALARY_LOW, SALARY_HIGH, SALARY_BINS, weight="weight")


def _mean(base: FanoutBase, dim: str, **kw) -> DataFrame:
    return grouped_avg(base, dim, avg_col="average_salary", **kw)


def avg_salary_by_education(base: FanoutBase) -> DataFrame:
    """Q-CO3."""
    return _mean(base, "EdLevel", exclude=[EDLEVEL_EXCLUDED])


def avg_salary_by_learn_code(base: FanoutBase) -> DataFrame:
    """Q-CO4."""
    return _mean(base, "learn_code_method", exclude=[LEARN_CODE_EXCLUDED])


def avg_salary_by_years_code_pro(base: FanoutBase) -> DataFrame:
    """Q-CO5: NULL group kept, sorted by the key."""
    return _mean(base, "YearsCodePro", sort="key")


def avg_salary_by_dev_type(base: FanoutBase) -> DataFrame:
    """Q-CO6."""
    return _mean(base, "DevType", exclude=[DEVTYPE_OTHER, NA])


def avg_salary_by_industry(base: FanoutBase) -> DataFrame:
    """Q-CO7."""
    return _mean(base, "Industry", exclude=[INDUSTRY_OTHER, NA])


def avg_salary_by_programming_language(base: FanoutBase) -> DataFrame:
    """Q-CO8: NULL group kept."""
    return _mean(base, "programming_language")


# ------------------------------------------------------------------ education pathways (Q-ED1 .. Q-ED10)

def clean_respondents(t: Tables) -> DataFrame:
    """Q-ED1: respondents with education, developer type and industry answered."""
    r = t["Respondent"].select(KEY, "EdLevel", "DevType", "Industry")
    return drop_missing(r, {
        "EdLevel": ANSWERED,
        "DevType": Missing(values=[NA], prefixes=[DEVTYPE_OTHER]),
        "Industry": Missing(values=[NA], prefixes=[INDUSTRY_OTHER]),
    })


def learn_code_methods(t: Tables) -> DataFrame:
    """Q-ED2: ``ResponseId, name`` of each learning method answer."""
    return decode(t["RespondentLearnCode"], KEY, "id", t["LearnCode"], "id", "name")


def _combined(t: Tables) -> DataFrame:
    """Respondents joined with their learning methods, counted (``mult``) per
    method and combination of answers."""
    return label_counts(clean_respondents(t), KEY, ["EdLevel", "DevType", "Industry"],
                        t["RespondentLearnCode"], KEY, "id", t["LearnCode"], "id", "name", "name")


def pathway_pair_flows(t: Tables) -> DataFrame:
    """Q-ED3: education -> method, method -> developer type, method -> industry."""
    return pair_flows(_combined(t), [("EdLevel", "name"), ("name", "DevType"), ("name", "Industry")], weight="mult")


def pathway_graphs(t: Tables) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Q-ED4: (nodes, links) of the two three-layer pathways.  They share
    their first hop: the join is counted once, for Q-ED3's three pairs, and both
    graphs are made of those stored counts."""
    flows = materialize(pathway_pair_flows(t))
    ends = ("DevType", "Industry")
    return {last: flow_graph(f) for last, f in zip(ends, forked_flows(flows, 1, [1, 2]))}


def _rename() -> dict:
    return {**RESPONDENT_RENAME, **LEARN_CODE_RENAME}


def indicator_matrix(t: Tables) -> DataFrame:
    """Q-ED5: long indicators ``ResponseId, feature, label`` of respondents
    that have at least one learning method (the reference's inner join)."""
    return indicator_long(clean_respondents(t), KEY, ["EdLevel", "DevType", "Industry"],
                          bridge_labels=learn_code_methods(t), bridge_feature="LearnCode", bridge_label="name",
                          rename=_rename())


def _universe(t: Tables) -> DataFrame:
    r = clean_respondents(t).join(learn_code_methods(t).select(KEY), KEY, "left_semi")
    m = _rename()
    return r.select(KEY, *[relabel(c, m).alias(c) for c in ("EdLevel", "DevType", "Industry")])


def education_industry_associations(t: Tables) -> DataFrame:
    """Q-ED6: top 10 education-industry pairs by Cramér's V."""
    g = association_grid(_universe(t), KEY, "EdLevel", "Industry", EDUCATION_FEATURES, INDUSTRY_TARGETS)
    return top_associations(g, TOP_ASSOCIATIONS)


def education_devtype_associations(t: Tables) -> DataFrame:
    """Q-ED7: top 10 education-developer type pairs by Cramér's V."""
    g = association_grid(_universe(t), KEY, "EdLevel", "DevType", EDUCATION_FEATURES, DEV_TYPE_TARGETS)
    return top_associations(g, TOP_ASSOCIATIONS)


def profile_vectors(t: Tables) -> DataFrame:
    """The 15 indicators (8 learning methods + 7 education levels) per respondent."""
    long = indicator_matrix(t).filter(F.col("feature").isin("LearnCode", "EdLevel"))
    return indicator_vectors(long, KEY, LEARN_CODE_FEATURES + EDUCATION_FEATURES)


def respondent_clusters(t: Tables, seed: int = SWEEP_SEED) -> DataFrame:
    """Q-ED8: KMeans (k = 3) on the normalised indicator vectors."""
    return cluster_profiles(profile_vectors(t), KEY, k=CLUSTERS, seed=seed)


def cluster_projection(t: Tables, seed: int = SWEEP_SEED) -> DataFrame:
    """Q-ED9: 2-D PCA projection with the cluster id."""
    return project_2d(respondent_clusters(t, seed), KEY)


def cluster_count_sweep(t: Tables, ks=SWEEP_KS, seed: int = SWEEP_SEED) -> DataFrame:
    """Q-ED10: cosine silhouette for k = 3..50."""
    return silhouette_sweep(profile_vectors(t), ks, seed=seed)


# ------------------------------------------------------------------ technology trends (Q-TT1 .. Q-TT9)

def technology_demand(t: Tables, bridge: str, lookup: str) -> DataFrame:
    """Q-TT: distinct respondents who worked with / want each technology."""
    return adoption_vs_demand(t[bridge], t[bridge + WANT_SUFFIX], KEY, "id", t[lookup], "id", "name").select(
        "name", "cnt", "want_cnt", "id"
    )


def _families(t: Tables) -> list[Family]:
    missing = [n for bridge, lookup in TECHNOLOGY_FAMILIES for n in (bridge, bridge + WANT_SUFFIX, lookup) if n not in t]
    if missing:
        raise KeyError(f"missing tables: {', '.join(missing)}")
    return [Family(lookup, t[bridge], t[bridge + WANT_SUFFIX], KEY, "id", t[lookup], "id", "name") for bridge, lookup in TECHNOLOGY_FAMILIES]


def technology_demand_table(t: Tables) -> DataFrame:
    """Q-TT1..9 as one table ``family, id, name, cnt, want_cnt`` from one pass:
    all families' answers share one distinct count and one lookup join."""
    return adoption_families(_families(t))


def technology_demand_all(t: Tables) -> dict[str, DataFrame]:
    """Q-TT1..9: one result per technology family; a missing table is an error."""
    _families(t)
    return {lookup: technology_demand(t, bridge, lookup) for bridge, lookup in TECHNOLOGY_FAMILIES}
