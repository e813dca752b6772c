"""Company scores: 24 factors, six categories, weights, overall score and texts.

Everything is column arithmetic over one row, so a score run has no shuffle; only
the percentiles look at other companies (``windows.with_percentile``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.common import any_contains, first_hit, issues, non_zero, text_list
from jobloom.functions.levels import best_headcount, size_standard
from jobloom.functions.strings import has_social
from jobloom.operators import filters, windows

VERSION = "2025.1.0"
LISTS = ("technologies", "benefits", "company_values")

# Factors of the form: distinct keyword hits in lowered text / number of keywords * points, at most 10.
# The text is T technologies, B benefits, V values. (fixed values)
KEYWORD_FACTORS: dict[str, tuple[str, float, list[str]]] = {
    "dev_practices": ("V", 15, [
        "agile", "scrum", "ci/cd", "continuous integration", "testing", "code review", "pair programming", "tdd",
        "bdd", "devops", "automation"]),
    "tools": ("T", 12, [
        "github", "gitlab", "jenkins", "docker", "kubernetes", "aws", "azure", "monitoring", "logging", "metrics",
        "observability"]),
    "tech_culture": ("VB", 15, [
        "innovation", "learning", "growth", "technical excellence", "engineering", "open source", "conferences",
        "tech talks", "knowledge sharing"]),
    "culture_align": ("V", 12, [
        "collaboration", "teamwork", "respect", "diversity", "inclusion", "transparency", "integrity", "innovation",
        "learning", "growth"]),
    "work_env": ("V", 12, [
        "collaborative", "supportive", "inclusive", "friendly", "open", "creative", "innovative", "flexible",
        "positive"]),
    "leadership": ("V", 15, [
        "leadership", "vision", "mission", "strategy", "guidance", "mentorship", "coaching", "development",
        "empowerment"]),
    "transparency": ("V", 15, [
        "transparency", "open", "communication", "feedback", "honest", "clear", "straightforward", "direct"]),
    "career": ("B", 15, [
        "career", "advancement", "promotion", "growth", "development", "progression", "path", "opportunity",
        "leadership"]),
    "learning": ("B", 15, [
        "training", "education", "learning", "course", "certification", "conference", "workshop",
        "development budget", "skill development"]),
    "mentorship": ("B", 20, [
        "mentor", "mentoring", "mentorship", "coaching", "guidance", "buddy system", "onboarding",
        "senior developer"]),
    "skills": ("BV", 15, [
        "skill development", "learning", "training", "upskilling", "reskilling", "professional development",
        "tech talks", "hackathon"]),
    "equity": ("B", 20, [
        "equity", "stock options", "shares", "ownership", "profit sharing", "employee stock", "vesting", "RSU",
        "ESPP"]),
    "perks": ("B", 15, [
        "free lunch", "free breakfast", "snacks", "coffee", "kitchen", "gym", "fitness", "sports", "massage",
        "game room", "parking", "team building", "parties", "events", "office perks"]),
    "time_off": ("B", 15, [
        "vacation", "annual leave", "paid time off", "PTO", "holidays", "sabbatical", "unlimited vacation",
        "flexible time off"]),
    "wellness": ("B", 15, [
        "wellness", "mental health", "fitness", "gym", "health", "wellbeing", "mindfulness", "stress", "support",
        "counseling"]),
}

# fixed values
MODERN_TECHS = [
    "React", "Vue.js", "Angular", "Node.js", "TypeScript", "Go", "Rust", "Kotlin", "Swift", "Docker", "Kubernetes",
    "AWS", "Azure", "Google Cloud", "GraphQL", "PostgreSQL", "MongoDB", "Redis", "Elasticsearch", "Kafka",
    "microservices", "serverless",
]
CUTTING_EDGE_TECHS = ["Rust", "Go", "GraphQL", "Kubernetes", "serverless"]
ESSENTIAL_BENEFITS = [
    "health insurance", "dental", "life insurance", "disability insurance", "retirement", "pension", "401k",
]
PREMIUM_BENEFITS = [
    "additional health insurance", "supplemental insurance", "vision", "mental health", "wellness", "family coverage",
]
SALARY_WORDS = ["competitive salary", "market rate", "bonus", "equity", "stock options"]
FLEXIBLE_WORDS = [
    "flexible hours", "flexible working", "work from home", "remote work", "flexible schedule", "core hours",
    "flexi time",
]
LIGHT_LOAD_WORDS = ["work life balance", "reasonable hours", "no overtime"]
HEAVY_LOAD_WORDS = ["crunch", "long hours", "overtime", "demanding"]
HIGH_PAY_INDUSTRIES = ["Financial Technology", "Finance", "Tech", "Consulting"]
RISK_INDUSTRIES = ["Technology", "Software", "Social Media"]
STABLE_INDUSTRIES = ["Healthcare", "Finance", "Government"]

# category -> its four factors, in factor order (fixed values)
CATEGORIES: dict[str, list[str]] = {
    "developer_experience": ["tech_innovation", "dev_practices", "tools", "tech_culture"],
    "culture_values": ["culture_align", "work_env", "leadership", "transparency"],
    "growth": ["career", "learning", "mentorship", "skills"],
    "compensation": ["salary", "equity", "benefits_quality", "perks"],
    "work_life": ["flexibility", "time_off", "workload", "wellness"],
    "stability": ["finance", "market", "growth_path", "layoff"],
}
FACTORS = [f for group in CATEGORIES.values() for f in group]

# weights in category order, and what an industry or a size overrides (fixed values)
BASE_WEIGHTS = {
    "developer_experience": 0.25, "culture_values": 0.20, "growth": 0.20, "compensation": 0.15, "work_life": 0.15,
    "stability": 0.05,
}
INDUSTRY_WEIGHTS = {
    "Financial Technology": {"compensation": 0.20, "stability": 0.10},
    "Gaming": {"developer_experience": 0.30, "work_life": 0.10},
    "Consulting": {"growth": 0.25, "work_life": 0.10},
    "Healthcare": {"stability": 0.10, "culture_values": 0.25},
}
SIZE_WEIGHTS = {
    "startup": {"stability": 0.02, "growth": 0.25},
    "enterprise": {"stability": 0.10, "work_life": 0.20},
}

# factor -> (strength, concern) texts (fixed values)
TEXTS: dict[str, tuple[str, str]] = {
    "tech_innovation": (
        "Cutting-edge technology stack and modern development practices",
        "Limited use of modern technologies and development practices"),
    "dev_practices": (
        "Strong software development methodologies and processes",
        "Potential gaps in software development methodologies"),
    "tools": (
        "Excellent development tools and infrastructure",
        "Development tools and infrastructure may need improvement"),
    "tech_culture": (
        "Mature technical culture with focus on engineering excellence",
        "Technical culture and engineering practices could be enhanced"),
    "culture_align": (
        "Strong cultural values alignment with developer priorities",
        "Company culture may not fully align with developer values"),
    "work_env": (
        "Positive and collaborative work environment",
        "Work environment could be more collaborative or supportive"),
    "leadership": (
        "Strong leadership and clear company vision",
        "Leadership effectiveness or company vision may need strengthening"),
    "transparency": (
        "High level of transparency and open communication",
        "Communication transparency could be improved"),
    "career": (
        "Clear career advancement opportunities and growth paths",
        "Career advancement opportunities may be limited"),
    "learning": (
        "Excellent professional development and learning support",
        "Professional development support could be enhanced"),
    "mentorship": (
        "Strong mentorship programs and senior developer guidance",
        "Mentorship programs may be lacking or underdeveloped"),
    "skills": (
        "Outstanding opportunities for skill development and learning",
        "Skill development opportunities appear to be limited"),
    "salary": (
        "Highly competitive salary and compensation packages",
        "Compensation may not be competitive with market rates"),
    "equity": (
        "Attractive equity participation and ownership opportunities",
        "Limited equity or ownership participation opportunities"),
    "benefits_quality": (
        "Comprehensive and high-quality benefits package",
        "Benefits package may be basic or lacking key components"),
    "perks": (
        "Valuable workplace perks and additional benefits",
        "Workplace perks and additional benefits appear minimal"),
    "flexibility": (
        "Excellent work flexibility and remote work options",
        "Work flexibility and remote work options may be limited"),
    "time_off": (
        "Generous time off and vacation policies",
        "Time off and vacation policies could be more generous"),
    "workload": (
        "Healthy work-life balance with reasonable workload",
        "Workload management and work-life balance may be challenging"),
    "wellness": (
        "Strong focus on employee wellness and mental health",
        "Employee wellness and mental health support appears limited"),
    "finance": (
        "Excellent financial stability and business health",
        "Financial stability of the company may be a concern"),
    "market": (
        "Strong market position and industry recognition",
        "Market position and industry recognition could be stronger"),
    "growth_path": (
        "Positive growth trajectory and expansion opportunities",
        "Growth trajectory and future opportunities may be uncertain"),
    "layoff": (
        "Low layoff risk and high employment security",
        "Higher risk of layoffs or employment instability"),
}
ADVICE = {
    "tech_innovation": "Consider adopting more modern technologies and development practices",
    "learning": "Invest in professional development programs and learning opportunities",
    "flexibility": "Implement more flexible work arrangements and remote work options",
    "benefits_quality": "Enhance the benefits package to be more competitive",
    "culture_align": "Focus on building a stronger, more inclusive company culture",
}


def _clip(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), value))


def _hits(text: str, words: list[str]) -> Column:
    """How many of the words a text column holds, as one parsed expression."""
    return F.expr(" + ".join(f"int(contains({text}, '{word}'))" for word in words))


def _points(condition: Column, value: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)


def with_texts(inputs: DataFrame) -> DataFrame:
    """Lowered technologies, benefits and values, each joined by spaces, as columns T, B, V, VB and BV."""
    t, b, v = [F.lower(F.array_join(F.coalesce(F.col(c), text_list([])), " ")) for c in LISTS]
    return inputs.withColumns({"_T": t, "_B": b, "_V": v}).withColumns(
        {"_VB": F.concat_ws(" ", "_V", "_B"), "_BV": F.concat_ws(" ", "_B", "_V")}
    )


def _technologies_like(names: list[str]) -> Column:
    """Technologies that contain one of the names."""
    lowered = [n.lower() for n in names]
    test = " OR ".join(f"contains(lower(t), '{n}')" for n in lowered)
    return F.expr(f"size(filter(coalesce(technologies, array()), t -> {test}))")


def _in_industry(names: list[str]) -> Column:
    return any_contains(F.coalesce(F.col("industry"), F.lit("")), names)


def factor_columns(year: int) -> dict[str, Column]:
    """The 24 factors, each 0..10, over ``with_texts`` rows; ``year`` is the year of the run."""
    b = F.col("_B")
    out: dict[str, Column] = {}
    for name, (source, points, words) in KEYWORD_FACTORS.items():
        out[name] = F.least(F.lit(10.0), _hits(f"_{source}", words) / float(len(words)) * float(points))

    modern = F.least(F.lit(10.0), _technologies_like(MODERN_TECHS) / float(len(MODERN_TECHS)) * 20.0)
    out["tech_innovation"] = F.least(F.lit(10.0), modern + _technologies_like(CUTTING_EDGE_TECHS) * 0.5)
    events = [_points(b.contains(w), 1.0) for w in ("conference", "training", "certification")]
    out["tech_culture"] = F.least(F.lit(10.0), out["tech_culture"] + events[0] + events[1] + events[2])
    model, size = F.col("work_model"), F.col("size")
    out["work_env"] = F.least(F.lit(10.0), out["work_env"] + _points(model.isin("remote", "hybrid"), 1.0))
    big, startup = size.isin("large", "enterprise"), size == "startup"
    out["career"] = _clip(out["career"] + _points(big, 1.0) - _points(startup, 0.5))
    out["salary"] = _clip(
        6.0 + _points(_in_industry(HIGH_PAY_INDUSTRIES), 1.0) + _points(big, 1.0) - _points(startup, 0.5)
        + _hits("_B", SALARY_WORDS) * 0.5
    )
    out["equity"] = F.least(F.lit(10.0), out["equity"] + _points(startup & (out["equity"] > 0), 2.0))
    out["benefits_quality"] = F.least(
        F.lit(10.0),
        _hits("_B", ESSENTIAL_BENEFITS) / float(len(ESSENTIAL_BENEFITS)) * 6.0
        + _hits("_B", PREMIUM_BENEFITS) / float(len(PREMIUM_BENEFITS)) * 4.0,
    )
    out["flexibility"] = F.least(
        F.lit(10.0), 5.0 + _points(model == "remote", 3.0) + _points(model == "hybrid", 2.0) + _hits("_B", FLEXIBLE_WORDS) * 0.8
    )
    out["time_off"] = F.least(
        F.lit(10.0),
        out["time_off"] + _points(b.contains("25") | b.contains("30"), 1.0) + _points(b.contains("unlimited"), 2.0),
    )
    out["workload"] = _clip(7.0 + _hits("_BV", LIGHT_LOAD_WORDS) * 1.0 - _hits("_BV", HEAVY_LOAD_WORDS) * 2.0)

    age = F.coalesce(F.lit(year) - non_zero("founded"), F.lit(0))
    out["finance"] = _clip(
        6.0
        + first_hit((age >= 20, F.lit(2.0)), (age >= 10, F.lit(1.0)), (age >= 5, F.lit(0.5)), (age < 2, F.lit(-1.0)), otherwise=0.0)
        + first_hit((size == "enterprise", F.lit(2.0)), (size == "large", F.lit(1.0)), (startup, F.lit(-1.0)), otherwise=0.0)
    )
    heads = F.coalesce(F.col("employee_count"), F.lit(0))
    out["market"] = _clip(
        6.0
        + F.least(F.lit(2.0), F.coalesce("award_count", F.lit(0)) * 0.5)
        + first_hit((heads > 1000, F.lit(2.0)), (heads > 500, F.lit(1.0)), (heads > 100, F.lit(0.5)), otherwise=0.0)
    )
    jobs = F.col("job_openings")
    out["growth_path"] = _clip(
        6.0
        + first_hit((jobs > 10, F.lit(2.0)), (jobs > 5, F.lit(1.0)), (jobs > 0, F.lit(0.5)), otherwise=0.0)
        + first_hit((age.between(2, 7), F.lit(1.0)), (age < 2, F.lit(0.5)), otherwise=0.0)
    )
    out["layoff"] = _clip(
        7.0
        + first_hit((big, F.lit(1.0)), (startup, F.lit(-2.0)), otherwise=0.0)
        - _points(_in_industry(RISK_INDUSTRIES), 0.5)
        + _points(_in_industry(STABLE_INDUSTRIES), 0.5)
    )
    return {name: out[name] for name in FACTORS}


def with_factors(inputs: DataFrame, year: int, only: list[str] | None = None) -> DataFrame:
    """All factors, or the named ones, beside the input columns."""
    columns = {name: c for name, c in factor_columns(year).items() if only is None or name in only}
    return with_texts(inputs).withColumns(columns).drop("_T", "_B", "_V", "_VB", "_BV")


def category_columns() -> dict[str, Column]:
    """Means of four factors each."""

    def mean(names: list[str]) -> Column:
        a, b, c, d = [F.col(n) for n in names]
        return (a + b + c + d) / 4.0

    return {f"cat_{name}": mean(names) for name, names in CATEGORIES.items()}


def weight_columns() -> dict[str, Column]:
    """Base weights, overridden by industry and then by size, scaled to sum to 1."""
    raw = {}
    for name, base in BASE_WEIGHTS.items():
        rules = [(F.col("size") == s, F.lit(w[name])) for s, w in SIZE_WEIGHTS.items() if name in w]
        rules += [(F.col("industry") == i, F.lit(w[name])) for i, w in INDUSTRY_WEIGHTS.items() if name in w]
        raw[name] = first_hit(*rules, otherwise=base) if rules else F.lit(base)
    total = None
    for value in raw.values():
        total = value if total is None else total + value
    return {f"w_{name}": value * (1.0 / total) for name, value in raw.items()}


def weight_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The overrides as rows, for storing or editing: (industry, category, weight) and (size, category, weight)."""

    def rows(table: dict) -> list[tuple]:
        return [(k, c, w) for k, ws in table.items() for c, w in ws.items()]

    return (
        spark.createDataFrame(rows(INDUSTRY_WEIGHTS), "industry string, category string, weight double"),
        spark.createDataFrame(rows(SIZE_WEIGHTS), "size string, category string, weight double"),
    )


def overall_column() -> Column:
    total = None
    for name in CATEGORIES:
        part = F.col(f"cat_{name}") * F.col(f"w_{name}")
        total = part if total is None else total + part
    return F.floor(total * 10.0 + 0.5).cast("int")


def _named(keep: Callable[[Column], Column], descending: bool, which: int) -> Column:
    """Texts of up to five kept factors in score order, ties in factor order."""
    sign = -1.0 if descending else 1.0
    entries = F.array(
        *[
            F.when(keep(F.col(f)), F.struct((F.col(f) * sign).alias("s"), F.lit(i).alias("i"), F.lit(TEXTS[f][which]).alias("t")))
            for i, f in enumerate(FACTORS)
        ]
    )
    ranked = F.array_sort(F.filter(entries, lambda e: e.isNotNull()))
    return F.transform(F.slice(ranked, 1, 5), lambda e: e["t"])


def strengths() -> Column:
    return _named(lambda c: c >= 8, True, 0)


def concerns() -> Column:
    return _named(lambda c: c <= 5, False, 1)


def advice() -> Column:
    return issues(*[(F.col(f) < 6, text) for f, text in ADVICE.items()])


def confidence() -> Column:
    value = F.coalesce(F.col("data_completeness"), F.lit(0)) * 0.7 + F.coalesce(F.col("source_reliability"), F.lit(0)) * 0.3
    for name in LISTS:
        value = value + _points(F.size(F.col(name)) > 0, 5.0)
    return F.least(F.lit(100), F.floor(value + 0.5)).cast("int")


def data_sources(glassdoor: Column, linkedin: Column, github: Column) -> Column:
    """The sources that fed a score; a missing or zero figure is no source."""

    def used(value: Column) -> Column:
        return F.coalesce(value != 0, F.lit(False))

    return issues(
        (F.lit(True), "structured_extraction"), (used(glassdoor), "glassdoor"), (used(linkedin), "linkedin"), (used(github), "github")
    )


def overall_scores(inputs: DataFrame, year: int) -> DataFrame:
    """Factors, categories, weights and overall score of every input row."""
    scored = with_factors(inputs, year).withColumns({**category_columns(), **weight_columns()})
    return scored.withColumn("overall", overall_column())


def score(inputs: DataFrame, year: int) -> DataFrame:
    """The overall scores plus texts and confidence."""
    return overall_scores(inputs, year).withColumns(
        {
            "strengths": strengths(),
            "concerns": concerns(),
            "advice": advice(),
            "confidence": confidence(),
            "scoring_version": F.lit(VERSION),
        }
    )


def with_percentiles(scored: DataFrame) -> DataFrame:
    """Percent ranks of the overall score within industry and within size."""
    counts = windows.value_counts(scored, ["industry", "size"], "overall")
    ranked = scored
    for group in ("industry", "size"):
        ranked = windows.join_percentile(ranked, counts, [group], "overall", f"{group}_percentile")
    return ranked


def industry_benchmark(scored: DataFrame) -> DataFrame:
    """Sample size, mean and four percentiles per industry and factor, one row each.

    Factor scores take few distinct values, so the exact percentile keeps a small
    count map per industry and combines it on the map side.
    """
    points = F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9)])
    wide = scored.groupBy("industry").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(F.avg(f).alias("mean"), F.percentile(f, points).alias("p")).alias(f) for f in FACTORS],
    )
    long = wide.unpivot(["industry", "n"], FACTORS, "factor", "stat")
    return long.select(
        "industry", "factor", "n", F.col("stat.mean").alias("mean"),
        *[F.col("stat.p")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75", "p90"))],
    )


def industry_sketches(scored: DataFrame, day: Column, k: int = 200) -> DataFrame:
    """(industry, factor, day, n, total, sketch): quantile sketches of a factor's scores that merge over days."""
    wide = scored.groupBy("industry", day.alias("day")).agg(
        *[
            F.struct(F.count(f).alias("n"), F.sum(f).alias("total"), F.kll_sketch_agg_double(F.col(f).cast("double"), k).alias("sketch")).alias(f)
            for f in FACTORS
        ]
    )
    long = wide.unpivot(["industry", "day"], FACTORS, "factor", "stat")
    return long.select("industry", "factor", "day", "stat.n", "stat.total", "stat.sketch")


def industry_benchmark_of(sketches: DataFrame, k: int = 200) -> DataFrame:
    """``industry_benchmark`` over merged sketches. With ``k`` 200 a percentile is off by 1.7% of the ranks or less, at odds of 99 in 100.

    Size and mean are exact; a percentile is a score that occurs, without interpolation.
    """
    merged = sketches.groupBy("industry", "factor").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return merged.select(
        "industry", "factor", "n", (F.col("total") / F.col("n")).alias("mean"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in points.items()],
    )


def assemble_input(found: DataFrame) -> DataFrame:
    """Scoring input from extracted company facts and the reply beside them, with the usual defaults."""
    empty = text_list([])
    return found.select(
        "company_id",
        F.coalesce("reply_name", "name", F.lit("Unknown")).alias("name"),
        F.coalesce("reply_industry", "industry", F.lit("Technology")).alias("industry"),
        F.coalesce(F.col("reply_size"), size_standard("size"), F.lit("medium")).alias("size"),
        F.coalesce(non_zero("reply_founded"), F.col("founded")).alias("founded"),
        F.coalesce(non_zero("reply_employees"), best_headcount("heads_local", "heads_it", "heads_global")).alias("employee_count"),
        *[F.coalesce(F.col(c), empty).alias(c) for c in ("technologies", "benefits", "company_values", "awards")],
        F.size(F.coalesce(F.col("awards"), empty)).alias("award_count"),
        "work_model",
        F.coalesce("job_openings", F.lit(0)).alias("job_openings"),
        has_social("linkedin", "facebook", "twitter", "github").alias("social_presence"),
        F.when(F.col("website").isNotNull(), 7).alias("website_quality"),
        F.coalesce(non_zero("completeness"), F.lit(50)).alias("data_completeness"),
        F.lit(85).alias("source_reliability"),
    )


def to_analysis(scored: DataFrame) -> DataFrame:
    """Analysis columns from a score, else from the reply beside it; a score of 0 counts as absent."""

    def pick(value: Column, fallback: str) -> Column:
        return F.coalesce(non_zero(value), non_zero(fallback))

    return scored.select(
        "company_id",
        pick(F.col("overall") / 10.0, "reply_recommendation").alias("recommendation_score"),
        pick(F.col("cat_culture_values"), "reply_culture").alias("culture_score"),
        pick(F.col("cat_work_life"), "reply_work_life").alias("work_life_balance"),
        pick(F.col("cat_growth"), "reply_career").alias("career_growth"),
        pick(F.col("cat_compensation"), "reply_salary").alias("salary_competitiveness"),
        pick(F.col("benefits_quality"), "reply_benefits").alias("benefits_score"),
        pick(F.col("cat_developer_experience"), "reply_tech").alias("tech_culture"),
        pick(F.col("layoff") * 10.0, "reply_retention").alias("retention_rate"),
        F.to_json(F.coalesce("reply_pros", "strengths")).alias("pros"),
        F.to_json(F.coalesce("reply_cons", "concerns")).alias("cons"),
        F.coalesce(non_zero("confidence"), F.col("reply_confidence"), F.lit(0)).alias("confidence_score"),
    )


# ---- vacancies against a reader's preferences ----

PREFERENCE_WEIGHTS = {"salary": 0.3, "tech": 0.4, "company": 0.2, "location": 0.1}


def vacancy_scores(
    vacancies: DataFrame,
    vacancy_tech: DataFrame,
    analyses: DataFrame,
    wanted: list[str],
    location: str,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Preference-weighted scores, each part 0..100.

    Salary is the percent rank of the minimum salary, technology the share of wanted
    ones named, company the newest analysis times 10, location a text match.
    """
    w = {**PREFERENCE_WEIGHTS, **(weights or {})}
    hits = filters.technology_hits(vacancy_tech, wanted)
    latest = windows.latest_analysis(analyses, "recommendation_score").select("company_id", "recommendation_score")
    rows = windows.with_percentile(filters.active(vacancies), [], "salary_min", "salary_part")
    rows = rows.join(hits, "vacancy_id", "left").join(latest, "company_id", "left")
    zero = F.lit(0.0)
    parts = rows.withColumns(
        {
            "salary_part": F.coalesce("salary_part", zero),
            "tech_part": F.coalesce(F.col("n_hits") / float(len(wanted)) * 100.0, zero),
            "company_part": F.coalesce(F.col("recommendation_score") * 10.0, zero),
            "location_part": F.when(F.lower("location").contains(location.lower()), 100.0).otherwise(0.0),
        }
    )
    total = (
        F.col("salary_part") * w["salary"]
        + F.col("tech_part") * w["tech"]
        + F.col("company_part") * w["company"]
        + F.col("location_part") * w["location"]
    )
    return parts.withColumn("score", total)


def register_preference_score(spark: SparkSession, name: str = "vacancy_preference_score") -> str:
    """The weighting as a SQL function over the four parts and a JSON text of weights, for use in queries."""

    def weight(key: str, default: float) -> str:
        return f"coalesce(try_cast(get_json_object(preferences, '$.{key}') AS double), {default}D)"

    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(
          salary double, tech double, company double, location double, preferences string DEFAULT '{{}}')
        RETURNS double
        RETURN salary * {weight('salaryWeight', 0.3)} + tech * {weight('techMatchWeight', 0.4)}
          + company * {weight('companyWeight', 0.2)} + location * {weight('locationWeight', 0.1)}"""
    )
    return name

