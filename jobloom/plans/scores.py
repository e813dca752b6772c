"""Queries of the scoring group and the percentile windows over scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions.common import half_up
from jobloom.operators import scoring as S
from jobloom.operators import windows
from jobloom.plans.registry import plan
from jobloom.plans.relational import ACTIVE, LATEST, r4, sql_r4
from jobloom.sources.inputs import view

YEAR = 2024

# ---- the same scores in SQL ----

TEXT_SQL = {"T": "tt", "B": "bt", "V": "vt", "VB": "vt || ' ' || bt", "BV": "bt || ' ' || vt"}
BASE_SQL = """(SELECT *, lower(array_to_string(technologies, ' ')) AS tt, lower(array_to_string(benefits, ' ')) AS bt,
    lower(array_to_string(company_values, ' ')) AS vt, CASE WHEN coalesce(founded, 0) = 0 THEN 0 ELSE 2024 - founded END AS age FROM scoring_inputs)"""


def hits_sql(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


def keyword_sql(name: str) -> str:
    source, points, words = S.KEYWORD_FACTORS[name]
    return f"least(10.0, {hits_sql(TEXT_SQL[source], words)} / {len(words)}.0E0 * {points}.0E0)"


def named_sql(names: list[str]) -> str:
    test = " OR ".join(f"contains(lower(t), '{n.lower()}')" for n in names)
    return f"len(list_filter(technologies, lambda t: {test}))"


def industry_sql(names: list[str]) -> str:
    return "(" + " OR ".join(f"contains(industry, '{n}')" for n in names) + ")"


def yes(condition: str, points: float) -> str:
    return f"CASE WHEN {condition} THEN {points}E0 ELSE 0.0E0 END"


BIG = "size IN ('large', 'enterprise')"


def factor_sql() -> dict[str, str]:
    k = {n: keyword_sql(n) for n in S.KEYWORD_FACTORS}
    out = dict(k)
    out["tech_innovation"] = (
        f"least(10.0, least(10.0, {named_sql(S.MODERN_TECHS)} / 22.0E0 * 20.0E0) + {named_sql(S.CUTTING_EDGE_TECHS)} * 0.5E0)"
    )
    out["tech_culture"] = (
        f"least(10.0, {k['tech_culture']} + {yes(chr(40) + 'contains(bt, ' + chr(39) + 'conference' + chr(39) + '))', 1.0)}"
        f" + {yes('contains(bt, ' + chr(39) + 'training' + chr(39) + ')', 1.0)} + {yes('contains(bt, ' + chr(39) + 'certification' + chr(39) + ')', 1.0)})"
    )
    model = "work_model IN ('remote', 'hybrid')"
    out["work_env"] = f"least(10.0, {k['work_env']} + {yes(model, 1.0)})"
    startup = "size = 'startup'"
    out["career"] = f"greatest(0.0, least(10.0, {k['career']} + {yes(BIG, 1.0)} - {yes(startup, 0.5)}))"
    out["salary"] = (
        f"greatest(0.0, least(10.0, 6.0E0 + {yes(industry_sql(S.HIGH_PAY_INDUSTRIES), 1.0)} + {yes(BIG, 1.0)} - {yes(startup, 0.5)}"
        f" + {hits_sql('bt', S.SALARY_WORDS)} * 0.5E0))"
    )
    out["equity"] = f"least(10.0, {k['equity']} + {yes(startup + ' AND ' + k['equity'] + ' > 0', 2.0)})"
    out["benefits_quality"] = (
        f"least(10.0, {hits_sql('bt', S.ESSENTIAL_BENEFITS)} / 7.0E0 * 6.0E0 + {hits_sql('bt', S.PREMIUM_BENEFITS)} / 6.0E0 * 4.0E0)"
    )
    remote, hybrid = "work_model = 'remote'", "work_model = 'hybrid'"
    out["flexibility"] = f"least(10.0, 5.0E0 + {yes(remote, 3.0)} + {yes(hybrid, 2.0)} + {hits_sql('bt', S.FLEXIBLE_WORDS)} * 0.8E0)"
    days, unlimited = "(contains(bt, '25') OR contains(bt, '30'))", "contains(bt, 'unlimited')"
    out["time_off"] = f"least(10.0, {k['time_off']} + {yes(days, 1.0)} + {yes(unlimited, 2.0)})"
    both = "bt || ' ' || vt"
    out["workload"] = f"greatest(0.0, least(10.0, 7.0E0 + {hits_sql(both, S.LIGHT_LOAD_WORDS)} * 1.0E0 - {hits_sql(both, S.HEAVY_LOAD_WORDS)} * 2.0E0))"
    out["finance"] = """greatest(0.0, least(10.0, 6.0E0 + CASE WHEN age >= 20 THEN 2.0E0 WHEN age >= 10 THEN 1.0E0 WHEN age >= 5 THEN 0.5E0 WHEN age < 2 THEN -1.0E0
      ELSE 0.0E0 END + CASE size WHEN 'enterprise' THEN 2.0E0 WHEN 'large' THEN 1.0E0 WHEN 'startup' THEN -1.0E0 ELSE 0.0E0 END))"""
    out["market"] = """greatest(0.0, least(10.0, 6.0E0 + least(2.0E0, award_count * 0.5E0) + CASE WHEN employee_count > 1000 THEN 2.0E0
      WHEN employee_count > 500 THEN 1.0E0 WHEN employee_count > 100 THEN 0.5E0 ELSE 0.0E0 END))"""
    out["growth_path"] = """greatest(0.0, least(10.0, 6.0E0 + CASE WHEN job_openings > 10 THEN 2.0E0 WHEN job_openings > 5 THEN 1.0E0 WHEN job_openings > 0
      THEN 0.5E0 ELSE 0.0E0 END + CASE WHEN age BETWEEN 2 AND 7 THEN 1.0E0 WHEN age < 2 THEN 0.5E0 ELSE 0.0E0 END))"""
    out["layoff"] = (
        f"greatest(0.0, least(10.0, 7.0E0 + CASE WHEN {BIG} THEN 1.0E0 WHEN size = 'startup' THEN -2.0E0 ELSE 0.0E0 END"
        f" - {yes(industry_sql(S.RISK_INDUSTRIES), 0.5)} + {yes(industry_sql(S.STABLE_INDUSTRIES), 0.5)}))"
    )
    return {f: out[f] for f in S.FACTORS}


FACTOR_SQL = factor_sql()


def weight_sql(name: str) -> str:
    whens = [f"WHEN size = '{s}' THEN {w[name]}E0" for s, w in S.SIZE_WEIGHTS.items() if name in w]
    whens += [f"WHEN industry = '{i}' THEN {w[name]}E0" for i, w in S.INDUSTRY_WEIGHTS.items() if name in w]
    base = f"{S.BASE_WEIGHTS[name]}E0"
    return f"CASE {' '.join(whens)} ELSE {base} END" if whens else base


FACTORS_SQL = f"(SELECT *, {', '.join(f'{e} AS {f}' for f, e in FACTOR_SQL.items())} FROM {BASE_SQL} b)"
CATEGORY_SQL = ", ".join(f"({' + '.join(fs)}) / 4.0E0 AS cat_{c}" for c, fs in S.CATEGORIES.items())
RAW_SQL = ", ".join(f"{weight_sql(c)} AS raw_{c}" for c in S.CATEGORIES)
RAW_SUM = " + ".join(f"raw_{c}" for c in S.CATEGORIES)
WEIGHT_SQL = ", ".join(f"raw_{c} * (1.0E0 / ({RAW_SUM})) AS w_{c}" for c in S.CATEGORIES)
SCORED_SQL = f"""(SELECT *, CAST(floor(({' + '.join(f'cat_{c} * w_{c}' for c in S.CATEGORIES)}) * 10.0E0 + 0.5E0) AS INT) AS overall
    FROM (SELECT *, {WEIGHT_SQL} FROM (SELECT *, {CATEGORY_SQL}, {RAW_SQL} FROM {FACTORS_SQL} f) c) w)"""


def scored(spark, d):
    return S.score(view(spark, d, "scoring_inputs"), YEAR)


def overall(spark, d):
    return S.overall_scores(view(spark, d, "scoring_inputs"), YEAR)


def register_factor(key: str, factor: str) -> None:
    @plan(key, f"SELECT company_id, {sql_r4(FACTOR_SQL[factor])} AS score FROM {BASE_SQL} b")
    def run(spark, d):
        rows = S.with_factors(view(spark, d, "scoring_inputs"), YEAR, only=[factor])
        return rows.select("company_id", r4(factor).alias("score"))


KEYS = {"benefits_quality": "fac_benefits", "growth_path": "fac_growth"}
for factor_name in S.FACTORS:
    register_factor(KEYS.get(factor_name, f"fac_{factor_name}"), factor_name)


@plan("sc_factors", f"SELECT company_id, {', '.join(f'{sql_r4(f)} AS {f}' for f in S.FACTORS)} FROM {FACTORS_SQL} f")
def sc_factors(spark, d):
    rows = S.with_factors(view(spark, d, "scoring_inputs"), YEAR)
    return rows.select("company_id", *[r4(f).alias(f) for f in S.FACTORS])


@plan("sc_categories", f"SELECT company_id, {', '.join(f'{sql_r4(f'cat_{c}')} AS cat_{c}' for c in S.CATEGORIES)} FROM {SCORED_SQL} s")
def sc_categories(spark, d):
    rows = S.with_factors(view(spark, d, "scoring_inputs"), YEAR).withColumns(S.category_columns())
    return rows.select("company_id", *[r4(f"cat_{c}").alias(f"cat_{c}") for c in S.CATEGORIES])


@plan("sc_weights", f"SELECT company_id, {', '.join(f'{sql_r4(f'w_{c}')} AS w_{c}' for c in S.CATEGORIES)} FROM {SCORED_SQL} s")
def sc_weights(spark, d):
    rows = view(spark, d, "scoring_inputs").withColumns(S.weight_columns())
    return rows.select("company_id", *[r4(f"w_{c}").alias(f"w_{c}") for c in S.CATEGORIES])


@plan("sc_overall", f"SELECT company_id, overall FROM {SCORED_SQL} s")
def sc_overall(spark, d):
    return overall(spark, d).select("company_id", "overall")


def ranked_sql(keep: str, direction: str, which: int) -> str:
    rows = " UNION ALL ".join(
        f"SELECT company_id, {i} AS i, {f} AS s, '{S.TEXTS[f][which]}' AS t FROM s WHERE {f} {keep}" for i, f in enumerate(S.FACTORS)
    )
    return f"""(SELECT company_id, string_agg(t, '; ' ORDER BY rn) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY company_id
      ORDER BY s {direction}, i) AS rn FROM ({rows}) u) q WHERE rn <= 5 GROUP BY 1)"""


def register_texts(key: str, column: str, keep: str, direction: str, which: int) -> None:
    @plan(
        key,
        f"""WITH s AS (SELECT * FROM {FACTORS_SQL} f) SELECT s.company_id, coalesce(t.texts, '') AS texts FROM s
        LEFT JOIN {ranked_sql(keep, direction, which)} t ON t.company_id = s.company_id""",
    )
    def run(spark, d):
        return scored(spark, d).select("company_id", F.array_join(column, "; ").alias("texts"))


register_texts("sc_strengths", "strengths", ">= 8", "DESC", 0)
register_texts("sc_concerns", "concerns", "<= 5", "ASC", 1)


@plan(
    "sc_recommend",
    f"""SELECT company_id, concat_ws('; ', {', '.join(f"CASE WHEN {f} < 6 THEN '{t}' END" for f, t in S.ADVICE.items())}) AS texts FROM {FACTORS_SQL} f""",
)
def sc_recommend(spark, d):
    return scored(spark, d).select("company_id", F.array_join("advice", "; ").alias("texts"))


@plan(
    "sc_confidence",
    "SELECT company_id, CAST(least(100, floor(data_completeness * 0.7E0 + source_reliability * 0.3E0 + 5.0E0 + 5.0E0 + 5.0E0 + 0.5E0)) AS INT) AS confidence FROM scoring_inputs",
)
def sc_confidence(spark, d):
    return view(spark, d, "scoring_inputs").select("company_id", S.confidence().alias("confidence"))


@plan(
    "sc_sources",
    """SELECT company_id, concat_ws(',', 'structured_extraction', CASE WHEN award_count > 0 THEN 'glassdoor' END,
    CASE WHEN employee_count > 0 THEN 'linkedin' END, CASE WHEN job_openings > 0 THEN 'github' END) AS sources FROM scoring_inputs""",
)
def sc_sources(spark, d):
    sources = S.data_sources(F.col("award_count"), F.col("employee_count"), F.col("job_openings"))
    return view(spark, d, "scoring_inputs").select("company_id", F.array_join(sources, ",").alias("sources"))


def found_facts(spark, d):
    """Extracted company facts beside a reply, as the page queries give them."""
    c = view(spark, d, "scoring_inputs")
    even = F.col("company_id") % 2 == 0
    null = F.lit(None)
    return c.select(
        "company_id",
        F.when(~even, F.concat(F.lit("Reply "), "name")).alias("reply_name"),
        F.when(F.col("company_id") % 9 != 0, F.col("name")).alias("name"),
        null.cast("string").alias("reply_industry"),
        F.when(even, F.col("industry")).alias("industry"),
        F.when(F.col("company_id") % 3 == 0, "large").alias("reply_size"),
        "size",
        F.lit(0).alias("reply_founded"),
        "founded",
        F.when(even, 0).alias("reply_employees"),
        F.col("job_openings").alias("heads_local"),
        null.cast("int").alias("heads_it"),
        F.col("employee_count").alias("heads_global"),
        "technologies",
        F.when(even, F.col("benefits")).alias("benefits"),
        "company_values",
        F.transform(F.sequence(F.lit(1), F.col("award_count") + 1), lambda i: F.concat(F.lit("Award "), i.cast("string"))).alias("awards"),
        "work_model",
        "job_openings",
        F.when(even, "https://linkedin.com/x").alias("linkedin"),
        F.lit("").alias("facebook"),
        null.cast("string").alias("twitter"),
        null.cast("string").alias("github"),
        F.when(even, "https://x.example.org").alias("website"),
        F.when(even, F.col("data_completeness")).alias("completeness"),
    )


@plan(
    "sc_input",
    """SELECT company_id, CASE WHEN company_id % 2 <> 0 THEN 'Reply ' || name WHEN company_id % 9 <> 0 THEN name ELSE 'Unknown' END AS name,
    CASE WHEN company_id % 2 = 0 THEN industry ELSE 'Technology' END AS industry, CASE WHEN company_id % 3 = 0 THEN 'large' ELSE size END AS size,
    founded, coalesce(nullif(job_openings, 0), nullif(employee_count, 0)) AS employee_count, len(technologies) AS n_tech,
    CASE WHEN company_id % 2 = 0 THEN len(benefits) ELSE 0 END AS n_benefits, award_count + 1 AS award_count, company_id % 2 = 0 AS social_presence,
    CASE WHEN company_id % 2 = 0 THEN 7 END AS website_quality,
    CASE WHEN company_id % 2 = 0 THEN coalesce(nullif(data_completeness, 0), 50) ELSE 50 END AS data_completeness, 85 AS source_reliability FROM scoring_inputs""",
)
def sc_input(spark, d):
    rows = S.assemble_input(found_facts(spark, d))
    return rows.select(
        "company_id", "name", "industry", "size", "founded", "employee_count", F.size("technologies").alias("n_tech"),
        F.size("benefits").alias("n_benefits"), "award_count", "social_presence", "website_quality", "data_completeness", "source_reliability",
    )


@plan(
    "sc_to_analysis",
    f"""SELECT company_id, {sql_r4('nullif(overall / 10.0E0, 0)')} AS recommendation_score, {sql_r4('nullif(cat_culture_values, 0)')} AS culture_score,
    {sql_r4('coalesce(nullif(cat_compensation, 0), 5.0)')} AS salary_competitiveness, {sql_r4('coalesce(nullif(benefits_quality, 0), 5.0)')} AS benefits_score,
    {sql_r4('nullif(layoff * 10.0E0, 0)')} AS retention_rate, CASE WHEN company_id % 2 = 0 THEN '["Pay"]' END AS given_pros,
    CAST(least(100, floor(data_completeness * 0.7E0 + source_reliability * 0.3E0 + 15.5E0)) AS INT) AS confidence_score FROM {SCORED_SQL} s""",
)
def sc_to_analysis(spark, d):
    null = F.lit(None).cast("double")
    even = F.col("company_id") % 2 == 0
    rows = scored(spark, d).withColumns(
        {
            **{f"reply_{n}": null for n in ("recommendation", "culture", "work_life", "career", "tech", "retention")},
            "reply_salary": F.lit(5.0),
            "reply_benefits": F.lit(5.0),
            "reply_pros": F.when(even, F.array(F.lit("Pay"))),
            "reply_cons": F.lit(None).cast("array<string>"),
            "reply_confidence": F.lit(0),
        }
    )
    out = S.to_analysis(rows)
    return out.select(
        "company_id", *[r4(c).alias(c) for c in ("recommendation_score", "culture_score", "salary_competitiveness", "benefits_score", "retention_rate")],
        F.when(F.col("company_id") % 2 == 0, F.col("pros")).alias("given_pros"), "confidence_score",
    )


PCT = "CASE WHEN count(*) OVER (PARTITION BY {g}) > 1 THEN (rank() OVER (PARTITION BY {g} ORDER BY overall) - 1) / CAST(count(*) OVER (PARTITION BY {g}) - 1 AS DOUBLE) * 100 ELSE 0.0 END"


@plan(
    "sc_company",
    f"""SELECT company_id, overall, {', '.join(f'{sql_r4(f'cat_{c}')} AS cat_{c}' for c in S.CATEGORIES)},
    {sql_r4(PCT.format(g='industry'))} AS industry_percentile, {sql_r4(PCT.format(g='size'))} AS size_percentile,
    concat_ws('; ', {', '.join(f"CASE WHEN {f} < 6 THEN '{t}' END" for f, t in S.ADVICE.items())}) AS advice FROM {SCORED_SQL} s""",
)
def sc_company(spark, d):
    rows = S.with_percentiles(scored(spark, d))
    return rows.select(
        "company_id", "overall", *[r4(f"cat_{c}").alias(f"cat_{c}") for c in S.CATEGORIES],
        r4("industry_percentile").alias("industry_percentile"), r4("size_percentile").alias("size_percentile"),
        F.array_join("advice", "; ").alias("advice"),
    )


def register_percentile(key: str, group: str) -> None:
    @plan(key, f"SELECT company_id, {group}, overall, {sql_r4(PCT.format(g=group))} AS percentile FROM {SCORED_SQL} s")
    def run(spark, d):
        rows = windows.with_percentile(overall(spark, d).select("company_id", group, "overall"), [group], "overall", "percentile")
        return rows.withColumn("percentile", r4("percentile"))


register_percentile("win_industry_pct", "industry")
register_percentile("win_size_pct", "size")

RANK = "CAST(rank() OVER (PARTITION BY {g} ORDER BY overall DESC) AS VARCHAR) || ' of ' || CAST(count(*) OVER (PARTITION BY {g}) AS VARCHAR)"


@plan(
    "win_peer_rank",
    f"SELECT company_id, {RANK.format(g='industry')} AS industry_rank, {RANK.format(g='size')} AS size_rank FROM {SCORED_SQL} s",
)
def win_peer_rank(spark, d):
    rows = overall(spark, d).select("company_id", "industry", "size", "overall")
    ranked = windows.with_peer_rank(rows, {"industry": "industry_rank", "size": "size_rank"}, "overall")
    return ranked.select("company_id", "industry_rank", "size_rank")


BENCH = " UNION ALL ".join(
    f"""SELECT industry, '{f}' AS factor, count(*) AS n, {sql_r4(f'avg({f})')} AS mean, {sql_r4(f'quantile_cont({f}, 0.25)')} AS p25,
    {sql_r4(f'quantile_cont({f}, 0.5)')} AS p50, {sql_r4(f'quantile_cont({f}, 0.75)')} AS p75, {sql_r4(f'quantile_cont({f}, 0.9)')} AS p90 FROM s GROUP BY 1"""
    for f in S.FACTORS
)


@plan("agg_industry_bench", f"WITH s AS (SELECT * FROM {FACTORS_SQL} f) {BENCH}")
def agg_industry_bench(spark, d):
    rows = S.industry_benchmark(S.with_factors(view(spark, d, "scoring_inputs"), YEAR))
    return rows.withColumns({c: r4(c) for c in ("mean", "p25", "p50", "p75", "p90")})


WANTED = ["java", "kafka", "docker"]
PARTS_SQL = f"""(SELECT v.vacancy_id, coalesce(p.pct, 0.0) AS salary_part, coalesce(h.n / 3.0E0 * 100.0E0, 0.0) AS tech_part,
      coalesce(a.recommendation_score * 10.0E0, 0.0) AS company_part, CASE WHEN contains(lower(v.location), 'sofia') THEN 100.0E0 ELSE 0.0E0 END AS location_part
    FROM vacancies v LEFT JOIN (SELECT vacancy_id, percent_rank() OVER (ORDER BY salary_min) * 100 AS pct FROM vacancies WHERE {ACTIVE} AND salary_min IS NOT NULL) p
      ON p.vacancy_id = v.vacancy_id
    LEFT JOIN (SELECT vacancy_id, count(DISTINCT tech) AS n FROM vacancy_tech WHERE tech IN ('java', 'kafka', 'docker') GROUP BY 1) h ON h.vacancy_id = v.vacancy_id
    LEFT JOIN {LATEST.format(where='WHERE recommendation_score IS NOT NULL')} a ON a.company_id = v.company_id WHERE {ACTIVE})"""


@plan(
    "sc_vacancy",
    f"""SELECT vacancy_id, {sql_r4('salary_part')} AS salary_part, {sql_r4('tech_part')} AS tech_part, {sql_r4('company_part')} AS company_part, location_part,
    floor((salary_part * 0.3E0 + tech_part * 0.4E0 + company_part * 0.2E0 + location_part * 0.1E0) * 100.0 + 0.5) / 100.0 AS score FROM {PARTS_SQL} p""",
)
def sc_vacancy(spark, d):
    rows = S.vacancy_scores(
        view(spark, d, "vacancy_facts"), view(spark, d, "vacancy_tech"), view(spark, d, "company_analyses"), WANTED, "sofia"
    )
    return rows.select(
        "vacancy_id", *[r4(c).alias(c) for c in ("salary_part", "tech_part", "company_part")], "location_part", half_up("score", 2).alias("score")
    )


@plan(
    "rg_score_fn",
    f"""SELECT vacancy_id, floor((salary_part * 0.3E0 + tech_part * 0.4E0 + company_part * 0.2E0 + location_part * 0.1E0) * 100.0 + 0.5) / 100.0 AS default_score,
    floor((salary_part * 0.6E0 + tech_part * 0.4E0 + company_part * 0.2E0 + location_part * 0.1E0) * 100.0 + 0.5) / 100.0 AS pay_score FROM {PARTS_SQL} p""",
)
def rg_score_fn(spark, d):
    function = S.register_preference_score(spark)
    rows = S.vacancy_scores(
        view(spark, d, "vacancy_facts"), view(spark, d, "vacancy_tech"), view(spark, d, "company_analyses"), WANTED, "sofia"
    )
    parts = "salary_part, tech_part, company_part, location_part"
    return rows.select(
        "vacancy_id",
        half_up(F.expr(f"{function}({parts})"), 2).alias("default_score"),
        half_up(F.expr(f"{function}({parts}, '{{\"salaryWeight\": 0.6}}')"), 2).alias("pay_score"),
    )
