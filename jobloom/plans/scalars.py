"""Queries of the scalar groups: strings, salaries, levels, dates, JSON, arrays, hashes, URLs, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import arrays, dates, hashes, jsons, levels, registries, rules, salaries, strings, urls
from jobloom.functions.common import moment
from jobloom.plans.registry import plan
from jobloom.plans.relational import AGE, AS_OF, RECOMMEND, VACANCY_AS_OF
from jobloom.sources.inputs import load, spread, view


def scalar(key: str, source: str, row: str, sql: str, make: Callable[[], Column], out: str = "value"):
    """One expression over every row of a view, beside the row's key."""

    @plan(key, f"SELECT {row}, {sql} AS {out} FROM {source}")
    def run(spark, d):
        return view(spark, d, source).select(row, make().alias(out))

    return run


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case(table: dict, value: str, default: str = "NULL") -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def contains_any(text: str, needles) -> str:
    escaped = [n.replace("'", "''") for n in needles]
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in escaped) + ")"


def in_range(text: str, span: str) -> str:
    return f"regexp_matches({text}, '(^|[^0-9]){span}([^0-9]|$)')"


# ---- strings ----

terms = "title"
for bulgarian, english in rules.JOB_TERMS.items():
    terms = f"regexp_replace({terms}, '{bulgarian}', '{english}', 'gi')"
scalar("str_job_terms", "cards", "card_id", terms, lambda: strings.job_terms("title"))
scalar("str_location", "vacancies", "vacancy_id", case(rules.LOCATIONS, "location", "location"), lambda: strings.location("location"))
scalar("str_work_model", "cards", "card_id", case(rules.WORK_MODELS, "model_text", "'on-site'"), lambda: strings.work_model("model_text"))
scalar(
    "str_badge_model", "cards", "card_id",
    "CASE WHEN contains(lower(badge), 'remote') OR contains(lower(badge), 'дистанционно') THEN 'remote' "
    "WHEN contains(lower(badge), 'hybrid') OR contains(lower(badge), 'хибридно') THEN 'hybrid' ELSE 'on-site' END",
    lambda: strings.badge_model("badge"),
)
first_line = "list_filter(list_transform(string_split(badge, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1]"
scalar(
    "str_badge_location", "cards", "card_id",
    f"coalesce({case(rules.LOCATIONS, first_line, first_line)}, 'Bulgaria')",
    lambda: strings.badge_location("badge"),
)
MIN = "CAST(nullif(regexp_extract(salary_range, '(\\d+)', 1), '') AS BIGINT) * 100"
scalar("sal_min", "cards", "card_id", MIN, lambda: salaries.range_min("salary_range"))
scalar(
    "sal_max", "cards", "card_id",
    f"coalesce(CAST(nullif(regexp_extract(salary_range, '\\d+\\D+(\\d+)', 1), '') AS BIGINT) * 100, {MIN})",
    lambda: salaries.range_max("salary_range"),
)


def amount(name: str, group: int) -> str:
    pattern = salaries.PATTERNS[name]
    return f"TRY_CAST(regexp_replace(regexp_extract(t, '{pattern}', {group}, 'i'), '[\\s,]', '', 'g') AS INT)"


@plan(
    "sal_extract",
    f"""WITH p AS (SELECT card_id, regexp_replace(regexp_replace(salary_html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM cards),
    a AS (SELECT card_id, {amount('range', 1)} AS lo1, {amount('range', 2)} AS hi1, {amount('from_to', 1)} AS lo2, {amount('from_to', 2)} AS hi2,
      {amount('up_to', 1)} AS hi3, {amount('up_to_bg', 1)} AS hi4 FROM p)
    SELECT card_id, CASE WHEN lo1 > 0 OR hi1 > 0 THEN lo1 WHEN lo2 > 0 OR hi2 > 0 THEN lo2 END AS salary_min,
    CASE WHEN lo1 > 0 OR hi1 > 0 THEN hi1 WHEN lo2 > 0 OR hi2 > 0 THEN hi2 WHEN hi3 > 0 THEN hi3 WHEN hi4 > 0 THEN hi4 END AS salary_max,
    CASE WHEN coalesce(nullif(lo1, 0), nullif(hi1, 0), nullif(lo2, 0), nullif(hi2, 0), nullif(hi3, 0), nullif(hi4, 0)) IS NOT NULL THEN 'BGN' END AS currency
    FROM a""",
)
def sal_extract(spark, d):
    cards = spread(view(spark, d, "cards").select("card_id", "salary_html"))
    found = salaries.with_page_salary(cards, "salary_html", "s")
    return found.select(
        "card_id", F.col("s.min").alias("salary_min"), F.col("s.max").alias("salary_max"), F.col("s.currency").alias("currency")
    )


scalar(
    "lvl_from_title", "cards", "card_id",
    f"CASE WHEN {contains_any('lower(title)', ['senior', 'lead', 'principal'])} THEN 'senior' "
    f"WHEN {contains_any('lower(title)', ['junior', 'graduate', 'entry'])} THEN 'junior' ELSE 'mid' END",
    lambda: levels.experience_from_title("title"),
)
scalar(
    "emp_from_model", "cards", "card_id",
    "CASE lower(model_text) WHEN 'part-time' THEN 'part-time' WHEN 'contract' THEN 'contract' WHEN 'internship' THEN 'internship' ELSE 'full-time' END",
    lambda: levels.employment_from_model("model_text"),
)


def short(x: str) -> str:
    return f"CASE WHEN {x} >= 1000 THEN CAST(CAST(floor({x} / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'k' ELSE CAST({x} AS VARCHAR) END"


SYMBOL = "CASE currency WHEN 'EUR' THEN '€' WHEN 'USD' THEN '$' ELSE currency END"
scalar(
    "str_salary", "vacancies", "vacancy_id",
    f"""CASE WHEN nullif(salary_min, 0) IS NOT NULL AND nullif(salary_max, 0) IS NOT NULL THEN {SYMBOL} || {short('salary_min')} || '-' || {short('salary_max')}
    WHEN nullif(salary_min, 0) IS NOT NULL THEN 'From ' || {SYMBOL} || {short('salary_min')}
    WHEN nullif(salary_max, 0) IS NOT NULL THEN 'Up to ' || {SYMBOL} || {short('salary_max')} ELSE 'Competitive' END""",
    lambda: levels.salary_text("salary_min", "salary_max", "currency"),
)
scalar(
    "lvl_quality", "vacancies", "vacancy_id",
    "CASE WHEN extraction_confidence >= 70 THEN 'high' WHEN extraction_confidence >= 50 THEN 'medium' ELSE 'low' END",
    lambda: levels.quality("extraction_confidence"),
)
scalar(
    "lvl_score", "vacancies", "vacancy_id",
    "CASE WHEN quality_score >= 80 THEN 'excellent' WHEN quality_score >= 60 THEN 'good' WHEN quality_score >= 40 THEN 'average' "
    "WHEN quality_score >= 20 THEN 'below-average' ELSE 'poor' END",
    lambda: levels.score_level("quality_score"),
)
scalar("lvl_recommend", "company_analyses", "analysis_id", RECOMMEND.format(s="recommendation_score"), lambda: levels.recommendation("recommendation_score"))
scalar(
    "lvl_work_bucket", "cards", "card_id",
    "CASE WHEN contains(lower(badge), 'remote') THEN 'remote' WHEN contains(lower(badge), 'hybrid') THEN 'hybrid' ELSE 'office' END",
    lambda: levels.work_bucket("badge"),
)
scalar(
    "str_initials", "vacancies", "vacancy_id",
    "upper(left(string_split(title, ' ')[1], 1)) || coalesce(upper(left(string_split(title, ' ')[2], 1)), '')",
    lambda: strings.initials("title"),
)
scalar(
    "str_truncate", "companies", "company_id",
    "CASE WHEN length(description) > 20 THEN left(description, 20) || '...' ELSE description END",
    lambda: strings.truncate("description", 20),
)
scalar(
    "str_emp_label", "vacancies", "vacancy_id",
    "CASE experience_level WHEN 'not_specified' THEN 'Not Specified' ELSE upper(left(experience_level, 1)) || substr(experience_level, 2) END",
    lambda: strings.employment_label("experience_level"),
)
SIZE = "lower(size_text)"
scalar(
    "size_bucket5", "cards", "card_id",
    f"""CASE WHEN size_text IS NULL OR {in_range(SIZE, '1-10')} OR contains({SIZE}, 'startup') THEN 'startup'
    WHEN {in_range(SIZE, '11-50')} OR contains({SIZE}, 'small') THEN 'small' WHEN {in_range(SIZE, '51-200')} OR contains({SIZE}, 'medium') THEN 'medium'
    WHEN {in_range(SIZE, '201-1000')} OR contains({SIZE}, 'large') THEN 'large' ELSE 'enterprise' END""",
    lambda: levels.size_bucket("size_text"),
)
scalar(
    "size_range", "cards", "card_id",
    f"""CASE WHEN {in_range(SIZE, '1-10')} OR contains({SIZE}, 'startup') THEN '1-10' WHEN {in_range(SIZE, '11-50')} OR contains({SIZE}, 'small') THEN '11-50'
    WHEN {in_range(SIZE, '51-200')} OR contains({SIZE}, 'medium') THEN '51-200' WHEN {in_range(SIZE, '201-500')} OR contains({SIZE}, 'large') THEN '201-500'
    WHEN {contains_any(SIZE, ['enterprise', '500+', '1000+'])} THEN '1000+' END""",
    lambda: levels.size_range("size_text"),
)
scalar(
    "size_std", "cards", "card_id",
    f"CASE WHEN {SIZE} IN ('startup', 'small', 'medium', 'large', 'enterprise') THEN {SIZE} ELSE 'medium' END",
    lambda: levels.size_standard("size_text"),
)
scalar(
    "size_headcount", "cards", "card_id",
    "CASE " + " ".join(
        f"WHEN contains({SIZE}, '{t}') THEN {n}"
        for t, n in [("1000+", 1500), ("501-1000", 750), ("201-500", 350), ("51-200", 125), ("11-50", 30), ("1-10", 5), ("large", 750),
                     ("medium", 125), ("small", 30), ("enterprise", 1500), ("startup", 15)]
    ) + " END",
    lambda: levels.size_headcount("size_text"),
)
scalar(
    "size_first_int", "cards", "card_id", "TRY_CAST(nullif(regexp_extract(size_text, '(\\d+)', 1), '') AS INT)",
    lambda: levels.first_integer("size_text"),
)
scalar(
    "num_best_headcount", "scoring_inputs", "company_id",
    "coalesce(nullif(award_count, 0), nullif(job_openings, 0), nullif(employee_count, 0))",
    lambda: levels.best_headcount("award_count", "job_openings", "employee_count"),
)
scalar(
    "str_best_location", "scoring_inputs", "company_id", "coalesce(nullif(work_model, ''), company_values[1], industry)",
    lambda: strings.best_location("work_model", "company_values", "industry"),
)
scalar(
    "bool_social", "companies", "company_id",
    "(CASE WHEN size = 'small' THEN website END IS NOT NULL OR CASE WHEN founded > 2000 THEN name END IS NOT NULL)",
    lambda: strings.has_social(
        F.when(F.col("size") == "small", F.col("website")), F.when(F.col("founded") > 2000, F.col("name")), F.lit("")
    ),
)

# ---- dates ----

MONTHS = "|".join(rules.MONTHS)
BG = f"regexp_extract(posted_text, '(\\d{{{{1,2}}}})\\s+({MONTHS})', {{g}}, 'i')"
month_no = "CASE lower(" + BG.format(g=2) + ") " + " ".join(f"WHEN '{m}' THEN '{i + 1:02d}'" for i, m in enumerate(rules.MONTHS)) + " END"
BG_DATE = f"TRY_CAST('2001-' || {month_no} || '-' || lpad({BG.format(g=1)}, 2, '0') AS DATE)"
scalar("dt_bg_find", "cards", "card_id", f"nullif({BG.format(g=0)}, '')", lambda: dates.find_bulgarian("posted_text"))
scalar(
    "dt_bg_parse", "cards", "card_id", f"coalesce({BG_DATE}, DATE '2001-09-01')",
    lambda: dates.parse_bulgarian("posted_text", moment(VACANCY_AS_OF)),
)
scalar(
    "dt_posted", "cards", "card_id",
    f"coalesce(TRY_CAST(posted_attr AS TIMESTAMP), CAST({BG_DATE} AS TIMESTAMP), TIMESTAMP '2001-09-01')",
    lambda: dates.posted("posted_attr", "posted_text", moment(VACANCY_AS_OF)),
)
scalar("dt_age_days", "company_analyses", "analysis_id", AGE.format(t="created_at"), lambda: dates.age_days("created_at", moment(AS_OF)))
LEFT = "CAST(ceil((epoch_us(deadline) - epoch_us(TIMESTAMP '2001-09-01')) / 86400000000.0) AS BIGINT)"
scalar(
    "dt_deadline", "cards", "card_id",
    f"""CASE WHEN {LEFT} < 0 THEN 'Expired' WHEN {LEFT} = 0 THEN 'Today' WHEN {LEFT} = 1 THEN 'Tomorrow'
    WHEN {LEFT} <= 7 THEN CAST({LEFT} AS VARCHAR) || ' days left' ELSE strftime(deadline, '%-m/%-d/%Y') END""",
    lambda: dates.deadline_label("deadline", moment(VACANCY_AS_OF)),
)
SINCE = "CAST(floor((epoch_us(TIMESTAMP '2001-09-01') - epoch_us(shown_at)) / 86400000000.0) AS BIGINT)"
scalar(
    "dt_posted_label", "cards", "card_id",
    f"""CASE WHEN {SINCE} = 0 THEN 'Today' WHEN {SINCE} = 1 THEN 'Yesterday' WHEN {SINCE} <= 7 THEN CAST({SINCE} AS VARCHAR) || ' days ago'
    WHEN {SINCE} <= 30 THEN CAST({SINCE} // 7 AS VARCHAR) || CASE WHEN {SINCE} // 7 = 1 THEN ' week ago' ELSE ' weeks ago' END
    ELSE strftime(shown_at, '%-m/%-d/%Y') END""",
    lambda: dates.posted_label("shown_at", moment(VACANCY_AS_OF)),
)

# ---- JSON ----

J = "CASE WHEN json_valid(reply) THEN reply END"


@plan(
    "js_field",
    f"""SELECT reply_id, json_valid(reply) AS parsed, json_extract_string({J}, '$.title') AS title,
    CASE WHEN NOT json_valid(reply) THEN reply END AS text FROM replies""",
)
def js_field(spark, d):
    rows = spread(view(spark, d, "replies")).select("reply_id", jsons.field("reply").alias("f"))
    return rows.select(
        "reply_id",
        F.col("f.value").isNotNull().alias("parsed"),
        F.try_variant_get(F.col("f.value"), "$.title", "string").alias("title"),
        F.col("f.text").alias("text"),
    )


scalar(
    "js_array", "company_analyses", "analysis_id",
    "CASE WHEN json_valid(cons) THEN 'Pace,Meetings,Tools' ELSE '' END || '|' || coalesce(CASE WHEN json_valid(pros) THEN json_extract_string(pros, '$[2]') END, '-')",
    lambda: F.concat(
        F.array_join(jsons.text_array("cons"), ","), F.lit("|"), F.coalesce(F.get(jsons.text_array("pros"), F.lit(2)), F.lit("-"))
    ),
)


@plan(
    "js_contact",
    """SELECT analysis_id, json_extract_string(raw_data, '$.contactEmail') AS email, json_extract_string(raw_data, '$.contactPhone') AS phone,
    json_extract_string(raw_data, '$.address') AS address, json_extract_string(raw_data, '$.companyType') AS company_type FROM company_analyses""",
)
def js_contact(spark, d):
    rows = view(spark, d, "company_analyses").select("analysis_id", jsons.contact("raw_data").alias("c"))
    return rows.select(
        "analysis_id", F.col("c.contactEmail").alias("email"), F.col("c.contactPhone").alias("phone"),
        F.col("c.address").alias("address"), F.col("c.companyType").alias("company_type"),
    )


scalar(
    "js_trace", "request_logs", "log_id",
    """'{"processingSteps":["content-extraction","html-cleaning","ai-processing","quality-validation"],"finalCleanedLength":' ||
    CAST(total_tokens AS VARCHAR) || ',"cacheHit":' || CAST(cache_hit AS VARCHAR) || ',"processingTime":' || CAST(duration AS VARCHAR) || '}'""",
    lambda: jsons.trace(
        processingSteps=F.array(*[F.lit(s) for s in ("content-extraction", "html-cleaning", "ai-processing", "quality-validation")]),
        finalCleanedLength=F.col("total_tokens"),
        cacheHit=F.col("cache_hit"),
        processingTime=F.col("duration"),
    ),
)

CONF = f"CAST(json_extract_string({J}, '$.confidenceScore') AS DOUBLE)"
VALID = f"coalesce(json_valid(reply) AND {CONF} > 0 AND {CONF} <= 100, FALSE)"


@plan(
    "js_reply_valid",
    f"""SELECT reply_id, {VALID} AS accepted, CASE WHEN {VALID} THEN json_extract_string({J}, '$.title') END AS title,
    CASE WHEN {VALID} THEN {CONF} END AS confidence FROM replies""",
)
def js_reply_valid(spark, d):
    rows = spread(view(spark, d, "replies")).select("reply_id", jsons.reply("reply").alias("r"))
    return rows.select(
        "reply_id", F.col("r").isNotNull().alias("accepted"), F.col("r.title").alias("title"), F.col("r.confidenceScore").alias("confidence")
    )


COMPANY_REPLY = "replace(replace(reply, '\"title\"', '\"name\"'), '\"salaryMin\"', '\"employeeCount\"')"


@plan(
    "js_company_reply",
    f"""SELECT reply_id, {VALID} AS accepted, CASE WHEN {VALID} THEN json_extract_string({J}, '$.name') END AS name,
    CASE WHEN {VALID} THEN CAST(json_extract_string({J}, '$.employeeCount') AS INT) END AS employee_count
    FROM (SELECT reply_id, {COMPANY_REPLY} AS reply FROM replies) q""",
)
def js_company_reply(spark, d):
    rows = spread(view(spark, d, "replies")).select("reply_id", jsons.company_reply(F.expr(COMPANY_REPLY)).alias("r"))
    return rows.select(
        "reply_id", F.col("r").isNotNull().alias("accepted"), F.col("r.name").alias("name"), F.col("r.employeeCount").alias("employee_count")
    )


WRAPPED = "'Sure, here it is: ' || reply || ' Hope it helps.'"


@plan(
    "js_salvage",
    f"""WITH w AS (SELECT reply_id, reply, {WRAPPED} AS t FROM replies)
    SELECT reply_id, CASE WHEN json_valid(reply) THEN json_extract_string({J}, '$.title') END AS title,
    CASE WHEN NOT json_valid(reply) THEN t END AS description,
    CASE WHEN json_valid(reply) THEN {CONF} ELSE 50.0 END AS confidence FROM w""",
)
def js_salvage(spark, d):
    rows = spread(view(spark, d, "replies")).select("reply_id", jsons.salvage(F.expr(WRAPPED)).alias("r"))
    return rows.select(
        "reply_id", F.col("r.title").alias("title"), F.col("r.description").alias("description"), F.col("r.confidenceScore").alias("confidence")
    )


def kind_sql(path: str) -> str:
    return f"json_type(reply, '$.{path}')"


NUMBER = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
CONTRACT = ", ".join(
    [
        f"CASE WHEN {kind_sql(n)} NOT IN ('NULL', {dict(text=quoted(['VARCHAR']), number=NUMBER[1:-1], list=quoted(['ARRAY']))[k]}) THEN '{n} must be {k}' END"
        for n, k in rules.REPLY_FIELDS.items()
    ]
    + [
        f"""CASE WHEN {kind_sql(n)} IS NULL THEN '{n} is required' END, CASE WHEN {kind_sql(n)} NOT IN {NUMBER} THEN '{n} must be number' END,
        CASE WHEN CAST(json_extract_string(reply, '$.{n}') AS DOUBLE) < 0 THEN '{n} must be >= 0' END,
        CASE WHEN CAST(json_extract_string(reply, '$.{n}') AS DOUBLE) > 100 THEN '{n} must be <= 100' END"""
        for n in rules.REPLY_SCORES
    ]
    + [f"CASE WHEN {kind_sql('extractionMetadata')} IS NULL THEN 'extractionMetadata is required' END"]
    + [
        "CASE WHEN len(list_filter(json_keys(reply), lambda k: k NOT IN ("
        + quoted([*rules.REPLY_FIELDS, *rules.REPLY_SCORES, "extractionMetadata"])
        + "))) > 0 THEN 'unknown keys' END"
    ]
)


@plan("js_contract", f"SELECT reply_id, concat_ws('; ', {CONTRACT}) AS errors FROM extractions")
def js_contract(spark, d):
    rows = spread(view(spark, d, "extractions"))
    checked = jsons.with_contract_errors(rows, "reply", "errors")
    return checked.select("reply_id", F.array_join("errors", "; ").alias("errors"))


def parsed_extractions(spark, d):
    return spread(view(spark, d, "extractions")).select("reply_id", F.from_json("reply", jsons.REPLY).alias("r"))


X = "json_extract_string(reply, '$.{}')"


@plan(
    "js_contract_quality",
    f"""SELECT reply_id, concat_ws('; ',
    CASE WHEN CAST({X.format('confidenceScore')} AS INT) < 70 THEN 'Low confidence score: ' || {X.format('confidenceScore')} END,
    CASE WHEN CAST({X.format('qualityScore')} AS INT) < 60 THEN 'Low quality score: ' || {X.format('qualityScore')} END,
    CASE WHEN {X.format('title')} IS NULL THEN 'Missing job title' END,
    CASE WHEN length({X.format('description')}) < 50 THEN 'Missing or insufficient job description' END,
    CASE WHEN coalesce(json_array_length(reply, '$.requirements'), 0) = 0 THEN 'Missing job requirements' END,
    CASE WHEN coalesce(json_array_length(reply, '$.technologies'), 0) = 0 THEN 'Missing technology stack information' END) AS gaps FROM extractions""",
)
def js_contract_quality(spark, d):
    return parsed_extractions(spark, d).select("reply_id", F.array_join(jsons.quality_gaps(F.col("r")), "; ").alias("gaps"))


@plan(
    "js_contract_meta",
    f"""SELECT reply_id, CASE WHEN json_type(reply, '$.extractionMetadata') IS NULL THEN 'Missing extraction metadata' ELSE concat_ws('; ',
    CASE WHEN CAST({X.format('extractionMetadata.contentLength')} AS INT) <= 0 THEN 'Invalid content length' END,
    CASE WHEN {X.format('extractionMetadata.sourceType')} NOT IN ({quoted(rules.SOURCE_TYPES)}) THEN 'Invalid source type: ' || {X.format('extractionMetadata.sourceType')} END,
    CASE WHEN length({X.format('extractionMetadata.language')}) <> 2 THEN 'Invalid language code' END) END AS gaps FROM extractions""",
)
def js_contract_meta(spark, d):
    return parsed_extractions(spark, d).select("reply_id", F.array_join(jsons.metadata_gaps(F.col("r")), "; ").alias("gaps"))


# ---- arrays ----


@plan(
    "arr_tech_union",
    """SELECT company_id, (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(list_concat(technologies, benefits, ['React', 'Go'])) AS x) q) AS value
    FROM scoring_inputs""",
)
def arr_tech_union(spark, d):
    extra = F.concat("benefits", F.array(F.lit("React"), F.lit("Go")))
    return view(spark, d, "scoring_inputs").select(
        "company_id", F.array_join(arrays.technology_union("technologies", extra), ",").alias("value")
    )


scalar(
    "arr_titles", "scoring_inputs", "company_id",
    "array_to_string(list_transform(technologies, lambda x: lower(x)), ',')",
    lambda: F.array_join(
        arrays.clean_titles(F.concat("technologies", F.array(F.lit(" ")), F.transform("technologies", lambda x: F.concat(F.lit(" "), F.upper(x))))), ","
    ),
)
scalar(
    "arr_merge_ci", "scoring_inputs", "company_id",
    "array_to_string(technologies, ',') || CASE WHEN list_contains(technologies, 'Docker') THEN '' ELSE ',DOCKER' END || ',cobol'",
    lambda: F.array_join(arrays.merge_ignoring_case("technologies", F.array(F.lit("DOCKER"), F.lit("cobol"), F.lit("COBOL"))), ","),
)

category = "CASE " + " ".join(f"WHEN tech IN ({quoted(ts)}) THEN '{c}'" for c, ts in rules.TECH_CATEGORIES.items()) + " ELSE 'other' END"


@plan(
    "arr_category",
    f"""SELECT vacancy_id, string_agg(category || ':' || techs, ' ' ORDER BY category) AS value FROM (SELECT vacancy_id, {category} AS category,
    string_agg(tech, ',' ORDER BY tech) AS techs FROM vacancy_tech GROUP BY 1, 2) q GROUP BY 1""",
)
def arr_category(spark, d):
    # a vacancy names at most the thirty known technologies, so the set per vacancy is bounded
    techs = view(spark, d, "vacancy_tech").groupBy("vacancy_id").agg(F.array_sort(F.collect_set("tech")).alias("techs"))
    groups = F.array_sort(F.map_entries(arrays.categorise("techs")))
    text = F.transform(groups, lambda g: F.concat(g["key"], F.lit(":"), F.array_join(g["value"], ",")))
    return techs.select("vacancy_id", F.array_join(text, " ").alias("value"))


display = "CASE " + " ".join(f"WHEN {contains_any('lower(tech)', ts)} THEN '{c}'" for c, ts in rules.DISPLAY_CATEGORIES.items()) + " ELSE 'Other' END"


@plan("arr_category_ui", f"SELECT {display} AS category, count(*) AS n FROM vacancy_tech GROUP BY 1")
def arr_category_ui(spark, d):
    return arrays.category_counts(view(spark, d, "vacancy_tech"))


scalar(
    "arr_slice", "scoring_inputs", "company_id",
    "array_to_string(technologies[1:5], ',') || '|' || array_to_string(benefits[1:3], ',') || '|' || array_to_string(company_values[1:2], ',')",
    lambda: F.concat_ws("|", *[F.array_join(arrays.first_n(c, n), ",") for c, n in (("technologies", 5), ("benefits", 3), ("company_values", 2))]),
)

# ---- hashes, URLs, names ----

CLEAN = """trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>[\\s\\S]*?</script>', '', 'gi'),
    '<style[^>]*>[\\s\\S]*?</style>', '', 'gi'), '<!--[\\s\\S]*?-->', '', 'g'), chr(160), ' '), '\\s+', ' ', 'g'))"""


@plan("hsh_content", f"SELECT page_id, sha256(regexp_extract(url, '^[^?#]*', 0) || {CLEAN}) AS hash FROM pages")
def hsh_content(spark, d):
    return spread(load(spark, d, "pages")).select("page_id", hashes.content("url", "html").alias("hash"))


@plan("hsh_simple", f"SELECT page_id, sha256(html) AS plain, sha256({CLEAN}) AS cleaned FROM pages")
def hsh_simple(spark, d):
    return spread(load(spark, d, "pages")).select(
        "page_id", hashes.simple("html").alias("plain"), hashes.simple("html", clean=True).alias("cleaned")
    )


MIXED = "CASE WHEN reply_id % 3 = 0 THEN upper(content_hash) WHEN reply_id % 3 = 1 THEN left(content_hash, 63) || 'g' ELSE content_hash END"
scalar(
    "hsh_valid", "replies", "reply_id", f"regexp_matches({MIXED}, '^[a-fA-F0-9]{{64}}$')", lambda: hashes.is_sha256(F.expr(MIXED))
)
scalar(
    "hsh_key", "replies", "reply_id", f"CASE WHEN regexp_matches({MIXED}, '^[a-fA-F0-9]{{64}}$') THEN 'extraction:' || {MIXED} END",
    lambda: hashes.key("extraction", F.expr(MIXED)),
)

HTTP = "regexp_matches({u}, '^(?i:https?)://[^/\\s?#]+')"
HOST = "lower(regexp_extract({u}, '^[a-zA-Z]+://([^/:?#]+)', 1))"
PATH = "regexp_extract({u}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
scalar("url_http", "link_samples", "page_id", HTTP.format(u="link"), lambda: urls.is_http("link"))


def company_url_sql(url: str) -> str:
    host, path = HOST.format(u=url), PATH.format(u=url)
    others = [x for x in rules.BOARD_DOMAINS if x != rules.PROFILE_BOARD]
    boards = " OR ".join(f"contains({host}, '{x}') OR contains('{x}', {host})" for x in others)
    return f"""({HTTP.format(u=url)} AND CASE WHEN contains({host}, 'dev.bg') THEN regexp_matches({path}, '/company/[a-zA-Z0-9\\-_]+/?$')
    ELSE NOT ({boards}) END)"""


scalar("url_company_ok", "link_samples", "page_id", company_url_sql("link"), lambda: urls.is_company_url("link"))
scalar(
    "url_slug", "link_samples", "page_id",
    "regexp_replace(regexp_replace(lower(new_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')", lambda: urls.slug("new_name"),
)


@plan(
    "url_infer_name",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'TechnoLogica' WHEN 1 THEN 'Senior Java' WHEN 2 THEN 'Recruitment' WHEN 3 THEN 'Ab Cd'
    WHEN 4 THEN NULL ELSE 'Firm' || CAST(page_id AS VARCHAR) END AS name FROM link_samples""",
)
def url_infer_name(spark, d):
    return view(spark, d, "link_samples").select("page_id", urls.name_from_job_url("job_url").alias("name"))


def name_ok_sql(name: str) -> str:
    low = f"lower(trim({name}))"
    boards = sorted({b.lower() for b in rules.BOARD_NAMES})
    hit = " OR ".join(f"contains({low}, '{b}') OR contains('{b}', {low})" for b in boards)
    return f"coalesce({low} <> '' AND NOT ({hit}), FALSE)"


scalar("nam_valid", "link_samples", "page_id", name_ok_sql("new_name"), lambda: urls.is_company_name("new_name"))
scalar(
    "nam_replace", "link_samples", "page_id",
    f"CASE WHEN {name_ok_sql('new_name')} AND NOT {name_ok_sql('old_name')} THEN new_name ELSE old_name END",
    lambda: F.when(urls.takes_new_name("old_name", "new_name"), F.col("new_name")).otherwise(F.col("old_name")),
)


@plan(
    "row_sanitize",
    f"""SELECT page_id, CASE WHEN {name_ok_sql('new_name')} THEN new_name END AS name,
    CASE WHEN {company_url_sql('link')} THEN link END AS website FROM link_samples""",
)
def row_sanitize(spark, d):
    rows = view(spark, d, "link_samples").select("page_id", F.col("new_name").alias("name"), F.col("link").alias("website"))
    return urls.sanitize(rows)


# ---- rule tables ----


@plan(
    "rg_boards",
    f"""SELECT page_id, {name_ok_sql('new_name')} AND NOT (contains(lower(trim(new_name)), 'acme') OR contains('acme', lower(trim(new_name)))) AS name_ok,
    {company_url_sql('link')} AND NOT contains({HOST.format(u='link')}, 'example.com') AS url_ok FROM link_samples WHERE new_name IS NOT NULL""",
)
def rg_boards(spark, d):
    boards = registries.BoardRules().add_name("Acme").add_domain("example.com")
    return view(spark, d, "link_samples").filter(F.col("new_name").isNotNull()).select(
        "page_id", boards.accepts_name("new_name").alias("name_ok"), boards.accepts_url("link").alias("url_ok")
    )


scalar(
    "rg_terms", "cards", "card_id",
    f"replace({terms}, 'Backend', 'Server') || '|' || {case({**rules.LOCATIONS, 'contract': 'Contract work'}, 'model_text', 'model_text')}",
    lambda: F.concat_ws(
        "|",
        registries.TermRules().with_term("Backend", "Server").job_terms("title"),
        registries.TermRules().with_location("contract", "Contract work").location("model_text"),
    ),
)
