"""Queries of the text group over documents, and the technology rule table."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import jsons, registries, rules, text
from jobloom.plans.registry import plan
from jobloom.plans.relational import r4, sql_r4
from jobloom.plans.scalars import X, contains_any, parsed_extractions
from jobloom.sources.inputs import load, spread, view


def documents(spark, d):
    return spread(load(spark, d, "documents"))


def squeeze_sql(t: str) -> str:
    return f"trim(regexp_replace(replace({t}, chr(160), ' '), '\\s+', ' ', 'g'))"


def strip_sql(t: str) -> str:
    return f"regexp_replace(replace({t}, chr(160), ' '), '^\\s+|\\s+$', '', 'g')"


def cut_sql(t: str, limit: int) -> str:
    head = f"substr({t}, 1, {limit})"
    words = f"regexp_extract({head}, '(?s)^(.*) ', 1)"
    return f"CASE WHEN length({t}) > {limit} THEN CASE WHEN length({words}) > {limit * 0.8} THEN {words} ELSE {head} END || '...' ELSE {t} END"


def techs_sql(patterns: dict[str, list[str]], t: str = "lower(text)") -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {contains_any(t, ns)} THEN '{n}' END" for n, ns in patterns.items()) + ")"


@plan("txt_tech", f"SELECT doc_id, {techs_sql(rules.TECH_PATTERNS)} AS techs FROM documents")
def txt_tech(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(text.technologies("text"), ",").alias("techs"))


edited = registries.TechRules().add("Tion", "tion", "heit").remove("rest")


@plan(
    "rg_tech",
    f"SELECT x.tech, count(*) AS n FROM (SELECT unnest(string_split({techs_sql(edited.patterns)}, ',')) AS tech FROM documents) x WHERE x.tech <> '' GROUP BY 1",
)
def rg_tech(spark, d):
    found = documents(spark, d).select(F.explode(edited.find("text")).alias("tech"))
    return found.groupBy("tech").agg(F.count(F.lit(1)).alias("n"))


def words_sql(language: str) -> str:
    listed = ", ".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS[language]))
    return f"len(list_filter(tokens, lambda w: w IN ({listed})))"


LANGUAGE_OF = """CASE WHEN greatest(en, bg, de, fr) <= 5 THEN 'unknown' WHEN en = greatest(en, bg, de, fr) THEN 'en'
    WHEN bg = greatest(en, bg, de, fr) THEN 'bg' WHEN de = greatest(en, bg, de, fr) THEN 'de' ELSE 'fr' END"""


@plan(
    "txt_lang",
    f"""WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS tokens FROM documents),
    h AS (SELECT doc_id, {', '.join(f'{words_sql(x)} AS {x}' for x in rules.STOP_WORDS)} FROM t)
    SELECT doc_id, greatest(en, bg, de, fr) AS hits, {LANGUAGE_OF} AS detected FROM h""",
)
def txt_lang(spark, d):
    rows = documents(spark, d).select("doc_id", text.stop_word_hits("text").alias("h"))
    best = F.greatest(*[F.col(f"h.{x}") for x in rules.STOP_WORDS])
    return rows.select("doc_id", best.alias("hits"), text.language_from_hits(F.col("h")).alias("detected"))


def noise_sql(t: str) -> str:
    out = squeeze_sql(t)
    for words in rules.NOISE_WORDS:
        out = f"regexp_replace({out}, '\\b({words})\\b', ' ', 'gi')"
    return squeeze_sql(f"regexp_replace({out}, '\\s*\\([^)]*\\)\\s*', ' ', 'g')")


noise = noise_sql("text")


@plan("txt_noise", f"WITH n AS (SELECT doc_id, {noise} AS t FROM documents) SELECT doc_id, length(t) AS n, sha256(t) AS cleaned FROM n")
def txt_noise(spark, d):
    cleaned = documents(spark, d).select("doc_id", text.drop_noise("text").alias("t"))
    return cleaned.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("cleaned"))


def profile_sql(name: str) -> str:
    out = "replace(text, chr(160), ' ')"
    for pattern in registries.PROFILES[name].patterns:
        out = f"regexp_replace({out}, '{pattern}', ' ', 'gi')"
    return squeeze_sql(out)


@plan(
    "txt_profile",
    f"""WITH n AS (SELECT doc_id, {profile_sql('standard')} AS s, {profile_sql('aggressive')} AS a FROM documents)
    SELECT doc_id, sha256(s) AS standard, sha256(a) AS aggressive FROM n""",
)
def txt_profile(spark, d):
    cleaned = documents(spark, d).select(
        "doc_id", *[registries.profile(n).clean_text("text").alias(n) for n in ("standard", "aggressive")]
    )
    return cleaned.select("doc_id", F.sha2("standard", 256).alias("standard"), F.sha2("aggressive", 256).alias("aggressive"))


BARE = squeeze_sql(
    "regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>[\\s\\S]*?</script>', '', 'gi'), '<style[^>]*>[\\s\\S]*?</style>', '', 'gi'), '<[^>]+>', ' ', 'g')"
)


@plan("txt_strip_html", f"SELECT page_id, length({BARE}) AS n, sha256({BARE}) AS stripped FROM pages")
def txt_strip_html(spark, d):
    bare = spread(load(spark, d, "pages")).select("page_id", text.strip_html("html").alias("t"))
    return bare.select("page_id", F.length("t").alias("n"), F.sha2("t", 256).alias("stripped"))


# documents as rough Markdown: blank lines, an empty heading and trailing space
MARKDOWN = "replace(replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10)), chr(10), ' ' || chr(10)) || chr(10) || '## ' || chr(10) || '- ' || chr(10) || 'end'"


def markdown_sql(m: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace({m}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '[ \\t]+', ' ', 'g')"
    return strip_sql(f"regexp_replace(regexp_replace({out}, '#+\\s*\\n', '', 'g'), '[-*]\\s*\\n', '', 'g')")


MD = markdown_sql("m")


@plan("txt_md_clean", f"WITH d AS (SELECT doc_id, {MARKDOWN} AS m FROM documents) SELECT doc_id, length({MD}) AS n, sha256({MD}) AS cleaned FROM d")
def txt_md_clean(spark, d):
    rough = documents(spark, d).select("doc_id", F.expr(MARKDOWN).alias("m"))
    cleaned = rough.select("doc_id", text.clean_markdown("m").alias("t"))
    return cleaned.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("cleaned"))


@plan(
    "txt_tokens",
    f"""WITH n AS (SELECT doc_id, text, {profile_sql('aggressive')} AS c FROM documents)
    SELECT doc_id, CAST(ceil(length(c) / 4) AS BIGINT) AS tokens, {sql_r4('length(c) / length(text)')} AS ratio FROM n""",
)
def txt_tokens(spark, d):
    rows = documents(spark, d).select("doc_id", "text", registries.profile("aggressive").clean_text("text").alias("c"))
    return rows.select("doc_id", text.token_estimate("c").alias("tokens"), r4(text.compression("c", "text")).alias("ratio"))


HEADED = "replace(text, chr(10), chr(10) || '## ')"


@plan(
    "txt_budget",
    f"""WITH t AS (SELECT doc_id, {HEADED} AS c FROM documents),
    s AS (SELECT doc_id, i, p[i] AS part, sum(length(p[i]) + CASE WHEN i > 1 THEN 3 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS upto
      FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(c, '\\n#{{1,3}}\\s') AS p FROM t) a) b),
    f AS (SELECT doc_id, min(i) AS stop FROM (SELECT *, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY i), 0) + length(part) > 1000 AS over FROM s) q WHERE over GROUP BY 1),
    k AS (SELECT s.doc_id, string_agg(part, chr(10) || '# ' ORDER BY i) AS done FROM s LEFT JOIN f ON f.doc_id = s.doc_id WHERE f.stop IS NULL OR i < f.stop GROUP BY 1),
    r AS (SELECT t.doc_id, t.c, coalesce(k.done, '') AS done, 1000 - length(coalesce(k.done, '')) AS room, s.part FROM t LEFT JOIN k ON k.doc_id = t.doc_id
      LEFT JOIN f ON f.doc_id = t.doc_id LEFT JOIN s ON s.doc_id = f.doc_id AND s.i = f.stop),
    e AS (SELECT *, regexp_extract(substr(part, 1, greatest(room - 50, 0)), '(?s)^.*\\.', 0) AS sentence FROM r),
    o AS (SELECT doc_id, CASE WHEN length(c) <= 1000 THEN c ELSE coalesce(nullif(CASE WHEN room > 100 AND length(sentence) - 1 > room * 0.7
      THEN done || CASE WHEN done = '' THEN '' ELSE chr(10) || '# ' END || sentence ELSE done END, ''), substr(c, 1, 1000)) END AS kept FROM e)
    SELECT doc_id, length(kept) AS n, sha256(kept) AS kept FROM o""",
)
def txt_budget(spark, d):
    kept = documents(spark, d).select("doc_id", text.budget(F.expr(HEADED), 250).alias("t"))
    return kept.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("kept"))


@plan("txt_priority_cut")
def txt_priority_cut(spark, d):
    rows = text.with_priority_cut(documents(spark, d).select("doc_id", "text"), "text", 5000, "t")
    return rows.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("kept"))


def unique_sql(t: str) -> str:
    return f"len(list_distinct(regexp_split_to_array(lower({t}), '\\s+'))) / len(regexp_split_to_array({t}, '\\s+'))"


@plan("txt_unique_ratio", f"SELECT doc_id, {sql_r4(unique_sql('replace(text, chr(160), chr(32))'))} AS ratio FROM documents")
def txt_unique_ratio(spark, d):
    return documents(spark, d).select("doc_id", r4(text.unique_ratio("text")).alias("ratio"))


# a document's first line serves as its title, its line count as its structure
TITLE = "CASE WHEN length(regexp_extract(text, '^[^\\n]*', 0)) BETWEEN 6 AND 199 THEN regexp_extract(text, '^[^\\n]*', 0) END"
SECTIONS = "CAST(length(text) - length(replace(text, chr(10), '')) > 5 AS INT) + CAST(contains(text, '|') AS INT) + CAST(contains(text, '- ') AS INT)"


@plan(
    "txt_quality",
    f"""WITH n AS (SELECT doc_id, text, {noise} AS t, {TITLE} AS title, {SECTIONS} AS sections FROM documents),
    c AS (SELECT *, t AS cleaned FROM n),
    b AS (SELECT *, length(cleaned) < 50 AS b1, length(cleaned) / length(text) < 0.1 AS b2, title IS NULL AS b3, sections < 2 AS b4, {unique_sql('cleaned')} < 0.3 AS b5 FROM c),
    s AS (SELECT *, greatest(0, 100 - CASE WHEN b1 THEN 30 ELSE 0 END - CASE WHEN b2 THEN 20 ELSE 0 END - CASE WHEN b3 THEN 15 ELSE 0 END
      - CASE WHEN b4 THEN 10 ELSE 0 END - CASE WHEN b5 THEN 25 ELSE 0 END) AS score FROM b)
    SELECT doc_id, score, score >= 50 AS is_valid, concat_ws('; ', CASE WHEN b1 THEN 'Content too short' END, CASE WHEN b2 THEN 'Low content density (too much markup)' END,
      CASE WHEN b3 THEN 'No title extracted' END, CASE WHEN b4 THEN 'Limited content structure' END, CASE WHEN b5 THEN 'High content repetition' END) AS issues FROM s""",
)
def txt_quality(spark, d):
    rows = documents(spark, d).select(
        "doc_id",
        text.drop_noise("text").alias("cleaned"),
        F.length("text").alias("n"),
        F.expr(TITLE).alias("title"),
        F.expr(SECTIONS).alias("sections"),
    )
    ratio = F.try_divide(F.length("cleaned"), F.col("n"))
    score = text.quality_score("title", "cleaned", ratio, "sections")
    found = text.quality_issues("title", "cleaned", ratio, "sections")
    return rows.select("doc_id", score.alias("score"), (score >= 50).alias("is_valid"), F.array_join(found, "; ").alias("issues"))


@plan(
    "txt_extract_score",
    f"""WITH s AS (SELECT reply_id, CASE WHEN coalesce({X.format('title')}, '') <> '' THEN 20 ELSE 0 END + CASE WHEN length({X.format('description')}) > 50 THEN 20 ELSE 0 END
    + CASE WHEN json_array_length(reply, '$.requirements') > 0 THEN 15 ELSE 0 END + CASE WHEN {X.format('location')} IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN {X.format('experienceLevel')} IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN CAST({X.format('salaryMin')} AS INT) > 0 THEN 10 ELSE 0 END
    + CASE WHEN json_array_length(reply, '$.technologies') > 0 THEN 10 ELSE 0 END + CASE WHEN CAST({X.format('confidenceScore')} AS INT) > 70 THEN 5 ELSE 0 END
    - CASE WHEN CAST({X.format('confidenceScore')} AS INT) < 50 THEN 20 ELSE 0 END AS score FROM extractions)
    SELECT reply_id, score, score >= 60 AS passed FROM s""",
)
def txt_extract_score(spark, d):
    scored = parsed_extractions(spark, d).select("reply_id", jsons.extraction_score(F.col("r")).alias("score"))
    return scored.withColumn("passed", F.col("score") >= 60)


# phrases that the supplied prose does hold, beside the fixed benefit list
PROSE = ["the ", "and ", "heit", "tion ", "ouen", "para", "ción"]


@plan(
    "txt_scan_phrases",
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"'{p}'" for p in PROSE + rules.BENEFIT_PHRASES)
    + "], lambda p: contains(lower(text), p)), '|') AS found FROM documents",
)
def txt_scan_phrases(spark, d):
    return documents(spark, d).select(
        "doc_id", F.array_join(text.phrases(F.lower("text"), PROSE + rules.BENEFIT_PHRASES), "|").alias("found")
    )


@plan(
    "rg_profiles",
    f"""WITH n AS (SELECT doc_id, 'standard' AS profile, {profile_sql('standard')} AS t FROM documents UNION ALL
    SELECT doc_id, 'aggressive', {profile_sql('aggressive')} FROM documents)
    SELECT profile, count(*) AS n_docs, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM n GROUP BY 1""",
)
def rg_profiles(spark, d):
    docs = documents(spark, d)
    parts = [
        docs.select(F.lit(name).alias("profile"), F.length(registries.profile(name).clean_text("text")).alias("n"))
        for name in ("standard", "aggressive")
    ]
    return parts[0].unionByName(parts[1]).groupBy("profile").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"))
