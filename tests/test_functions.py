"""Exact anchors on small literal rows."""

import time

import pytest
from pyspark.sql import functions as F

from jobloom.functions import arrays, dates, hashes, jsons, levels, registries, salaries, strings, text, urls
from jobloom.functions.common import moment
from jobloom.operators import scoring as S

AS_OF = "2024-02-01 00:00:00"


def run(spark, values, make, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_salaries(spark):
    values = ["3000-5000 BGN", "2500 BGN", None, "none"]
    assert run(spark, values, salaries.range_min) == [300000, 250000, None, None]
    assert run(spark, values, salaries.range_max) == [500000, 250000, None, None]


def test_page_salaries(spark):
    texts = ["<p>4 500 - 9,500 лв</p>", "От 5000 до 8000 лева", "Up to 9500 BGN", "до 7000 лв", "0 - 0 BGN", "nothing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, html string")
    rows = salaries.with_page_salary(df, "html").orderBy("i").collect()
    got = [(r.salary.min, r.salary.max, r.salary.currency) if r.salary else None for r in rows]
    assert got == [(4500, 9500, "BGN"), (5000, 8000, "BGN"), (None, 9500, "BGN"), (None, 7000, "BGN"), None, None]


def test_levels(spark):
    titles = ["Lead Backend Developer", "Junior Software Engineer", "Java Developer", "Mid-level Programmer"]
    assert run(spark, titles, levels.experience_from_title) == ["senior", "junior", "mid", "mid"]
    models = ["remote", "part-time", "contract", "unknown"]
    assert run(spark, models, levels.employment_from_model) == ["full-time", "part-time", "contract", "full-time"]
    scores = [8.5, 7.5, 6.5, 5.5, 1.0, 0.0, None]
    want = ["Highly Recommended", "Recommended", "Good Option", "Consider Carefully", "Proceed with Caution", "No rating", "No rating"]
    assert run(spark, scores, levels.recommendation, "double") == want


def test_sizes(spark):
    sizes = ["1000+", "501-1000", "201-500", "51-200", "11-50", "1-10", "startup"]
    assert run(spark, sizes, levels.size_headcount) == [1500, 750, 350, 125, 30, 5, 15]
    assert run(spark, ["501-1000", "1-10", "11-50", None], levels.size_bucket) == ["enterprise", "startup", "small", "startup"]


def test_names_and_urls(spark):
    url = "https://dev.bg/company/jobads/{}/"
    slugs = ["technologica-senior-java-developer", "recruitment-bg-middle", "java-x", "senior"]
    assert run(spark, [url.format(s) for s in slugs], urls.name_from_job_url) == ["TechnoLogica", "Recruitment", "Java X", None]
    assert run(spark, ["Acme", "DEV.BG", "dice", " ", None, "LinkedIn Jobs"], urls.is_company_name) == [True, False, False, False, False, False]
    links = ["https://dev.bg/company/acme/", "https://dev.bg/company/jobs/java/", "https://www.indeed.com/x", "https://acme.io", "ftp://a.b", "x"]
    assert run(spark, links, urls.is_company_url) == [True, False, False, True, False, False]
    assert run(spark, ["Acme & Sons, Ltd."], urls.slug) == ["acme-sons-ltd"]


def test_translation(spark):
    assert run(spark, ["София", "Remote City"], strings.location) == ["Sofia", "Remote City"]
    assert run(spark, ["СТАРШИ Java разработчик"], strings.job_terms) == ["Senior Java Developer"]
    assert run(spark, ["\n София\nХибридно", ""], strings.badge_location) == ["Sofia", "Bulgaria"]


def test_dates(spark):
    assert run(spark, ["Публикувана 5 март"], dates.find_bulgarian) == ["5 март"]
    found = run(spark, ["31 февруари", "29 ФЕВРУАРИ", "soon"], lambda c: dates.parse_bulgarian(c, moment(AS_OF)).cast("string"))
    assert found == ["2024-02-01", "2024-02-29", "2024-02-01"]


def test_arrays(spark):
    df = spark.createDataFrame([(["Java", "AWS", "java"], ["aws", "Go"])], "a array<string>, b array<string>")
    row = df.select(
        arrays.merge_ignoring_case("a", "b").alias("m"), arrays.technology_union("a", "b").alias("u"),
        arrays.categorise(F.array(F.lit("java"), F.lit("kafka"), F.lit("cobol"))).alias("c"),
    ).first()
    assert row.m == ["Java", "AWS", "Go"]
    assert row.u == ["AWS", "Go", "Java", "aws", "java"]
    assert row.c == {"backend": ["java"], "messaging": ["kafka"], "other": ["cobol"]}


def test_hashes(spark):
    a = hashes.content(F.lit("https://x/y?q=1#z"), F.lit("<p>a  b</p><script>x</script><!-- c -->"))
    b = hashes.content(F.lit("https://x/y"), F.lit("<p>a b</p>"))
    assert spark.range(1).select((a == b).alias("same")).first().same
    assert run(spark, ["f" * 64, "F" * 64, "g" * 64, None], hashes.is_sha256) == [True, True, False, False]


def test_replies(spark):
    texts = ['{"title":"A","confidenceScore":70}', '{"confidenceScore":0}', '{"confidenceScore":101}', "{broken", None]
    assert run(spark, texts, lambda c: jsons.reply(c).isNotNull()) == [True, False, False, False, False]
    assert run(spark, ['say {"title":"A"} ok', "plain"], lambda c: jsons.salvage(c)["title"]) == ["A", None]
    assert run(spark, ["plain"], lambda c: jsons.salvage(c)["confidenceScore"]) == [50.0]


def test_text(spark):
    assert run(spark, ["NodeJS and TypeScript requirements"], text.technologies) == [["node", "typescript", "javascript"]]
    assert run(spark, ["the and for are but not you", "за от до на или като може", "x"], text.language) == ["en", "bg", "unknown"]
    assert run(spark, ["Please accept cookies (or not) now"], text.drop_noise) == ["Please now"]
    assert run(spark, ["one two three"], lambda c: text.cut_at_word(c, 9)) == ["one two t..."]
    assert run(spark, ["one two three"], lambda c: text.cut_at_word(c, 8)) == ["one two..."]


def test_priority_cut_keeps_context_and_everything_else(spark):
    body = "x" * 300 + " salary 5000 " + "y" * 400 + " remote " + "z" * 50
    df = spark.createDataFrame([(body,), ("short",)], "t string")
    rows = [r.o for r in text.with_priority_cut(df, "t", 10000, "o").collect()]
    first = rows[0].split("\n")
    at = body.index("salary")
    assert first[0] == body[at - 100 : at + 200]
    assert sorted(rows[0].replace("\n", "")) == sorted(body)
    assert rows[1] == "short"


def test_rule_tables(spark):
    rules = registries.TechRules().add("Cobol", "COBOL").remove("java")
    assert "cobol" in rules.names() and "java" not in rules.names()
    assert run(spark, ["Java and Cobol"], rules.find) == [["cobol"]]
    with pytest.raises(ValueError):
        registries.profile("job-vacancy")


def test_weights(spark):
    df = spark.createDataFrame([("Gaming", None), (None, "startup")], "industry string, size string")
    rows = [list(r) for r in df.select(*S.weight_columns().values()).collect()]
    assert rows[0] == pytest.approx([0.30, 0.20, 0.20, 0.15, 0.10, 0.05])
    assert rows[1] == pytest.approx([w / 1.02 for w in (0.25, 0.20, 0.25, 0.15, 0.15, 0.02)])


def test_score_bounds(spark, small):
    from jobloom.sources.inputs import view

    scored = S.score(view(spark, small, "scoring_inputs"), 2024)
    for name in S.FACTORS:
        low, high = scored.agg(F.min(name), F.max(name)).first()
        assert 0 <= low and high <= 10, name
    assert scored.filter(~F.col("overall").between(0, 100)).count() == 0
    total = sum(F.col(f"w_{c}") for c in S.CATEGORIES)
    assert scored.filter(F.abs(total - 1) > 1e-9).count() == 0
    assert scored.filter((F.size("strengths") > 5) | (F.size("concerns") > 5)).count() == 0


def test_ten_thousand_needles_in_one_pass(spark):
    import random

    rng = random.Random(12)
    letters = "abcdefgh#+ éя"
    table = {f"t{i}": ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(1 + i % 2)] for i in range(7000)}
    table.update({"none": [], "blank": [""], "long": ["abc" * 5000], "emoji": ["\U0001f600x"]})
    rules_ = registries.TechRules(table)
    assert sum(map(len, table.values())) > 10_000
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))).upper() for _ in range(150)]
    texts += [None, "", "a", "abc" * 5001, "\U0001f600\U0001f600x y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    start = time.time()
    got = {r.i: r.f for r in rows.select("i", rules_.find("t").alias("f")).collect()}
    assert time.time() - start < 60
    for i, t in enumerate(texts):
        want = None if t is None else [n for n, needles in table.items() if any(x and x in t.lower() for x in needles)]
        assert got[i] == want
    assert spark.range(1).select(registries.TechRules({}).find(F.lit("java"))).first()[0] == []
