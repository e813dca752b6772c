"""Joins between the entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.arrays import merge_ignoring_case
from jobloom.functions.common import non_zero, present
from jobloom.operators import filters, windows
from jobloom.session import ensure_checkpoint_dir


def with_company(vacancies: DataFrame, companies: DataFrame) -> DataFrame:
    card = companies.select(
        "company_id",
        F.col("name").alias("company_name"),
        F.col("industry").alias("company_industry"),
        F.col("size").alias("company_size"),
        F.col("location").alias("company_location"),
    )
    return vacancies.join(card, "company_id", "inner")


def active_view(vacancies: DataFrame, companies: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Active, unexpired vacancies with their company and source."""
    open_rows = filters.unexpired(filters.active(vacancies), as_of)
    return windows.split_join(with_company(open_rows, companies), sources, ["source_site"], "inner")


def vacancy_detail(
    vacancies: DataFrame, companies: DataFrame, scores: DataFrame, applications: DataFrame, cvs: DataFrame
) -> DataFrame:
    """Vacancies with one row per score and per application, or one bare row.

    Children stay rows: a popular vacancy may hold a third of all applications,
    which no single array can. Sort by ``child_at`` descending to read one vacancy.
    """
    score_rows = scores.select(
        "vacancy_id",
        F.lit("score").alias("child"),
        F.col("score_id").alias("child_id"),
        F.col("scored_at").alias("child_at"),
        F.col("overall_score").cast("string").alias("detail"),
        F.lit(None).cast("string").alias("cv_file"),
    )
    app_rows = application_with_cv(applications, cvs).select(
        "vacancy_id",
        F.lit("application").alias("child"),
        F.col("application_id").alias("child_id"),
        F.col("created_at").alias("child_at"),
        F.col("status").alias("detail"),
        F.col("filename").alias("cv_file"),
    )
    base = with_company(vacancies, companies).select("vacancy_id", "title", "company_name")
    children = score_rows.unionByName(app_rows)
    # an outer join could not split a hot vacancy's children; an inner join can, and the bare rows come apart
    bare = without(base, children, "vacancy_id")
    return base.join(children, "vacancy_id").unionByName(bare, allowMissingColumns=True)


def having(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with at least one child. Child keys are made distinct on the map side, so hot keys do not gather."""
    return parents.join(children.select(key).distinct(), key, "left_semi")


def without(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


def application_with_cv(applications: DataFrame, cvs: DataFrame) -> DataFrame:
    return applications.join(cvs, "cv_id", "left")


def company_detail(companies: DataFrame, analyses: DataFrame, sources: DataFrame, vacancies: DataFrame) -> DataFrame:
    """Companies with each child reduced first, so children never multiply each other."""
    by_company = analyses.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_analyses"),
        F.max_by("recommendation_score", F.struct("created_at", "analysis_id")).alias("latest_score"),
    )
    by_source = sources.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_sources"))
    counts = vacancies.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_vacancies"), F.count_if(F.col("status") == "active").alias("n_active")
    )
    newest = windows.newest_n(
        filters.active(vacancies), "company_id", [F.col("created_at").desc(), F.col("vacancy_id").desc()], 10
    )
    ten = newest.groupBy("company_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "vacancy_id"))), lambda x: x["vacancy_id"]
        ).alias("newest_active")
    )
    out = companies
    for child in (by_company, by_source, counts, ten):
        out = out.join(child, "company_id", "left")
    return out.fillna(0, ["n_analyses", "n_sources", "n_vacancies", "n_active"])


def with_latest_analysis(companies: DataFrame, analyses: DataFrame) -> DataFrame:
    latest = windows.latest_analysis(analyses)
    return companies.join(latest, "company_id", "left")


def with_stored_source(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Probe the stored source of each (company, site)."""
    stored = sources.select(
        "company_id",
        "source_site",
        F.col("source_id").alias("stored_id"),
        F.col("source_url").alias("stored_url"),
        F.col("is_valid").alias("stored_valid"),
        F.col("last_scraped_at").alias("stored_at"),
    )
    return requests.join(stored, ["company_id", "source_site"], "left")


def match_existing(listings: DataFrame, vacancies: DataFrame) -> DataFrame:
    """Each listing with the stored vacancy it updates: by URL, else by (title, company).

    A blank URL is none: it matches no stored one, and such a listing is matched by title.
    """
    by_url = (
        vacancies.filter(present("source_url").isNotNull())
        .groupBy(F.col("source_url").alias("url"))
        .agg(F.min("vacancy_id").alias("by_url"))
    )
    by_title = vacancies.groupBy("title", "company_id").agg(F.min("vacancy_id").alias("by_title"))
    found = windows.split_join(listings, by_url, ["url"])
    return (
        windows.split_join(found, by_title, ["title", "company_id"])
        .withColumn("match_id", F.coalesce("by_url", "by_title"))
        .withColumn(
            "match_by",
            F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_title").isNotNull(), "title"),
        )
        .drop("by_url", "by_title")
    )


def merge_profiles(structured: DataFrame, legacy: DataFrame, key: str = "company_id") -> DataFrame:
    """Two profiles of a company in one: the first non-empty value wins, lists are joined."""
    s, g = structured.alias("s"), legacy.alias("g")
    both = s.join(g, F.col(f"s.{key}") == F.col(f"g.{key}"), "full_outer")

    def merged(field) -> Column:
        first, second = F.col(f"s.{field.name}"), F.col(f"g.{field.name}")
        kind = field.dataType.typeName()
        if kind == "array":
            return merge_ignoring_case(first, second)
        if kind == "string":
            return F.coalesce(present(first), present(second))
        return F.coalesce(non_zero(first), second)

    shared = [f for f in structured.schema.fields if f.name != key and f.name in legacy.columns]
    return both.select(
        F.coalesce(F.col(f"s.{key}"), F.col(f"g.{key}")).alias(key), *[merged(f).alias(f.name) for f in shared]
    )


def title_key(title: Column | str) -> Column:
    """A title without case, punctuation and extra space."""
    text = F.col(title) if isinstance(title, str) else title
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def vacancy_words(title: Column | str = "title", description: Column | str = "description") -> Column:
    """The distinct words of title and description, in order."""
    text = F.lower(F.concat_ws(" ", title, description))
    return F.sort_array(F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def word_rows(vacancies: DataFrame) -> DataFrame:
    """(company_id, vacancy_id, created_at, title, words) of every vacancy, written once: all steps read it."""
    ensure_checkpoint_dir(vacancies.sparkSession)
    return vacancies.select("company_id", "vacancy_id", "created_at", title_key("title").alias("title"), vacancy_words().alias("words")).checkpoint()


def word_classes(rows: DataFrame) -> DataFrame:
    """(company_id, words, first, size) per distinct word set of a company; ``first`` is its oldest vacancy."""
    rows = rows.filter(F.col("company_id").isNotNull() & (F.size("words") > 0))
    return rows.groupBy("company_id", "words").agg(
        F.min(F.struct("created_at", "vacancy_id")).alias("first"), F.size(F.first("words")).alias("size")
    )


def by_rarity(classes: DataFrame) -> DataFrame:
    """The classes with ``ranked``, their words from the rarest of the company to the most frequent."""
    id_ = F.col("first.vacancy_id").alias("node")
    each = classes.select("company_id", id_, F.explode("words").alias("word"))
    held = each.groupBy("company_id", "word").agg(F.count(F.lit(1)).alias("held"))
    met = windows.split_join(each, held, ["company_id", "word"], "inner")
    ranked = met.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("held", "word"))), lambda x: x.word).alias("ranked"))
    return classes.withColumn("node", F.col("first.vacancy_id")).join(ranked, "node")


def similar_classes(classes: DataFrame, least: int = 80) -> DataFrame:
    """(a, b, common, every): classes of one company whose word sets have a similarity of ``least`` hundredths or more.

    Two sets that alike share one of their rarest words: of n words the first n - ceil(least n / 100) + 1. Only
    those are joined, and a pair is made at the first such word alone. Where the words that
    follow a shared one, or the sizes, are too few for the similarity, the pair goes at once. The
    whole sets decide. ``a`` holds the older vacancy.
    """
    ranked = by_rarity(classes).select("company_id", "node", "first", "size", "ranked").checkpoint()
    need = F.ceil(F.col("size") * least / 100).cast("int")
    short = F.slice("ranked", 1, F.col("size") - need + 1)
    index = ranked.select("company_id", "node", "first", "size", short.alias("prefix"), F.posexplode(short).alias("at", "word"))
    a, b = index.alias("a"), index.alias("b")
    total = F.col("a.size") + F.col("b.size")
    # common >= least / (100 + least) of both sizes together
    enough = (100 + least) * F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) >= least * total
    sizes = (100 * F.col("a.size") >= least * F.col("b.size")) & (100 * F.col("b.size") >= least * F.col("a.size"))
    once = F.element_at(F.array_intersect("a.prefix", "b.prefix"), 1) == F.col("a.word")
    same = (F.col("a.company_id") == F.col("b.company_id")) & (F.col("a.word") == F.col("b.word"))
    met = a.join(b, same & (F.col("a.first") < F.col("b.first")) & sizes & enough)
    pairs = met.filter(once).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    left, right = (ranked.select(F.col("node").alias(x), F.col("ranked").alias(f"words_{x}")) for x in "ab")
    both = windows.split_join(windows.split_join(pairs, left, ["a"], "inner"), right, ["b"], "inner")
    common = F.size(F.array_intersect("words_a", "words_b"))
    sized = both.select("a", "b", common.alias("common"), (F.size("words_a") + F.size("words_b") - common).alias("every"))
    return sized.filter(100 * F.col("common") >= least * F.col("every"))


def similar_pairs(vacancies: DataFrame, least: int = 80) -> DataFrame:
    """(original_id, duplicate_id, similarity) of the vacancies of one company with similar words, the older one first.

    Vacancies with one and the same word set are a class: each is paired with its oldest, and only the oldest
    of two classes are paired with each other, so that copies make no more pairs than there are copies.
    """
    return pairs_by_words(word_rows(vacancies), least)


def pairs_by_words(rows: DataFrame, least: int) -> DataFrame:
    classes = word_classes(rows).checkpoint()
    members = windows.split_join(rows.select("company_id", "vacancy_id", "words"), classes.select("company_id", "words", F.col("first.vacancy_id").alias("original_id")), ["company_id", "words"], "inner")
    copies = members.filter(F.col("vacancy_id") != F.col("original_id"))
    copies = copies.select("original_id", F.col("vacancy_id").alias("duplicate_id"), F.lit(100).cast("bigint").alias("similarity"))
    near = similar_classes(classes, least)
    share = F.floor(F.col("common") * 100 / F.col("every") + 0.5)
    return copies.unionByName(near.select(F.col("a").alias("original_id"), F.col("b").alias("duplicate_id"), share.alias("similarity")))


def pairs_by_title(rows: DataFrame) -> DataFrame:
    """(original_id, duplicate_id, similarity) for ``word_rows`` of one company with the same title.

    Every copy is paired with its group's oldest row only: as many pairs as
    copies, where pairing all of a hot group with each other would be quadratic.
    """
    rows = rows.filter(F.col("title").isNotNull()).withColumnsRenamed({"title": "_title", "words": "_words"})
    oldest = rows.groupBy("company_id", "_title").agg(
        F.min_by(F.struct("vacancy_id", F.col("_words").alias("words")), F.struct("created_at", "vacancy_id")).alias("_first")
    )
    common = F.size(F.array_intersect("_words", "_first.words"))
    every = F.size("_words") + F.size("_first.words") - common
    return (
        windows.split_join(rows, oldest, ["company_id", "_title"], "inner")
        .filter(F.col("vacancy_id") != F.col("_first.vacancy_id"))
        .select(
            F.col("_first.vacancy_id").alias("original_id"),
            F.col("vacancy_id").alias("duplicate_id"),
            F.when(every == 0, 100).otherwise(F.floor(common * 100 / every + 0.5)).alias("similarity"),
        )
    )


def duplicate_pairs(vacancies: DataFrame, least: int = 80) -> DataFrame:
    """(original_id, duplicate_id, similarity, detection_method): equal titles, and similar words beyond those; each pair once."""
    rows = word_rows(vacancies)
    by_title = pairs_by_title(rows).withColumn("detection_method", F.lit("title_match"))
    by_words = pairs_by_words(rows, least).withColumn("detection_method", F.lit("similarity"))
    both = by_title.unionByName(by_words)
    best = both.groupBy("original_id", "duplicate_id").agg(F.max("detection_method").alias("detection_method"), F.first("similarity").alias("similarity"))
    return best.select("original_id", "duplicate_id", "similarity", "detection_method")
