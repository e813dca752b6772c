"""What crawled pages say: picks for the page pass, and the columns made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import arrays, dates, jsons, levels, registries, rules, strings, text, urls
from jobloom.functions.common import any_contains, first_hit, half_up, issues, non_zero, present, text_list
from jobloom.operators import windows
from jobloom.operators.pages import Pick, first, page_pass, page_views

# ---- general content: selectors in priority order (fixed values) ----

TITLE = first(
    "titles", "h1", "title", '[data-testid*="title"]', '[class*="title"]', '[class*="heading"]', ".job-title",
    ".position-title", "h2",
)
ALWAYS_DROP = (
    "script", "style", "noscript", "iframe", "object", "embed", "form", "input", "button", "select", "textarea",
    ".advertisement", ".ads", ".social-share", ".comments", ".footer", ".sidebar",
    '[class*="cookie"]', '[class*="popup"]', '[class*="modal"]', '[id*="cookie"]', '[id*="popup"]', '[id*="modal"]',
)
DROP_IMAGES = ("img",)
AGGRESSIVE_DROP = (
    "nav", "header", "aside", ".navigation", ".menu", ".breadcrumb", ".related", ".recommended", ".tags", ".share",
    ".author", ".date", ".meta", '[class*="social"]', '[class*="share"]', '[class*="follow"]', '[class*="subscribe"]',
)
MAIN = first(
    "containers", "main", "article", '[role="main"]', ".main-content", ".content", ".job-description", ".job-details",
    ".vacancy-description", ".position-description", '[class*="description"]', '[class*="content"]', '[id*="description"]',
    '[id*="content"]',
)
BLOCK = Pick("block", "longest", ("div, section, article",))
BODY = Pick("body", "joined", ("body",))
SHAPE = (
    Pick("n_headings", "count", ("h1, h2, h3",)),
    Pick("n_lists", "count", ("ul, ol",)),
    Pick("n_tables", "count", ("table",)),
    Pick("n_paragraphs", "count", ("p",)),
    Pick("n_marked", "count", ('script[type="application/ld+json"]', "[itemscope]", '[property^="og:"]')),
)
SECTIONS = {
    "title": ("h1.job-title", ".job-title", ".title-date-wrap h1", 'h1[class*="title"]', ".job-header h1", "h1", ".position-title"),
    "description": (
        ".job_description", ".job-description", ".vacancy-description", '[class*="description"]',
        ".job-content .description", ".content-description",
    ),
    "requirements": (
        ".job-requirements", ".requirements", '[class*="requirement"]', ".job-content .requirements",
        ".vacancy-requirements",
    ),
    "benefits": (".benefits", ".job-benefits", '[class*="benefit"]', ".perks", ".advantages"),
    "companyInfo": (".company-info", ".company-description", '[class*="company"]', ".employer-info", ".about-company"),
    "salary": (".salary", ".compensation", '[class*="salary"]', ".wage", ".payment"),
    "location": (".location", ".job-location", '[class*="location"]', ".workplace", ".office"),
}
MARKDOWN = (
    Pick("headings", "tagged", ("h1, h2, h3, h4, h5, h6",)),
    Pick("lists", "lists", ("ul, ol",)),
    Pick("paragraphs", "all", ("p",)),
    Pick("strong", "all", ("strong, b",)),
    Pick("emphasis", "all", ("em, i",)),
    Pick("plain", "text"),
)


def filled(value: Column | str) -> Column:
    """A text array without nulls and blanks."""
    return F.filter(F.col(value) if isinstance(value, str) else value, lambda x: x.isNotNull() & (x != ""))


def first_where(values: str, test) -> Column:
    return F.get(F.filter(F.col(values), lambda x: F.coalesce(test(x), F.lit(False))), F.lit(0))


def drop_list(aggressive: bool = False, images: bool = True) -> tuple[str, ...]:
    return (*ALWAYS_DROP, *(DROP_IMAGES if images else ()), *(AGGRESSIVE_DROP if aggressive else ()))


def title() -> Column:
    """First candidate of 6 to 199 characters."""
    return first_where("titles", lambda t: F.length(t).between(6, 199))


def main_text() -> Column:
    """First container over 100 characters, else the largest block over 100, else the body."""
    block = F.when(F.length("block") > 100, F.col("block"))
    return F.coalesce(first_where("containers", lambda t: F.length(t) > 100), block, F.col("body")[0], F.lit(""))


def structure() -> Column:
    return issues(
        (F.col("n_headings") > 0, "headings"), (F.col("n_lists") > 0, "lists"), (F.col("n_tables") > 0, "tables"),
        (F.col("n_paragraphs") > 5, "paragraphs"),
    )


def with_content(pages: DataFrame, limit: int | None = None, drop_links: bool = False, aggressive: bool = False) -> DataFrame:
    """Title, main text, cleaned text and metadata of every page."""
    late = [MAIN, BLOCK, BODY, *SHAPE]
    sized = pages.withColumn("original_length", F.length("html"))
    read = page_pass(sized, [TITLE], drop_list(aggressive), late)
    out = read.withColumns({"title": title(), "content": main_text(), "sections": structure(), "has_structured_data": F.col("n_marked") > 0})
    out = out.withColumn("cleaned", text.drop_noise("content", limit, drop_links))
    out = out.withColumns(
        {
            "cleaned_length": F.length("cleaned"),
            "compression_ratio": F.try_divide(F.length("cleaned"), F.col("original_length")),
            "language": text.language("cleaned"),
        }
    )
    return out.drop("titles", "containers", "block", "body", "dropped_tags", *[p.name for p in SHAPE])


def section_picks() -> list[Pick]:
    return [first(f"s_{name}", *selectors) for name, selectors in SECTIONS.items()]


def sections() -> Column:
    """name -> text of the sections that have over 10 characters."""
    found = [
        F.struct(F.lit(name).alias("key"), first_where(f"s_{name}", lambda t: F.length(t) > 10).alias("value")) for name in SECTIONS
    ]
    return F.map_from_entries(F.filter(F.array(*found), lambda s: s["value"].isNotNull()))


def markdown() -> Column:
    """Headings, lists, paragraphs, bold and italic text as Markdown; the plain text when that is short."""

    def each(values: Column, make) -> Column:
        return F.array_join(F.transform(values, make), "")

    nonempty = F.filter(F.col("headings"), lambda h: h["text"] != "")
    heads = each(
        nonempty,
        lambda h: F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.substring(h["tag"], 2, 1).cast("int")), F.lit(" "), h["text"], F.lit("\n\n")),
    )

    def one_list(entry: Column) -> Column:
        items = filled(entry["items"])
        lines = F.transform(
            items,
            lambda x, i: F.concat(
                F.when(entry["tag"] == "ol", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x, F.lit("\n")
            ),
        )
        return F.concat(F.array_join(lines, ""), F.lit("\n"))

    made = F.concat(
        heads,
        each(F.col("lists"), one_list),
        each(filled("paragraphs"), lambda p: F.concat(p, F.lit("\n\n"))),
        each(filled("strong"), lambda b: F.concat(F.lit("**"), b, F.lit("** "))),
        each(filled("emphasis"), lambda e: F.concat(F.lit("*"), e, F.lit("* "))),
    )
    return F.when(F.length(text.strip(made)) < 100, F.col("plain")).otherwise(made)


def with_markdown(pages: DataFrame) -> DataFrame:
    """Named sections and Markdown of every page after the aggressive drop."""
    read = page_pass(pages, [], drop_list(aggressive=True), [*section_picks(), *MARKDOWN])
    out = read.withColumns({"sections": sections(), "raw_markdown": markdown()})
    out = out.withColumn("markdown", text.clean_markdown("raw_markdown"))
    return out.drop("dropped_tags", "raw_markdown", *[f"s_{n}" for n in SECTIONS], *[p.name for p in MARKDOWN])


def preprocess(pages: DataFrame, max_tokens: int = 10000) -> DataFrame:
    """Sections, budgeted Markdown, sizes, token estimate and language of every page."""
    rows = with_markdown(pages.withColumn("original_size", F.length("html")))
    rows = rows.withColumn("markdown", text.budget("markdown", max_tokens))
    return rows.withColumns(
        {
            "processed_size": F.length("markdown"),
            "compression_ratio": F.try_divide(F.length("markdown"), F.col("original_size")),
            "tokens": text.token_estimate("markdown"),
            "n_sections": F.size("sections"),
            "language": text.language("markdown"),
        }
    )


def clean(pages: DataFrame, *profiles: registries.CleaningProfile) -> DataFrame:
    """A row for each page and cleaning profile: its text, with the tags removed and kept. Pages are read once."""
    views = {
        p.name: (p.remove, [first("containers", *p.containers), BODY, Pick("kept_tags", "tags", p.keep)]) for p in profiles
    }
    keep = [c for c in pages.columns if c != "html"]

    def of(profile: registries.CleaningProfile) -> Column:
        held = F.filter(f"{profile.name}_containers", lambda t: F.length(t) >= profile.min_length)
        raw = F.coalesce(F.get(held, F.lit(0)), F.col(f"{profile.name}_body")[0], F.lit(""))
        return F.struct(
            F.col(f"{profile.name}_dropped_tags").alias("dropped_tags"), F.col(f"{profile.name}_kept_tags").alias("kept_tags"),
            profile.clean_text(raw).alias("cleaned"), F.lit(profile.name).alias("profile"),
        )

    read = page_views(pages, views)
    return read.select(*keep, F.explode(F.array(*[of(p) for p in profiles])).alias("_view")).select(*keep, "_view.*")


def looks_scripted(html: Column | str) -> Column:
    """Little text and more than five scripts: the content is made in the browser."""
    source = F.col(html) if isinstance(html, str) else html
    return (F.length(text.strip_html(source)) < 500) & (F.regexp_count(source, F.lit("(?i)<script[\\s>]")) > 5)


# ---- listing pages ----

CARDS = Pick(
    "cards",
    scope=".job-list-item",
    parts=(
        Pick("title", "joined", ("h6.job-title, .job-title",)),
        Pick("company", "joined", (".company-name",)),
        Pick("url", "attr", ('a.overlay-link, a[href*="jobads"]',), "href"),
        first("badge", ".badge"),
        Pick("salary", "joined", ('.salary, .price, [class*="salary"]',)),
        Pick("time_attr", "attr", ("time",), "datetime"),
        Pick("time_text", "joined", ("time",)),
        Pick("icons", "attrs", ("img[title]",), "title"),
        Pick("full_text", "text"),
    ),
)


def cards(pages: DataFrame) -> DataFrame:
    """One row per job card; cards without a title or company drop."""
    read = page_pass(pages, [CARDS])
    rows = read.select("*", F.posexplode("cards").alias("position", "c")).drop("cards")
    out = rows.withColumns(
        {
            **{n: F.col(f"c.{n}")[0] for n in ("title", "company", "salary", "time_attr", "time_text")},
            "url": F.coalesce(F.col("c.url")[0], F.lit("")),
            "badge": F.coalesce(F.col("c.badge")[0], F.lit("")),
            "icons": arrays.clean_titles("c.icons"),
            "full_text": F.lower("c.full_text"),
        }
    ).drop("c")
    return out.filter(present("title").isNotNull() & present("company").isNotNull())


def listings(pages: DataFrame, as_of: Column) -> DataFrame:
    """Cards as typed listings."""
    return cards(pages).select(
        *[c for c in pages.columns if c != "html"],
        "position",
        strings.job_terms("title").alias("title"),
        strings.job_terms("company").alias("company"),
        strings.badge_location("badge").alias("location"),
        strings.badge_model("badge").alias("work_model"),
        arrays.technology_union(text.technologies("full_text"), F.col("icons")).alias("technologies"),
        F.col("salary").alias("salary_range"),
        dates.posted("time_attr", "full_text", as_of).alias("posted_at"),
        "url",
    )


def job_detail(html: Column | str, kind: str) -> Column:
    """Tag-free text of the first ``job-description`` or ``job-requirements`` div."""
    source = F.col(html) if isinstance(html, str) else html
    inside = F.regexp_extract(source, rf'<div[^>]*class="[^"]*job-{kind}[^"]*"[^>]*>([\s\S]*?)</div>', 1)
    return text.strip(F.regexp_replace(inside, r"<[^>]*>", ""))


# ---- links ----

PROFILE_LINKS = Pick("profile_links", "attrs", ('a[href*="/company/"]',), "href")
# groups of anchors in priority order; a group may repeat anchors of an earlier one (fixed values)
SITE_GROUPS = (
    'a[href*="www."]', 'a[href^="http"][href*=".com"]', 'a[href^="http"][href*=".bg"]', 'a[href^="https://"]',
    "a.company-website", "a.external-link", '.company-info a[href^="http"]',
)
SITE_LINKS = [Pick(f"site_links_{i}", "links", (s,)) for i, s in enumerate(SITE_GROUPS)]
SITE_SHAPES = (
    r"^https?://[a-zA-Z0-9\-_.]+\.(com|bg|org|net|io)",
    r"^https?://(www\.)?[a-zA-Z0-9\-_.]+\.[a-zA-Z]{2,}$",
)
TEXT_URL = r"""https?://(www\.)?[a-zA-Z0-9\-_.]+\.[a-zA-Z]{2,}[^\s<>"']*"""


def with_company_links(pages: DataFrame, company: str | None = None) -> DataFrame:
    """Profile URL and external site of the company behind a job page.

    ``company`` names a column that gives the profile slug when no link does.
    """
    board = f"https://{rules.PROFILE_BOARD}"
    read = page_pass(pages.withColumn("_source", F.col("html")), [PROFILE_LINKS, *SITE_LINKS])
    bare = "^" + board.replace(".", r"\.")
    profile = F.get(
        F.filter(
            "profile_links",
            lambda h: F.regexp_replace(h, bare, "").rlike(r"^/company/[a-zA-Z0-9\-_]+/?$")
            & ~any_contains(h, ["/jobs/", "/jobads/", "/categories/"]),
        ),
        F.lit(0),
    )
    profile = F.when(profile.startswith("http"), profile).otherwise(F.concat(F.lit(board), profile))
    if company is not None:
        named = present(urls.slug(company))
        profile = F.coalesce(profile, F.concat(F.lit(f"{board}/company/"), named, F.lit("/")))

    def usable(link: Column) -> Column:
        href = link["href"]
        return (
            href.isNotNull()
            & ~any_contains(href, rules.JOB_LINK_EXCLUDED)
            & (href.rlike(SITE_SHAPES[0]) | href.rlike(SITE_SHAPES[1]))
        )

    def worded(link: Column) -> Column:
        return any_contains(F.lower(link["text"]), ["website", "сайт"])

    keyword, plain = [], []
    for pick in SITE_LINKS:
        good = F.filter(pick.name, usable)
        # within a group the last worded link wins, the first group with one ends the search
        keyword.append(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(good, worded), lambda x: x["href"])), -1))
        plain.append(F.get(F.transform(F.filter(good, lambda x: ~worded(x)), lambda x: x["href"]), F.lit(0)))
    in_text = F.get(
        F.filter(
            F.regexp_extract_all("_source", F.lit(TEXT_URL), F.lit(0)),
            lambda u: ~any_contains(u, rules.TEXT_LINK_EXCLUDED) & u.rlike(r"\.(com|bg|org|net|io|eu)"),
        ),
        F.lit(0),
    )
    out = read.withColumns({"profile_url": profile, "website": F.coalesce(*keyword, *plain, in_text)})
    return out.drop("_source", "profile_links", *[p.name for p in SITE_LINKS])


# ---- company pages: selectors in priority order (fixed values) ----

NAME = first("names", "h1.company-name", ".company-header h1", ".page-title", "h1", ".brand-name", ".company-title")
HEAD_TITLE = Pick("head_title", "joined", ("title",))
DESCRIPTION = first(
    "descriptions", ".company-description", ".company-description p", ".about-company", ".company-info .description",
    ".company-details p", ".about-text", '[data-testid="company-description"]',
)
LINKS = Pick("links", "links", ('a[href^="http"]',))
LOGO = Pick("logos", "attr", (".company-logo img", ".logo img", ".brand-logo img", 'img[alt*="logo"]'), "src")
PAGE_TEXT = Pick("page_text", "text")
PLACES = Pick("places", "joined", (".location", ".address", ".office-location", ".headquarters", ".offices"))
INDUSTRY = first("industries", ".industry", ".sector", ".business-type", ".category")
JOB_COUNTS = Pick("job_counts", "joined", (".job-count", ".open-positions", ".vacancies-count", ".jobs-available"))
JOB_LINKS = Pick("n_job_links", "count", ('a[href*="/job/"], a[href*="/vacancy/"]',))
TECH_ITEMS = Pick("tech_items", "all", (".technologies li", ".tech-stack li", ".skills li", ".tools li", ".programming-languages li"))
BENEFIT_ITEMS = Pick("benefit_items", "all", (".benefits li", ".perks li", ".company-benefits li", ".advantages li", ".why-work-here li"))
VALUE_ITEMS = Pick("value_items", "all", (".values li", ".principles li", ".culture li", ".beliefs li", ".company-values li"))
AWARD_ITEMS = Pick("award_items", "all", (".awards li", ".recognition li", ".achievements li", ".certifications li"))
ADDRESSES = first("addresses", ".address", ".contact-address", ".office-address")
COMPANY_PICKS = [
    NAME, HEAD_TITLE, DESCRIPTION, LINKS, LOGO, PAGE_TEXT, PLACES, INDUSTRY, JOB_COUNTS, JOB_LINKS, TECH_ITEMS,
    BENEFIT_ITEMS, VALUE_ITEMS, AWARD_ITEMS, ADDRESSES,
]

# patterns over the page text, tried in order; the first group is the value (fixed values)
HEAD_PATTERNS = {
    "heads_global": [
        r"(?i)Global[^:]*:\s*(\d+[\d,]*)", r"(?i)Worldwide[^:]*:\s*(\d+[\d,]*)", r"(?i)Total employees[^:]*:\s*(\d+[\d,]*)",
        r"(?i)(\d+[\d,]*)\+?\s*employees? globally",
    ],
    "heads_local": [
        r"(?i)Bulgaria[^:]*:\s*(\d+[\d,]*)", r"(?i)Bulgarian[^:]*:\s*(\d+[\d,]*)",
        r"(?i)(\d+[\d,]*)\+?\s*employees? in Bulgaria", r"(?i)Sofia[^:]*:\s*(\d+[\d,]*)",
    ],
    "heads_it": [
        r"(?i)IT[^:]*:\s*(\d+[\d,]*)", r"(?i)Tech[^:]*:\s*(\d+[\d,]*)", r"(?i)Engineering[^:]*:\s*(\d+[\d,]*)",
        r"(?i)(\d+[\d,]*)\+?\s*(?:IT|tech|engineering) employees?",
    ],
}
HQ_PATTERNS = [r"(?i)Headquarters[^:]*:\s*([^,\n]+)", r"(?i)HQ[^:]*:\s*([^,\n]+)", r"(?i)Head office[^:]*:\s*([^,\n]+)"]
YEAR_PATTERNS = [
    r"(?i)Founded[^:]*:\s*(\d{4})", r"(?i)Established[^:]*:\s*(\d{4})", r"(?i)Since[^:]*:\s*(\d{4})",
    r"(?i)(\d{4})\s*-\s*present", r"(?i)Founded in (\d{4})",
]
AWARD_PATTERNS = ["(?i)Best Employer[^.]+", r"(?i)Award[^.]+\d{4}", "(?i)Certified[^.]+", "(?i)Winner[^.]+", "(?i)Recognized[^.]+"]
EMAIL = r"[\w._%+-]+@[\w.-]+\.[A-Z|a-z]{2,}"
PHONE = r"\+?\d{1,4}?[-.\s]?\(?\d{1,3}?\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
SITE_ENDING = r"\.(com|bg|org|net|io|eu)$"


def _matches(source: Column, patterns: list[str]) -> list[Column]:
    return [present(F.regexp_extract(source, p, 1)) for p in patterns]


def company_name() -> Column:
    board = rules.PROFILE_BOARD
    found = first_where("names", lambda n: (n != "") & ~F.lower(n).contains(board))
    bare = F.regexp_replace(F.col("head_title")[0], r"(?i)\s*[-|–]\s*(dev\.bg).*$", "")
    return F.coalesce(found, present(text.strip(bare)))


def company_description() -> Column:
    return first_where("descriptions", lambda t: F.length(t) > 3)


def company_site() -> Column:
    def good(link: Column) -> Column:
        href = link["href"]
        named = any_contains(F.lower(link["text"]), ["website", "site"]) | href.rlike(SITE_ENDING)
        return ~any_contains(href, rules.SITE_LINK_EXCLUDED) & (named | (F.length(href) < 100))

    return F.get(F.filter("links", good), F.lit(0))["href"]


def company_logo() -> Column:
    src = first_where("logos", lambda s: s.startswith("http") | s.startswith("//"))
    return F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).otherwise(src)


def headcounts() -> dict[str, Column]:
    page = F.col("page_text")
    return {
        name: F.regexp_replace(F.coalesce(*_matches(page, patterns)), ",", "").try_cast("int")
        for name, patterns in HEAD_PATTERNS.items()
    }


def headquarters() -> Column:
    places = F.array_join(filled("places"), " ")
    return text.strip(F.coalesce(*_matches(places, HQ_PATTERNS)))


def offices() -> Column:
    return F.filter(text_list(rules.CITIES), lambda c: F.col("page_text").contains(c))


def founded_year(last: int) -> Column:
    """First year of the patterns that lies in 1900..last."""
    years = [F.regexp_extract(F.col("page_text"), p, 1).try_cast("int") for p in YEAR_PATTERNS]
    return F.coalesce(*[F.when(y.between(1900, last), y) for y in years])


def company_industry() -> Column:
    page = F.lower("page_text")
    word = first_hit(*[(page.contains(w), F.lit(name)) for w, name in rules.INDUSTRY_WORDS.items()])
    return F.coalesce(first_where("industries", lambda t: t != ""), word)


def job_openings() -> Column:
    counted = F.transform("job_counts", lambda t: F.regexp_extract(t, r"(\d+)", 1).try_cast("int"))
    return F.coalesce(F.get(F.filter(counted, lambda x: x.isNotNull()), F.lit(0)), F.col("n_job_links"))


def company_technologies() -> Column:
    listed = F.array_distinct(F.filter("tech_items", lambda t: F.length(t) > 1))
    return text.phrases(F.col("page_text"), rules.TECH_PHRASES, held=listed)


def company_benefits() -> Column:
    listed = F.array_distinct(F.filter("benefit_items", lambda t: F.length(t) > 3))
    return text.phrases(F.lower("page_text"), rules.BENEFIT_PHRASES, held=listed)


def company_values() -> Column:
    return F.array_distinct(F.filter("value_items", lambda t: F.length(t).between(4, 99)))


def company_awards() -> Column:
    listed = F.array_distinct(F.filter("award_items", lambda t: F.length(t) > 5))
    page = F.col("page_text")
    named = F.flatten(F.array(*[F.regexp_extract_all(page, F.lit(p), F.lit(0)) for p in AWARD_PATTERNS]))
    named = F.transform(F.filter(named, lambda t: F.length(t) < 200), lambda t: text.strip(t))
    new = F.array_except(named, listed)
    return F.concat(listed, new)


def social_links() -> dict[str, Column]:
    """First link per network; a link counts for the first network it names."""
    names = list(rules.NETWORKS.items())

    def link(i: int) -> Column:
        earlier = [needle for _, needle in names[:i]]
        mine = F.filter(
            "links", lambda x: x["href"].contains(names[i][1]) & ~any_contains(x["href"], earlier)
        )
        return F.get(mine, F.lit(0))["href"]

    return {name: link(i) for i, (name, _) in enumerate(names)}


def company_model() -> Column:
    page = F.lower("page_text")
    return first_hit(
        (any_contains(page, ["fully remote", "100% remote"]), F.lit("remote")),
        (any_contains(page, ["hybrid", "flexible office"]), F.lit("hybrid")),
        (any_contains(page, ["office-based", "on-site"]), F.lit("office")),
    )


def company_hours() -> Column:
    page = F.lower("page_text")
    return first_hit(
        (any_contains(page, ["flexible hours", "flexible working hours"]), F.lit("flexible")),
        (any_contains(page, ["standard hours", "9 to 5"]), F.lit("standard")),
        (page.contains("core hours"), F.lit("core_hours")),
    )


def contact() -> dict[str, Column]:
    page = F.col("page_text")
    return {
        "email": present(F.regexp_extract(page, EMAIL, 0)),
        "phone": present(F.regexp_extract(page, PHONE, 0)),
        "address": first_where("addresses", lambda t: F.length(t) > 10),
    }


def percent_present(*found: Column) -> Column:
    total = F.lit(0)
    for value in found:
        total = total + value.cast("int")
    return half_up(total / float(len(found)) * 100).cast("int")


def completeness13() -> Column:
    def some(name: str) -> Column:
        return F.size(name) > 0

    return percent_present(
        *[F.col(c).isNotNull() for c in ("name", "description", "website", "heads_global", "heads_local", "founded", "industry")],
        some("technologies"), some("benefits"), some("company_values"), some("offices"),
        F.col("work_model").isNotNull(), F.coalesce("linkedin", "facebook").isNotNull(),
    )


def has_key_facts() -> Column:
    return (
        present("name").isNotNull()
        | F.coalesce(non_zero("heads_global"), non_zero("heads_local")).isNotNull()
        | (F.size("technologies") > 0)
        | (F.size("benefits") > 0)
        | (F.col("job_openings") > 0)
    )


def company_facts(pages: DataFrame, year: int) -> DataFrame:
    """All company facts of every page, in one pass."""
    read = page_pass(pages, COMPANY_PICKS)
    facts = {
        "name": company_name(), "description": company_description(), "website": company_site(), "logo": company_logo(),
        **headcounts(), "headquarters": headquarters(), "offices": offices(), "founded": founded_year(year),
        "industry": company_industry(), "size": levels.size_in_page(F.col("page_text")), "job_openings": job_openings(),
        "technologies": company_technologies(), "benefits": company_benefits(), "company_values": company_values(),
        "awards": company_awards(), **social_links(), "work_model": company_model(), "working_hours": company_hours(),
        **contact(),
    }
    kept = [c for c in pages.columns if c != "html"]
    out = read.select(*kept, *[c.alias(n) for n, c in facts.items()])
    return out.withColumns({"completeness": completeness13(), "structured": has_key_facts()})


# ---- label/value company pages ----

INFO = Pick("info", scope=".info-item", parts=(Pick("label", "joined", (".label",)), Pick("value", "joined", (".value",))))
SIMPLE_TECH = Pick("tech_items", "all", (".tech-stack .tech-tag, .tech-tags .tech-tag, .technologies .technology, .skills-section .skill",))
SIMPLE_ICONS = Pick("tech_icons", "attrs", (".tech-stack img[title], .tech-tags img[title]",), "title")
SIMPLE_BENEFITS = Pick("benefit_items", "all", (".benefits-section li, .benefits-list li",))
SIMPLE_VALUES = Pick("value_items", "all", (".company-values li",))
SIMPLE_AWARDS = Pick("award_items", "all", (".awards-section .award",))
SIMPLE_JOBS = Pick("n_jobs", "count", (".job-openings .job-item",))
LABELS = {
    "industry": ("industry", "индустрия"), "size": ("size", "размер"), "founded": ("founded", "основана"),
    "location": ("location", "местоположение"),
}


def simple_name() -> Column:
    def tidy(name: Column) -> Column:
        line = text.squeeze(F.split_part(name, F.lit("\n"), F.lit(1)))
        return F.regexp_replace(line, r"(?i)\s+(missing|closing|tags|some|content).*$", "")

    usable = F.filter("names", lambda n: (n != "") & ~F.lower(n).contains(rules.PROFILE_BOARD))
    found = F.get(F.filter(F.transform(usable, tidy), lambda n: n != ""), F.lit(0))
    bare = F.regexp_replace(F.col("head_title")[0], r"(?i)\s*[-|–]\s*(dev\.bg).*$", "")
    return F.coalesce(found, present(text.strip(bare)))


def label_value_company(pages: DataFrame, year: int) -> DataFrame:
    """Company row of a page in the label/value layout."""
    picks = [NAME, HEAD_TITLE, DESCRIPTION, INDUSTRY, PAGE_TEXT, INFO, SIMPLE_TECH, SIMPLE_ICONS, SIMPLE_BENEFITS, SIMPLE_VALUES, SIMPLE_AWARDS, SIMPLE_JOBS]
    read = page_pass(pages, picks)

    def labelled(name: str) -> Column:
        """The value beside the label; empty text when the label is there without one; null without the label."""
        hits = F.filter("info", lambda i: any_contains(F.lower(F.coalesce(i["label"][0], F.lit(""))), list(LABELS[name])))
        joined = text.strip(F.array_join(F.transform(hits, lambda i: F.coalesce(i["value"][0], F.lit(""))), ""))
        return F.when(F.size(hits) > 0, joined)

    industry, year_text = labelled("industry"), labelled("founded")
    out = read.withColumns(
        {
            "name": simple_name(),
            "description": company_description(),
            "industry": F.when(industry.isNull(), company_industry()).otherwise(present(industry)),
            "size": present(labelled("size")),
            "founded": F.when(year_text.isNull(), founded_year(year)).otherwise(F.regexp_extract(year_text, r"^\s*(\d+)", 1).try_cast("int")),
            "location": present(labelled("location")),
            "technologies": F.concat(filled("tech_items"), F.col("tech_icons")),
            "benefits": filled("benefit_items"),
            "company_values": filled("value_items"),
            "awards": filled("award_items"),
            "job_openings": F.col("n_jobs"),
        }
    )
    out = out.withColumn("employee_count", levels.size_headcount("size")).withColumn("completeness", completeness10())
    return out.drop(*[p.name for p in picks])


def completeness10() -> Column:
    lists = [F.size(c) > 0 for c in ("technologies", "benefits", "company_values", "awards")]
    return percent_present(*[F.col(c).isNotNull() for c in ("name", "description", "industry", "size", "founded", "location")], *lists)


# ---- generic profiles and company web sites ----


def profile(pages: DataFrame) -> DataFrame:
    """Company profile by generic selectors; lists of at most 10, 15 and 5 entries."""
    # selectors in priority order (fixed values)
    picks = [
        first("p_names", ".company-name, .page-title, h1"), HEAD_TITLE,
        first("p_texts", ".company-description, .about-company, .company-info p", ".content .text, .company-details"),
        Pick("p_links", "links", ('a[href^="http"]:not([href*="dev.bg"])',)),
        first("p_places", ".company-location, .location, .address", "span:contains(София), span:contains(Пловдив), span:contains(Варна)"),
        first("p_sizes", ".company-size, .employees, .team-size"), first("p_industries", ".industry, .sector, .business-area"),
        Pick("p_benefits", "all", (".benefits li", ".perks li", ".company-benefits li", ".why-join-us li", ".advantages li")),
        Pick("p_techs", "all", (".technologies li", ".tech-stack li", ".skills li", ".tools li")),
        Pick("p_values", "all", (".values li", ".principles li", ".culture li", ".beliefs li")),
        PAGE_TEXT,
    ]
    read = page_pass(pages, picks)
    bare = text.strip(F.regexp_replace(F.col("head_title")[0], r"\s*-\s*dev\.bg.*$", ""))
    place = F.regexp_replace(F.col("p_places")[0], r"(?i)^Location:\s*", "")
    listed = F.array_distinct(filled("p_benefits"))
    page = F.lower("page_text")
    found = F.filter(text_list(rules.PROFILE_BENEFIT_PHRASES), lambda p: page.contains(p))
    site = F.get(F.filter("p_links", lambda x: ~any_contains(x["href"], ["linkedin.com", "facebook.com"])), F.lit(0))["href"]
    out = read.withColumns(
        {
            "name": F.coalesce(present(F.col("p_names")[0]), bare),
            "description": F.coalesce(present(F.col("p_texts")[0]), present(F.col("p_texts")[1])),
            "website": site,
            "location": F.coalesce(present(place), present(F.col("p_places")[1])),
            "employee_count": levels.first_integer(F.col("p_sizes")[0]),
            "size": levels.size_range(F.col("p_sizes")[0]),
            "industry": F.coalesce(present(F.col("p_industries")[0]), F.lit("Technology")),
            "benefits": F.concat(listed, found),
            "technologies": F.array_distinct(filled("p_techs")),
            "company_values": F.array_distinct(filled("p_values")),
        }
    )
    return out.drop(*[p.name for p in picks])


def company_site_page(pages: DataFrame) -> DataFrame:
    """Fields of a company's own web site."""
    # selectors in priority order (fixed values)
    picks = [
        first("w_names", "h1", ".company-name, .brand-name, .site-title"), HEAD_TITLE,
        first("w_about", ".about, .company-description, .intro, #about", ".hero-text, .hero-description"),
        Pick("w_meta", "attr", ('meta[name="description"]',), "content"),
        first("w_places", ".address, .location, .contact-address"),
        Pick("w_values", "all", (".values li, .mission, .vision", "h2:contains(Values) + * li, h3:contains(Mission) + * li")),
        Pick("w_benefits", "all", (".benefits li, .perks li, .careers-benefits li", "h2:contains(Benefits) + * li, h3:contains(Perks) + * li")),
        Pick("w_techs", "all", (".tech-stack li, .technologies li, .tools li", "h2:contains(Technology) + * li, h3:contains(Tech Stack) + * li")),
    ]
    read = page_pass(pages, picks)
    out = read.withColumns(
        {
            "name": F.coalesce(
                present(F.col("w_names")[0]), present(F.col("w_names")[1]), text.strip(F.split(F.col("head_title")[0], "[-|]")[0])
            ),
            "description": F.coalesce(present(F.col("w_about")[0]), present(F.col("w_meta")[0]), present(F.col("w_about")[1])),
            "location": present(F.col("w_places")[0]),
            "company_values": filled("w_values"),
            "benefits": filled("w_benefits"),
            "technologies": filled("w_techs"),
        }
    )
    return out.drop(*[p.name for p in picks])


# ---- end to end ----


def for_extraction(content: DataFrame, profile_name: str = "standard") -> DataFrame:
    """Content with the text that is extracted from and its hash, by which replies are found again."""
    rows = content.withColumn("for_extraction", registries.profile(profile_name).clean_text("content"))
    return rows.withColumn("content_hash", F.sha2("for_extraction", 256))


def extract_and_gate(rows: DataFrame, replies: DataFrame, threshold: int = 60) -> DataFrame:
    """The stored reply for equal text, and the quality gate, over rows of ``for_extraction``.

    ``replies`` has one (content_hash, reply) per hash. Pages without an accepted
    reply carry an error, pages below the threshold a warning.
    """
    rows = windows.split_join(rows, replies, ["content_hash"])
    rows = rows.withColumn("facts", jsons.reply("reply"))
    rows = rows.withColumn("quality", F.when(F.col("facts").isNotNull(), jsons.extraction_score(F.col("facts"))).otherwise(0))
    ok = F.col("facts").isNotNull()
    passed = ok & (F.col("quality") >= threshold)
    errors = issues(
        (F.col("for_extraction") == "", "No content"), (F.col("reply").isNull(), "No reply for this content"),
        (F.col("reply").isNotNull() & ~ok, "Reply not accepted"),
    )
    warnings = issues(
        (ok & ~passed, F.concat(F.lit("Quality validation failed (score: "), F.col("quality").cast("string"), F.lit(f", threshold: {threshold})"))),
        (ok & (F.col("facts.confidenceScore") < 50), F.lit("Low confidence")),
    )
    return rows.withColumns({"passed": passed, "success": ok, "errors": errors, "warnings": warnings})
