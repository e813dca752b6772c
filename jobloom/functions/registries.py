"""Editable rule tables: technologies, job boards, translations and cleaning profiles.

Each is an immutable value; an edit returns a new one. ``rows`` gives the table
as (name, pattern) pairs for storing, and the functions in this package take the
tables as arguments, so an edited table changes the expression that is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession

from jobloom.functions import rules, strings, text, urls


@dataclass(frozen=True)
class TechRules:
    patterns: dict[str, list[str]] = field(default_factory=lambda: dict(rules.TECH_PATTERNS))

    def names(self) -> list[str]:
        return sorted(self.patterns)

    def add(self, name: str, *needles: str) -> TechRules:
        return replace(self, patterns={**self.patterns, name.lower(): [n.lower() for n in needles]})

    def remove(self, name: str) -> TechRules:
        return replace(self, patterns={k: v for k, v in self.patterns.items() if k != name.lower()})

    def find(self, column: Column | str) -> Column:
        return text.technologies_by_index(column, self.patterns)

    def rows(self, spark: SparkSession) -> DataFrame:
        pairs = [(name, needle) for name, needles in self.patterns.items() for needle in needles]
        return spark.createDataFrame(pairs, "tech string, needle string")


@dataclass(frozen=True)
class BoardRules:
    names: tuple[str, ...] = tuple(rules.BOARD_NAMES)
    domains: tuple[str, ...] = tuple(rules.BOARD_DOMAINS)

    def add_name(self, name: str) -> BoardRules:
        return self if name in self.names else replace(self, names=(*self.names, name))

    def add_domain(self, domain: str) -> BoardRules:
        return self if domain in self.domains else replace(self, domains=(*self.domains, domain))

    def accepts_name(self, column: Column | str) -> Column:
        return urls.is_company_name(column, list(self.names))

    def accepts_url(self, column: Column | str) -> Column:
        return urls.is_company_url(column, list(self.domains))


@dataclass(frozen=True)
class TermRules:
    locations: dict[str, str] = field(default_factory=lambda: dict(rules.LOCATIONS))
    terms: dict[str, str] = field(default_factory=lambda: dict(rules.JOB_TERMS))

    def with_location(self, source: str, target: str) -> TermRules:
        return replace(self, locations={**self.locations, source: target})

    def with_term(self, source: str, target: str) -> TermRules:
        return replace(self, terms={**self.terms, source: target})

    def location(self, column: Column | str) -> Column:
        return strings.location(column, self.locations)

    def job_terms(self, column: Column | str) -> Column:
        return strings.job_terms(column, self.terms)


@dataclass(frozen=True)
class CleaningProfile:
    name: str
    remove: tuple[str, ...]
    keep: tuple[str, ...]
    containers: tuple[str, ...]
    patterns: tuple[str, ...]
    min_length: int
    #: characters kept of a cleaned text; None keeps all
    max_length: int | None = None

    def clean_text(self, column: Column | str) -> Column:
        return text.by_profile(column, list(self.patterns), self.max_length)


# fixed values of the two profiles
PROFILES = {
    "standard": CleaningProfile(
        name="standard",
        remove=(
            "nav", "header", "footer", "aside", "script", "style", "noscript", "iframe",
            ".sidebar", ".menu", ".navigation", ".breadcrumb",
            ".social", ".share", ".follow", ".subscribe", '[class*="social"]',
            ".ad", ".ads", ".advertisement", ".sponsored", '[class*="ad-"]', '[class*="promo"]',
            ".comments", ".reviews", '[class*="comment"]', '[class*="review"]',
            ".cookie", ".popup", ".modal", ".overlay", '[class*="cookie"]',
            "form:not(.application-form)", "button:not(.apply-button)", 'input:not([type="hidden"])',
        ),
        keep=(
            "main", "article", ".content", ".main-content", '[role="main"]',
            ".job-description", ".job-details", ".job-requirements", ".responsibilities",
            ".company-info", ".salary", ".compensation", ".benefits",
        ),
        containers=("main", "article", ".content", ".main-content", "body"),
        patterns=(
            "privacy policy|cookie policy|terms of service|we use cookies|accept.*cookies",
            "follow us|share this|subscribe.*newsletter|join.*mailing list",
            "click here|read more|view all|show more|load more",
            r"home\s*[>|]\s*|breadcrumb|skip to|go to",
        ),
        min_length=100,
    ),
    "aggressive": CleaningProfile(
        name="aggressive",
        remove=(
            "nav", "header", "footer", "aside", "form", "script", "style", "noscript",
            "iframe", "object", "embed", "video", "audio", "button", "input", "select", "textarea",
            ".sidebar", ".menu", ".social", ".ad", ".ads", ".comments", ".cookie", ".popup",
        ),
        keep=("main", "article", "p", "h1", "h2", "h3", "ul", "ol", "li"),
        containers=("main", "article", ".content", "body"),
        patterns=(
            r"©.*?\d{4}|copyright.*?\d{4}|all rights reserved",
            "powered by|built with|click here|read more",
        ),
        min_length=50,
    ),
}


def profile(name: str, **changes) -> CleaningProfile:
    """A profile by name with overrides; an unknown name is an error."""
    if name not in PROFILES:
        raise ValueError(f"no cleaning profile {name!r}; there are {sorted(PROFILES)}")
    return replace(PROFILES[name], **changes)
