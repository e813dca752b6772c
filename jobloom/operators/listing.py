"""The composed list queries: all filters at once, then count, sort and page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators import aggregates, filters, joins, ordering


@dataclass(frozen=True)
class VacancyQuery:
    """What a reader may ask for at once. Empty values are absent; ``sort`` may also be ``score``."""

    conditions: filters.VacancyFilter = field(default_factory=filters.VacancyFilter)
    technologies: tuple[str, ...] = ()
    need_all: bool = False
    sort: str = "created_at"
    descending: bool = True
    page: int = 1
    size: int = 20

    def matches(self, vacancies: DataFrame, vacancy_tech: DataFrame) -> DataFrame:
        """All matching vacancies, unsorted."""
        rows = vacancies.filter(self.conditions.predicate())
        if not self.technologies:
            return rows
        return filters.with_technologies(rows, vacancy_tech, list(self.technologies), self.need_all)

    def rows(self, vacancies: DataFrame, companies: DataFrame, vacancy_tech: DataFrame, scores: DataFrame) -> DataFrame:
        """One page with each vacancy's company; the company is joined to the page only."""
        found = self.matches(vacancies, vacancy_tech)
        if self.sort == "score":
            found, order = ordering.by_score_count(found, scores)
        else:
            order = ordering.by_field(self.sort, self.descending)
        return joins.with_company(ordering.page(found, order, self.page, self.size), companies).orderBy(*order)

    def info(self, vacancies: DataFrame, vacancy_tech: DataFrame) -> DataFrame:
        """Total and number of pages."""
        return ordering.page_info(self.matches(vacancies, vacancy_tech), self.size)


@dataclass(frozen=True)
class CompanyQuery:
    """``analysed`` asks for companies with (True) or without (False) an analysis; ``sort`` is ``name`` or a metric."""

    conditions: filters.CompanyFilter = field(default_factory=filters.CompanyFilter)
    analysed: bool | None = None
    sort: str = "name"
    descending: bool | None = None
    page: int = 1
    size: int = 20

    def matches(self, companies: DataFrame, analyses: DataFrame) -> DataFrame:
        rows = companies.filter(self.conditions.predicate())
        if self.analysed is None:
            return rows
        return (joins.having if self.analysed else joins.without)(rows, analyses, "company_id")

    def order(self) -> list[Column]:
        down = self.sort != "name" if self.descending is None else self.descending
        if self.sort == "name":
            return [F.desc("name") if down else F.asc("name"), F.asc("company_id")]
        return ordering.by_metric(self.sort, down)

    def rows(self, companies: DataFrame, analyses: DataFrame, vacancies: DataFrame) -> DataFrame:
        """One page with each company's newest scores and its number of open vacancies."""
        found = joins.with_latest_analysis(self.matches(companies, analyses), analyses)
        page = ordering.page(found, self.order(), self.page, self.size)
        return aggregates.open_per_company(page, vacancies).orderBy(*self.order())

    def info(self, companies: DataFrame, analyses: DataFrame) -> DataFrame:
        return ordering.page_info(self.matches(companies, analyses), self.size)
