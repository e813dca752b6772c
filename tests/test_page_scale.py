"""Pages made from a few MB of rows are made and read on all cores, and a worker's rows stay bounded."""

import pandas as pd
import pytest

from jobloom.operators.pages import Page, Pick, compiled, page_pass, slices
from jobloom.plans import QUERIES
from jobloom.sources.inputs import PARTITIONS, TASKS_A_CORE

LISTED = ("pg_label_value", "pg_structured", "pg_profile", "pg_site", "pg_cards", "pg_listing", "pg_icons")
DEALT = sorted(k for k in QUERIES if k.startswith("pg_com") or k in LISTED)


@pytest.fixture
def cluster(spark):
    """A session that names no number of partitions, as on a cluster."""
    named = spark.conf.get(PARTITIONS)
    spark.conf.unset(PARTITIONS)
    yield spark
    spark.conf.set(PARTITIONS, named)


@pytest.mark.parametrize("key", DEALT)
def test_rows_are_dealt_out_before_they_become_pages(cluster, small, key):
    plan = QUERIES[key](cluster, small)._jdf.queryExecution().executedPlan().toString()
    above, exchange, below = plan.partition("RoundRobinPartitioning(")
    assert exchange and below.startswith(f"{TASKS_A_CORE * cluster.sparkContext.defaultParallelism})")
    assert "MapInPandas" in above and "MapInPandas" not in below
    # narrow rows are shuffled, not the pages made of them
    assert "<html>" not in below


def test_slices():
    assert list(slices([3, 3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(slices([7], 6)) == [(0, 1)] and list(slices([0, 0], 6)) == [(0, 2)]


def test_rows_go_out_slice_by_slice(spark, monkeypatch):
    """No frame that leaves the worker holds the rows of all pages of its batch."""
    frame = spark.createDataFrame([(i, "<p>" + "x" * 97) for i in range(40)], "page_id int, html string").coalesce(1)
    taken = {}
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, read, schema: taken.setdefault("read", read))
    monkeypatch.setattr(slices, "__defaults__", (1000,))
    page_pass(frame, [Pick("p", "all", ("p",))])
    out = list(taken["read"](iter([pd.DataFrame({"page_id": range(40), "html": ["<p>" + "x" * 97] * 40})])))
    assert [len(part) for part in out] == [10] * 4
    assert pd.concat(out)["page_id"].tolist() == list(range(40))


def test_tasks_when_no_executor_has_come_yet(cluster, small):
    """On a cluster that is still starting, cores say little: the session's shuffle partitions count."""
    named = cluster.conf.get("spark.sql.shuffle.partitions")
    cluster.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        plan = QUERIES["pg_label_value"](cluster, small)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning(211)" in plan
    finally:
        cluster.conf.set("spark.sql.shuffle.partitions", named)


class Slow(Page):
    """Reads every tag by the standard parser."""

    def _feed_plain(self, html):
        return 0


PLAIN = '<html><title>A &amp; B</title><DIV class="x y" id="">1 &lt 2<p>a<p>b</p><img src="s"><b>c</div>d</b></html>'
ODD = ("<!-- <b> -->", "<script>if (a<b) x</script>", "a < b &am", "<br/>", "<a href=x>", '<a b="1&amp;2">', "</ p>", "<p", "&", "</>", "<?x?>", '<i t="a>b">')


def shape(page):
    return [(n.tag, n.attrs, n.start, n.end, n.stop) for n in page.nodes], page.pieces


@pytest.mark.parametrize("odd", ODD)
def test_plain_tags_are_read_as_the_parser_reads_them(odd):
    assert shape(Page(PLAIN)) == shape(Slow(PLAIN))
    for i in range(len(PLAIN) + 1):
        html = PLAIN[:i] + odd + PLAIN[i:]
        assert shape(Page(html)) == shape(Slow(html)), html


def test_plain_pages_do_not_reach_the_parser(monkeypatch):
    def refuse(self, rest):
        raise AssertionError(rest)

    monkeypatch.setattr(Page, "feed", refuse)
    assert Page(PLAIN).text() == "A & B1 < 2abcd"


def test_selectors_whose_elements_a_page_lacks_are_not_tried(monkeypatch):
    from jobloom.operators import pages

    def refuse(*args):
        raise AssertionError(args)

    page = Page("<ul><li>a</li><li>b</li></ul>")
    assert [page.text(n) for n in page.find("ul li, .x li")] == ["a", "b"]
    monkeypatch.setattr(pages, "chain_matches", refuse)
    assert page.find(".technologies li, table + li") == [] and compiled(".x + b, *")[0][0] == {".x", "b"}
