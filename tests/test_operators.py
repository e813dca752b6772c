"""Operators against brute force on small fixtures, hot keys included."""

import datetime as dt
import random

from pyspark.sql import functions as F

from jobloom.operators import components, joins, merge, ordering, quality, windows
from jobloom.sources import listing_pages
from jobloom.sources.inputs import view

START = dt.datetime(2024, 1, 1)


def test_previous_value_over_a_hot_key(spark):
    random.seed(1)
    rows = [
        (i, "hot" if i % 3 else f"k{i % 7}", START + dt.timedelta(minutes=random.randrange(20000)), float(random.randrange(100)))
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz, v double")
    got = {r.id: r.p for r in windows.with_previous(df, "k", "t", "id", "v", "p").collect()}
    want, last = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = last.get(k)
        last[k] = v
    assert got == want


def test_percentile_and_rank(spark):
    random.seed(2)
    rows = [(i, "a" if i % 3 else "b", random.randrange(8)) for i in range(120)] + [(200, "c", 5), (201, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {r.id: (r.pct, r.rank) for r in windows.with_peer_rank(windows.with_percentile(df, ["g"], "v", "pct"), {"g": "rank"}, "v").collect()}
    for i, g, v in rows:
        group = [x for _, h, x in rows if h == g and x is not None]
        if v is None:
            assert got[i] == (None, None)
            continue
        below, above = sum(x < v for x in group), sum(x > v for x in group)
        pct = below / (len(group) - 1) * 100 if len(group) > 1 else 0.0
        assert got[i] == (pct, f"{above + 1} of {len(group)}")


def test_connected_groups(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)]
    edges += [(300 + i, 301 + i) for i in range(40)] + [(1000, 1001 + i) for i in range(50)]  # a chain and a star
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")
    got = {r.node: r.group for r in components.connected_groups(df).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: root(n) for n in parent}


def test_stars_are_groups_without_a_round(spark, monkeypatch):
    # a hub, and many small stars with repeated, turned and empty links, are settled before any step
    links = [(0, 1 + i) for i in range(50)] + [(100 + 3 * i, 101 + 3 * i) for i in range(30)] + [(102 + 3 * i, 100 + 3 * i) for i in range(30)]
    df = spark.createDataFrame(links + links[:5] + [(7, 7), (None, 3), (3, None)], "a long, b long").repartition(4)
    want = {n: 0 for n in range(51)} | {100 + i: 100 + i - i % 3 for i in range(90)}
    monkeypatch.setattr(components, "_large_star", None)
    monkeypatch.setattr(components, "_small_star", None)
    assert {r.node: r.group for r in components.connected_groups(df).collect()} == want
    assert components.connected_groups(df.limit(0)).count() == 0
    # a link between two stars, or of two of their ends, is no star
    assert not components._settled(components._tidy(df.unionByName(spark.createDataFrame([(0, 100)], "a long, b long"))))
    assert not components._settled(components._tidy(df.unionByName(spark.createDataFrame([(50, 101)], "a long, b long"))))


def test_duplicate_pairs_are_linear_in_a_hot_title(spark):
    rows = [(i, 1, "Java Dev" if i % 2 else "java  DEV!", "d", START + dt.timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "vacancy_id long, company_id long, title string, description string, created_at timestamp_ntz")
    pairs = joins.duplicate_pairs(df).collect()
    assert len(pairs) == 59
    assert {p.original_id for p in pairs} == {0}
    assert {p.similarity for p in pairs} == {100}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 21, 1), (2, "B", None, 2), (3, "c", 30, 1)], "k int, s string, n int, o int")
    rows = {r.k: (r.s, r.n, r.action) for r in merge.upsert(old, new, ["k"], ["o"]).collect()}
    assert rows == {1: ("a", 10, "keep"), 2: ("B", 20, "update"), 3: ("c", 30, "insert")}
    rows = {r.k: (r.s, r.n) for r in merge.upsert(old, new, ["k"], ["o"], keep_null=False).collect()}
    assert rows[2] == ("B", None)


def test_scrape_decision(spark):
    when = dt.datetime(2024, 1, 10)
    stored = spark.createDataFrame(
        [(1, 1, "dev.bg", "u", when, True), (2, 1, "company_website", "u", when, True), (3, 1, "other", "u", when, True), (4, 2, "other", "u", when, False)],
        "source_id long, company_id long, source_site string, source_url string, last_scraped_at timestamp_ntz, is_valid boolean",
    )
    asked = spark.createDataFrame(
        [(1, "dev.bg", "u", False), (1, "company_website", "u", False), (1, "other", "v", False), (2, "other", "u", False), (2, "new", "u", True), (1, "other", "u", True)],
        "company_id long, source_site string, source_url string, force boolean",
    )
    rows = {(r.company_id, r.source_site, r.source_url): r.reason for r in merge.scrape_decision(asked, stored, "2024-01-20 00:00:00").collect()}
    assert rows[(1, "dev.bg", "u")] == "Within TTL window (expires in 480h)"
    assert rows[(1, "company_website", "u")] == "TTL expired (168h limit exceeded)"
    assert rows[(1, "other", "v")] == "Source URL has changed"
    assert rows[(2, "other", "u")] == "Source was marked as invalid"
    assert rows[(2, "new", "u")] == "No existing source found"
    assert rows[(1, "other", "u")] == "Force flag enabled - bypassing TTL"


def test_run_pages(spark):
    rows = [("a", i, 5 if i != 4 else 0) for i in range(1, 9)] + [("b", i, 5) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "site string, page int, n int")
    got = listing_pages.run_pages(df, "site", "page", F.col("n") == 0, max_pages=10).collect()
    assert sorted(r.page for r in got if r.site == "a") == [1, 2, 3]
    assert sorted(r.page for r in got if r.site == "b") == list(range(1, 11))


def test_paging_covers_all_rows_once(spark, small):
    rows = view(spark, small, "vacancy_facts").filter("status = 'active'")
    order = ordering.by_field("salary_min")
    whole = [r.vacancy_id for r in rows.orderBy(*order).collect()]
    pages = []
    for number in range(1, -(-len(whole) // 100) + 1):
        pages += [r.vacancy_id for r in ordering.page(rows, order, number, 100).collect()]
    assert pages == whole


def test_name_fixes(spark):
    companies = spark.createDataFrame([(1, "LinkedIn"), (2, "Acme")], "company_id long, name string")
    vacancies = spark.createDataFrame(
        [(1, 1, START, "https://dev.bg/company/jobads/java/"), (2, 1, START + dt.timedelta(1), "https://dev.bg/company/jobads/nova-dev/")],
        "vacancy_id long, company_id long, created_at timestamp_ntz, source_url string",
    )
    fixes = quality.name_fixes(companies, vacancies)
    assert [(r.company_id, r.new_name) for r in fixes.collect()] == [(1, "Nova")]
    assert {r.name for r in quality.apply_name_fixes(companies, fixes).collect()} == {"Nova", "Acme"}


def test_listings_without_a_url_are_kept(spark):
    stored = spark.createDataFrame(
        [("1", "Cook", 1, "", "filled"), ("2", "Mason", 2, "u2", "active")],
        "vacancy_id string, title string, company_id long, source_url string, status string",
    ).select("*", *[F.lit(None).cast("string").alias(c) for c in ("location", "experience_level", "employment_type", "work_model", "source_site")],
             *[F.lit(None).cast("int").alias(c) for c in ("salary_min", "salary_max")])
    listed = [(1, "Baker", 3, ""), (2, "Diver", 4, ""), (3, "Pilot", 5, None), (4, "Mason", 2, None), (5, "Cook", 1, ""), (6, "Pilot", 5, "u6"), (7, None, 1, "")]
    listings = spark.createDataFrame(
        [(i, t, c, u, None, "remote", "Ruse", "site", dt.datetime(2024, 1, i)) for i, t, c, u in listed],
        "listing_id long, title string, company_id long, url string, salary_range string, work_model string, location string, "
        "source_site string, posted_at timestamp_ntz",
    )
    rows = merge.upsert_vacancies(stored, listings).collect()
    got = sorted((r.title, r.company_id, r.source_url, r.action) for r in rows)
    assert got == [
        ("Baker", 3, "", "insert"), ("Cook", 1, "", "update"), ("Diver", 4, "", "insert"), ("Mason", 2, "u2", "update"), ("Pilot", 5, "u6", "insert"),
    ]
    assert all(r.vacancy_key for r in rows) and len({r.vacancy_key for r in rows}) == len(rows)


def test_ranks_without_a_group_are_those_of_a_window(spark):
    rows = spark.createDataFrame([(v,) for v in [5, 5, -3, 0, 2_000_000_000, 7, 7, 7, -2_000_000_000, 12, None]], "v int")
    counts = windows.value_counts(rows, [], "v")
    got = {r.v: (r.n_below, r.n_above, r.n_group) for r in windows.value_ranks(counts, [], "v").collect()}
    values = [r.v for r in rows.collect() if r.v is not None]
    assert got == {v: (sum(x < v for x in values), sum(x > v for x in values), len(values)) for v in set(values)}


def test_text_cuts_are_parameters(spark):
    from jobloom.functions import registries, text

    rows = spark.createDataFrame([("word " * 40 + "end",)], "t string")
    row = rows.select(
        text.drop_noise("t", 50).alias("a"), text.drop_noise("t").alias("b"),
        registries.profile("standard", max_length=30).clean_text("t").alias("c"), F.size(text.phrases(F.col("t"), ["word", "end"], 1)).alias("d"),
    ).first()
    assert row.a == ("word " * 10).strip()[:49] + "..." or row.a.endswith("...") and len(row.a) <= 53
    assert row.b == "word " * 40 + "end" and row.c.endswith("...") and row.d == 1


def brute_pairs(rows, least=80):
    """rows: (id, company, created, words); links of two vacancies of a company, the older one first."""
    out = set()
    for i, c, t, w in rows:
        for j, d, u, v in rows:
            if c == d and c is not None and (t, i) < (u, j) and w and v and 100 * len(w & v) >= least * len(w | v):
                out.add((i, j, int(len(w & v) * 100 / len(w | v) + 0.5)))
    return out


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(220):
        words = rng.sample(common, rng.randrange(3, 12)) + [f"r{rng.randrange(40)}" for _ in range(rng.randrange(0, 3))]
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None]), dt.datetime(2024, 1, 1 + rng.randrange(28)), " ".join(words[:2]).upper(), ", ".join(words[2:])))
    rows += [(1000 + i, 9, dt.datetime(2024, 1, 1), None if i % 2 else "", None if i % 3 else "--") for i in range(6)]
    frame = spark.createDataFrame(rows, "vacancy_id long, company_id int, created_at timestamp, title string, description string").repartition(3)
    sets = [(i, c, t, frozenset(f"{a or ''} {b or ''}".lower().replace(",", "").split()) - {"--"}) for i, c, t, a, b in rows]
    want = brute_pairs(sets)
    got = {tuple(r) for r in joins.similar_pairs(frame).collect()}
    # copies hang on the oldest of their word set only; every link between different sets is there
    first = {}
    for i, c, t, w in sorted(sets, key=lambda r: (r[2], r[0])):
        first.setdefault((c, w), i)
    firsts = {(i, j, s) for i, j, s in want if i in first.values() and j in first.values()}
    copies = {(first[c, w], i, 100) for i, c, t, w in sets if c is not None and w and first[c, w] != i}
    assert got == firsts | copies
    assert len(firsts) > 20 and len(copies) > 0


def test_reordered_titles_pair_and_unlike_offers_do_not(spark):
    text = "Build services in Java and Kafka for a bank in Sofia"
    rows = [(1, 5, "Senior Java Developer", text), (2, 5, "Java Developer (Senior)", text), (3, 5, "Senior Java Developer", "Sell shoes"), (4, 6, "Java Developer (Senior)", text)]
    frame = spark.createDataFrame(rows, "vacancy_id long, company_id int, title string, description string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    got = {(r.original_id, r.duplicate_id): (r.similarity, r.detection_method) for r in joins.duplicate_pairs(frame).collect()}
    assert got[1, 2] == (100, "similarity")
    assert got[1, 3][0] < 50 and got[1, 3][1] == "title_match"
    assert len(got) == 2
    groups = {r.vacancy_id: r.canonical_id for r in quality.duplicate_groups(frame).collect()}
    assert groups == {1: 1, 2: 1}


def test_copies_of_one_company_make_linear_pairs(spark):
    rows = spark.range(3000).selectExpr("id AS vacancy_id", "7 AS company_id", "'Baker' AS title", "concat('bread ', id % 3) AS description", "timestamp_seconds(id) AS created_at")
    assert joins.similar_pairs(rows, 60).count() <= 3000
