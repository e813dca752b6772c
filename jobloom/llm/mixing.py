"""Mixing sources to target weights by hierarchical budgets, in column functions alone.

The tree is domain, language, source. A leaf holds the tokens of its documents and can give
``max_epochs`` times as many. The total budget flows down: a node's budget is dealt to its
children by their weights; a child that cannot use its share gives what is over to its
siblings, by their weights again, until the node's budget is spent or all children are full.
A node's own budget never exceeds what its leaves can give, so a shortage is met by siblings
first and reaches the parent's siblings only when all of them are full.

Each leaf repeats whole epochs while its budget lasts and takes a prefix of the next one, in
an order drawn by seed and epoch, of documents that fit the rest in full. The prefix is found
by descent: tokens are added up by ranges of the drawn number, the range that crosses the
budget is split again, and only the documents of the last range are put in order. So a leaf
with a third of all rows is never sorted in one task.

All amounts are whole tokens in decimals; each level's shares are exact and add up.

Nulls: a null language or source is a leaf of its own, named "". A null or empty text has no
tokens; such rows are taken with every epoch their leaf gives, and a leaf without any tokens
gives one epoch. Rows are drawn by doc_id and text, so rows that share an id, or have none, are drawn
apart; equal rows are each counted and are taken together or not at all, and ties in the drawn order
go to the smaller doc_id. An empty table gives no rows. ``mix`` keeps all columns, whatever
their names, and repeats a row once for each time it is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ["domain", "language", "source"]
#: Whole-number weights; what is not named weighs 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}
#: Tokens asked for, as a part of what the table holds; and how often a document may repeat.
BUDGET = (1, 1)
MAX_EPOCHS = 4
SEED = 11
#: Hexadecimal digits of the drawn number that each step of the descent looks at.
DIGITS, STEPS = 2, 2
#: Leaves whose budgets may be broadcast (some 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_LEAVES = 50_000
WIDE = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """Sources are dealt to four domains by the number in their name."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit("d0")).otherwise(F.concat(F.lit("d"), (F.nullif(digits, F.lit("")).cast("int") % 4).cast("string")))


def weight_of(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out.cast(WIDE)


def leaf_columns(docs: DataFrame) -> dict[str, Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {"domain": domain_of(source), "language": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": source}


def slim(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, language, source, n_tokens, digest) of every row."""
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id"), *[c.alias(n) for n, c in leaf_columns(docs).items()], tokens.alias("n_tokens"), digest().alias("digest"))


def digest() -> Column:
    """Half the MD5 of a row's text, which tells rows of one id apart."""
    return F.left(F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")), F.lit(16))


def deal(nodes: DataFrame, parents: list[str], weight: Column) -> DataFrame:
    """Deals ``given`` of each parent to its children (columns ``can`` and ``given``) as ``budget``.

    Children in order of what they can take for their weight: one is full if its share of
    what is left exceeds what it can take. The others split the rest by cumulative rounding.
    """
    order = [(F.col("can") / F.col("weight").cast("double")), *[F.col(c) for c in nodes.columns if c in LEVELS]]
    nodes = nodes.withColumn("weight", weight)
    before = Window.partitionBy(*parents).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parents).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parents)
    zero = F.lit(0).cast(WIDE)
    nodes = nodes.withColumns({"taken": F.coalesce(F.sum("can").over(before), zero), "open": F.sum("weight").over(onward)})
    full = F.col("can") * F.col("open") <= F.col("weight") * (F.col("given") - F.col("taken"))
    nodes = nodes.withColumn("full", full)
    kept = F.when(F.col("full"), F.col("can")).otherwise(zero)
    light = F.when(F.col("full"), zero).otherwise(F.col("weight"))
    nodes = nodes.withColumns({"rest": (F.col("given") - F.sum(kept).over(whole)).cast(WIDE), "light": light})
    nodes = nodes.withColumns({"all": F.sum("light").over(whole).cast(WIDE), "upto": F.sum("light").over(before.rowsBetween(Window.unboundedPreceding, 0)).cast(WIDE)})
    share = "CAST(CAST(upto * rest AS DECIMAL(38,0)) div `all` - CAST((upto - light) * rest AS DECIMAL(38,0)) div `all` AS DECIMAL(38,0))"
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("can")).otherwise(F.expr(share)))


def budgets(rows: DataFrame, part: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, language, source, tokens, budget) of every leaf of rows (leaf, n_tokens)."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").cast(WIDE).alias("tokens"))
    leaves = leaves.withColumn("can", (F.col("tokens") * max_epochs).cast(WIDE)).checkpoint()
    languages = leaves.groupBy("domain", "language").agg(F.sum("can").cast(WIDE).alias("can"))
    domains = leaves.groupBy("domain").agg(F.sum("can").cast(WIDE).alias("can"), F.sum("tokens").cast(WIDE).alias("tokens"))
    # the domains are few by their definition, so one window may hold them all
    whole = Window.partitionBy("root")
    totals = {"all_can": F.sum("can").over(whole).cast(WIDE), "all_tokens": F.sum("tokens").over(whole).cast(WIDE)}
    domains = domains.withColumn("root", F.lit(0)).withColumns(totals)
    asked = F.expr(f"CAST(all_tokens * {part[0]} div {part[1]} AS {WIDE})")
    domains = domains.select("root", "domain", "can", F.least(asked, F.col("all_can")).alias("given"))
    top = deal(domains, ["root"], weight_of("domain", DOMAIN_WEIGHTS))
    middle = deal(
        languages.join(top.select("domain", F.col("budget").alias("given")), "domain"), ["domain"], weight_of("language", LANGUAGE_WEIGHTS)
    )
    given = middle.select("domain", "language", F.col("budget").alias("given"))
    return deal(leaves.join(given, ["domain", "language"]), ["domain", "language"], F.lit(1).cast(WIDE)).select(*LEVELS, "tokens", "budget")


def drawn(epoch: Column) -> Column:
    """A number for each document (doc_id, digest) and epoch, as nine hexadecimal digits."""
    key = F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")
    return F.left(F.md5(F.encode(key, "UTF-8")), F.lit(9))


def joined(rows: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """Rows with their leaf's plan; broadcast only where the number of leaves is known to be small."""
    return rows.join(F.broadcast(plan) if size <= BROADCAST_LEAVES else plan, LEVELS)


def plan_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """((leaf, epochs, last_draw, last_doc), number of leaves): what each leaf takes.

    A document is taken ``epochs`` times, and once more if it does not stand behind
    (last_draw, last_doc) in the order of the epoch after; null: none is.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    leaf = budgets(rows)
    epochs = F.when(F.col("tokens") == 0, F.lit(1)).otherwise(F.expr("CAST(budget div nullif(tokens, 0) AS INT)"))
    leaf = leaf.withColumn("epochs", epochs)
    rest = F.when(F.col("tokens") == 0, F.lit(0)).otherwise(F.col("budget") - F.col("epochs") * F.col("tokens"))
    leaf = leaf.select(*LEVELS, "epochs", rest.cast(WIDE).alias("rest")).checkpoint()
    size = leaf.count()
    # the range still open in each leaf, and the tokens before it
    open_ = leaf.filter("rest > 0").select(*LEVELS, "epochs", "rest", F.lit("").alias("range"), F.lit(0).cast(WIDE).alias("base"))
    for step in range(1, STEPS + 1):
        near = joined(rows, open_, size).withColumn("draw", drawn(F.col("epochs"))).filter(F.col("draw").startswith(F.col("range")))
        sums = near.groupBy(*LEVELS, "epochs", "rest", "base", F.left("draw", F.lit(step * DIGITS)).alias("range")).agg(F.sum("n_tokens").cast(WIDE).alias("n"))
        order = Window.partitionBy(*LEVELS).orderBy("range")
        sums = sums.withColumn("upto", (F.col("base") + F.sum("n").over(order)).cast(WIDE)).filter("upto > rest")
        first = sums.withColumn("k", F.row_number().over(order)).filter("k = 1")
        open_ = first.select(*LEVELS, "epochs", "rest", "range", (F.col("upto") - F.col("n")).cast(WIDE).alias("base")).checkpoint()
    near = joined(rows, open_, size).withColumn("draw", drawn(F.col("epochs"))).filter(F.col("draw").startswith(F.col("range")))
    # equal rows are one, so that a row of which there are many is not many rows of one task
    near = near.groupBy(*LEVELS, "rest", "base", "draw", "doc_id").agg(F.sum("n_tokens").cast(WIDE).alias("n_tokens"))
    order = Window.partitionBy(*LEVELS).orderBy("draw", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("upto", F.col("base") + F.sum("n_tokens").over(order))
    last = near.filter("upto <= rest").groupBy(*LEVELS).agg(F.max(F.struct("draw", "doc_id")).alias("last"))
    ends = open_.join(last, LEVELS, "left").select(
        # nothing of the open range fits: all before the range does
        *LEVELS, F.coalesce("last.draw", "range").alias("last_draw"), F.col("last.doc_id").alias("last_doc"), F.col("last").isNotNull().alias("inside")
    )
    return leaf.select(*LEVELS, "epochs").join(ends, LEVELS, "left").checkpoint(), size


def times() -> Column:
    """How often a row with its leaf's plan is taken."""
    draw = drawn(F.col("epochs"))
    tie = F.col("inside") & (draw == F.col("last_draw")) & (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= F.col("last_doc"), F.lit(False)))
    more = (draw < F.col("last_draw")) | tie
    return F.col("epochs") + F.when(F.col("last_draw").isNotNull() & more, 1).otherwise(0)


def selection(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, language, source, n_tokens, times) of every document that is taken."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = slim(docs).checkpoint()
    plan, size = plan_of(rows)
    out = joined(rows, plan, size).withColumn("times", times().cast("int")).filter("times > 0")
    return out.select("doc_id", *LEVELS, "n_tokens", "times")


def mix(docs: DataFrame) -> DataFrame:
    """The documents taken, all columns, one row for each time, with ``epoch`` counted from 0.

    Where the documents have a column of that name, the new one gets as many ``_`` before it as it needs.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    plan, size = plan_of(slim(docs).checkpoint())
    plan = plan.select(F.struct(*LEVELS).alias("_leaf"), F.struct("epochs", "last_draw", "last_doc", "inside").alias("_plan"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*columns).alias("_row"), digest().alias("digest"), F.struct(*[c.alias(n) for n, c in leaf_columns(docs).items()]).alias("_leaf"))
    met = whole.join(F.broadcast(plan) if size <= BROADCAST_LEAVES else plan, "_leaf")
    flat = met.select("_row", F.col("_row.doc_id").alias("doc_id"), "digest", "_plan.*")
    taken = flat.withColumn("_times", times().cast("int")).filter("_times > 0")
    name = "epoch"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    each = taken.select("_row", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias(name))
    return each.select("_row.*", name)


#: The selection in DuckDB's SQL, over a relation {docs}; the order, shares and prefixes are the same.
ORACLE = r"""
    WITH rows AS (
        SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source,
            CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'd0'
                ELSE 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) END AS domain,
            len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens, left(md5(coalesce(text, '')), 16) AS digest
        FROM {docs}
    ), leaves AS (
        SELECT domain, language, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * {epochs} AS HUGEINT) AS can
        FROM rows GROUP BY ALL
    ), d0 AS (
        SELECT domain, CAST(sum(can) AS HUGEINT) AS can, {domain_weight} AS weight,
            (SELECT least(sum(tokens) * {num} // {den}, sum(can)) FROM leaves) AS given FROM leaves GROUP BY domain
    ), d1 AS ({deal_d0}), m0 AS (
        SELECT domain, language, CAST(sum(leaves.can) AS HUGEINT) AS can, {language_weight} AS weight, any_value(d1.budget) AS given
        FROM leaves JOIN d1 USING (domain) GROUP BY domain, language
    ), m1 AS ({deal_m0}), s0 AS (
        SELECT domain, language, source, tokens, leaves.can, 1 AS weight, m1.budget AS given FROM leaves JOIN m1 USING (domain, language)
    ), s1 AS ({deal_s0}), plan AS (
        SELECT domain, language, source, CASE WHEN tokens = 0 THEN 1 ELSE CAST(budget // tokens AS INT) END AS epochs,
            CASE WHEN tokens = 0 THEN 0 ELSE budget - (budget // tokens) * tokens END AS rest FROM s1
    ), ordered AS (
        SELECT doc_id, domain, language, source, n_tokens, epochs, rest,
            sum(n_tokens) OVER (PARTITION BY domain, language, source
                ORDER BY left(md5('{seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 9), doc_id) AS upto
        FROM rows JOIN plan USING (domain, language, source)
    )
    SELECT doc_id, domain, language, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INT) AS times
    FROM ordered WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""


def oracle(docs: str = "documents") -> str:
    """``ORACLE`` over a named relation, with this module's parameters."""

    def dealt(table: str, parents: str, names: str) -> str:
        by = f"PARTITION BY {parents} " if parents else ""
        order = f"{by}ORDER BY CAST(can AS DOUBLE) / CAST(weight AS DOUBLE), {names}"
        first = f"""SELECT *, coalesce(sum(can) OVER (ROWS_W ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
            sum(weight) OVER (ROWS_W ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {table}""".replace("ROWS_W", order)
        second = f"SELECT *, can * open <= weight * (given - taken) AS is_full FROM ({first})"
        third = f"""SELECT *, given - sum(CASE WHEN is_full THEN can ELSE 0 END) OVER ({by}) AS rest_,
            CASE WHEN is_full THEN 0 ELSE weight END AS light FROM ({second})"""
        fourth = f"SELECT *, sum(light) OVER ({by}) AS all_, sum(light) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto FROM ({third})"
        share = "(upto * rest_) // nullif(all_, 0) - ((upto - light) * rest_) // nullif(all_, 0)"
        return f"SELECT * EXCLUDE (light), CASE WHEN is_full THEN can ELSE {share} END AS budget FROM ({fourth})"

    def weight(column: str, weights: dict[str, int]) -> str:
        return "CASE " + column + "".join(f" WHEN '{n}' THEN {w}" for n, w in weights.items()) + " ELSE 1 END"

    return ORACLE.format(
        docs=docs, epochs=MAX_EPOCHS, num=BUDGET[0], den=BUDGET[1], seed=SEED,
        domain_weight=weight("domain", DOMAIN_WEIGHTS), language_weight=weight("language", LANGUAGE_WEIGHTS),
        deal_d0=dealt("d0", "", "domain"), deal_m0=dealt("m0", "domain", "domain, language"),
        deal_s0=dealt("s0", "domain, language", "domain, language, source"),
    )
