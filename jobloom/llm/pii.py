"""Personal data by bootstrapped contextual extraction, in column functions and joins.

Seeds are the spans that four fixed patterns with checks find: e-mail and IP addresses, card and
phone numbers. The words around the seeds are lexical patterns. Candidates are strings of a
wider form (``CANDIDATE``) that no seed covers. Patterns and identifiers are the two sides of a
graph, with one edge for each distinct pair, so that copies of a document add nothing. In each
round a pattern's confidence for a kind is the share of known identifiers of that kind among
all identifiers it stands by; where it is high and rests on enough of them, its other identifiers
gain a score, and those with a high one are known in the next round. In the end an occurrence
that stands in a trusted pattern and holds an identifier known for the pattern's kind is a span
of that kind, unless it overlaps a seed's.

The texts are read once; a table of the spans and candidates with their contexts is written to the
shared folder. All later steps are joins and aggregates of it, dealt so that a frequent pattern
or identifier can be split. Patterns never run back over a text: runs start at their first sign only and
give nothing back, so that their time is in proportion to the text.

A null text counts as empty. Repeated rows, and rows with a null or repeated doc_id, are each
judged and returned. Empty texts have no spans, an empty table no rows. Extra columns are left
out, whatever their names. Positions count code points; the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from jobloom.operators.windows import split_join
from jobloom.session import ensure_checkpoint_dir, scratch

#: A kind's place in the order of spans that start together.
KINDS = ["email", "ip", "card", "phone"]
#: The seeds' patterns. A run is tried at its first sign, or where the last match ended, and nowhere else.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

_MAILBOX, _HOST = r"\p{L}\p{N}._%+-", r"\p{L}\p{N}-"
CANDIDATE = (
    rf"(?<![{_MAILBOX}])[{_MAILBOX}]{{1,64}}+(?:@| ?[(\[]at[)\]] ?)[{_HOST}]++(?:\.[{_HOST}]++)*+"
    r"|(?<![\p{L}\p{N}:.])(?:[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}+|[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){3,7}+)(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}])(?:[0-9]{7,19}+|\(?[0-9]{2,6}+(?:[ ().\-/]{1,2}[0-9]{2,6}+){1,5}+)(?![\p{L}\p{N}])"
)
#: Code points on each side that a context is read from.
AROUND = 40
ROUNDS = 3
#: A pattern is trusted from this share of known identifiers (one more is counted as unknown) and this many of them.
CONFIDENCE, SUPPORT = 0.8, 5
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string,before:string,after:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """Sums of an array up to each place. Blocks of about the root of its size keep copying small."""
    empty = F.array().cast("array<bigint>")

    def sums(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("t"), empty.alias("a"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc.t + x).alias("t"), F.concat(acc.a, F.array(acc.t + x)).alias("a"))

        return F.aggregate(block, start, step, lambda acc: acc.a)

    def of(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda b: F.slice(all_, b * size + 1, size))
        return let(F.transform(blocks, sums), join)

    def join(inner: Column) -> Column:
        ends = sums(F.transform(inner, lambda a: F.element_at(a, -1)))
        before = F.concat(F.array(F.lit(0).cast("bigint")), ends)
        shifted = F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda a, o: F.transform(a, lambda x: x + o))
        return F.flatten(shifted)

    return F.when(F.size(lengths) == 0, empty).otherwise(let(lengths, of))


def spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None, hint: Column) -> Column:
    """Spans of a pattern's matches, leftmost and without overlap, that ``keep`` lets pass.

    The gaps between matches give the places and the words around them in one pass. ``hint`` is a quick
    test that every text with a match passes.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: with_gaps(found, gaps))

    def with_gaps(found: Column, gaps: Column) -> Column:
        both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, f: (F.length(g) + F.length(f)).cast("bigint"))
        parts = F.arrays_zip(
            found.alias("f"), running(both).alias("e"), F.slice(gaps, 1, F.size(found)).alias("b"), F.slice(gaps, 2, F.size(found)).alias("a")
        )
        made = F.transform(
            parts,
            lambda p: F.struct(
                (p.e - F.length(p.f)).cast("bigint").alias("start"),
                F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS)).alias("rank"),
                p.e.cast("bigint").alias("end"),
                F.lit(kind).alias("kind"),
                p.f.alias("value"),
                F.right(p.b, F.lit(AROUND)).alias("before"),
                F.left(p.a, F.lit(AROUND)).alias("after"),
            ),
        )
        return F.filter(made, lambda s: keep(s.value)) if keep else made

    found = F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(placed(f)))


def luhn(number: Column) -> Column:
    """Whether 12 to 19 digits, spaces and hyphens aside, have a valid check digit."""

    def doubled(digit: Column, place: Column) -> Column:
        n = digit.cast("int")
        return F.when(place % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    def check(digits: Column) -> Column:
        terms = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), doubled)
        valid = F.aggregate(terms, F.lit(0), lambda acc, x: acc + x) % 10 == 0
        return F.when(F.length(digits).between(12, 19), valid).otherwise(False)

    return let(F.regexp_replace(number, "[ -]", ""), check)


def digits_between(value: Column, least: int, most: int) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(least, most)


def seeds(text: Column) -> Column:
    """The base spans of a text, by start, then kind."""
    digit = text.rlike("[0-9]")
    octets = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
    return F.sort_array(
        F.concat(
            spans(text, EMAIL, "email", None, F.contains(text, F.lit("@"))),
            spans(text, IP, "ip", lambda v: v.rlike(octets), digit),
            spans(text, CARD, "card", luhn, digit),
            spans(text, PHONE, "phone", lambda v: digits_between(v, 9, 15), F.contains(text, F.lit("+"))),
        )
    )


def form_of(value: Column) -> Column:
    """The outer form of an identifier, which says what kinds it can be."""
    return F.when(value.rlike(r"@|[(\[]at[)\]]"), "mail").when(value.rlike(r":|^[0-9]+(\.[0-9]+){3}$"), "address").otherwise("number")


def identity(form: Column, value: Column) -> Column:
    """One text for all spellings of an identifier."""
    return F.when(form == "number", F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value))


def can_be(kind: Column, form: Column, name: Column) -> Column:
    return (
        ((kind == "email") & (form == "mail"))
        | ((kind == "ip") & (form == "address"))
        | ((kind == "card") & (form == "number") & F.length(name).between(12, 19))
        | ((kind == "phone") & (form == "number") & F.length(name).between(7, 15))
    )


def contexts(form: Column, before: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence: the word before, the two before, the word after, and both sides."""

    def plain(text: Column) -> Column:
        return F.regexp_replace(F.lower(text), "[0-9]", "0")

    one = F.regexp_extract(plain(before), r"(\S+)\s*$", 1)
    two = F.regexp_extract(plain(before), r"(\S+\s+\S+)\s*$", 1)
    next_ = F.regexp_extract(plain(after), r"^\s*(\S+)", 1)
    made = F.array(
        F.when(one != "", F.concat_ws(" ", form, F.lit("<"), one)),
        F.when(two != "", F.concat_ws(" ", form, F.lit("<<"), F.regexp_replace(two, r"\s+", " "))),
        F.when(next_ != "", F.concat_ws(" ", form, F.lit(">"), next_)),
        F.when((one != "") & (next_ != ""), F.concat_ws(" ", form, F.lit("<>"), one, next_)),
    )
    return F.array_compact(made)


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, candidates) of each document, written and read again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hint = F.col("text").rlike(r"[0-9@]|[(\[]at[)\]]")
    found = rows.select("row", "doc_id", seeds(F.col("text")).alias("base"), spans(F.col("text"), CANDIDATE, "", None, hint).alias("candidates"))
    path = scratch(docs.sparkSession, "pii")
    found.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def described(rows: DataFrame, column: str, known: bool) -> DataFrame:
    """(row, start, end, kind, form, name, patterns) of each span of a column; seeds take their form from their kind."""
    kind = F.col("s.kind")
    form = F.when(kind == "email", "mail").when(kind == "ip", "address").otherwise("number") if known else form_of(F.col("s.value"))
    each = rows.select("row", F.explode(column).alias("s")).select("row", "s.start", "s.end", "s.kind", form.alias("form"), "s.value", "s.before", "s.after")
    name = identity(F.col("form"), F.col("value"))
    return each.select("row", "start", "end", "kind", "form", name.alias("name"), contexts(F.col("form"), F.col("before"), F.col("after")).alias("patterns"))


def bootstrap(edges: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(trusted patterns, scores of identifiers) after the rounds.

    ``edges`` (pattern, form, name) are distinct; ``known`` (form, name, kind) are the seeds.
    """
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    scores = seeded = known.withColumn("score", F.lit(1.0)).checkpoint()
    names = seeded.select("form", "name").distinct()
    for _ in range(rounds):
        met = split_join(edges, scores.groupBy("form", "name").agg(F.collect_list(F.struct("kind", "score")).alias("kinds")), ["form", "name"], "inner")
        met = met.select("pattern", F.explode("kinds").alias("k")).groupBy("pattern", "k.kind").agg(F.sum("k.score").alias("weight"), F.count(F.lit(1)).alias("support"))
        share = F.col("weight") / (F.col("total") + 1)
        trusted = met.join(totals, "pattern").withColumn("confidence", share).filter((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
        trusted = trusted.select("pattern", "kind", "confidence").checkpoint()
        kinds = trusted.groupBy("pattern").agg(F.collect_list(F.struct("kind", "confidence")).alias("kinds"))
        reached = split_join(edges, kinds, ["pattern"], "inner").select("form", "name", F.explode("kinds").alias("k"))
        gained = reached.groupBy("form", "name", "k.kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("k.confidence"))))).alias("score"))
        gained = gained.filter((F.col("score") >= CONFIDENCE) & can_be(F.col("kind"), F.col("form"), F.col("name")))
        scores = seeded.unionByName(gained.join(names, ["form", "name"], "left_anti")).checkpoint()
    return trusted, scores


def found_spans(rows: DataFrame) -> DataFrame:
    """(row, added): the spans that trusted patterns find beside the base ones."""
    own, others = described(rows, "base", True), described(rows, "candidates", False)
    every = own.select("form", "name", "patterns").unionByName(others.select("form", "name", "patterns"))
    edges = every.select(F.explode("patterns").alias("pattern"), "form", "name").distinct().checkpoint()
    trusted, scores = bootstrap(edges, own.select("form", "name", "kind").distinct())
    kinds = trusted.groupBy("pattern").agg(F.collect_list("kind").alias("kinds"))
    asked = others.select("row", "start", "end", "form", "name", F.explode("patterns").alias("pattern"))
    asked = split_join(asked, kinds, ["pattern"], "inner").select("row", "start", "end", "form", "name", F.explode("kinds").alias("kind"))
    held = split_join(asked.distinct(), scores, ["form", "name", "kind"], "inner")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    best = held.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", -rank)).alias("kind")).checkpoint()

    # seeds of the same documents: the furthest end of those that start before, the first start of those after
    beside = rows.join(best.select("row").distinct(), "row", "left_semi").select("row", F.explode("base").alias("s")).select("row", "s.start", "s.end")
    both = best.unionByName(beside.withColumn("kind", F.lit(None).cast("string")))
    seed = F.col("kind").isNull()
    upto = both.withColumn("reach", F.max(F.when(seed, F.col("end"))).over(_by_start(False)))
    upto = upto.withColumn("next", F.min(F.when(seed, F.col("start"))).over(_by_start(True)))
    clear = ~seed & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    free = upto.filter(clear)
    return free.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("added"))


def _by_start(backwards: bool) -> WindowSpec:
    return Window.partitionBy("row").orderBy(F.desc("start") if backwards else F.asc("start"))


def written(spans_: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of documents (doc_id, text).

    The counts and the digest are those of the base spans; ``spans`` holds all.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = occurrences(docs)
    plain = F.transform("base", lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    rows_ = rows.join(found_spans(rows), "row", "left").select("doc_id", plain.alias("base"), "added")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))
    return rows_.select(
        "doc_id",
        *[of_kind(k) for k in KINDS],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(every).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )
