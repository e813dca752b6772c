"""Text cleaning, language, budget and quality. Columns only: no shuffle, no Python."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions.common import any_contains, col, compact, first_hit, issues, let, text_list


def plain_spaces(text: Column | str) -> Column:
    """No-break spaces as plain ones, so that \\s means the same everywhere."""
    return F.replace(col(text), F.lit(chr(160)), F.lit(" "))


def squeeze(text: Column | str) -> Column:
    # only runs and odd white space match, so single spaces cost nothing
    return F.trim(F.regexp_replace(plain_spaces(text), r"\s{2,}|[^\S ]", " "))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(plain_spaces(text), r"^\s+|\s+$", "")


def technologies(text: Column | str, patterns: dict[str, list[str]] | None = None) -> Column:
    """Technologies a text mentions, in table order."""
    lowered = F.lower(col(text))
    table = patterns or rules.TECH_PATTERNS
    return compact([F.when(any_contains(lowered, needles), F.lit(name)) for name, needles in table.items()])


#: Longest grams of a needle index; shorter needles go by grams of their own length.
GRAM = 3


def needle_index(patterns: dict[str, list[str]]) -> dict[int, dict[str, list[tuple[str, int]]]]:
    """Needles by one gram of theirs: gram length -> gram -> (needle, place of its name in the table).

    A needle goes by the gram that the fewest needles hold, so that no gram leads to many.
    """
    needles = [(n, at) for at, names in enumerate(patterns.values()) for n in dict.fromkeys(names) if n]

    def grams(needle: str) -> list[str]:
        size = min(GRAM, len(needle))
        return [needle[i : i + size] for i in range(len(needle) - size + 1)]

    held = Counter(g for n, _ in needles for g in set(grams(n)))
    index: dict[int, dict[str, list[tuple[str, int]]]] = {}
    for needle, at in needles:
        gram = min(grams(needle), key=lambda g: (held[g], g))
        index.setdefault(len(gram), {}).setdefault(gram, []).append((needle, at))
    return index


def technologies_by_index(text: Column | str, patterns: dict[str, list[str]]) -> Column:
    """``technologies`` for rule tables of any size: the table is data of the plan, not part of its expressions.

    The grams of a text are met with those of the index in one pass, and only needles that go by a gram
    of the text are looked for in it. A table without needles finds nothing; a null text gives null.
    """
    index = needle_index(patterns)
    found_type = "array<struct<n:string,at:int>>"

    def data(value: object, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)

    def hits(lowered: Column) -> Column:
        lists = []
        for size, by_gram in index.items():
            grams = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
            met = F.array_intersect(grams, data(list(by_gram), "array<string>"))
            table = data({g: [{"n": n, "at": at} for n, at in named] for g, named in by_gram.items()}, f"map<string,{found_type}>")
            lists.append(F.flatten(F.transform(met, _looked_up(table))))
        every = F.concat(*lists) if lists else F.array().cast(found_type)
        places = F.transform(F.filter(every, lambda x: F.contains(lowered, x.n)), lambda x: x.at)
        names = data(list(patterns), "array<string>")
        return let(names, lambda all_: F.transform(F.array_sort(F.array_distinct(places)), lambda at: F.element_at(all_, at + 1)))

    return F.when(col(text).isNotNull(), let(F.lower(col(text)), hits))


def _looked_up(table: Column) -> Callable[[Column], Column]:
    return lambda gram: F.element_at(table, gram)


def stop_word_hits(text: Column | str, head: int | None = None) -> Column:
    """struct(en, bg, de, fr): stop words of each language among the words of a text, or of its first ``head`` characters."""
    lowered = F.lower(col(text))
    words = F.split(lowered if head is None else F.substring(lowered, 1, head), r"[^\p{L}\p{N}_]+")

    def counts(tokens: Column) -> Column:
        return F.struct(
            *[F.size(F.filter(tokens, lambda w: w.isin(stops))).alias(lang) for lang, stops in rules.STOP_WORDS.items()]
        )

    return let(words, counts)


def language_from_hits(hits: Column) -> Column:
    """Most hits wins, earlier languages win ties, and fewer than six hits is unknown."""
    best = F.greatest(*[hits[lang] for lang in rules.STOP_WORDS])
    ordered = [((best > 5) & (hits[lang] == best), F.lit(lang)) for lang in rules.STOP_WORDS]
    return first_hit(*ordered, otherwise="unknown")


def language(text: Column | str) -> Column:
    return let(stop_word_hits(text), language_from_hits)


def cut_at_word(text: Column, limit: int | None) -> Column:
    """At most ``limit`` characters plus ``...``, cut at a space that lies past 80% of the limit; None cuts nothing."""
    if limit is None:
        return text
    head = F.substring(text, 1, limit)
    words = F.regexp_extract(head, "(?s)^(.*) ", 1)
    cut = F.when(F.length(words) > limit * 0.8, words).otherwise(head)
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("..."))).otherwise(text)


def drop_noise(text: Column | str, limit: int | None = None, drop_links: bool = False) -> Column:
    # the word groups never overlap, so one pass over all of them equals one pass each
    words = "|".join(rules.NOISE_WORDS)
    out = F.regexp_replace(squeeze(text), rf"(?i)(?<!\w)(?:{words})(?!\w)", " ")
    out = F.regexp_replace(out, r"\s*\([^)]*\)\s*", " ")
    if drop_links:
        out = F.regexp_replace(out, r"https?://\S+", "")
        out = F.regexp_replace(out, r"\S+@\S+\.\S+", "")
    return cut_at_word(squeeze(out), limit)


def by_profile(text: Column | str, patterns: list[str], limit: int | None = None) -> Column:
    """Profile-driven phrase removal, and a length cap where the profile has one."""
    out = plain_spaces(text)
    for pattern in patterns:
        out = F.regexp_replace(out, f"(?id){pattern}", " ")
    return cut_at_word(squeeze(out), limit)


def strip_html(html: Column | str) -> Column:
    out = F.regexp_replace(col(html), r"(?i)<script[^>]*>[\s\S]*?</script>", "")
    out = F.regexp_replace(out, r"(?i)<style[^>]*>[\s\S]*?</style>", "")
    return squeeze(F.regexp_replace(out, r"<[^>]+>", " "))


def clean_markdown(text: Column | str) -> Column:
    out = F.regexp_replace(col(text), r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?md)[ \t]+$", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"#+\s*\n", "")
    out = F.regexp_replace(out, r"[-*]\s*\n", "")
    return strip(out)


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(col(text)) / 4)


def compression(processed: Column | str, original: Column | str) -> Column:
    return F.try_divide(F.length(col(processed)), F.length(col(original)))


def budget(text: Column | str, max_tokens: int) -> Column:
    """Whole heading sections up to four characters per token, then a part that ends a sentence."""
    limit = max_tokens * 4
    c = col(text)

    def joined(done: Column, part: Column) -> Column:
        return F.concat(done, F.when(done == "", "").otherwise("\n# "), part)

    def step(acc: Column, section: Column) -> Column:
        done = acc["text"]
        room = F.lit(limit) - F.length(done)
        part = F.substring(section, F.lit(1), room - 50)
        sentence = F.regexp_extract(part, r"(?s)^.*\.", 0)
        keeps = (room > 100) & (F.length(sentence) - 1 > room * 0.7)
        rest = F.when(keeps, joined(done, sentence)).otherwise(done)
        return F.when(acc["full"], acc).otherwise(
            F.when(
                F.length(done) + F.length(section) <= limit,
                F.struct(joined(done, section).alias("text"), F.lit(False).alias("full")),
            ).otherwise(F.struct(rest.alias("text"), F.lit(True).alias("full")))
        )

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    kept = F.aggregate(F.split(c, r"\n#{1,3}\s"), start, step)["text"]
    return F.when(F.length(c) <= limit, c).otherwise(F.coalesce(F.nullif(kept, F.lit("")), F.substring(c, 1, limit)))


def with_priority_cut(df: DataFrame, name: str, limit: int, out: str) -> DataFrame:
    """Text around the priority patterns first, then the rest, cut to ``limit`` characters.

    Each hit keeps up to 100 characters before it and 200 from its start. Hits are
    marked with two control characters and cut out in one pass over the text. The
    patterns run one after the other on what is left, one projection each.
    """
    df = df.withColumn("_rest", F.translate(col(name), "\x01\x02", "  ")).withColumn("_first", F.lit(""))
    pieces = F.col("_pieces")  # outside, hit, outside, hit, .. outside
    for pattern in rules.PRIORITY_PATTERNS:
        marked = F.regexp_replace("_rest", f"(?is)(?={pattern}).{{1,200}}", "\x01$0\x02")
        df = df.withColumn("_pieces", F.split(marked, "[\x01\x02]"))
        hits = F.transform(
            pieces,
            lambda x, i: F.when(i % 2 == 1, F.concat(F.right(F.get(pieces, i - 1), F.lit(100)), x, F.lit("\n"))).otherwise(""),
        )
        outside = F.transform(
            pieces,
            lambda x, i: F.when(i % 2 == 1, "")
            .when(i < F.size(pieces) - 1, F.substring(x, F.lit(1), F.greatest(F.length(x) - 100, F.lit(0))))
            .otherwise(x),
        )
        df = df.withColumn("_first", F.concat("_first", F.array_join(hits, ""))).withColumn(
            "_rest", F.array_join(outside, "")
        )
    return df.withColumn(out, F.substring(F.concat("_first", "_rest"), 1, limit)).drop("_rest", "_first", "_pieces")


def unique_ratio(text: Column | str) -> Column:
    words = F.split(plain_spaces(text), r"\s+")
    return F.size(F.array_distinct(F.split(F.lower(plain_spaces(text)), r"\s+"))) / F.size(words)


def _quality_rules(title, cleaned, ratio, n_sections):
    # limits, messages and points (fixed values)
    return [
        (F.length(col(cleaned)) < 50, "Content too short", 30),
        (col(ratio) < 0.1, "Low content density (too much markup)", 20),
        (F.coalesce(col(title), F.lit("")) == "", "No title extracted", 15),
        (col(n_sections) < 2, "Limited content structure", 10),
        (unique_ratio(cleaned) < 0.3, "High content repetition", 25),
    ]


def quality_score(title, cleaned, ratio, n_sections) -> Column:
    penalty = F.lit(0)
    for broken, _, points in _quality_rules(title, cleaned, ratio, n_sections):
        penalty = penalty + F.when(F.coalesce(broken, F.lit(False)), points).otherwise(0)
    return F.greatest(F.lit(0), F.lit(100) - penalty)


def quality_issues(title, cleaned, ratio, n_sections) -> Column:
    return issues(*[(broken, text) for broken, text, _ in _quality_rules(title, cleaned, ratio, n_sections)])


def phrases(text: Column, wanted: list[str], cap: int | None = None, held: Column | None = None) -> Column:
    """Wanted phrases that occur, in list order; those held come first. With ``cap`` no more are added beyond it."""
    found = F.filter(text_list(wanted), lambda p: text.contains(p))
    if held is None:
        return found if cap is None else F.slice(found, 1, cap)
    new = F.array_except(found, held)
    if cap is None:
        return F.concat(held, new)
    room = F.greatest(F.lit(cap) - F.size(held), F.lit(0))
    return F.concat(held, F.slice(new, F.lit(1), room))
