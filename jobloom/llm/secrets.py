"""Secret scan: candidate strings, judged by a random forest that removes false positives.

Candidates are wide, and the forest rejects: private key blocks; the user and password of a URL; whatever
is assigned to a name such as ``password`` or ``api_key``, of any printable signs, with digits or
without; and every other run of at least ``SHORTEST`` letters, digits and ``+/_-`` with a digit in it.
Features are length, classes of characters and their transitions, spread of characters,
coverage by dictionary words, path marks, and the words before and after, which are read from the
text, whatever candidates stand there. The forest is trained from labelled findings
(``labelled_findings``, made by a rule, or a table of one's own), and its trees become column
expressions: scanning is one pass of column functions without a shuffle, and redaction needs no join.

Nulls: a null text has no candidates and stays null. Empty texts have none. Repeated rows are
each scanned. ``findings`` leaves extra columns out; ``redact`` keeps all columns, whatever
their names.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.session import ensure_checkpoint_dir

SHORTEST = 12
BEFORE, AFTER = 48, 24
TREES, DEPTH, SEED = 15, 6, 10
#: Rows of the labelled findings made by rule.
LABELLED = 6000
MASK = "[SECRET]"

_TOKEN = "A-Za-z0-9+/_-"
#: Names that a secret is assigned to.
NAMES = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?"
#: The start of what is assigned: one look back for the sign before, then for the name. Few places pass the first.
_ASSIGNED = rf"(?<=[=:\s\"'])(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]++-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?<=://)[^\s/:@\"'<>]{1,64}+:[^\s/@\"'<>]{3,128}+(?=@)"
    rf"|{_ASSIGNED}[^\s\"'<>,;]{{4,256}}"
    rf"|(?<![{_TOKEN}])(?=[A-Za-z+/_-]*+[0-9])[{_TOKEN}]{{{SHORTEST},}}+={{0,2}}"
)
#: What every text with a candidate holds.
HINT = rf"[0-9]|-----BEGIN|://|(?i:{NAMES})"

#: Words that make a string look written rather than drawn at random.
DICTIONARY = (
    "account|admin|address|archive|article|asset|backup|build|button|cache|change|class|client|code|color|config|content|count|data|date|"
    "default|demo|document|download|dummy|email|event|example|export|field|file|final|footer|format|group|guide|header|here|home|icon|image|"
    "import|index|info|input|item|label|library|link|list|local|logo|main|manual|member|menu|message|method|model|module|name|number|object|"
    "order|output|package|page|param|photo|place|picture|post|preview|print|product|profile|project|public|query|record|release|report|"
    "request|response|result|sample|screen|script|search|section|server|service|session|setting|shot|size|source|state|static|status|store|"
    "style|summary|system|table|task|template|test|text|theme|thumb|time|title|track|type|update|upload|user|value|version|video|view|"
    "window|word|your"
)
SECRET_WORDS = r"pass(word|wd|phrase)?|pwd|secret|token|api.?key|auth|bearer|credential|private|access.?key"
HASH_WORDS = r"sha.?\d*|md5|commit|digest|checksum|hash|revision|integrity|etag|blob"
ID_WORDS = r"uuid|guid|order|invoice|isbn|phone|card|iban|tracking|serial|ticket|number|call|ref"
PLACEHOLDERS = r"example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234|abcd|test|\*\*\*|\$\{|\{\{|\(\)|required|optional|string|none|null|username|hidden|<"
PREFIXES = r"^(AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk[-_]|pk_live|rk_live|xox[abprs]-|eyJ|ya29)"


def number(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def features(before: Column, found: Column, after: Column) -> dict[str, Column]:
    """Named numbers of one candidate with what stands around it."""
    low, near = F.lower(found), F.lower(F.right(before, F.lit(BEFORE)))
    size = F.length(found).cast("double")
    last = F.regexp_extract(near, r"(\S*\s*\S*\s*)$", 1)
    follow = F.lower(F.left(after, F.lit(AFTER)))

    def share(pattern: str) -> Column:
        return F.regexp_count(found, F.lit(pattern)).cast("double") / size

    return {
        "length": size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[+/_-]"),
        "signs": share("[^A-Za-z0-9+/_-]"),
        "key_block": number(found.startswith("-----BEGIN")),
        "user_pass": number(near.endswith("://") & found.contains(":")),
        "classes": number(found.rlike("[a-z]")) + number(found.rlike("[A-Z]")) + number(found.rlike("[0-9]")) + number(found.rlike("[^A-Za-z0-9]")),
        "transitions": share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "spread": F.size(F.array_distinct(F.split(found, ""))).cast("double") / size,
        "hex": number(found.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "numeric": number(found.rlike("^[0-9+/_-]+$")),
        "uuid": number(low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "runs": F.regexp_count(low, F.lit(r"(.)\1\1")).cast("double"),
        "vowels": F.regexp_count(low, F.lit("[aeiou]")).cast("double") / size,
        "dictionary": (size - F.length(F.regexp_replace(low, DICTIONARY, ""))) / size,
        "placeholder": number(low.rlike(PLACEHOLDERS)),
        "prefix": number(found.rlike(PREFIXES)),
        "assigned": number(near.rlike(r"[=:]\s*[\"']?$")),
        "quoted": number(near.rlike("[\"']$")),
        "secret_word": number(last.rlike(SECRET_WORDS)),
        "named": number(near.rlike(rf"({NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?$")),
        "hash_word": number(last.rlike(HASH_WORDS)),
        "id_word": number(last.rlike(ID_WORDS)),
        "path": number(near.rlike(r"(/|\\|://\S*|\.)$") | follow.rlike(r"^(/|\.[a-z0-9]{1,5}\b)") | found.rlike("^/|/.*/")),
        "next_word": number(follow.rlike(r"^\W*(" + HASH_WORDS + "|" + ID_WORDS + ")")),
    }


def drawn(alphabet: str, size: int, salt: int) -> Column:
    """Characters of an alphabet drawn by hashes of the row number."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    pick = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.element_at(letters, (F.pmod(F.xxhash64("id", i, F.lit(salt)), F.lit(len(alphabet))) + 1).cast("int")))
    return F.array_join(pick, "")


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """(before, found, after, label): findings made by rule, about half of each label.

    Each kind is a shape of string in a typical place. Surrounding words are drawn too, so
    that only the words that matter decide.
    """
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes, mixed = digit + "abcdef", upper + lower + digit
    words = DICTIONARY.split("|")

    def word(salt: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))

    def cut(text: Column, least: int, most: int, salt: int) -> Column:
        return F.left(text, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most - least + 1)) + least).cast("int"))

    def any_of(*texts: str, salt: int = 50) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(texts))) + 1).cast("int"))

    prose = F.concat(drawn(lower, 6, 1), F.lit(" "), drawn(lower, 4, 2), F.lit(" "))
    secret_place = F.concat(prose, any_of("password=", "password: ", 'token = "', 'secret="', "api_key=", "auth: ", "Bearer token ", 'passwd = "', "access key "))
    kinds: list[tuple[Column, Column, Column, int]] = [
        (prose, F.concat(any_of("AKIA", "ASIA"), drawn(upper + digit, 16, 3)), any_of(" ", ".", '"'), 1),
        (secret_place, cut(drawn(hexes, 64, 4), 16, 64, 5), any_of(" ", '"', ","), 1),
        (secret_place, cut(drawn(mixed, 48, 6), 14, 48, 7), any_of(" ", '"', ","), 1),
        (secret_place, F.concat(cut(drawn(mixed + "+/", 60, 8), 20, 60, 9), any_of("", "=", "==")), any_of(" ", '"'), 1),
        (prose, F.concat(any_of("ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-"), cut(drawn(mixed, 40, 10), 24, 40, 11)), any_of(" ", "."), 1),
        (secret_place, cut(drawn(lower + digit, 32, 12), 14, 32, 13), any_of(" ", '"', ","), 1),
        (F.concat(prose, any_of("commit ", "sha256:", "sha1 ", "md5 = ", "checksum: ", "revision ", "digest ")), cut(drawn(hexes, 64, 14), 12, 64, 15), any_of(" ", "."), 0),
        (prose, F.concat_ws("-", drawn(hexes, 8, 16), drawn(hexes, 4, 17), drawn(hexes, 4, 18), drawn(hexes, 4, 19), drawn(hexes, 12, 20)), any_of(" ", ","), 0),
        (F.concat(prose, any_of("", "card ", "order ", "invoice ", "phone +", "isbn ", "tracking ")), cut(drawn(digit, 20, 21), 12, 20, 22), any_of(" ", ".", ","), 0),
        (F.concat(prose, any_of("/", "https://www.site.org/", "./", "images/")), F.concat_ws("-", word(23), word(24), word(25), cut(drawn(digit, 4, 26), 1, 4, 27)), any_of(".html", ".png", "/", " "), 0),
        (prose, F.concat_ws("_", word(28), word(29), word(30), cut(drawn(digit, 4, 31), 1, 4, 32)), any_of(" ", "(", " = "), 0),
        (secret_place, F.concat(any_of("your-token-here-", "example-password-", "xxxxxxxxxxxx", "changeme-now-", "dummy-secret-value-", "test-token-test-"), cut(drawn(digit, 4, 33), 1, 4, 34)), any_of(" ", '"'), 0),
        (prose, F.concat(any_of("2019-", "2020-", "2021-", "2024-"), drawn(digit, 2, 35), F.lit("-"), drawn(digit, 2, 36), F.lit("T"), drawn(digit, 2, 37), drawn(digit, 4, 38)), any_of(" ", "Z"), 0),
        (prose, F.concat(cut(drawn(lower, 16, 39), 8, 16, 40), drawn(digit, 2, 41), cut(drawn(lower, 8, 42), 2, 8, 43)), any_of(" ", ".", ","), 0),
        (secret_place, F.concat(drawn(lower, 6, 60), any_of("!", "@", "#", "$", ".", ":"), cut(drawn(mixed + "!@#$%^&*.", 24, 61), 3, 18, 62)), any_of(" ", '"', ","), 1),
        (secret_place, cut(drawn(mixed + "!@#$%^&*.:", 24, 63), 6, 24, 64), any_of(" ", '"', ","), 1),
        (secret_place, cut(drawn(lower, 40, 65), 14, 40, 66), any_of(" ", '"', ","), 1),
        (secret_place, cut(drawn(upper, 40, 67), 12, 40, 68), any_of(" ", '"', ","), 1),
        (F.concat(prose, any_of("postgres", "mysql", "https", "amqp", "redis", "ftp"), F.lit("://")), F.concat(cut(drawn(lower, 10, 69), 3, 10, 70), F.lit(":"), cut(drawn(mixed + "!#$%.", 20, 71), 6, 20, 72)), F.lit("@host/db "), 1),
        (prose, F.concat(F.lit("-----BEGIN "), any_of("RSA ", "EC ", ""), F.lit("PRIVATE KEY-----"), drawn(mixed + "+/", 64, 73), F.lit("\n-----END "), any_of("RSA ", "EC ", ""), F.lit("PRIVATE KEY-----")), any_of(" ", "."), 1),
        (F.concat(prose, any_of("password: ", "token: ", "secret = ", 'api_key: "', "auth: ", "access_key=", "passphrase: ")), F.concat(word(74), any_of("", "ed", "s", ".", "()", "er", "ing")), any_of(" ", '"', "\n"), 0),
        (F.concat(prose, any_of("password: ", "token = ", "secret=", 'api_key="', "auth: ")), cut(drawn(lower, 10, 75), 4, 9, 76), any_of(" and", " is", " the", '"', "."), 0),
        (F.concat(prose, any_of("password: ", "token = ", 'secret="', "api_key=", "pwd=")), any_of("${PASSWORD}", "********", "{{token}}", "getpass()", "os.environ[KEY]", "required", "optional", "string", "None", "null", "hidden", "changeme", salt=77), any_of(" ", '"'), 0),
        (F.concat(prose, any_of("postgres", "mysql", "https", "amqp"), F.lit("://")), any_of("user:password", "username:password", "user:pass", "name:${PASSWORD}", "admin:********", "user:your-password", salt=78), F.lit("@host/db "), 0),
    ]
    chosen = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(len(kinds)))
    parts = [F.struct(b.alias("before"), f.alias("found"), a.alias("after"), F.lit(y).alias("label")) for b, f, a, y in kinds]
    row = parts[-1]
    for i, part in enumerate(parts[:-1]):
        row = F.when(chosen == i, part).otherwise(row)
    made = spark.range(rows).select(row.alias("x")).select("x.*")
    whole = F.regexp_extract_all(F.concat("before", "found", "after"), F.lit(CANDIDATE), F.lit(0))
    return made.filter(F.array_contains(whole, F.col("found")))


def fit(labelled: DataFrame) -> tuple[RandomForestClassificationModel, DataFrame, list[str]]:
    """The forest, the rows (label, features and their vector ``features``) it learned from, and the features' names.

    The forest passes over its rows once a level: they are made once, and its jobs have small plans.
    """
    ensure_checkpoint_dir(labelled.sparkSession)
    named = features(F.col("before"), F.col("found"), F.col("after"))
    table = labelled.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in named.items()]).checkpoint()
    assembled = VectorAssembler(inputCols=list(named), outputCol="features").transform(table)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird")
    return forest.fit(assembled), assembled, list(named)


def train(labelled: DataFrame) -> list[str]:
    """The forest's trees as SQL over a struct ``x`` of features; each votes 0 or 1."""
    model, _, names = fit(labelled)
    return [tree_sql(tree.toDebugString, names) for tree in model.trees]


def tree_sql(text: str, names: list[str]) -> str:
    """One decision tree, from the text Spark ML prints, as nested CASE."""
    lines = [line.strip() for line in text.splitlines()]
    lines = [line for line in lines if re.match(r"(If|Else|Predict)", line)]

    def read(at: int) -> tuple[str, int]:
        test = re.match(r"If \(feature (\d+) <= ([-0-9.Ee]+)\)", lines[at])
        if not test:
            return f"{int(float(lines[at].split(':')[1]))}", at + 1
        yes, at = read(at + 1)
        no, at = read(at + 1)
        return f"CASE WHEN x.{names[int(test[1])]} <= {float(test[2])!r}D THEN {yes} ELSE {no} END", at

    return read(0)[0]


def forest(spark: SparkSession) -> list[str]:
    return train(labelled_findings(spark))


def pieces(text: Column) -> Column:
    """struct(found, parts): the candidates of a text in order, and what stands before, between and after them."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.struct(found.alias("found"), F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)).alias("parts"))


def candidates(held: Column) -> Column:
    """The candidates of a text's ``pieces``: length of what stands before, the string, and its features.

    The words around are those of the text: a candidate beside another one has it as a word before it.
    """
    found, parts, size = held.found, held.parts, F.size(held.found)
    none = F.array(F.lit("")).cast("array<string>")
    beside = F.arrays_zip(
        found.alias("found"), F.slice(parts, 1, size).alias("gap"), F.slice(parts, 2, size).alias("next_gap"),
        F.slice(F.concat(none, found), 1, size).alias("last"), F.slice(F.concat(found, none), 2, size).alias("next"),
    )

    def one(x: Column) -> Column:
        before = F.concat(F.right(x["last"], F.lit(BEFORE)), F.right(x["gap"], F.lit(BEFORE)))
        after = F.concat(F.left(x["next_gap"], F.lit(AFTER)), F.left(x["next"], F.lit(AFTER)))
        named = features(before, x["found"], after)
        return F.struct(F.length(x["gap"]).alias("gap"), x["found"].alias("found"), *[c.alias(n) for n, c in named.items()])

    return F.when(size > 0, F.transform(beside, one))


def judged(column: str, trees: list[str]) -> Column:
    """Candidates with ``share``, the part of the trees that call them secret."""
    votes = " + ".join(trees)
    return F.expr(f"transform(`{column}`, x -> struct(x.gap AS gap, x.found AS found, ({votes}) / {len(trees)}D AS share))")


def findings(docs: DataFrame, trees: list[str]) -> DataFrame:
    """One row for each candidate: where it stands, its share of votes, and whether it is a secret.

    (doc_id, start, stop, length, share, secret, sha256); positions are characters from 0, the
    string itself is given by its digest alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), pieces(F.col("text")).alias("_p"))
    rows = rows.select("doc_id", "rid", candidates(F.col("_p")).alias("_c")).withColumn("_c", judged("_c", trees))
    each = rows.select("doc_id", "rid", F.posexplode("_c").alias("n", "c"))
    each = each.select("doc_id", "rid", "n", "c.gap", "c.share", F.length("c.found").alias("length"), F.sha2("c.found", 256).alias("sha256"))
    so_far = Window.partitionBy("rid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("length")).over(so_far)
    return each.withColumn("stop", stop).select(
        "doc_id", (F.col("stop") - F.col("length")).alias("start"), "stop", F.col("length").cast("long").alias("length"), "share",
        (F.col("share") >= 0.5).alias("secret"), "sha256",
    )


def redact(docs: DataFrame, trees: list[str]) -> DataFrame:
    """All rows and columns, each secret in ``text`` replaced by ``MASK`` and ``n_chars``, if there, made to fit."""
    text = F.col("text")
    own = "_candidates_" + "_" * max((len(c) for c in docs.columns), default=0)
    parts = f"{own}parts"
    held = docs.withColumn(parts, pieces(text)).withColumn(own, candidates(F.col(parts))).withColumn(own, judged(own, trees))
    told = F.zip_with(
        own, F.slice(F.col(parts).parts, 2, F.size(own)), lambda c, gap: F.concat(F.when(c.share >= 0.5, MASK).otherwise(c.found), gap)
    )
    clean = F.concat(F.element_at(F.col(parts).parts, 1), F.array_join(told, ""))
    out = held.withColumn("text", F.when(F.exists(own, lambda c: c.share >= 0.5), clean).otherwise(text))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out.select(*docs.columns)
