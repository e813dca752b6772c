"""JSON text columns and extraction replies. Field names, messages and limits are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions.common import col, issues, text_list

LIST = "array<string>"
REPLY = (
    "title string, company string, location string, salaryMin double, salaryMax double, currency string, "
    "experienceLevel string, employmentType string, workModel string, description string, "
    f"requirements {LIST}, responsibilities {LIST}, technologies {LIST}, benefits {LIST}, "
    "educationLevel string, industry string, teamSize string, companySize string, applicationDeadline string, "
    "postedDate string, confidenceScore double, qualityScore double, "
    "extractionMetadata struct<sourceType:string,contentLength:double,hasStructuredData:boolean,language:string>"
)
COMPANY_REPLY = (
    "name string, description string, industry string, size string, location string, website string, "
    f"founded int, employeeCount int, pros {LIST}, cons {LIST}, technologies {LIST}, benefits {LIST}, values {LIST}, "
    "recommendationScore double, cultureScore double, confidenceScore double, dataCompleteness double"
)
CONTACT = (
    "contactEmail string, contactPhone string, address string, services string, companyType string, "
    "businessLicense string, clientProjects string"
)


def is_json(text: Column | str) -> Column:
    return F.try_parse_json(col(text)).isNotNull()


def field(text: Column | str) -> Column:
    """struct(value, text): the parsed document, or the text itself when it does not parse."""
    parsed = F.try_parse_json(col(text))
    return F.struct(parsed.alias("value"), F.when(parsed.isNull(), col(text)).alias("text"))


def text_array(text: Column | str) -> Column:
    """The list in a JSON text; empty on null, malformed or something else."""
    return F.coalesce(F.from_json(col(text), LIST), F.array().cast(LIST))


def contact(raw: Column | str) -> Column:
    return F.from_json(col(raw), CONTACT)


def _gate(parsed: Column, text: Column) -> Column:
    score = parsed["confidenceScore"]
    return F.when(is_json(text) & (score != 0) & score.between(0, 100), parsed)


def reply(text: Column | str) -> Column:
    """The typed reply if it parses and its confidence is above 0 and at most 100, else null."""
    return _gate(F.from_json(col(text), REPLY), col(text))


def company_reply(text: Column | str) -> Column:
    return _gate(F.from_json(col(text), COMPANY_REPLY), col(text))


def split_replies(replies: DataFrame, name: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Accepted replies with their typed struct, and the rejected rows."""
    typed = replies.withColumn("parsed", reply(name))
    return typed.filter(F.col("parsed").isNotNull()), typed.filter(F.col("parsed").isNull()).drop("parsed")


def salvage(text: Column | str) -> Column:
    """The document between the first ``{`` and the last ``}``, else a low-confidence stub around the text."""
    body = F.regexp_extract(col(text), r"(?s)\{.*\}", 0)
    trimmed = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    stub = F.from_json(
        F.to_json(
            F.struct(
                trimmed.alias("description"),
                F.lit(50).alias("confidenceScore"),
                F.lit(50).alias("qualityScore"),
                F.struct(
                    F.lit("unstructured_text").alias("sourceType"),
                    F.length(col(text)).alias("contentLength"),
                    F.lit(False).alias("hasStructuredData"),
                    F.lit("en").alias("language"),
                ).alias("extractionMetadata"),
            )
        ),
        REPLY,
    )
    return F.when(is_json(body), F.from_json(body, REPLY)).when(trimmed != "", stub)


def trace(**facts: Column) -> Column:
    """A processing trace as one JSON document."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in facts.items()]))


META = "extractionMetadata"
META_FIELDS = {"sourceType": "text", "contentLength": "number", "hasStructuredData": "flag", "language": "text"}


def _kind(path: str) -> str:
    """SQL for the kind of one member: text, number, list, flag, object, null or other; null when it is missing."""
    name = f"schema_of_variant(try_variant_get(_doc, '$.{path}', 'variant'))"
    return f"""CASE WHEN {name} IS NULL THEN NULL WHEN {name} = 'STRING' THEN 'text' WHEN {name} = 'BIGINT' THEN 'number'
      WHEN {name} IN ('ARRAY<STRING>', 'ARRAY<VOID>') THEN 'list' WHEN {name} = 'VOID' THEN 'null' WHEN {name} = 'BOOLEAN' THEN 'flag'
      WHEN startswith({name}, 'OBJECT') THEN 'object' WHEN startswith({name}, 'DECIMAL') OR {name} IN ('DOUBLE', 'FLOAT') THEN 'number'
      ELSE 'other' END"""


def with_contract_errors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the schema errors of an extraction reply: types, required members, bounds and unknown keys.

    The reply is parsed once and every member's kind found once, in projections of their own.
    """
    names = [*rules.REPLY_FIELDS, *rules.REPLY_SCORES, META, *[f"{META}.{n}" for n in META_FIELDS]]
    kinds = {n: f"_k_{n.replace('.', '_')}" for n in names}
    parsed = df.withColumn("_doc", F.try_parse_json(text))
    parsed = parsed.withColumns({c: F.expr(_kind(n)) for n, c in kinds.items()})
    found: list[tuple[str, str]] = []
    for name, kind in rules.REPLY_FIELDS.items():
        found.append((f"{kinds[name]} NOT IN ('{kind}', 'null')", f"{name} must be {kind}"))
    for name in rules.REPLY_SCORES:
        value = f"try_variant_get(_doc, '$.{name}', 'double')"
        found.append((f"{kinds[name]} IS NULL", f"{name} is required"))
        found.append((f"{kinds[name]} <> 'number'", f"{name} must be number"))
        found.append((f"{value} < 0", f"{name} must be >= 0"))
        found.append((f"{value} > 100", f"{name} must be <= 100"))
    meta = kinds[META]
    found.append((f"{meta} IS NULL", f"{META} is required"))
    found.append((f"{meta} <> 'object'", f"{META} must be object"))
    for name, kind in META_FIELDS.items():
        got = kinds[f"{META}.{name}"]
        found.append((f"{meta} = 'object' AND {got} IS NULL", f"{META}.{name} is required"))
        found.append((f"{got} <> '{kind}'", f"{META}.{name} must be {kind}"))
    found.append((f"try_variant_get(_doc, '$.{META}.contentLength', 'double') < 0", f"{META}.contentLength must be >= 0"))
    known = text_list([*rules.REPLY_FIELDS, *rules.REPLY_SCORES, META])
    extra = F.size(F.array_except(F.json_object_keys(text), known)) > 0
    broken = issues(*[(F.expr(condition), message) for condition, message in found], (extra, "unknown keys"))
    errors = F.when(F.col("_doc").isNull(), F.array(F.lit("not a JSON document"))).otherwise(broken)
    return parsed.withColumn(out, errors).drop("_doc", *kinds.values())


def quality_gaps(parsed: Column) -> Column:
    """Quality issues of a typed reply."""

    def short(name: str) -> Column:
        return F.coalesce(F.size(parsed[name]), F.lit(0)) <= 0

    def number(x: Column) -> Column:
        return F.regexp_replace(x.cast("string"), r"\.0$", "")

    confidence, quality = parsed["confidenceScore"], parsed["qualityScore"]
    return issues(
        (confidence < 70, F.concat(F.lit("Low confidence score: "), number(confidence))),
        (quality < 60, F.concat(F.lit("Low quality score: "), number(quality))),
        (F.coalesce(parsed["title"], F.lit("")) == "", "Missing job title"),
        (F.coalesce(F.length(parsed["description"]), F.lit(0)) < 50, "Missing or insufficient job description"),
        (short("requirements"), "Missing job requirements"),
        (short("technologies"), "Missing technology stack information"),
    )


def metadata_gaps(parsed: Column) -> Column:
    meta = parsed["extractionMetadata"]
    kind = meta["sourceType"]
    return F.when(meta.isNull(), F.array(F.lit("Missing extraction metadata"))).otherwise(
        issues(
            (meta["contentLength"] <= 0, "Invalid content length"),
            (
                ~F.coalesce(kind.isin(rules.SOURCE_TYPES), F.lit(False)),
                F.concat(F.lit("Invalid source type: "), F.coalesce(kind, F.lit("null"))),
            ),
            (F.coalesce(F.length(meta["language"]), F.lit(0)) != 2, "Invalid language code"),
        )
    )


def extraction_score(parsed: Column) -> Column:
    """Field-presence score, less 20 when confidence is below 50; 60 passes."""

    def points(condition: Column, n: int) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)

    paid = (F.coalesce(parsed["salaryMin"], F.lit(0)) != 0) | (F.coalesce(parsed["salaryMax"], F.lit(0)) != 0)
    return (
        points(parsed["title"] != "", 20)
        + points(F.length(parsed["description"]) > 50, 20)
        + points(F.size(parsed["requirements"]) > 0, 15)
        + points(parsed["location"] != "", 10)
        + points(parsed["experienceLevel"] != "", 10)
        + points(paid, 10)
        + points(F.size(parsed["technologies"]) > 0, 10)
        + points(parsed["confidenceScore"] > 70, 5)
        - points(parsed["confidenceScore"] < 50, 20)
    )
