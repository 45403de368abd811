"""Raw JSON comments: validation, the malformed side output, and the cleaned record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.operators.language import Detector, is_english
from rivulet.schemas import RAW, REQUIRED

DELETED = ("[deleted]", "[removed]")
RAW_CHARS = 2000


def parse(df: DataFrame, value: str = "value") -> DataFrame:
    """The seven fields of each JSON comment, the raw text and its error, which is null for a valid comment.

    The first rule that fails gives the error: json_decode_error, root_not_object, missing_fields (sorted),
    empty_body (no string, or blank), deleted_body, invalid_created_utc (no whole number, or negative). A field that is
    null counts as there. Numbers are cut to whole ones, numbers in strings are read, other values of score and
    controversiality are 0; a null id, author or subreddit is the text None. Objects with a name twice and NaN are
    rejected as no JSON.
    """
    v, raw = F.col("_v"), F.col(f"`{value}`")
    body_kind = F.schema_of_variant(F.try_variant_get(v, "$.body", "variant"))
    keys = F.json_object_keys(raw)
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), keys))
    body, created = F.try_variant_get(v, "$.body", "string"), F.try_variant_get(v, "$.created_utc", "bigint")
    error = (
        F.when(v.isNull(), "json_decode_error: not valid JSON")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "root_not_object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing_fields: ['"), F.array_join(missing, "', '"), F.lit("']")))
        .when(body.isNull() | (body_kind != "STRING") | (X.strip(body) == ""), "empty_body")
        .when(body.isin(*DELETED), "deleted_body")
        .when(F.coalesce(created, F.lit(-1)) < 0, "invalid_created_utc")
    )
    text = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("None"))
    whole = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "bigint"), F.lit(0).cast("bigint"))
    return df.withColumn("_v", F.try_parse_json(raw)).select(
        text("id").alias("id"),
        text("author").alias("author"),
        created.alias("created_utc"),
        body.alias("body"),
        whole("score").alias("score"),
        text("subreddit").alias("subreddit"),
        whole("controversiality").alias("controversiality"),
        raw.alias("raw"),
        error.alias("error"),
        *[F.col(c) for c in df.columns if c != value and c not in RAW.names],
    )


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).drop("raw", "error")


def malformed(parsed: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """The rejected records: the first 2,000 characters, the error, and the arrival in milliseconds (0 if unknown)."""
    at = F.coalesce(ingest_ts, F.lit(0)) if ingest_ts is not None else F.lit(0)
    return parsed.where(F.col("error").isNotNull()).select(
        F.substring("raw", 1, RAW_CHARS).alias("raw"), "error", at.cast("bigint").alias("ingest_ts")
    )


def cleaned(comments: DataFrame, detector: Detector | None = None, stopwords=(), stem: bool = False) -> DataFrame:
    """The cleaned record of each valid comment; texts that are not English go. Without a detector all stay."""
    df = comments.withColumn("cleaned_body", X.clean(F.col("body")))
    if detector is not None:
        df = df.where(is_english(df.sparkSession, F.col("cleaned_body"), detector))
    tokens = X.tokenize(F.col("cleaned_body"), stopwords)
    if stem:
        from rivulet.functions.stem import stem_tokens

        tokens = stem_tokens(tokens)
    return df.select(
        "id", "author", "created_utc", "subreddit",
        F.col("body").alias("original_body"), "cleaned_body", tokens.alias("tokens"),
        "score", "controversiality", F.lit("en").alias("language"),
        *[c for c in comments.columns if c not in RAW.names and c != "cleaned_body"],
    )


def decode_dump(df: DataFrame, value: str = "value", start: int | None = None, end: int | None = None) -> DataFrame:
    """Dump lines as raw comments: bad JSON, a creation time that is no number, and empty or deleted bodies go.

    Missing fields become '' or 0. With start and end only comments created within them (both included) stay.
    """
    v = F.col("_v")
    text = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    whole = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "bigint"), F.lit(0).cast("bigint"))
    out = df.withColumn("_v", F.try_parse_json(F.col(f"`{value}`"))).select(
        text("id").alias("id"),
        text("author").alias("author"),
        F.try_variant_get(v, "$.created_utc", "bigint").alias("created_utc"),
        text("body").alias("body"),
        whole("score").alias("score"),
        text("subreddit").alias("subreddit"),
        whole("controversiality").alias("controversiality"),
        *[F.col(c) for c in df.columns if c != value],
    )
    out = out.where(F.col("created_utc").isNotNull() & (F.trim("body") != "") & ~F.col("body").isin(*DELETED))
    if start is not None:
        out = out.where(F.col("created_utc").between(start, end))
    return out
