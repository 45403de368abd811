"""Schemas of the records between the stages. Times are unix seconds unless they are timestamps."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS, SENSES = T.ArrayType(S), T.MapType(S, S)

RAW = _struct(id=S, author=S, created_utc=L, body=S, score=L, subreddit=S, controversiality=L)
CLEANED = _struct(
    id=S, author=S, created_utc=L, subreddit=S, original_body=S, cleaned_body=S, tokens=STRINGS, score=L, controversiality=L, language=S
)
TAGGED = T.StructType([*CLEANED.fields, *_struct(matched_keywords=STRINGS, keyword_senses=SENSES).fields])
SCORED = T.StructType(
    [*TAGGED.fields, *_struct(sentiment_label=S, sentiment_score=D, sentiment_model=S, sentiment_status=S).fields]
)
MALFORMED = _struct(raw=S, error=S, ingest_ts=L)
SENTIMENT_WINDOW = _struct(keyword=S, window_start=L, window_end=L, positive_ratio=D, comment_count=L)
ITEM = _struct(token=S, count=L, score=D)
CMS_INFO = _struct(kind=S, width=L, depth=L, stream_total=L)
HLL_INFO = _struct(kind=S, precision=L, std_error=D)
TRENDING = _struct(type=S, keyword=S, window_start=L, window_end=L, items=T.ArrayType(ITEM), sketch=CMS_INFO)
REACH = _struct(type=S, keyword=S, window_start=L, window_end=L, unique_authors=L, comment_count=L, sketch=HLL_INFO)
LATE_DROP = _struct(type=S, pipeline=S, count=L, emitted_at=L)
LABELLED = _struct(id=S, tokens=STRINGS, cleaned_body=S, language=S, matched_keywords=STRINGS, label=S, vader_compound=D)
LIVE_CORPUS = _struct(tokens=STRINGS, label=S)
KEYWORDS = _struct(keyword=S, subkeywords=STRINGS)
CURSOR = _struct(cursor=L, high_water=L)

#: The fields that a raw comment must have (fixed values).
REQUIRED = ["author", "body", "controversiality", "created_utc", "id", "score", "subreddit"]
