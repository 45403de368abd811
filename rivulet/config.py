"""Settings, from the environment or given."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Topics and defaults are fixed values."""

    bootstrap: str = "localhost:9092"
    raw_topic: str = "reddit-comments"
    cleaned_topic: str = "reddit-comments-cleaned"
    malformed_topic: str = "reddit-comments-malformed"
    results_topic: str = "sentiment-results"
    analytics_topic: str = "analytics-results"
    starting: str = "earliest"
    window_s: int = 3600
    analytics_window_s: int = 3600
    watermark_s: int = 5
    late_window_s: int = 10
    keywords: tuple[str, ...] = ()
    subkeywords: dict[str, list[str]] = field(default_factory=dict)
    remove_stopwords: bool = False
    stem: bool = False
    min_tokens: int = 2
    trending_min_terms: int = 30
    trending_min_count: int = 2
    trending_k: int = 20
    trending_stopwords: str | None = None
    output: str = "file"

    def __post_init__(self):
        if self.output not in ("file", "kafka"):
            raise ValueError("output must be file or kafka")
        for name in ("window_s", "analytics_window_s", "late_window_s"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Settings:
        e = os.environ if env is None else env
        flag = lambda k: e.get(k, "").strip().lower() in ("1", "true", "yes", "on")
        window = int(e.get("WINDOW_SIZE_SEC", 3600))
        return Settings(
            bootstrap=e.get("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"),
            starting="earliest" if e.get("START_FROM", "earliest") == "earliest" else "latest",
            window_s=window,
            analytics_window_s=int(e.get("ANALYTICS_WINDOW_SEC", window)),
            watermark_s=int(e.get("WATERMARK_SEC", 5)),
            keywords=tuple(normalise_keywords(e.get("KEYWORDS", "").split(","))),
            subkeywords=parse_subkeywords(e.get("SUBKEYWORDS", "")),
            remove_stopwords=flag("REMOVE_STOPWORDS"),
            stem=flag("STEM"),
            trending_min_terms=int(e.get("TRENDING_MIN_TOKENS", 30)),
            trending_min_count=int(e.get("TRENDING_MIN_COUNT", 2)),
            output=e.get("OUTPUT_SINK", "file"),
            trending_stopwords=e.get("TRENDING_STOPWORDS_FILE") or None,
        )


def normalise_keywords(words) -> list[str]:
    """Trimmed, lower-cased, distinct and sorted; blanks go."""
    return sorted({w.strip().lower() for w in words if w and w.strip()})


def parse_subkeywords(text: str) -> dict[str, list[str]]:
    """``a:x,y;b:z`` as {a: [x, y], b: [z]}. Segments without a name or without values are skipped."""
    out: dict[str, list[str]] = {}
    for segment in text.split(";"):
        name, colon, values = segment.partition(":")
        listed = [v.strip().lower() for v in values.split(",") if v.strip()]
        if colon and name.strip() and listed:
            out[name.strip().lower()] = listed
    return out
