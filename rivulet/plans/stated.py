"""What the SQL of the queries states by itself: patterns and words are written out here and not taken from the operators."""

#: Fixed values of the reference results, written for RE2.
WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x{85}\x{1c}-\x{1f}\p{Z}"
ENTITY = "&(amp|lt|gt|quot|#39);"
LINK = r"\[([^\]]*)\]\([^)]+\)"
REFERENCE = r"(?i)/[ru]/[\p{L}\p{N}_]+"
ADDRESS = r"(?i)(https?://|www\.)[^\s\x{85}\x{1c}-\x{1f}\p{Z}]+"
SPACES = r"[\t\x{0b}\f\r\x{85}\x{1c}-\x{1f}\p{Z}]+"
TOKEN = (
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F900}-\x{1F9FF}]+"
    r"|[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?"
    r"|[:;=8][-oO]*[\)\]\(\[dDpP/\\|]+"
    r"|[!?]+|\p{L}+"
)
STOP = """
a an the and or but in on at to for
of is it this that with as by from be
are was were been have has had do does did
i you he she we they my your his her our
not no so if up out about just get would
could should will can its also than then when
""".split()


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def clean(c: str) -> str:
    s = f"coalesce({c}, '')"
    for pattern, to in ((ENTITY, " "), (LINK, r"\1"), (REFERENCE, " "), (ADDRESS, " "), (SPACES, " ")):
        s = f"regexp_replace({s}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return strip(s)


def strip(c: str) -> str:
    return f"regexp_replace({c}, {quoted(rf'^[{BLANK}]+|[{BLANK}]+$')}, '', 'g')"


def tokens(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), {quoted(TOKEN)})"


def has_word(c: str, word: str) -> str:
    """Whether a text has a word of letters, digits and blanks between word boundaries, in any case."""
    return f"regexp_matches({c}, {quoted(rf'(?i)(^|[^{WORD}]){word}($|[^{WORD}])')})"


#: y: (kafka_partition, kafka_offset, language) of every text of x (kafka_partition, kafka_offset, t): naive Bayes over letter trigrams.
def _letters(c: str) -> str:
    return f"' ' || trim(lower(regexp_replace({c}, '[^\\p{{L}}]+', ' ', 'g'))) || ' '"


LANGUAGE = f"""s AS (SELECT lang, {_letters("text")} AS t FROM language_samples WHERE lang IS NOT NULL AND regexp_matches(text, '\\p{{L}}')),
  c AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram FROM s) GROUP BY ALL),
  v AS (SELECT DISTINCT gram FROM c), l AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
  p AS (SELECT gram, l.lang, ln((coalesce(n, 0) + 0.5) / (total + 0.5 * (SELECT count(*) FROM v))) AS log
    FROM v CROSS JOIN l LEFT JOIN c USING (gram, lang)),
  xl AS (SELECT kafka_partition, kafka_offset, {_letters("coalesce(t, '')")} AS t FROM x),
  xg AS (SELECT kafka_partition, kafka_offset, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram FROM xl),
  y AS (SELECT kafka_partition, kafka_offset, lang AS language FROM xg JOIN p USING (gram) GROUP BY kafka_partition, kafka_offset, lang
    QUALIFY row_number() OVER (PARTITION BY kafka_partition, kafka_offset ORDER BY sum(log) DESC, lang) = 1)"""
