"""Text functions as column expressions. Nothing here leaves the JVM except where it says so.

Regular expressions name their character classes by Unicode property: a word character is a letter, a number or an
underscore in any script, white space includes the Unicode separators.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"\p{L}\p{N}_"
SPACE = r"\s\x{85}\x{1c}-\x{1f}\p{Z}"

#: Patterns of the cleaner and the tokenizer (fixed values).
ENTITY = r"&(?:amp|lt|gt|quot|#39);"
MARKDOWN_LINK = r"\[([^\]]*)\]\([^)]+\)"
REFERENCE = rf"(?i)/[ur]/[{W}]+"
URL = rf"(?i)https?://[^{SPACE}]+|www\.[^{SPACE}]+"
BLANKS = r"[\t\x{0b}\f\r\x{85}\x{1c}-\x{1f}\p{Z}]+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F900}-\x{1F9FF}]+"
WORD = rf"[{W}]+(?:'[{W}]+)?"
EMOTICON = r"[:;=8][-oO]*[)\]\(\[dDpP/\\|]+"
MARKS = r"[!?]+"
TOKEN = rf"{EMOJI}|{WORD}|{EMOTICON}|{MARKS}|\p{{L}}+"

#: Words that the tokenizer can leave out (fixed values).
STOPWORDS = """
a an the and or but in on at to for
of is it this that with as by from be
are was were been have has had do does did
i you he she we they my your his her our
not no so if up out about just get would
could should will can its also than then when
""".split()


def slices(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Slices of a batch whose sizes add up to at most so much, or that are a single row: long texts in one batch do not add up."""
    start = total = i = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if sizes:
        yield slice(start, i + 1)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Without white space at either end, newlines included."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_entities(c: Column) -> Column:
    return F.regexp_replace(c, ENTITY, " ")


def unlink(c: Column) -> Column:
    """The text of markdown links, without their addresses."""
    return F.regexp_replace(c, MARKDOWN_LINK, "$1")


def strip_references(c: Column) -> Column:
    return F.regexp_replace(c, REFERENCE, " ")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def collapse_blanks(c: Column) -> Column:
    """Runs of white space other than newlines become one space; newlines stay."""
    return F.regexp_replace(c, BLANKS, " ")


def clean(c: Column, urls: bool = True, markdown: bool = True, lower: bool = False) -> Column:
    """A comment body without entities, link addresses, user and community references, and addresses. Null gives ''."""
    c = strip_entities(F.coalesce(c, F.lit("")))
    if markdown:
        c = strip_references(unlink(c))
    if urls:
        c = strip_urls(c)
    c = strip(collapse_blanks(c))
    return F.lower(c) if lower else c


def tokenize(c: Column, stopwords: Sequence[str] = ()) -> Column:
    """Emoji runs, words (with one inner apostrophe), emoticons and runs of ! and ?; without the given words in any case."""
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*stopwords)) if stopwords else tokens


def whole_word(word: str) -> str:
    """A pattern for the word with boundaries at both ends, in any case.

    At an edge that is no word character the boundary needs a word character beside it: ``c++`` is found in ``c++11``
    and not in ``c++ a``.
    """
    edge = re.compile(r"[^\W]")
    left = rf"(?<![{W}])" if edge.match(word[0]) else rf"(?<=[{W}])"
    right = rf"(?![{W}])" if edge.match(word[-1]) else rf"(?=[{W}])"
    return rf"(?iu){left}{java_quote(word)}{right}"


def java_quote(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\\1", word)


def term_pattern(term: Column) -> Column:
    """A pattern that finds the words of a term with any non-word characters between them, as whole words, in any case."""
    quoted = F.regexp_replace(F.trim(term), r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\$1")
    joined = F.regexp_replace(quoted, r"\s+", rf"[^{W}]+".replace("\\", "\\\\"))
    return F.concat(F.lit(rf"(?iu)(?<![{W}])"), joined, F.lit(rf"(?![{W}])"))


def snippet(body: Column, term: Column, radius: int = 140) -> Column:
    """The text around the first place of a term, with an ellipsis at each cut; the head of the text if it is not there."""
    body = F.coalesce(body, F.lit(""))
    hit = F.call_function("regexp_substr", body, term_pattern(term))
    at = F.call_function("instr", body, hit)
    lo = F.greatest(at - 1 - radius, F.lit(0))
    hi = F.least(at - 1 + F.length(hit) + radius, F.length(body))
    cut = F.concat(
        F.when(lo > 0, "…").otherwise(""),
        strip(F.substring(body, lo + 1, hi - lo)),
        F.when(hi < F.length(body), "…").otherwise(""),
    )
    return F.when(hit.isNull(), F.substring(body, 1, 2 * radius)).otherwise(cut)


def hash64(c: Column, seed: int = 0) -> Column:
    """A 64-bit hash that depends on the seed."""
    return F.xxhash64(F.lit(seed).cast("bigint"), c)


def countable(token: Column, stopwords: Sequence[str], shortest: int = 3) -> Column:
    """Whether a lower-cased token can be part of a trending term: letters only, long enough, no stop word."""
    return (F.length(token) >= shortest) & token.rlike(r"^\p{L}+$") & ~token.isin(*stopwords)


def known_zipf(zipf: Column) -> Column:
    """A Zipf frequency, with that of rare words (2.5) for words without one (0 or null)."""
    return F.when(F.coalesce(zipf, F.lit(0.0)) <= 0, F.lit(2.5)).otherwise(zipf)


def informativeness(zipf: Column) -> Column:
    """How telling a word is by its Zipf frequency: rarer words weigh more, unknown ones (0 or null) count as 2.5."""
    return F.greatest(F.lit(1.0), F.lit(7.5) - known_zipf(zipf))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def cache_key(tokens: Column) -> Column:
    return F.sha1(F.array_join(tokens, " "))


def signed_score(label: Column, score: Column) -> Column:
    """The size of the score below zero for negative labels, above for positive ones, else 0."""
    return F.when(label == "negative", -F.abs(score)).when(label == "positive", F.abs(score)).otherwise(F.lit(0.0))


def centred_score(label: Column, score: Column) -> Column:
    """2 p - 1 for a probability p of the positive class: what signed_score means where the score is such a probability."""
    return F.when(label.isin("positive", "negative"), 2 * score - 1).otherwise(F.lit(0.0))


def first_text(*texts: Column, tokens: Column | None = None) -> Column:
    """The first text that is not blank, else the tokens joined by spaces."""
    picks = [F.when(strip(t) != "", t) for t in texts]
    return F.coalesce(*picks, F.array_join(tokens, " ") if tokens is not None else F.lit(""), F.lit(""))


def label_of(compound: Column, band: float = 0.05) -> Column:
    """positive from band on, negative from -band down, else neutral."""
    if band < 0:
        raise ValueError("the neutral band cannot be negative")
    return F.when(compound >= band, "positive").when(compound <= -band, "negative").otherwise("neutral")
