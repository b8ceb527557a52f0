"""Tokenisers and text primitives as column expressions.

Word characters are always spelled out as Unicode classes, never as \\w or \\b, so that every engine
splits alike. All functions take a column (or its name) and give null for null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
CJK_WORD = "[0-9A-Za-z가-힣]+|[一-鿿]"
# Words that carry no content, English and Korean, for context compression and for node scores; every function takes others in their place.
STOPWORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "은", "는", "이", "가", "을", "를", "의", "에", "에서", "으로", "로")
QUESTION_WORDS = ("을", "를", "이", "가", "은", "는", "의", "에", "로", "와", "과", "에서", "the", "a", "an", "is", "are", "was", "were")
#: Particles that follow a Korean noun without a space; a default, callers may pass their own.
PARTICLES = (
    "에서는", "에서의", "으로는", "으로의", "에서", "에게", "한테", "께서", "으로", "부터", "까지", "보다", "처럼", "마다", "조차", "밖에", "이나", "이란", "이라", "하고",
    "은", "는", "이", "가", "을", "를", "의", "에", "로", "와", "과", "도", "만", "나", "란", "랑",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str, longer_than: int = 0) -> Column:
    """Lower-case runs of word characters, those of more than `longer_than` characters."""
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda x: F.length(x) > longer_than) if longer_than else found


def long_words(c: Column | str) -> Column:
    """words of two characters or more."""
    return words(c, 1)


def tokens_cjk(c: Column | str) -> Column:
    """ASCII and Hangul words, and single ideographs, lower-case."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(CJK_WORD), F.lit(0))


def word_set(c: Column | str) -> Column:
    return F.array_distinct(words(c))


def white_space_tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(_col(c)), r"\s+"), lambda x: x != "")


def content_tokens(c: Column | str, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of two characters or more outside the stop list, repeats kept."""
    return F.filter(words(c, 1), lambda x: ~x.isin(*stop))


def query_keywords(c: Column | str, longer_than: int = 2) -> Column:
    """Words of a query that are looked for as substrings."""
    return words(c, longer_than)


def question_terms(c: Column | str, stop: tuple[str, ...] = QUESTION_WORDS) -> Column:
    """The distinct white-space tokens outside the stop list."""
    return F.array_distinct(F.filter(white_space_tokens(c), lambda x: ~x.isin(*stop)))


def without_particle(token: Column, particles: tuple[str, ...] = PARTICLES) -> Column:
    """A Korean token less the longest particle that it ends with, if two syllables are left; others as they are.

    The shortest possible beginning is taken first, hence the longest of the particles.
    """
    return F.regexp_replace(token, rf"^([가-힣]{{2,}}?)(?:{'|'.join(particles)})$", "$1")


def critical_keywords(c: Column | str, particles: tuple[str, ...] = PARTICLES) -> Column:
    """Words of four characters or more; in a text with Korean ones, their stems of two syllables or more and the other words of four."""
    korean = F.filter(F.transform(words(c), lambda x: F.when(x.rlike("^[가-힣]+$"), without_particle(x, particles)).otherwise(x)), lambda x: F.when(x.rlike("^[가-힣]+$"), F.length(x) >= 2).otherwise(F.length(x) > 3))
    return F.when(_col(c).rlike("[가-힣]"), korean).otherwise(words(c, 3))


def char_ngrams(c: Column | str, n: int = 3, collapse: bool = True) -> Column:
    """Distinct n-grams of the lower-case text; a shorter one is its own only gram, an empty one has none."""
    t = F.lower(_col(c))
    if collapse:
        t = F.trim(F.regexp_replace(t, r"\s+", " "))
    chars = F.split(t, "")
    grams = chars
    for k in range(1, n):  # arguments of zip_with are evaluated once a row, what a lambda refers to once an element
        grams = F.zip_with(grams, F.slice(chars, k + 1, 1 << 30), lambda x, y: F.concat(x, y))
    grams = F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(F.array_compact(grams)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(grams)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being evaluated once a row; what a lambda refers to otherwise is evaluated once an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Neighbouring words joined by one space; fewer words than n give none."""

    def grams(w: Column) -> Column:
        out = w
        for k in range(1, n):
            out = F.zip_with(out, F.slice(w, k + 1, 1 << 30), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.array_compact(out)

    return F.coalesce(once(tokens, grams), F.array().cast("array<string>"))


def char_windows(c: Column | str, width: int = 15, stride: int = 7) -> Column:
    """Windows of `width` characters, one every `stride`, out of the text's array of characters: time is linear in its length."""
    t = _col(c)
    at = lambda x: F.sequence(F.lit(1), F.greatest(F.size(x) - width + 1, F.lit(1)), F.lit(stride))
    cut = once(F.split(t, ""), lambda x: F.transform(at(x), lambda i: F.concat_ws("", F.slice(x, i, width))))
    return F.when(F.length(t) >= width, cut).otherwise(F.array().cast("array<string>"))


def sentences(c: Column | str, pattern: str = r"[.!?]+\s+") -> Column:
    return F.filter(F.transform(F.split(_col(c), pattern), lambda x: F.trim(x)), lambda x: x != "")


def normalised(c: Column | str) -> Column:
    """For exact match: lower-case, punctuation to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[\p{P}\p{S}]", " "), r"\s+", " "))


def language(c: Column | str) -> Column:
    t = _col(c)
    return F.when(t.rlike("[가-힣]"), "ko").when(t.rlike("[぀-ヿ一-鿿]"), "ja").otherwise("en")


def tokens_estimate(c: Column | str, chars_each: int = 4) -> Column:
    return F.floor(F.length(_col(c)) / chars_each)


def model_answer(c: Column | str) -> Column:
    """An answer out of model output: fences stripped, the first known JSON key, else the text."""
    t = F.trim(F.regexp_replace(_col(c), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    keys = [F.get_json_object(t, f"$.{k}") for k in ("answer", "response", "result", "text")]
    cut = F.nullif(F.regexp_extract(t, r'(?s)"(?:answer|response|result|text)"\s*:\s*"((?:[^"\\]|\\.)*)', 1), F.lit(""))
    return F.coalesce(*keys, cut, t)


def first_json(c: Column | str) -> Column:
    """The first {...} of a text, fences or not; null where there is none."""
    return F.nullif(F.regexp_extract(_col(c), r"(?s)\{.*\}", 0), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)
