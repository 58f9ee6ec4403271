"""Text functions as column expressions of the engine; all stay in generated code.

Patterns use possessive groups where the regular-expression engine would otherwise recurse once a
repetition, so that one hostile row cannot end the session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as the documents' producers understand it, and characters without width.
WHITE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
NO_WIDTH = r"[\u00AD\u200B-\u200D\uFEFF]"
# Identifiers that need no roster.
EMAIL = r"(?<![\p{L}\p{N}._%+\-\]])(?:\[REDACTED\]|[\p{L}\p{N}._%+-])++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
ID_LIKE = r"(?<![0-9])[0-9](?:[ .-]?[0-9]){6,9}(?![0-9])"
TAIL = r"\[REDACTED\][\p{L}\p{N}]+"
CHAIN = r"\[REDACTED\](?:[ \t]*+\[REDACTED\])++"
MARK = "[REDACTED]"


@F.pandas_udf(T.StringType())
def compatible(texts):
    """NFKC, for which the engine has no function."""
    import unicodedata

    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WHITE}]++|[{WHITE}]++\z", "")


def without_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, NO_WIDTH, "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def rejoined(text: Column) -> Column:
    """Words that a hyphen breaks at a line end are joined again."""
    return F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")


def squeezed_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def cleaned(text: Column) -> Column:
    """What follows extraction and NFKC."""
    return trimmed(squeezed_lines(rejoined(unix_lines(without_zero_width(text)))))


def without_emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, MARK)).otherwise(text)


def has_email(text: Column) -> Column:
    return F.contains(text, F.lit("@")) & F.coalesce(text.rlike(EMAIL), F.lit(False))


def has_id_like(text: Column) -> Column:
    return F.coalesce(text.rlike(ID_LIKE), F.lit(False))


def without_id_like(text: Column) -> Column:
    return F.regexp_replace(text, ID_LIKE, MARK)


def without_tails(text: Column) -> Column:
    return F.regexp_replace(text, TAIL, MARK)


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, CHAIN, MARK)


def alnum_runs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def words_of_two(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{2,}"))


def blank_separated(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{WHITE}]+"))


def looks_like_writing(text: Column) -> Column:
    """At least 10 words of 3 letters, and at least half of all tokens."""
    tokens = F.filter(F.split(text, rf"[{WHITE}]+"), lambda t: t != "")
    written = F.size(F.filter(tokens, lambda t: t.rlike(r"^[\p{L}'’]{3,}[.,;:!?]?\z")))
    return (written >= 10) & (2 * written >= F.size(tokens))


def lower_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), F.lit(1)))


def same_words(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words: both of 10 at least, and 60 % of each in the other."""
    shared = F.size(F.array_intersect(a, b))
    return (F.size(a) >= 10) & (F.size(b) >= 10) & (10 * shared >= 6 * F.size(a)) & (10 * shared >= 6 * F.size(b))


def without_trailing_tags(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?:[{WHITE}]*+</?[\w:-]++>)++[{WHITE}]*\z", ""))


def fenced(text: Column) -> Column:
    """A text that cannot close the tag it is put in."""
    return F.regexp_replace(text, rf"(?i)<([{WHITE}]*/?[{WHITE}]*essay)", "‹$1")


def short_digest(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def html_escaped(text: Column) -> Column:
    """Characters with a meaning in HTML by their numbers; the ampersand first, as the others bring new ones."""
    out = text
    for c in "&<>\"'":
        out = F.replace(out, F.lit(c), F.lit(f"&#{ord(c)};"))
    return out


def starts_upper(word: Column) -> Column:
    return word.rlike(r"^[\p{Lu}\p{N}]")


def is_initial(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}\.\z")


def is_calendar_name(word: Column) -> Column:
    return F.lower(word).isin("may", "june", "july", "march", "april", "august", "monday", "friday", "sunday")
