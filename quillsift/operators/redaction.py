"""Redaction of everybody on a roster. The order of the steps is part of the result: each sees what the one before it left."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions.batches import rowwise
from quillsift.functions.names import alike, near, ocr_fold
from quillsift.operators.roster import FLAGS, SPACE, Roster

MARK = "[REDACTED]"

# Patterns and words that decide what is an identifier.
EMAIL = regex.compile(r"(?<![\p{L}\p{N}._%+\-\]])(?:\[REDACTED\]|[\p{L}\p{N}._%+-])++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+", FLAGS)
ID_LIKE = regex.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){6,9}(?![0-9])", FLAGS)
TAIL = regex.compile(r"\[REDACTED\][\p{L}\p{N}]+", FLAGS)
WORD = regex.compile(r"[\p{L}\p{N}'’]+", FLAGS)
LABEL = regex.compile(
    r"((?:^|[|;,][ \t]*|[ \t]{2,})[-–—•*]?[ \t]*"
    rf"(?:(?:student[{SPACE}]+)?(?:name|id(?:[{SPACE}]*(?:number|no\.?|#))?|e-?mail)|student|author|(?:submitted|written|prepared)[{SPACE}]+by|by|"
    r"instructor|professor|teacher|prof\.?)"
    r"[ \t]*:[ \t]*)([^\n]*)",
    FLAGS | regex.I,
)
BYLINE = regex.compile(rf"^([ \t]*(?:(?:submitted|written|prepared)[{SPACE}]+)?by[{SPACE}]+)([^{SPACE}].*)$", FLAGS | regex.I)
MID_CAPITAL = regex.compile(r"(?<=[\p{L}\p{N},;)'’”\"][ \t]+)\p{Lu}[\p{L}\p{N}'’]*", FLAGS)
CALENDAR = frozenset("may june july march april august monday friday sunday".split())
HEADER_LINES, FOOTER_LINES, ZONE_WORDS, SHORT_WORDS, VALUE_WORDS = 6, 3, 7, 3, 4

_ALNUMS = regex.compile(r"[\p{L}\p{N}]+", FLAGS)
_STARTS_UPPER = regex.compile(r"[\p{Lu}\p{N}]", FLAGS)
_UNIT = regex.compile(r"\[REDACTED\]|\p{Lu}\.|[\p{L}\p{N}'’]+", FLAGS)
_INITIAL = regex.compile(r"\p{Lu}\.", FLAGS)


def is_blank(text: str) -> bool:
    return not regex.sub(rf"[{SPACE}]+", "", text)


def word_total(line: str) -> int:
    return len(_ALNUMS.findall(line))


def starts_upper(word: str) -> bool:
    return bool(_STARTS_UPPER.match(word))


def replace_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """Text with each of the ascending, disjoint spans replaced by the mark."""
    out, at = [], 0
    for begin, end in spans:
        out += [text[at:begin], MARK]
        at = end
    return "".join([*out, text[at:]])


def labels(text: str, roster: Roster) -> str:
    """Values of form labels; a label alone on its line takes a short next line as its value."""
    lines, done = text.split("\n"), 0
    while done < len(lines):
        found = LABEL.search(lines[done])
        if found:
            if not is_blank(found[2]):
                lines[done] = lines[done][: found.end(1)] + MARK
            elif done + 1 < len(lines) and not is_blank(lines[done + 1]) and word_total(lines[done + 1]) <= VALUE_WORDS:
                done += 1
                lines[done] = MARK
        done += 1
    return "\n".join(lines)


def _is_pair(roster: Roster, left: str, right: str, gap: str) -> bool:
    """Whether two neighbouring words are one person's name, one part exact and the other nearly."""
    a, b = ocr_fold(left), ocr_fold(right)
    people = [*roster.partners.get(a, ()), *roster.partners.get(b, ())] if a in roster.partners or b in roster.partners else ()
    if not people or starts_upper(left) != starts_upper(right):
        return False
    comma = gap.strip(" \t") == "," and gap.count(",") == 1
    if not comma and (not gap or gap.strip(" \t")):
        return False
    for first, last in people:
        in_order = not comma and a == first and alike(b, last, True)
        if not starts_upper(left):
            if in_order:
                return True
            continue
        if in_order or (not comma and b == last and alike(a, first, True)):
            return True
        if (a == last and alike(b, first, True)) or (comma and b == first and alike(a, last, True)):
            return True
    return False


def pairs(text: str, roster: Roster) -> str:
    spans: list[tuple[int, int]] = []
    before = None
    for word in WORD.finditer(text):
        if before is not None and _is_pair(roster, before[0], word[0], text[before.end() : word.start()]):
            spans.append((before.start(), word.end()))
            before = None
        else:
            before = word
    return replace_spans(text, spans)


def zone(lines: list[str]) -> set[int]:
    """Lines where names cluster: a block of short lines at the top and the end, and every very short line."""
    sizes = [word_total(x) for x in lines]
    found = {i for i, n in enumerate(sizes) if n <= SHORT_WORDS}
    for numbers, most in ((range(len(lines)), HEADER_LINES), (range(len(lines) - 1, -1, -1), FOOTER_LINES)):
        taken = 0
        for i in numbers:
            if is_blank(lines[i]):
                continue
            if sizes[i] > ZONE_WORDS or taken == most:
                break
            found.add(i)
            taken += 1
    return found


def zones(text: str, roster: Roster) -> str:
    lines = text.split("\n")
    for i in zone(lines):
        line = BYLINE.sub(lambda m: m[1] + MARK, lines[i], count=1)
        lines[i] = WORD.sub(lambda m: MARK if m[0] != "REDACTED" and roster.near_names(m[0]) else m[0], line)
    return "\n".join(lines)


def folded_names(text: str, roster: Roster) -> str:
    return WORD.sub(lambda m: MARK if starts_upper(m[0]) and ocr_fold(m[0]) in roster.owners else m[0], text)


def is_author_word(word: str, parts: tuple[str, str], in_bytes: bool = False) -> bool:
    folded = ocr_fold(word)
    return folded not in CALENDAR and any(near(folded, n, in_bytes) for n in parts)


def author_names(text: str, roster: Roster, author: str | None) -> str:
    """The author's initials, and capitalised words inside a sentence that come near the author's name."""
    if author not in roster.authors:
        return text
    parts, initials = roster.authors[author]
    return MID_CAPITAL.sub(lambda m: MARK if is_author_word(m[0], parts, roster.in_bytes) else m[0], initials.sub(MARK, text))


def neighbours(text: str, roster: Roster) -> str:
    """Initials and names beside a mark, on its line; chains go in one walk each way."""

    def one_line(line: str) -> str:
        units = list(_UNIT.finditer(line))
        gone = [u[0] == MARK for u in units]
        if not any(gone):
            return line
        new = [False] * len(units)
        gaps = [line[a.end() : b.start()] for a, b in zip(units, units[1:], strict=False)]
        blank = [not g.strip(" \t") for g in gaps]
        spaced = [bool(g) and not g.strip(" \t,") for g in gaps]
        for i in range(len(units) - 2, -1, -1):
            if gone[i] or not gone[i + 1]:
                continue
            if _INITIAL.fullmatch(units[i][0]):
                start = units[i].start()
                gone[i] = new[i] = blank[i] and not (start and regex.match(r"[\p{L}\p{N}.]", line[start - 1]))
            else:
                gone[i] = new[i] = spaced[i] and ocr_fold(units[i][0]) in roster.owners
        for i in range(1, len(units)):
            if gone[i] or not gone[i - 1]:
                continue
            if _INITIAL.fullmatch(units[i][0]):
                gone[i] = new[i] = blank[i - 1]
            else:
                gone[i] = new[i] = spaced[i - 1] and starts_upper(units[i][0]) and any(n in roster.surnames for n in roster.near_names(units[i][0]))
        return replace_spans(line, [u.span() for u, hit in zip(units, new, strict=True) if hit])

    return "\n".join(map(one_line, text.split("\n")))


_CHAIN = regex.compile(r"\[REDACTED\](?:[ \t]*+\[REDACTED\])++", FLAGS)

#: Name and function (text, roster, author) of every step, in order.
STEPS: tuple[tuple[str, Callable[[str, Roster, str | None], str]], ...] = (
    ("compatibility_forms", lambda t, r, a: unicodedata.normalize("NFKC", t)),
    ("labels", lambda t, r, a: labels(t, r)),
    ("full_names", lambda t, r, a: r.full.sub(MARK, t)),
    ("comma_names", lambda t, r, a: r.comma.sub(MARK, t)),
    ("last_first_names", lambda t, r, a: r.last_first.sub(MARK, t)),
    ("email_locals", lambda t, r, a: r.local.sub(MARK, t)),
    ("student_ids", lambda t, r, a: r.ids.sub(MARK, t)),
    ("school_domains", lambda t, r, a: r.domain.sub(MARK, t) if r.domain_only.search(t) else t),
    ("pairs", lambda t, r, a: pairs(t, r)),
    ("emails", lambda t, r, a: EMAIL.sub(MARK, t) if "@" in t else t),
    ("id_like_runs", lambda t, r, a: ID_LIKE.sub(MARK, t)),
    ("tails", lambda t, r, a: TAIL.sub(MARK, t)),
    ("bare_names", lambda t, r, a: r.bare.sub(MARK, t)),
    ("folded_names", lambda t, r, a: folded_names(t, r)),
    ("author", author_names),
    ("zones", lambda t, r, a: zones(t, r)),
    ("neighbours", lambda t, r, a: neighbours(t, r)),
    ("collapse", lambda t, r, a: _CHAIN.sub(MARK, t)),
)


def redact(text: str, roster: Roster, author: str | None = None) -> str:
    for _, step in STEPS:
        text = step(text, roster, author)
    return text


def after_step(documents: DataFrame, roster: Roster, step: str, text: str = "text", author: str | None = None, out: str = "redacted") -> DataFrame:
    """``documents`` with the text after one step alone, for looking at a step by itself."""
    return _through(documents, roster, dict(STEPS)[step], text, author, out)


def redacted(documents: DataFrame, roster: Roster, text: str = "text", author: str | None = None, out: str = "redacted") -> DataFrame:
    """``documents`` with the redacted text added; ``author``: the column of the author's student id, if there is one.

    One Arrow crossing for all steps; the roster, of bounded size, goes with the task. Null texts stay null.
    """
    return _through(documents, roster, redact, text, author, out)


def _through(documents: DataFrame, roster: Roster, change: Callable[[str, Roster, str | None], str], text: str, author: str | None, out: str) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(roster)

    def prepare() -> Callable[[str | None, str | None], str | None]:
        compiled = sent.value
        return lambda written, who: None if written is None else change(written, compiled, who)

    by: Column = F.col(author).cast("string") if author else F.lit(None).cast("string")
    return documents.withColumn(out, rowwise(T.StringType(), prepare)(F.col(text), by))
