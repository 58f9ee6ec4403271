"""A roster compiled for matching: patterns and lookup tables, built once and sent to the workers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from quillsift.functions.names import REMEMBERED, deletions, near, normalise, ocr_fold, reach, squeeze, utf8

# Characters that are read in place of digits, and of letters in a domain.
DIGIT_LOOKALIKES = {"0": "0OoDQ", "1": "1Ili|!", "2": "2Zz", "5": "5Ss", "6": "6bG", "8": "8B", "9": "9gq"}
DOMAIN_LOOKALIKES = {"m": "(?:m|rn)", "d": "(?:d|cl)", "w": "(?:w|vv)", "l": "[l1i|]", "i": "[il1|]", "o": "[o0]", "s": "[s5]"}
# White space, and what may stand between the parts of a name.
SPACE = r"\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BETWEEN = rf"[{SPACE}.,_\-]*"
TEACHER = "teacher"
MOST_STUDENTS = 500
FLAGS = regex.V0


@dataclass(frozen=True)
class Person:
    first: str
    last: str
    email: str
    student_id: str | None = None

    @property
    def owner(self) -> str:
        return self.student_id or TEACHER

    @property
    def local(self) -> str:
        return self.email.split("@")[0]

    @property
    def domain(self) -> str:
        return self.email.split("@")[1].lower()

    @property
    def orders(self) -> tuple[str, str, str]:
        return f"{self.first} {self.last}", f"{self.last}, {self.first}", f"{self.last} {self.first}"


@dataclass(frozen=True)
class Spelling:
    """How a reader may find a kind of identifier written: where it is split, what stands for a character, and what may come between.

    ``readings``: pattern of a character that may be misread; others stand for themselves. ``glue``: what may
    come between two characters of a part; ``gap``: between two parts.
    """

    split: str | None
    readings: Mapping[str, str]
    glue: str = ""
    gap: str = ""

    def of(self, value: str) -> str:
        parts = regex.split(self.split, value) if self.split else [value]
        return self.gap.join(self.glue.join(self.readings.get(c) or regex.escape(c, literal_spaces=True) for c in part) for part in parts)


def _class(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "|!" else c for c in characters) + "]"


_DOT = r"[(\[]?dot[)\]]?"
_APOSTROPHE = {"'": f"['’{SPACE}]?"}
# What may stand between the parts of an identifier of each kind.
SPELLINGS = {
    "name": Spelling(rf"[{SPACE},]+", _APOSTROPHE, gap=BETWEEN),
    "comma name": Spelling(", ", _APOSTROPHE, gap=rf"[{SPACE}.]*,[{SPACE}.]*"),
    "email local": Spelling(r"[._\-]+", {}, glue=rf"[{SPACE}.]?", gap=rf"(?:{BETWEEN}|[{SPACE}]*{_DOT}[{SPACE}]*)"),
    "student id": Spelling(None, {d: _class(seen) for d, seen in DIGIT_LOOKALIKES.items()}, glue=r"[^\p{L}\p{N}\n]{0,3}"),
    "domain": Spelling(r"\.", DOMAIN_LOOKALIKES, glue=" ?", gap=rf"(?:[{SPACE}]*(?:[.,]|{_DOT})[{SPACE}]*|[{SPACE}]+)"),
}
LETTER = r"[\p{L}\p{N}]"


def spelled(kind: str, values: Iterable[str], edge: str = LETTER, before: str = "", any_case: bool = False) -> regex.Pattern:
    """One pattern for all ``values`` of a kind, the longest tried first, not inside a run of ``edge``; ``before``: what may be attached in front."""
    bodies = sorted({SPELLINGS[kind].of(v): None for v in values}, key=len, reverse=True)
    bounds = (f"(?<!{edge})", f"(?!{edge})") if edge else ("", "")
    return regex.compile(f"{bounds[0]}{before}(?:{'|'.join(bodies)}){bounds[1]}", FLAGS | (regex.I if any_case else 0))


# Local parts that may be attached to a school domain.
_LOCAL_WORD = r"[\p{L}\p{N}_%+\-\[\]]+"
_DOTTED = rf"(?:\.[{SPACE}]?|[{SPACE}]+dot[{SPACE}]+)"
_LOCAL = rf"{_LOCAL_WORD}(?:{_DOTTED}{_LOCAL_WORD})*"
_ATTACHED = (
    rf"(?:{_LOCAL}(?:[{SPACE}]*(?:@|[(\[]at[)\]])[{SPACE}]*|[{SPACE}]+at[{SPACE}]+)"
    rf"|{_LOCAL_WORD}(?:{_DOTTED}{_LOCAL_WORD})+[{SPACE}]+|{_LOCAL}[._]?|@[{SPACE}]*)?"
)


#: Letters by which run-together names are found.
HEAD = 4


def _by_first(terms: Mapping[tuple[str, ...], list]) -> dict[str, list[tuple[tuple[str, ...], list]]]:
    """Terms of tokens by their first token."""
    out: dict[str, list] = defaultdict(list)
    for term, hits in terms.items():
        if term:
            out[term[0]].append((term, hits))
    return out


@dataclass
class Roster:
    """``in_bytes``: where matching is loose, edits are counted in bytes of UTF-8, as DuckDB's distances do, instead of letters."""

    people: tuple[Person, ...]
    in_bytes: bool = False
    full: regex.Pattern = field(init=False)

    def __post_init__(self) -> None:
        people = self.people
        if not any(p.student_id for p in people):
            raise ValueError("the roster needs at least one student")
        if sum(p.student_id is not None for p in people) > MOST_STUDENTS:
            raise ValueError(f"the roster has more than {MOST_STUDENTS} students")
        aloud = lambda names: [v for n in names for v in (n, n.upper())]
        first_last, comma, last_first = zip(*(p.orders for p in people), strict=True)
        domains = list(dict.fromkeys(p.domain for p in people))
        self.full = spelled("name", first_last, any_case=True)
        self.comma = spelled("comma name", comma, any_case=True)
        self.last_first = spelled("name", aloud(last_first))
        self.local = spelled("email local", (p.local for p in people), any_case=True)
        self.ids = spelled("student id", (p.student_id for p in people if p.student_id), edge=r"\p{N}")
        self.domain_only = spelled("domain", domains, edge="", any_case=True)
        attached = rf"(?<![\p{{L}}\p{{N}}_%+\-\[\].@]){_ATTACHED}"
        self.domain = spelled("domain", domains, edge="", before=attached, any_case=True)
        self.bare = spelled("name", aloud(n for p in people for n in (p.first, p.last)))
        self.folded_domains = [ocr_fold(d.replace(".", "")) for d in domains]

        self.partners: dict[str, list[tuple[str, str]]] = defaultdict(list)  # folded part -> (first, last) of who has it
        self.owners: dict[str, list[str]] = defaultdict(list)  # folded part -> owners
        self.surnames = {ocr_fold(p.last) for p in people}
        self.authors: dict[str, tuple[tuple[str, str], regex.Pattern]] = {}
        self.terms: dict[tuple[str, ...], list[tuple[str, str]]] = defaultdict(list)  # any case -> (owner, kind)
        self.capital_terms: dict[tuple[str, ...], list[tuple[str, str, bool]]] = defaultdict(list)  # -> (owner, kind, is a first name)
        self.locals: dict[str, list[str]] = defaultdict(list)
        self.student_ids = {p.student_id for p in people if p.student_id}
        self.merged: dict[str, list[str]] = defaultdict(list)
        self.long_surnames: dict[str, list[str]] = defaultdict(list)
        for p in people:
            first, last = ocr_fold(p.first), ocr_fold(p.last)
            for part in dict.fromkeys((first, last)):
                self.partners[part].append((first, last))
            for part in (first, last):
                self.owners[part].append(p.owner)
            if p.student_id:
                initials = regex.compile(rf"(?<!\p{{L}}){regex.escape(p.first[0].upper())}\.[{SPACE}]?{regex.escape(p.last[0].upper())}\.", FLAGS)
                self.authors[p.student_id] = ((first, last), initials)
            for kind, values in (("email", (p.email, p.local)), ("name", p.orders)):
                for v in values:
                    self.terms[tuple(normalise(v).split())].append((p.owner, kind))
            self.capital_terms[tuple(normalise(p.first).split())].append((p.owner, "name", True))
            self.capital_terms[tuple(normalise(p.last).split())].append((p.owner, "name", False))
            if len(squeeze(p.local)) >= 5:
                self.locals[squeeze(p.local)].append(p.owner)
            for run in (p.first + p.last, p.last + p.first):
                if len(squeeze(run)) >= 7:
                    self.merged[squeeze(run)].append(p.owner)
            if len(squeeze(p.last)) >= 6:
                self.long_surnames[squeeze(p.last)].append(p.owner)
        self.longest_name = max(map(len, self.owners))
        # Indexes, so that a text costs the same whatever the size of the roster.
        self.variants: dict[str, list[str]] = defaultdict(list)  # what deletions leave of a folded part -> parts
        for name in self.owners:
            for left in deletions(self._units(name), reach(name)):
                self.variants[left].append(name)
        self.term_starts = _by_first(self.terms)
        self.capital_starts = _by_first(self.capital_terms)
        self.local_sizes, self.id_sizes, self.surname_sizes = (sorted({len(x) for x in index}) for index in (self.locals, self.student_ids, self.long_surnames))
        self.merged_heads: dict[str, list[str]] = defaultdict(list)
        for run in self.merged:
            self.merged_heads[run[:HEAD]].append(run)
        self._remembered = lru_cache(maxsize=50_000)(self._near_names)

    def _units(self, text: str) -> str:
        return utf8(text) if self.in_bytes else text

    def near_names(self, word: str) -> tuple[str, ...]:
        """Folded name parts that a word may stand for where matching is loose, in the order of the roster."""
        return self._remembered(word) if len(word) <= REMEMBERED else self._near_names(word)

    def _near_names(self, word: str) -> tuple[str, ...]:
        folded = ocr_fold(word)
        if not 2 <= len(folded) <= self.longest_name + 2:
            return ()
        met = {n for left in deletions(self._units(folded), 2) for n in self.variants.get(left, ())}
        return tuple(n for n in self.owners if n in met and near(folded, n, self.in_bytes)) if met else ()

    def __getstate__(self) -> tuple[tuple[Person, ...], bool]:
        return self.people, self.in_bytes

    def __setstate__(self, state: tuple[tuple[Person, ...], bool]) -> None:
        self.people, self.in_bytes = state
        self.__post_init__()
