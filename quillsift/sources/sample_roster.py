"""An invented roster, for queries over tables that have none. Both sides of a comparison use the same rows."""

from __future__ import annotations

from quillsift.operators.roster import Person, Roster

TEACHER = Person("Ines", "Vargas", "ivargas@northvale.edu")
STUDENTS = (
    Person("Tomas", "Keller", "tomas.keller@northvale.edu", "700200301"),
    Person("Ruth", "Halvorsen", "rhalvorsen2@northvale.edu", "700200302"),
    Person("Ian", "Novak", "ian.novak@northvale.edu", "700200303"),
    Person("Opal", "Hart", "opal.hart@northvale.edu", "700200304"),
    Person("Mark", "D'Arcy", "mdarcy@northvale.edu", "700200305"),
    Person("Rose", "Lim", "rose.lim@northvale.edu", "700200306"),
    Person("Dean", "Whitlock", "dwhitlock@northvale.edu", "700200307"),
    Person("Leila", "Farouk", "leila.farouk@northvale.edu", "700200308"),
)


def sample_roster(in_bytes: bool = False) -> Roster:
    return Roster((TEACHER, *STUDENTS), in_bytes)


def values_sql() -> str:
    """``VALUES`` of (n, student_id, first_name, last_name, email), students only."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({n}, {q(p.student_id)}, {q(p.first)}, {q(p.last)}, {q(p.email)})" for n, p in enumerate(STUDENTS))
