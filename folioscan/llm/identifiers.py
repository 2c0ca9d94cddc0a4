"""Numbers that identify a person, as far as they can be checked: what is valid, and valid numbers made of free parts.

Each form has a free part, of which any letters and digits may be valid or not, and a check part that follows from it."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass

_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_DATED = "0123456789ABCDEFHJKLMNPRSTUVWXY"
#: Lengths of account numbers by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _luhn(digits: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _eleven(digits: str) -> str:
    """The last digit of a German tax number, by the public ISO 7064 mod 11, 10 rule."""
    p = 10
    for c in digits:
        p = (int(c) + p) % 10 or 10
        p = 2 * p % 11
    return str((11 - p) % 10)


@dataclass(frozen=True)
class Form:
    name: str
    #: shape of the letters and digits alone
    shape: re.Pattern
    #: free part and rest of a number, the rest empty where the check follows from the free part alone
    payload: Callable[[str], tuple[str, str]]
    #: the whole number for a free part, None where there is none
    complete: Callable[[str, str], str | None]

    def holds(self, plain: str) -> bool:
        return bool(self.shape.fullmatch(plain)) and self.complete(*self.payload(plain)) == plain


def _ssn(free: str, _: str) -> str | None:
    return None if free[:3] in ("000", "666") or free[3:5] == "00" or free[5:] == "0000" else free


def _finnish(free: str, mark: str) -> str | None:
    """Day, month, year and a running number; the mark between is of the century."""
    try:
        datetime.date({"+": 1800, "-": 1900, "A": 2000}[mark or "-"] + int(free[4:6]), int(free[2:4]), int(free[:2]))
    except ValueError:
        return None
    return free[:6] + (mark if mark == "A" else "") + free[6:9] + _DATED[int(free[:9]) % 31]


def _iban(free: str, country: str) -> str:
    return f"{country}{98 - _mod97(free + country + '00'):02d}{free}"


def _french(free: str, _: str) -> str | None:
    return f"{free}{97 - int(free) % 97:02d}" if free[0] in "12" and 1 <= int(free[3:5]) <= 12 else None


def _steuer(free: str, _: str) -> str | None:
    most = max(free.count(c) for c in set(free))
    return free + _eleven(free) if free[0] != "0" and most in (2, 3) and len(set(free)) in (8, 9) else None


def _tail(n: int):
    return lambda v: (v[:-n], "")


FORMS = [
    Form("ssn", re.compile(r"\d{9}"), lambda v: (v, ""), _ssn),
    Form("finnish", re.compile(r"\d{6}A?\d{3}[0-9A-Y]"), lambda v: (v[:6] + v[-4:-1], "A" if len(v) == 11 else "-"), _finnish),
    Form("iban", re.compile(r"[A-Z]{2}\d{2}[0-9A-Z]{11,24}"), lambda v: (v[4:], v[:2]), _iban),
    Form("french", re.compile(r"[12]\d{14}"), _tail(2), _french),
    Form("spanish", re.compile(r"\d{8}[A-Z]"), _tail(1), lambda free, _: free + _LETTERS[int(free) % 23]),
    Form("spanish foreign", re.compile(r"[XYZ]\d{7}[A-Z]"), lambda v: (v[1:-1], v[0]), lambda free, head: head + free + _LETTERS[int(str("XYZ".index(head)) + free) % 23]),
    Form("card", re.compile(r"[3-6]\d{15}"), lambda v: (v[1:-1], v[0]), lambda free, head: head + free + _luhn(head + free)),
    Form("steuer", re.compile(r"[1-9]\d{10}"), _tail(1), _steuer),
]
_BY_NAME = {f.name: f for f in FORMS}

#: Shapes that count only where the number is valid. Spaces may stand between groups.
SHAPES = re.compile(
    r"(?<![\w.+/-])(?:"
    r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,6}(?: ?[0-9A-Z]{1,4})?"
    r"|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}"
    r"|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|[3-6]\d{3}(?:[ -]?\d{4}){3}"
    r"|[1-9]\d ?\d{3} ?\d{3} ?\d{3}"
    r")(?![\w]|[-./]\d)"
)


def _plain(text: str) -> str:
    return re.sub(r"[^0-9A-Z]", "", text)


def valid(text: str) -> bool:
    """Whether a number of one of SHAPES is valid in a form that has a check part."""
    v = _plain(text)
    for f in FORMS[2:]:
        if f.shape.fullmatch(v):
            if f.name == "iban" and IBAN_LENGTHS.get(v[:2]) != len(v):
                continue
            if f.holds(v):
                return True
    return False


def issued(text: str) -> bool:
    """False for numbers of a known format that are never given out. Dates in them are not held against the calendar:
    texts have many made-up or masked ones, which are as personal as others."""
    return not re.fullmatch(r"\d{3}-\d{2}-\d{4}", text) or _BY_NAME["ssn"].holds(_plain(text))


def form_of(text: str) -> Form | None:
    """The form in which a number is valid, by how it is written."""
    v = _plain(text)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{9}", text.strip()):
        return _BY_NAME["ssn"] if _BY_NAME["ssn"].holds(v) else None
    if re.fullmatch(r"\d{6}[-A]\d{3}[0-9A-Y]", text.strip()):
        return _BY_NAME["finnish"] if _BY_NAME["finnish"].holds(v) else None
    return next((f for f in FORMS[2:] if f.holds(v) and (f.name != "iban" or IBAN_LENGTHS.get(v[:2]) == len(v))), None)
