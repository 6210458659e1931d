"""Format-preserving stand-ins: keyed Feistel permutations of values within their format.

A value is reduced to what all its spellings share, ranked among the values of
its format, permuted by a Feistel network over that many numbers, and written
back in the spelling that it had. Check digits are worked out anew, so a valid
number stays valid and an invalid one isn't made to look valid by rule.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import math
import re

ROUNDS = 10


def _mac(key: bytes, text: str) -> int:
    return int.from_bytes(hmac.new(key, text.encode(), hashlib.sha256).digest()[:16], "big")


def permuted(x: int, n: int, key: bytes, tweak: str = "", back: bool = False) -> int:
    """A keyed permutation of 0 ... n - 1, or its inverse: Feistel over a square that holds them, walked until it is back in range."""
    if n < 2:
        return x
    side = math.isqrt(n - 1) + 1
    while True:
        a, b = divmod(x, side)
        if not back:
            for r in range(ROUNDS):
                a, b = b, (a + _mac(key, f"{tweak}:{n}:{r}:{b}")) % side
        else:
            for r in reversed(range(ROUNDS)):
                a, b = (b - _mac(key, f"{tweak}:{n}:{r}:{a}")) % side, a
        x = a * side + b
        if x < n:
            return x


# ---- formats: lists of the characters that each place may have ---------------

_DIGITS, _LETTERS, _FIRST = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "123456789"


def _within(text: str, places: list[str], key: bytes, tweak: str, back: bool = False) -> str:
    """The text permuted among all texts of the same places."""
    n, x = 1, 0
    for c, chars in zip(text, places):
        n *= len(chars)
        x = x * len(chars) + chars.index(c)
    x = permuted(x, n, key, tweak, back)
    out = []
    for chars in reversed(places):
        x, i = divmod(x, len(chars))
        out.append(chars[i])
    return "".join(reversed(out))


def _generic(text: str, key: bytes, tweak: str) -> str:
    """Digits to digits and letters to letters of the same case; a leading digit other than 0 stays so."""
    places = [_DIGITS if c in _DIGITS else _LETTERS if c in _LETTERS else _LETTERS.lower() if c in _LETTERS.lower() else c for c in text]
    if places and places[0] == _DIGITS and text[0] != "0":
        places[0] = _FIRST
    return _within(text, places, key, tweak)


# Check letters of the Spanish identity number, by the number modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _dni(text: str) -> str:
    number = text[:-1].translate(str.maketrans("XYZ", "012"))
    return text[:-1] + DNI_LETTERS[int(number) % 23]


def _nir(text: str) -> str:
    return text[:13] + f"{97 - int(text[:13]) % 97:02d}"


def _tax_id(text: str) -> str:
    """ISO 7064, modulo 11 and 10."""
    p = 10
    for c in text[:10]:
        s = (int(c) + p) % 10 or 10
        p = s * 2 % 11
    return text[:10] + str((11 - p) % 10)


def _luhn(text: str) -> str:
    total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(text[:-1]))))
    return text[:-1] + str(-total % 10)


def _iban(text: str) -> str:
    number = "".join(str(int(c, 36)) for c in text[4:] + text[:2] + "00")
    return text[:2] + f"{98 - int(number) % 97:02d}" + text[4:]


def _same(text: str) -> str:
    return text


def _ssn(text: str) -> list[str] | None:
    """Area 001 to 899 but not 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = int(text[:3]), int(text[3:5]), int(text[5:])
    return [text] if area in range(1, 900) and area != 666 and group and serial else None


#: Formats of validated numbers: pattern of the bare text, places, and what makes the check characters right.
_MONTHS = [f"{m:02d}" for m in range(1, 13)]
FORMATS = {
    "dni": (r"\d{8}[A-Z]", lambda t: [_DIGITS] * 8, _dni),
    "nie": (r"[XYZ]\d{7}[A-Z]", lambda t: ["XYZ", *[_DIGITS] * 7], _dni),
    # sex, year, month, place: the month stays a month
    "nir": (r"[12]\d{2}(?:0[1-9]|1[0-2])\d{10}", lambda t: ["12", _DIGITS, _DIGITS, _MONTHS, *[_DIGITS] * 8], _nir),
    "tax_id": (r"[1-9]\d{10}", lambda t: [_FIRST, *[_DIGITS] * 9], _tax_id),
    "nino": (r"[A-Z]{2}\d{6}[A-D]", lambda t: [_LETTERS, _LETTERS, *[_DIGITS] * 6, "ABCD"], _same),
}


def _validated(text: str, key: bytes, kinds: dict = FORMATS) -> str | None:
    for kind, (pattern, places, check) in kinds.items():
        if re.fullmatch(pattern, text) and check(text) == text:
            own = places(text)
            parts, at = [], 0
            for chars in own:
                size = len(chars[0])
                parts.append(text[at : at + size])
                at += size
            return check(_within(parts, own, key, kind) + text[at:])
    if re.fullmatch(r"\d{9}", text) and _ssn(text):
        # walked on until the number is valid again: a permutation of the valid ones
        out = text
        while True:
            out = _within(out, [_DIGITS] * 9, key, "ssn")
            if _ssn(out):
                return out
    return None


def _laid(value: str, new: str) -> str:
    """The characters of `new` in the places of the letters and digits of `value`."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in value)


def _plain(text: str) -> str:
    """Digits of any script as ASCII."""
    return "".join(str(int(c)) if c.isdecimal() else c for c in text)


def identity_number(value: str, key: bytes) -> str:
    """A stand-in of the same format; spellings with other separators have the same letters and digits."""
    bare = _plain("".join(c for c in value if c.isalnum()))
    return _laid(value, _validated(bare, key) or _generic(bare, key, "id"))


# Calling codes of one and two digits; all others have three.
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def phone_number(value: str, key: bytes) -> str:
    """A stand-in that keeps the calling code and the trunk zero, and the number a valid one.

    Only the national number is permuted, so spellings with and without a
    calling code are linked; a number of ten digits keeps the first digits of
    its area and exchange from 2 to 9 where they are so.
    """
    m = re.search(r"(?:ext\.?|x|Ext\.|extension|Durchwahl|poste) ?\d{1,5}$", value)
    main, extra = (value[: m.start()], value[m.start() :]) if m else (value, "")
    digits = [(i, str(int(c))) for i, c in enumerate(main) if c.isdecimal()]
    text = "".join(d for _, d in digits)
    kept = 0
    international = main.lstrip().startswith("+") or text.startswith("00")
    if international:
        kept = 2 if text.startswith("00") else 0
        kept += next((len(c) for c in CALLING_CODES if text[kept:].startswith(c)), 3)
    elif len(text) == 11 and text[0] == "1":
        kept = 1
    while kept < len(text) - 2 and text[kept] == "0":
        kept += 1  # the trunk zero, in brackets or not
    own = text[kept:]
    places = [_FIRST if own[:1] in _FIRST and own else _DIGITS, *[_DIGITS] * (len(own) - 1)]
    if re.fullmatch(r"[2-9]\d{2}[2-9]\d{6}", own):
        places[0] = places[3] = "23456789"
    new = text[:kept] + _within(own, places, key, "phone")
    out = list(main)
    for (i, _), d in zip(digits, new):
        out[i] = d
    more = [i for i, c in enumerate(extra) if c.isdecimal()]
    if more:
        tail = list(extra)
        for i, d in zip(more, _within("".join(extra[i] for i in more), [_DIGITS] * len(more), key, "ext")):
            tail[i] = d
        extra = "".join(tail)
    return "".join(out) + extra


def payment_card(value: str, key: bytes) -> str | None:
    """A stand-in with a right check digit, of the same first digit; null if the number's own is wrong."""
    bare = _plain("".join(c for c in value if c.isalnum()))
    if not re.fullmatch(r"\d{13,19}", bare) or _luhn(bare) != bare:
        return None
    return _laid(value, _luhn(bare[0] + _within(bare[1:-1], [_DIGITS] * (len(bare) - 2), key, "card") + "0"))


def iban(value: str, key: bytes) -> str | None:
    """A stand-in of the same country with right check digits; null if the value's own are wrong."""
    bare = "".join(c for c in value if c.isalnum())
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", bare) or _iban(bare) != bare:
        return None
    return _laid(value, _iban(bare[:4] + _within(bare[4:], [_DIGITS if c in _DIGITS else _LETTERS for c in bare[4:]], key, "iban")))


#: Range in which dates are permuted.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
_DATES = [(r"(\d{4})([-/.])(\d{2})\2(\d{2})", (0, 2, 3)), (r"(\d{2})([-/.])(\d{2})\2(\d{4})", (3, 2, 0))]


def date(value: str, key: bytes, day_first: bool = True) -> str | None:
    """A stand-in day in the same spelling; null if there is no such day."""
    for pattern, (y, m, d) in _DATES:
        found = re.fullmatch(pattern, value)
        if found:
            parts = list(found.groups())
            if y == 3 and not day_first:
                m, d = d, m
            try:
                day = dt.date(int(parts[y]), int(parts[m]), int(parts[d]))
            except ValueError:
                return None
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            new = FIRST_DAY + dt.timedelta(permuted((day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, key, "date"))
            parts[y], parts[m], parts[d] = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
            return parts[0] + parts[1] + parts[2] + parts[1] + parts[3]
    return None
