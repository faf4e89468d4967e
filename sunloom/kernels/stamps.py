"""Stamps in mixed formats to numbers, by their shapes: NumPy over a batch of texts.

Every character becomes its class (digits 9, letters A, others themselves), which gives
the stamp's shape mask.  A mask fixes where each field stands, so each distinct mask is
matched once against the families of formats, and all stamps of a mask are converted by
slices of one matrix of characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Longest text, in bytes, that can be a stamp.
LONGEST = 64
_FRACTION, _ZONE = r"(?:[.,](?P<fraction>9{1,9})9{0,9})?", r"(?: ?(?P<zone>A{1,5}|[+-]99:?99))?"
_TIME = r"(?P<hour>9{1,2}):(?P<minute>99)(?::(?P<second>99)" + _FRACTION + ")?"
#: Families of formats as patterns of masks.
FAMILIES = (
    ("iso", r"(?P<year>9999)-(?P<month>99)-(?P<day>99)(?P<t>[A ])" + _TIME + _ZONE),
    ("iso", r"(?P<year>9999)(?P<month>99)(?P<day>99)(?P<t>[A ])(?P<hour>99)(?P<minute>99)(?P<second>99)?" + _FRACTION + _ZONE),
    ("ordinal", r"(?P<year>9999)-(?P<ordinal>999)(?P<t>[A ])" + _TIME + _ZONE),
    ("slash", r"(?P<month>9{1,2})/(?P<day>9{1,2})/(?P<year>9999) " + _TIME + r"(?: ?(?P<half>AA))?"),
    ("iso", r"(?P<day>9{1,2})\.(?P<month>9{1,2})\.(?P<year>9999) " + _TIME + _ZONE),
    ("named", r"(?P<day>9{1,2})-(?P<name>AAA)-(?P<year>99|9999) " + _TIME + _ZONE),
    ("named", r"(?:AAA, )?(?P<day>9{1,2}) (?P<name>AAA) (?P<year>9999) " + _TIME + _ZONE),
    ("days", r"(?P<whole>9{5})(?:\.(?P<part>9{1,18}))?"),
    ("epoch", r"(?P<epoch>9{9,10}|9{12,13}|9{15,16}|9{18,19})"),
)
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Zone names that mean UTC itself.
UTC_NAMES = ("Z", "UTC", "GMT", "UT")
DAY_MS = 86_400_000
#: First day of the count of days, 1899-12-30, before 1970.
DAYS_TO_1970 = 25_569

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = ord("A")
_WEIGHTS = np.random.default_rng(1).integers(1, 2**62, LONGEST, dtype=np.uint64) | np.uint64(1)
_DAYS_IN_MONTH = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


@dataclass(frozen=True)
class Parser:
    """What a mask says: its family and where its fields stand."""

    family: str
    at: dict[str, tuple[int, int]]


def parser_of(mask: str) -> Parser | None:
    """The parser of a mask, or None where no family fits."""
    for family, pattern in FAMILIES:
        if m := re.fullmatch(pattern, mask):
            return Parser(family, {k: m.span(k) for k, v in m.groupdict().items() if v is not None})
    return None


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the texts' bytes, 0 beyond their ends, and which texts are short enough to be in it."""
    texts = texts.cast(pa.string())
    n = len(texts)
    if n == 0:
        return np.zeros((0, 1), np.uint8), np.zeros(0, bool)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, texts.offset * 4).astype(np.int64)
    lengths = np.diff(at)
    ok = (lengths > 0) & (lengths <= LONGEST)
    if texts.null_count:
        ok &= texts.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(ok, lengths, 0)
    out = np.zeros((n, max(int(lengths.max()), 1)), np.uint8)
    total = int(lengths.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = np.repeat(np.arange(n), lengths)
        out[rows, within] = np.frombuffer(data, np.uint8)[np.repeat(at[:-1], lengths) + within]
    return out, ok


def shapes(chars: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct masks of the rows, and the number of each row's mask."""
    masks = _CLASS[chars]
    # Rows by a sum of weighted classes; should two masks have one sum, by the masks themselves.
    sums = masks.astype(np.uint64) @ _WEIGHTS[: masks.shape[1]]
    _, first, which = np.unique(sums, return_index=True, return_inverse=True)
    if not (masks == masks[first[which]]).all():
        _, first, which = np.unique(masks, axis=0, return_index=True, return_inverse=True)
    return [masks[i].tobytes().rstrip(b"\0").decode("latin-1") for i in first], which.ravel()


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for c in range(*span):
        out = out * 10 + (chars[:, c] - np.uint8(48))
    return out


def _letters(chars: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct upper-case texts of a span, and each row's number among them."""
    part = np.ascontiguousarray(chars[:, span[0] : span[1]])
    part = np.where((part >= 97) & (part <= 122), part - 32, part).astype(np.uint8)
    names, which = np.unique(np.ascontiguousarray(part).view(f"S{part.shape[1]}").ravel(), return_inverse=True)
    return np.array([x.decode("latin-1") for x in names], object), which


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of a date, and whether it exists."""
    m = np.clip(month, 1, 12)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = _DAYS_IN_MONTH[m - 1] + (leap & (m == 2))
    first = ((np.clip(year, 1, 9999) - 1970) * 12 + m - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + day - 1, (month == m) & (day >= 1) & (day <= longest) & (year >= 1)


def _clock(chars: np.ndarray, parser: Parser) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(ms of the clock, whether it is a time, the same with day and month exchanged, whether that is one, hint of the order)."""
    at = parser.at
    n = len(chars)
    zero = np.zeros(n, np.int64)
    hour, minute = _number(chars, at["hour"]), _number(chars, at["minute"])
    second = _number(chars, at["second"]) if "second" in at else zero
    ok = (minute < 60) & (second < 60)
    if "t" in at:
        mark = chars[:, at["t"][0]]
        ok &= (mark == ord("T")) | (mark == ord(" "))
    if "half" in at:
        names, which = _letters(chars, at["half"])
        half = np.select([names == "AM", names == "PM"], [0, 12], -1)[which]
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.maximum(half, 0)
    ok &= hour < 24
    fraction = zero
    if "fraction" in at:
        a, b = at["fraction"]
        fraction = (_number(chars, at["fraction"]) * 10 ** (9 - (b - a)) + 500_000) // 1_000_000
    of_day = ((hour * 60 + minute) * 60 + second) * 1000 + fraction
    year = _number(chars, at["year"])
    if at["year"][1] - at["year"][0] == 2:
        year = year + 2000
    if "ordinal" in at:
        day = _number(chars, at["ordinal"])
        first, real = _days(year, np.ones(n, np.int64), np.ones(n, np.int64))
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        real &= (day >= 1) & (day <= 365 + leap)
        return (first + day - 1) * DAY_MS + of_day, ok & real, zero, np.zeros(n, bool), None
    day = _number(chars, at["day"])
    if "name" in at:
        names, which = _letters(chars, at["name"])
        month = np.array([MONTHS.index(x) + 1 if x in MONTHS else 0 for x in names])[which]
    else:
        month = _number(chars, at["month"])
    days, real = _days(year, month, day)
    if parser.family != "slash":
        return days * DAY_MS + of_day, ok & real, zero, np.zeros(n, bool), None
    other, other_real = _days(year, day, month)
    hint = np.where(month > 12, 1, 0) - np.where(day > 12, 1, 0)
    return days * DAY_MS + of_day, ok & real, other * DAY_MS + of_day, ok & other_real, hint


class Reader:
    """Reads batches of stamps; the parsers of the masks that it met are kept."""

    def __init__(self) -> None:
        self.parsers: dict[str, Parser | None] = {}

    def read(self, texts: pa.Array) -> dict[str, pa.Array]:
        """For each text: mask, family, clock and swapped (ms of the clock as written and with day and month exchanged), absolute (UTC ms where the
        stamp says it), abbr (abbreviation of a zone that is stated) and hint (1 or -1 where its numbers show that the day or the month comes first)."""
        n = len(texts)
        chars, short = characters(texts)
        masks, which = shapes(chars)
        values = {c: np.zeros(n, np.int64) for c in ("clock", "swapped", "absolute", "hint")}
        known = {c: np.zeros(n, bool) for c in ("clock", "swapped", "absolute")}
        abbr = np.full(n, None, object)
        order = np.argsort(which, kind="stable")
        ends = np.cumsum(np.bincount(which, minlength=len(masks)))
        families: list[str | None] = []
        for k, mask in enumerate(masks):
            if mask not in self.parsers:
                self.parsers[mask] = parser_of(mask)
            parser = self.parsers[mask]
            families.append(parser and parser.family)
            if parser is None:
                continue
            rows = order[ends[k - 1] if k else 0 : ends[k]]
            part = chars[rows]
            if parser.family == "epoch":
                values["absolute"][rows], known["absolute"][rows] = self._epoch(part, parser), True
            elif parser.family == "days":
                values["clock"][rows], known["clock"][rows] = self._days(part, parser), True
            else:
                clock, ok, other, other_ok, hint = _clock(part, parser)
                if hint is not None:
                    values["swapped"][rows], known["swapped"][rows], values["hint"][rows] = other, other_ok, hint
                if "zone" not in parser.at:
                    values["clock"][rows], known["clock"][rows] = clock, ok
                    continue
                a, b = parser.at["zone"]
                if mask[a] != "A":
                    hours, minutes = _number(part, (a + 1, a + 3)), _number(part, (b - 2, b))
                    sign = np.where(part[:, a] == ord("-"), -1, 1)
                    values["absolute"][rows], known["absolute"][rows] = clock - sign * (hours * 60 + minutes) * 60_000, ok
                    continue
                names, at = _letters(part, (a, b))
                utc = np.array([x in UTC_NAMES for x in names])[at]
                values["absolute"][rows], known["absolute"][rows] = clock, ok & utc
                values["clock"][rows], known["clock"][rows] = clock, ok & ~utc
                abbr[rows] = np.where(utc, None, names[at])
        text = lambda names: pa.DictionaryArray.from_arrays(pa.array(np.where(short, which, 0), pa.int32(), mask=~short), pa.array(names, pa.string())).cast(pa.string())
        out = {"mask": text(masks), "family": text(families)}
        out |= {c: pa.array(values[c], pa.int64(), mask=~known[c]) for c in known}
        return out | {"abbr": pa.array(abbr, pa.string()), "hint": pa.array(values["hint"], pa.int32())}

    @staticmethod
    def _epoch(chars: np.ndarray, parser: Parser) -> np.ndarray:
        """ms since 1970 of a count of seconds, milli-, micro- or nanoseconds."""
        a, b = parser.at["epoch"]
        if b - a <= 10:
            return _number(chars, (a, b)) * 1000
        if b - a <= 13:
            return _number(chars, (a, b))
        unit = 1000 if b - a <= 16 else 1_000_000
        digits = 3 if unit == 1000 else 6
        return _number(chars, (a, b - digits)) + (_number(chars, (b - digits, b)) >= unit // 2)

    @staticmethod
    def _days(chars: np.ndarray, parser: Parser) -> np.ndarray:
        whole = (_number(chars, parser.at["whole"]) - DAYS_TO_1970) * DAY_MS
        if "part" not in parser.at:
            return whole
        a, b = parser.at["part"]
        return whole + np.floor(_number(chars, (a, b)) / 10.0 ** (b - a) * DAY_MS + 0.5).astype(np.int64)
