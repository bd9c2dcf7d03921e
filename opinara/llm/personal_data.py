"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, schemes, account cues, names of secrets,
plus signs and digits. Small deterministic parsers grow an anchor to both sides and validate what they found.
Every parser yields spans from left to right that do not overlap within their kind; a span that
fails its check is dropped and not tried again in parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opinara.llm.common import give_back, id_and_text, in_parts

# Kinds in the order in which spans with one start are listed. The first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE_KINDS = KINDS[:4]

# Anchors of the automaton.
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://", "FTP://")
ACCOUNT_CUES = ("IBAN", "iban", "Iban", "SSN", "ssn", "account", "Account", "ACCOUNT")
SECRET_CUES = tuple(
    form for name in ("token", "secret", "api_key", "apikey", "access_key", "private_key", "password", "passwd")
    for form in (name, name.capitalize(), name.upper())
)
# Two digits with at most one sign between them: every address, card and telephone number has some.
_DIGITS = "0123456789"
_PAIRS = tuple(a + sign + b for a in _DIGITS for sign in ("", " ", "-", ".") for b in _DIGITS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_NUMBER = frozenset(_DIGITS)
_DIAL = frozenset(" ().-" + _DIGITS)
_URL_END = frozenset(" \t\n\r\v\f<>\"'`{}|\\^")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

Span = tuple[int, int]


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (
        ("at", ("@",)), ("plus", ("+",)), ("scheme", SCHEMES), ("cue", ACCOUNT_CUES),
        ("secret", SECRET_CUES), ("digits", _PAIRS),
    ):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _run_end(text: str, start: int, allowed: frozenset[str]) -> int:
    end, n = start, len(text)
    while end < n and text[end] in allowed:
        end += 1
    return end


def _run_start(text: str, end: int, least: int, allowed: frozenset[str]) -> int:
    start = end
    while start > least and text[start - 1] in allowed:
        start -= 1
    return start


def emails(text: str, signs: list[int]) -> Iterator[Span]:
    """Grow each at-sign to a local part and a host of two labels or more."""
    least = 0
    for at in signs:
        if at < least:
            continue
        start = _run_start(text, at, least, _LOCAL)
        end = _run_end(text, at + 1, _HOST)
        if start == at or end == at + 1:
            continue
        labels = 0
        while end < len(text) and text[end] == "." and (more := _run_end(text, end + 1, _HOST)) > end + 1:
            end, labels = more, labels + 1
        if labels:
            yield start, end
            least = end


def addresses(text: str, places: list[int]) -> Iterator[Span]:
    """Grow a digit to four numbers joined by dots; none may exceed 255."""
    least = 0
    for place in places:
        if place < least:
            continue
        start = _run_start(text, place, least, _NUMBER)
        end = _run_end(text, place, _NUMBER)
        parts = [text[start:end]]
        while len(parts) < 4 and text[end:end + 1] == "." and (more := _run_end(text, end + 1, _NUMBER)) > end + 1:
            parts.append(text[end + 1:more])
            start, end, least = start, more, more
        # A chain of fewer numbers cannot start an address anywhere inside it.
        least = end
        if len(parts) == 4 and all(_at_most(p, 255) for p in parts):
            yield start, end


def _at_most(number: str, most: int) -> bool:
    number = number.lstrip("0")
    return len(number) <= len(str(most)) and int(number or 0) <= most


def cards(text: str, places: list[int]) -> Iterator[Span]:
    """Grow a digit to a run of digits with single blanks or hyphens; 12 to 19 digits, Luhn."""
    least, n = 0, len(text)
    for place in places:
        if place < least:
            continue
        # The sign of a pair may belong to another run, so the start is looked for afresh.
        start = place
        while start > least and (
            text[start - 1] in _NUMBER
            or (text[start - 1] in " -" and start - 1 > least and text[start - 2] in _NUMBER)
        ):
            start -= 1 if text[start - 1] in _NUMBER else 2
        end = start + 1
        while end < n and (
            text[end] in _NUMBER or (text[end] in " -" and end + 1 < n and text[end + 1] in _NUMBER)
        ):
            end += 1 if text[end] in _NUMBER else 2
        least = end
        digits = text[start:end].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, character in enumerate(reversed(digits)):
        value = int(character) << (i & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def phones(text: str, signs: list[int]) -> Iterator[Span]:
    """Grow each plus sign to the last digit of a run of dial characters; 9 to 15 digits."""
    least = 0
    for plus in signs:
        if plus < least or text[plus + 1:plus + 2] not in _NUMBER or plus + 1 >= len(text):
            continue
        end = _run_end(text, plus + 2, _DIAL)
        while end > plus + 2 and text[end - 1] not in _NUMBER:
            end -= 1
        # One dial character and a last digit must follow the first digit.
        if end < plus + 4:
            continue
        least = end
        if 9 <= sum(c in _NUMBER for c in text[plus:end]) <= 15:
            yield plus, end


def urls(text: str, schemes: list[Span]) -> Iterator[Span]:
    """Grow a scheme to the next character that no URL holds, without a closing sign."""
    least = 0
    for start, end in schemes:
        if start < least:
            continue
        last, n = end, len(text)
        while last < n and text[last] not in _URL_END:
            last += 1
        while last > end and text[last - 1] in ".,;:!?)]":
            last -= 1
        if last > end and text[end] in _HOST:
            yield start, last
            least = last


def accounts(text: str, cues: list[Span]) -> Iterator[Span]:
    """Grow the number that follows a cue: an IBAN with its check digits, or 6 to 18 digits.

    Between cue and number there may be up to 12 characters of blanks, signs and "no".
    """
    least = 0
    for start, end in cues:
        if start < least or (start and text[start - 1] in _WORD) or text[end:end + 1] in _WORD and end < len(text):
            continue
        found = _AFTER_CUE.match(text, end)
        if not found:
            continue
        first, last = found.span(1)
        value = text[first:last].replace(" ", "").replace("-", "")
        if iban(value) or (value.isdigit() and 6 <= len(value) <= 18):
            yield first, last
            least = last


_AFTER_CUE = re.compile(
    r"[ :#.]{0,6}(?:(?:no|No|number|nr)[ :#.]{1,6})?"
    r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])|[0-9](?:[ -]?[0-9]){5,17}(?![A-Za-z0-9]))"
)


def iban(value: str) -> bool:
    """Country, check digits and remainder 1 of 97."""
    if not (15 <= len(value) <= 34 and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def secrets(text: str, cues: list[Span]) -> Iterator[Span]:
    """Grow the value that is given to a name such as token, api_key or password.

    Name and value are joined by an equals sign or a colon. The value has at least 16 characters of
    the usual codes, letters and digits among them; a password in quotes may be any 6 to 64, but
    not a kind in brackets, as `redact` writes it.
    """
    least = 0
    for start, end in cues:
        if start < least or start and text[start - 1] in _WORD and text[start].islower():
            continue
        found = _AFTER_NAME.match(text, end)
        if found:
            first, last = found.span("code")
            value = text[first:last]
            good = last - first >= 16 and not (value.isalpha() or value.isdigit())
        if not found or not good:
            found = text[start:end].lower().startswith("passw") and _AFTER_PASSWORD.match(text, end)
            if not found:
                continue
            first, last = found.span("any")
        yield first, last
        least = last


_GIVEN = r"[A-Za-z_]{0,16}[\"']?[ \t]{0,4}[:=][ \t]{0,4}"
_AFTER_NAME = re.compile(_GIVEN + r"[\"']?(?P<code>[A-Za-z0-9_+/.-]+(?<![.])={0,2})")
_AFTER_PASSWORD = re.compile(_GIVEN + r"(?P<quote>[\"'])(?P<any>(?!\[[A-Z]+\])[^\s\"']{6,64})(?P=quote)")


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and then kind; ends are exclusive code points."""
    places: dict[str, list[Span]] = {"at": [], "plus": [], "scheme": [], "cue": [], "secret": [], "digits": []}
    for last, (kind, length) in _automaton().iter(text):
        places[kind].append((last - length + 1, last + 1))
    if not any(places.values()):
        return []
    digits = sorted({start for start, _ in places["digits"]})
    found = (
        emails(text, [s for s, _ in places["at"]]),
        addresses(text, digits),
        cards(text, digits),
        phones(text, [s for s, _ in places["plus"]]),
        urls(text, sorted(places["scheme"])),
        accounts(text, sorted(places["cue"])),
        secrets(text, sorted(places["secret"])),
    )
    spans = [(kind, *span) for kind, own in zip(KINDS, found) for span in own]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_data(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row `doc_id` and `spans`: array of (kind, start, end) over the whole text.

    A null or empty text has no spans, repeated rows and null ids give a row each, an empty
    table none. Texts never leave their partition.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, _SPAN_ARROW)], ["doc_id", "spans"]
            )

    return id_and_text(df, id_column, text_column).mapInArrow(run, f"doc_id bigint, spans {_SPAN}")


def listed(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; spans that touch become one."""
    out, done = [], 0
    for kind, start, end in find_spans(text):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, text_column: str = "text") -> DataFrame:
    """All rows and columns, the text without personal data; a null text stays null."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        found = texts.map(redact_text, na_action="ignore")
        give_back()
        return found

    return df.withColumn(text_column, redacted(F.col(text_column)))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """Digest of the base spans as the contract words them, for checks."""
    base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE_KINDS)
    return hashlib.sha256(base.encode()).hexdigest()
