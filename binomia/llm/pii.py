"""PII: an Aho-Corasick automaton finds anchors, local parsers expand them to personal data.

The automaton stops at at-signs, schemes, plus signs, digits and identifier cues. Each anchor is
expanded to the left and right by a deterministic parser of its kind, which validates the boundaries:
emails around an at-sign, dotted, card and phone numbers around digits, and the values that stand
behind a cue or a scheme (accounts, keys, passwords, user parts of addresses, streets).

The base kinds (email, ip, card, phone) equal the leftmost non-overlapping matches of the patterns in
`base_patterns`; matches that fail their check are dropped and nothing inside them is tried again. The
other kinds come on top: `url` (address with a user part or a query), `iban`, `account` (a number behind
a cue), `secret` (a key or password), `street`.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import regex
from pyspark.sql import DataFrame

from binomia.llm.common import map_batches, needed

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret", "street")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGITS = frozenset("0123456789")
_PHONE = frozenset(" ().0123456789-")
_SMALL = frozenset("abcdefghijklmnopqrstuvwxyz")

#: The base kinds as patterns (fixed values), for checks.
base_patterns = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Cue words, lower case, and what stands behind them.
CUES = {
    "account": ("account", "acct", "passport", "ssn", "social security", "tax id", "konto", "compte", "cuenta"),
    "secret": ("password", "passwd", "pwd", "secret", "api_key", "apikey", "token"),
    "street": (" street", " avenue", " road", "strasse", "straße", " rue ", " calle "),
}
_AFTER_ACCOUNT = regex.compile(r"(?:\s*(?:number|no\.?|nr\.?|#|is|:|=))*\s*([A-Z]{0,3}[0-9][0-9A-Z-]{4,24})\b")
_AFTER_SECRET = regex.compile(r"\s*[:=]\s*[\"']?([^\s\"'<>]{6,})")
_KEY = regex.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{30,}")
#: Lengths of account numbers by country (fixed values of the public registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}
#: Account numbers of other countries, whose length is not known.
_IBAN = regex.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_URL = regex.compile(r"[^\s<>\"']+")
_STREET_NUMBER = regex.compile(r"\s{0,2}[0-9]{1,5}[a-z]?\b")
#: Words a street's name may have between its number and the cue.
_STREET_WORDS = 4
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
_KEY_STARTS = ("AKIA", "ASIA", "sk-", "ghp_")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in ("@", "+", *"0123456789"):
        found.add_word(sign, (sign if sign in "@+" else "0", 1))
    found.add_word("://", ("://", 3))
    for start in _KEY_STARTS:
        found.add_word(start.lower(), ("key", len(start)))
    for kind, words in CUES.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


class Finder:
    """Spans of personal data in a text: (start, kind, end), by start and then kind as listed."""

    def __init__(self):
        self.anchors = automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        emails = cards = ips = phones = 0  # where the next match of the kind may begin
        size = len(text)

        def add(kind: str, start: int, end: int) -> None:
            out.append((start, KINDS.index(kind), end))

        # anchors are lower case; only A-Z change, so places stay
        for last, (kind, length) in self.anchors.iter(text.lower() if text.isascii() else text.translate(_LOWER)):
            at = last - length + 1
            if kind == "0":
                if at >= cards:
                    end, digits = at + 1, [text[at]]
                    while end < size:
                        step = 1 if text[end] in " -" and end + 1 < size else 0
                        if text[end + step] not in _DIGITS:
                            break
                        digits.append(text[end + step])
                        end += step + 1
                    cards = end
                    if 12 <= len(digits) <= 19 and _luhn("".join(digits)):
                        add("card", at, end)
                if at >= ips:
                    ips = self._dotted(text, at, add)
                if at >= 2 and text[at - 1].isupper() and text[at - 2].isupper():
                    self._iban_at(text, at - 2, add)
            elif kind == "@":
                start = at
                while start > emails and text[start - 1] in _LOCAL:
                    start -= 1
                end = self._host(text, at + 1) if start < at else 0
                if end:
                    add("email", start, end)
                    emails = end
            elif kind == "+":
                if at >= phones and at + 1 < size and text[at + 1] in _DIGITS:
                    end = at + 2
                    while end < size and text[end] in _PHONE:
                        end += 1
                    while end > at + 3 and text[end - 1] not in _DIGITS:
                        end -= 1
                    if end > at + 3 and text[end - 1] in _DIGITS:
                        phones = end
                        if 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                            add("phone", at, end)
            elif kind == "://":
                self._url(text, at, add)
            elif kind == "key":
                if (m := _KEY.match(text, at)) and not (at and text[at - 1].isalnum()):
                    add("secret", at, m.end())
            elif kind == "secret":
                if m := _AFTER_SECRET.match(text, last + 1):
                    add("secret", m.start(1), m.end(1))
            elif kind == "account":
                if m := _AFTER_ACCOUNT.match(text, last + 1):
                    add("account", m.start(1), m.end(1))
            elif kind == "street":
                self._street(text, at, last + 1, add)
        return sorted(set(out))

    @staticmethod
    def _host(text: str, at: int) -> int:
        """End of a host name with a dot at `at`; 0 if there is none."""
        end, labels, size = at, 0, len(text)
        while True:
            stop = end
            while stop < size and text[stop] in _HOST:
                stop += 1
            if stop == end:
                return end - 1 if labels > 1 else 0
            labels += 1
            if stop >= size or text[stop] != ".":
                return stop if labels > 1 else 0
            end = stop + 1

    @staticmethod
    def _dotted(text: str, at: int, add) -> int:
        """Parse a chain of dotted numbers that begins at `at`; every four of them are one match."""
        parts, size, start = [], len(text), at
        while True:
            stop = start
            while stop < size and text[stop] in _DIGITS:
                stop += 1
            if stop == start:
                break
            parts.append((start, stop))
            if stop >= size or text[stop] != ".":
                break
            start = stop + 1
        for k in range(0, len(parts) - 3, 4):
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in parts[k : k + 4]):
                add("ip", parts[k][0], parts[k + 3][1])
        return parts[-1][1]

    @staticmethod
    def _iban_at(text: str, start: int, add) -> None:
        if start and text[start - 1].isalnum():
            return
        length = IBAN_LENGTHS.get(text[start : start + 2])
        if length is None:
            m = _IBAN.match(text, start)
            if m and _iban(m.group()):
                add("iban", start, m.end())
            return
        end, plain, size = start, "", len(text)
        while len(plain) < length:
            step = 1 if end < size and text[end] == " " and plain and len(plain) % 4 == 0 else 0
            sign = text[end + step : end + step + 1]
            if not (sign.isascii() and (sign.isdigit() or sign.isupper())):
                return
            plain += sign
            end += step + 1
        if not text[end : end + 1].isalnum() and _iban(plain):
            add("iban", start, end)

    @staticmethod
    def _url(text: str, at: int, add) -> None:
        start = at
        while start > 0 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
            start -= 1
        m = _URL.match(text, at + 3)
        if start < at and m:
            rest = m.group().rstrip(".,;:!?)")
            if "@" in rest.split("/")[0] or "?" in rest:
                add("url", start, at + 3 + len(rest))

    @staticmethod
    def _street(text: str, at: int, end: int, add) -> None:
        start = Finder._number_before(text, at)
        if start >= 0:
            add("street", start, end)
        elif after := _STREET_NUMBER.match(text, end):
            start = at
            while start > 0 and text[start - 1].isalpha():
                start -= 1
            add("street", start, after.end())

    @staticmethod
    def _number_before(text: str, at: int) -> int:
        """Start of a house number that capital words, as long as they may be, part from `at`; -1 without."""
        start = at
        for _ in range(_STREET_WORDS):
            stop = start - 1 if start and text[start - 1].isspace() else start
            start = stop
            while start and (text[start - 1].isalpha() or text[start - 1] in "'.-"):
                start -= 1
            if start == stop or not text[start].isupper():
                return -1
            stop = start - 1
            if stop > 0 and text[stop] == " ":
                if text[stop - 1] in _SMALL:
                    stop -= 1
                number = stop
                while number and text[number - 1] in _DIGITS:
                    number -= 1
                if 1 <= stop - number <= 5 and not (number and (text[number - 1].isalnum() or text[number - 1] == "_")):
                    return number
        return -1


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every row of docs (doc_id, text), and the text with them masked.

    n_email, n_ip, n_card, n_phone count the base kinds; base_sha256 is the hash of the base spans,
    spans lists all of them (code points, end exclusive). Null and empty texts have no spans (a null
    stays null when masked). Every row gives one row; other columns are ignored; texts of any length
    are read whole; an empty table gives an empty one.
    """

    def found(batch, finder):
        out: dict[str, list] = {"n_email": [], "n_ip": [], "n_card": [], "n_phone": [], "base_sha256": [], "spans": [], "masked": []}
        for value in batch.column("text"):
            text = value.as_py()
            spans = finder.spans(text) if text else []
            for k, kind in enumerate(KINDS[:4]):
                out[f"n_{kind}"].append(sum(s[1] == k for s in spans))
            out["base_sha256"].append(hashlib.sha256(joined([s for s in spans if s[1] < 4]).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["masked"].append(masked(text, spans) if spans else text)
        yield {"doc_id": batch.column("doc_id"), **out}

    return map_batches(
        needed(docs, "doc_id", "text"),
        found,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string",
        start=Finder,
    )
