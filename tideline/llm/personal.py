"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a whole text: at-signs, plus signs, digits, schemes and identifier cues. Each
anchor goes to one local parser, which expands it to the left and right, checks it, and says up to where it has read; later
anchors of that kind before this place are skipped, so the work follows the text's length. Offsets are code points, ends exclusive.

Base kinds, leftmost and non-overlapping, exactly the spans of their patterns (those that fail their check are dropped):

- email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
- ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
- card ``[0-9]([\\x20-]?[0-9])+`` with 16 to 19 digits that pass Luhn's check
- phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 8 to 15 digits

Added kinds, of which none lies inside a base span or overlaps another added one:

- mailbox: an address at an at-sign that is no base email: letters outside ASCII, a quoted local part, an address literal
  in square brackets. The domain needs a dot or a literal of four parts.
- login: user and password or token before the at-sign of a URL's authority, after a scheme (``https://user:word@host``)
- account: after a cue (IBAN, account, SSN and the like), an IBAN that passes modulo 97, a US social security number
  with allowed parts, or a run of 8 to 18 digits
- secret: after a cue (token, password, api key and the like) and ``=`` or ``:``, 12 or more characters with a letter and a digit

Cases: a null text is empty and has no spans; a null id stays; repeated rows are rows of their own; an empty table gives an
empty result; texts are read whole, one at a time. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mailbox", "login", "account", "secret")
#: Cues in lower case; they are also found in upper case and with a capital first letter.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "git://", "postgres://", "mysql://", "redis://", "amqp://", "mongodb://")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "social security", "konto", "cuenta", "compte", "passport", "tax id", "routing")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "private_key")
#: How far a value may lie behind its cue: quotes, blanks and a few signs or a short word such as "number" or "no".
_GAP = re.compile(r"(?:[\x20_]?(?:number|num|nr|no|id|key)\b)?\.?['\"]?[\x20\t]{0,3}(?:is[\x20])?[:=#]?[\x20\t]{0,3}['\"]?", re.I)
_SECRET_GAP = re.compile(r"['\"]?[\x20\t]{0,3}[:=][\x20\t]{0,3}['\"]?")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_LABEL, _DIGIT, _PHONE = re.compile(r"[A-Za-z0-9-]*"), re.compile(r"[0-9]*"), re.compile(r"[\x20().0-9-]*")
_SECRET = re.compile(r"[A-Za-z0-9_./+~-]*")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20]?[A-Za-z0-9]){11,30}")
_SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]*")
_QUOTED = re.compile(r"[^\"\r\n]{1,64}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    turned = (text[4:] + text[:4]).upper()
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Text:
    """The spans of one text; ``done`` says for each kind up to where it has been read."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        self.done = dict.fromkeys((*KINDS, "number"), 0)
        self.odd: list[int] = []

    def at_sign(self, at: int) -> None:
        text, first = self.text, at
        while first > self.done["email"] and text[first - 1] in _LOCAL:
            first -= 1
        if first < at:
            end = _LABEL.match(text, at + 1).end()
            dots = 0
            while end > at + 1 and end < self.n and text[end] == "." and (after := _LABEL.match(text, end + 1).end()) > end + 1:
                end, dots = after, dots + 1
            if dots:
                self.spans["email"].append((first, end))
                self.done["email"] = end
                return
        self.odd.append(at)

    def number(self, at: int) -> None:
        """Both readings of the digits at ``at``: parts joined by dots, and digits joined by single blanks or hyphens."""
        text = self.text
        if at >= self.done["ip"]:
            parts, end = [], at
            while True:
                stop = _DIGIT.match(text, end).end()
                parts.append((end, stop))
                end = stop
                if not (end + 1 < self.n and text[end] == "." and text[end + 1] in _DIGITS):
                    break
                end += 1
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or "0") <= 255 for a, b in four):
                    self.spans["ip"].append((four[0][0], four[3][1]))
            self.done["ip"] = end
        if at >= self.done["card"]:
            digits, end = 0, at
            while True:
                stop = _DIGIT.match(text, end).end()
                digits += stop - end
                end = stop
                if not (end + 1 < self.n and text[end] in " -" and text[end + 1] in _DIGITS):
                    break
                end += 1
            if 16 <= digits <= 19 and luhn(text[at:end].replace(" ", "").replace("-", "")):
                self.spans["card"].append((at, end))
            self.done["card"] = end

    def plus(self, at: int) -> None:
        text = self.text
        if at < self.done["phone"] or at + 1 >= self.n or text[at + 1] not in _DIGITS:
            return
        end = _PHONE.match(text, at + 2).end()
        while end > at + 3 and text[end - 1] not in _DIGITS:
            end -= 1
        if end <= at + 3:
            return
        self.done["phone"] = end
        if 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
            self.spans["phone"].append((at, end))

    def scheme(self, first: int, end: int) -> None:
        if end < self.done["login"]:
            return
        stop = _AUTHORITY.match(self.text, end).end()
        self.done["login"] = stop
        at = self.text.rfind("@", end, stop)
        if at > end and at + 1 < stop:
            self.spans["login"].append((end, at))

    def account(self, first: int, end: int) -> None:
        text = self.text
        if end < self.done["account"] or (first and text[first - 1].isalnum()) or (end < self.n and text[end].isalpha()):
            return
        at = _GAP.match(text, end).end()
        for found in (_IBAN.match(text, at), _SSN.match(text, at)):
            if found is None:
                continue
            value = found[0].replace(" ", "")
            if found.re is _SSN:
                area, group, serial = found.groups()
                good = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
            else:  # the longest prefix that is an IBAN, as words may follow
                end, good = found.end(), False
                while not good and len(value := text[at:end].replace(" ", "")) >= 15:
                    good = text[end - 1] != " " and not (end < self.n and text[end].isalnum()) and iban(value)
                    end -= not good
                found = (at, end)
            if good:
                stop = found[1] if isinstance(found, tuple) else found.end()
                return self._add("account", at, stop)
        stop = _DIGIT.match(text, at).end()
        if 8 <= stop - at <= 18 and not (stop < self.n and text[stop].isalpha()):
            self._add("account", at, stop)

    def secret(self, first: int, end: int) -> None:
        gap = _SECRET_GAP.match(self.text, end) if end >= self.done["secret"] else None
        if gap is None:
            return
        stop = _SECRET.match(self.text, gap.end()).end()
        value = self.text[gap.end() : stop].rstrip(".")
        if len(value) >= 12 and any(c.isalpha() for c in value) and any(c in _DIGITS for c in value):
            self._add("secret", gap.end(), gap.end() + len(value))

    def mailboxes(self) -> None:
        """At-signs that no base email holds, once those are known."""
        text, taken = self.text, self.spans["email"]
        starts = {at for a, b in taken for at in (text.find("@", a, b),)}
        logins, k = self.spans["login"], 0
        for at in self.odd:
            if at in starts or at < self.done["mailbox"]:
                continue
            while k < len(logins) and logins[k][1] < at:
                k += 1
            if k < len(logins) and logins[k][1] == at:
                continue
            least = max(self.done["mailbox"], 0)
            first = at
            if at and text[at - 1] == '"':
                first = text.rfind('"', max(least, at - 66), at - 1)
                if first < 0 or not _QUOTED.fullmatch(text, first + 1, at - 1):
                    continue
            else:
                while first > least and (text[first - 1] in _LOCAL or text[first - 1].isalnum()):
                    first -= 1
                while first < at and text[first] in ".-":
                    first += 1
            if first == at:
                continue
            if at + 1 < self.n and text[at + 1] == "[":
                close = text.find("]", at, at + 20)
                parts = text[at + 2 : close].split(".") if close > 0 else []
                if len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in parts):
                    self._add("mailbox", first, close + 1)
                continue
            end = at + 1
            while end < self.n and (text[end].isalnum() or text[end] in "-."):
                end += 1
            self.done["mailbox"] = end
            while end > at + 1 and text[end - 1] in "-.":
                end -= 1
            labels = text[at + 1 : end].split(".")
            if len(labels) > 1 and all(labels):
                self._add("mailbox", first, end)

    def _add(self, kind: str, first: int, end: int) -> None:
        self.spans[kind].append((first, end))
        self.done[kind] = end

    def result(self) -> dict[str, list[tuple[int, int]]]:
        """All spans by kind; added ones inside a base span, or that overlap an added one before, go."""
        self.mailboxes()
        base = sorted(s for k in BASE for s in self.spans[k])
        reach, k, last = 0, 0, 0
        added = sorted((first, end, kind) for kind in KINDS if kind not in BASE for first, end in self.spans[kind])
        kept: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS if kind not in BASE}
        for first, end, kind in added:
            while k < len(base) and base[k][0] <= first:
                reach = max(reach, base[k][1])
                k += 1
            if reach < end and last <= first:
                kept[kind].append((first, end))
                last = end
        return {kind: self.spans[kind] if kind in BASE else kept[kind] for kind in KINDS}


@cache
def anchors():
    """The automaton of all anchors: (parser, length)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign, parser in (("@", "at_sign"), ("+", "plus"), *((d, "number") for d in sorted(_DIGITS))):
        found.add_word(sign, (parser, 1))
    for parser, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (parser, len(form)))
    found.make_automaton()
    return found


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind of one text."""
    out = Text(text)
    done = out.done
    for last, (parser, n) in anchors().iter(text):
        if parser == "number":
            if last >= done["ip"] or last >= done["card"]:
                out.number(last)
        elif n == 1:
            getattr(out, parser)(last)
        else:
            getattr(out, parser)(last + 1 - n, last + 1)
    return out.result()


def joined(found: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


def find_personal(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_<kind> for each kind, spans (kind:start:end by kind, then start), base_sha256 of those of the base kinds."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [spans(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), *[pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS],
                        pa.array([hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found]), pa.array([joined(f) for f in found]),
                    ],
                    [key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {counts}, base_sha256 string, spans string")
