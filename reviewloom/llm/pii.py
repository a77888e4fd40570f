"""Personal values in free text: finding them by anchor expansion, and replacing them with typed placeholders.

One pass of an Aho-Corasick automaton over the lower-cased text finds anchors: at-signs in all spellings, digits, address
designators, cues of names, and known name parts. A local parser for each kind of anchor then looks at the neighbourhood,
expands to the boundaries of the value, however far they are, and validates it: numbers by their shape, by the cue before
them and by check digits (cards, twelve-digit identities, bank account numbers), names by what is known of them, by the cue,
by what follows and by their capitals. A name found in one text of a row is one in the row's other texts, where the capitals
may be gone. Where values overlap, the order is email, address, id, phone, name; nothing inside a value is another one.

Amounts, dates, times, versions, builds, error codes, handles and existing placeholders are no values. Null and empty texts
have none. Positions count code points from 0. Whole texts are read, however long.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.staging import spread

KINDS = ("email", "address", "id", "phone", "name")
#: The list of known names is sent to every worker; a longer one than this is refused.
MAX_NAMES = 100_000

# Cues and designators, and name parts that are ordinary words as well.
AT = ("@", "(at)", "[at]", "{at}", " at ", " (at) ", " [at] ")
DESIGNATORS = ("flat ", "flat no", "plot ", "h.no", "h. no", "hno", "house no", "house ", "door no", "d.no", "p.o. box", "p.o.box", "po box", "p.o box", "post box", "apartment ", "apt ", "room no", "shop no", "block ", "villa ")
WAYS = (" street", " road", " lane", " cross", " avenue", " marg")
ORDINARY = frozenset("sunny hope grace joy rose amber frank summer may june april august".split())
RELATIVES = "wife|husband|brother|sister|son|daughter|father|mother|dad|mom|friend|colleague|uncle|aunt|cousin|neighbour|neighbor|boss|manager"
NOT_NAMES = frozenset("not a an the my your our his her its it is was and or so no all very here there this that now still just amazing happy sad worried frustrated disappointed tired losing using done new old good bad best worst user customer trader support team me us them everyone anyone someone".split())

ROLES = "agent executive officer advisor adviser representative manager supervisor nominee holder beneficiary trainer technician".split()
TITLES = "mr mrs ms miss dr prof shri smt sri".split()
#: What goes on after a name: verbs, and words that begin another phrase.
_GOES_ON = r" (?:told|said|says|was|is|has|had|helped|called|calls|asked|promised|confirmed|replied|answered|refused|twice|about|yesterday|today|tomorrow|again|here|from|who|by the way)\b"
_CLAUSE_ENDS = r"\s*[.,!?;\n]|\s*$"
#: Cues after which a word in capitals that isn't the first of its sentence is a name if it is two words, or the phrase goes on as above.
SHAPE_CUES = (
    "name is ", "name's ", "i am ", "i'm ", "this is ", "spoke to ", "spoke with ", "talked to ", "contact ", "contacted ", "ask ", "ask for ", "called by ", "named ", "signed ", "regards, ", "regards ", "thanks, ",
    *(f"{r} " for r in ROLES), *(f"{t} " for t in TITLES), *(f"{t}. " for t in TITLES), *(f"my {r} " for r in RELATIVES.split("|")),
)
#: After these a single word must be followed by a phrase that goes on: what ends there may be any word.
WEAK_CUES = ("i am ", "i'm ", "this is ", "contact ")
#: Capitals that begin no name after such a cue.
PRODUCTS = frozenset("app apps support team customer care service services store play google apple android ios bank fund funds mutual sip kyc upi otp nav nse bse sebi demat trading india indian english hindi monday tuesday wednesday thursday friday saturday sunday january february march july september october november december".split())

# Cues of names: what stands before, and what must follow unless a known name follows the cue. None: the cue is enough.
NAME_CUES: tuple[tuple[str, str | None], ...] = (
    ("name is ", r" and i (?:need|have|want)\b|[.,!?\n]|$"),
    ("in the name of ", r"[.,!?\n]|\s*$|\s[.!?]|\s[^\W\d_]"),
    ("i am ", r" and i have\b"),
    ("i'm ", r" by the way\b"),
    ("this is ", r" here\b"),
    ("agent ", r" told me\b"),
    ("executive ", r" told me\b"),
    ("nominee ", r" was (?:removed|deleted|changed)\b"),
    ("ask ", r", (?:he|she|they) saw\b"),
    ("mr. ", None),
    ("mrs. ", None),
    ("ms. ", None),
    ("dr. ", None),
    ("mr ", r" (?:twice|told|said|about)\b"),
    ("mrs ", r" (?:twice|told|said|about)\b"),
    ("regards, ", r"[.,!?\n]|\s*$|\s[.!?]"),
    ("regards ", r"[.!?\n]|\s*$"),
    ("sincerely, ", r"[.,!?\n]|\s*$|\s[.!?]"),
    ("yours, ", r" from\b|[.,!?\n]|\s*$|\s[.!?]"),
    *((f"my {r} ", r" has the same app\b") for r in RELATIVES.split("|")),
)

_LOCAL = re.compile(r"[a-z0-9](?:[a-z0-9._%+\-]*[a-z0-9])?$")
_DOMAIN = re.compile(r"\s?([a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9\-]+)*?)(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\sdot\s)([a-z]{2,})(?:(?:\.|\sdot\s)(?:com|in|org|net|co|uk)\b)?(?![a-z0-9@])")
_DOMAIN_SPELLED = re.compile(r"([a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)(?:\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)([a-z]{2,})(?![a-z0-9@])")

_TOWN = r"[a-z][a-z'\-]+"
_UNIT = re.compile(
    r"(?:flat|plot|h\.? ?no\.?|hno|house(?: no\.?| number)?|door no\.?|d\.no\.?|apartment|apt\.?|room no\.?|shop no\.?|block|villa)(?: no\.?| number)?[ #:.\-]{0,3}"
    r"(?:\d+[a-z]?(?:[\-/]\d+[a-z]?)*)(?: sector \d+)?(?![\d.]*\d)"
)
_BOX = re.compile(r"(?:p\.? ?o\.? ?box|post box)(?: no\.?)?[ #:]{0,2}\d+")
_TAIL = re.compile(rf"(?:,? (?:near )?{_TOWN} (?:residency|towers|heights|layout|nagar|colony|apartments|enclave|street|road|lane|cross|temple|park|society|complex))*(?:, {_TOWN})?(?: ?-? ?\d{{6}}\b)?")
_WAY_TAIL = re.compile(rf"(?=, (?:near )?{_TOWN})(?:, near {_TOWN}(?: {_TOWN})?)?(?:, {_TOWN})?(?: ?-? ?\d{{6}}\b)?")
_WAY_CUE = re.compile(r"(?:live|lives|living|reside|resides|stay|stays|office|located|visit us|meet me) (?:at|in) $|(?:address|moved|shifted|sent|delivered|deliver|send it|ship)(?: is)?(?: to)? ?:? ?$")
_WAY_LEFT = re.compile(rf"(?:(?<=\s)|^|(?<=[(\[:,]))(\d+[a-z]?(?:[/\-]\d+)?,? (?:{_TOWN} ){{0,1}}{_TOWN})$")

_TAX = re.compile(r"(?<![a-z0-9])[a-z]{5}\d{4}[a-z](?![a-z0-9])")
_ACCOUNT = re.compile(r"[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?![a-z0-9])")
_CUED_CODE = re.compile(r"[a-z]{0,3}[ \-]?\d{6,}(?![\d.,]*\d)")
_CODE_CUE = re.compile(r"(?:passport|licen[cs]e|voter|policy|membership|employee)(?: id| no\.?| number| card)?(?: is)?[ :.#]*$")
_SOCIAL = re.compile(r"\d{3}-\d{2}-\d{4}(?![\d\-])")
_SOCIAL_CUE = re.compile(r"(?:ssn|social security|tax id|tin)(?: no\.?| number)?(?: is)?[ :.#]*$")
_CARD = re.compile(r"\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?![ \-]?\d)")
_IDENTITY = re.compile(r"\d{4}-\d{4}-\d{4}(?![ \-]?\d)")
_PREFIXED = re.compile(r"(?<![a-z0-9])(?:ord|upi|tkt|txn|ref|utr|inv|fol|acc|cust|clt)[#\-:]?\d{4,}(?![a-z0-9])")
_CODE = re.compile(r"(?<![a-z0-9\-])[a-z]{2}-\d{5}(?![\d\-])")
_DIGITS = re.compile(r"(?<![a-z0-9#/])[+(]?\d[\d ().\-/]*\d(?![a-z])")
# Words before a number that say it is none of ours, and those that say it is an identifier.
_OTHER = re.compile(r"(?:build|version|update|code|err|error|since|rs\.?|inr|rupees|range)[ :.#]*$|(?:value|index|price|worth|amount|total)(?: [a-z]+){0,2} (?:was|is|from|at|of)[ :.#]*$")
_ID_CUE = re.compile(r"(?:a/c|account|acct|folio|order|ticket|client|customer|identity|national id|aadhaar|aadhar|card|ref|txn|transaction|complaint|invoice|bill|receipt|policy|loan|id|number)[a-z .:#]{0,14}$")
_PHONE_CUE = re.compile(r"(?:call|reach|ring|phone|mobile|whatsapp|contact|number is|ph|tel|gave|dial|sms|text)[^0-9\n]{0,24}$")
_PHONE_SHAPES = tuple(
    re.compile(p)
    for p in (
        r"\+\d{1,3}[ \-]?(?:\d[ \-]?){8,11}\d(?!\d)",
        r"\(\d{3}\) ?\d{3}[\- ]\d{4}(?!\d)",
        r"\d{3}\.\d{3}\.\d{4}(?!\d)",
        r"0\d{2,4}[\- ]\d{3,4}[\- ]?\d{4}(?!\d)",
        r"\d{5}[\- ]\d{5}(?!\d)",
        r"\d(?: \d){9,11}(?! ?\d)",
        r"\d{3}-\d{3}-\d{4}(?!\d)",
        r"\d{10}(?!\d)",
    )
)
_ID_SHAPES = (re.compile(r"\d{4} \d{4} \d{4}(?! ?\d)"), re.compile(r"\d{3,5}/\d{2}/\d{2,4}(?![\d/])"), re.compile(r"\d{11,18}(?!\d)"))
_ID_CUED = re.compile(r"\d{6,18}(?![\d.,])")
_FOLIO = re.compile(r"folio[a-z .:#]{0,10}$")
_NAME = re.compile(r"([^\W\d_]+(?:['\-][^\W\d_]+)?)(?: ([^\W\d_]+(?:['\-][^\W\d_]+)?))?")
_GOES_ON_NEXT = re.compile(_GOES_ON)
_GOES_ON_OR_ENDS = re.compile(f"{_GOES_ON}|{_CLAUSE_ENDS}")
_SIGNED = re.compile(r"(?:^|[.!?\])]\s+|\n\s*)[\-–—] ([^\W\d_]+)(?: ([^\W\d_]+))?(?=\s?(?:[.!?\n]|$))")


# The tables of the check digit of twelve-digit identities.
_DIHEDRAL = [[(i + j) % 5 if i < 5 and j < 5 else (i + j % 5) % 5 + 5 if i < 5 else (i - j) % 5 + 5 if j < 5 else (i - j) % 5 for j in range(10)] for i in range(10)]
_TURNS = [[1, 5, 7, 6, 2, 8, 3, 0, 9, 4]]


def _digits_of(s: str) -> list[int]:
    return [int(c) for c in s if c in "0123456789"]


def card_holds(s: str) -> bool:
    """The check digit of payment cards: every second digit from the right but one doubled, digits added up, by ten."""
    d = _digits_of(s)[::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def identity_holds(s: str) -> bool:
    """The check digit of twelve-digit identities: a walk in the dihedral group of order ten."""
    while len(_TURNS) < 8:
        _TURNS.append([_TURNS[0][x] for x in _TURNS[-1]])
    at = 0
    for i, x in enumerate(_digits_of(s)[::-1]):
        at = _DIHEDRAL[at][x if i % 8 == 0 else _TURNS[i % 8 - 1][x]]
    return at == 0


def account_holds(s: str) -> bool:
    """The check of international bank accounts: turned by four signs, letters as two digits, 1 modulo 97."""
    t = s.replace(" ", "").lower()
    return len(t) >= 15 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


class Finder:
    def __init__(self, names: dict[str, str]) -> None:
        """names: lower-cased name parts with 'given', 'family' or 'both'."""
        self.names = names
        self.rules = [re.compile(follow) if follow else None for _, follow in NAME_CUES]
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list[tuple]] = {}
        for a in AT:
            entries.setdefault(a, []).append(("at", len(a)))
        for d in DESIGNATORS:
            entries.setdefault(d, []).append(("unit", len(d)))
        for w in WAYS:
            entries.setdefault(w, []).append(("way", len(w)))
        for k, (cue, _) in enumerate(NAME_CUES):
            entries.setdefault(cue, []).append(("cue", k))
        for dash in ("- ", "– ", "— "):
            entries.setdefault(dash, []).append(("dash", len(dash)))
        for digit in "0123456789":
            entries.setdefault(digit, []).append(("digit", 1))
        for cue in SHAPE_CUES:
            entries.setdefault(cue, []).append(("shape", len(cue)))
        for part in names:
            entries.setdefault(part, []).append(("known", len(part)))
        for word, what in entries.items():
            self.automaton.add_word(word, what)
        self.automaton.make_automaton()

    # Parsers: each takes the text, its lower-cased form and the end of the anchor, and gives (start, end) or None.

    def _email(self, low: str, start: int, end: int) -> tuple[int, int] | None:
        sign = low[start:end].strip()
        left = start
        if sign == "@" and low[left - 1 : left] == " ":
            left -= 1
        first = left
        while first and (low[first - 1].isascii() and low[first - 1].isalnum() or low[first - 1] in "._%+-"):
            first -= 1
        if first == left or not low[left - 1].isalnum():
            return None
        local = _LOCAL.search(low, first, left)
        if local is None or (local.start() and low[local.start() - 1] in "@"):
            return None
        domain = (_DOMAIN_SPELLED if sign == "at" else _DOMAIN).match(low, end)
        if domain is None:
            return None
        return local.start(), domain.end()

    def _way(self, low: str, start: int, end: int) -> tuple[int, int] | None:
        if low[end : end + 1].isalpha():
            return None
        first = start
        for _ in range(3):  # a number and one or two words
            first = max(0, low.rfind(" ", 0, first))
        left = _WAY_LEFT.search(low, max(0, first - 1), start)
        if left is None:
            return None
        tail = _WAY_TAIL.match(low, end)
        if tail:
            return left.start(1), tail.end()
        return (left.start(1), end) if _WAY_CUE.search(low, max(0, left.start(1) - 40), left.start(1)) else None

    def _unit(self, low: str, at: int) -> tuple[int, int] | None:
        if at and (low[at - 1].isalnum() or low[at - 1] == "."):
            return None
        m = _UNIT.match(low, at) or _BOX.match(low, at)
        if m is None:
            return None
        tail = _TAIL.match(low, m.end())
        end = tail.end() if tail else m.end()
        if end == m.end() and not low.startswith(("h.", "h ", "hno", "p", "d.", "door"), at):
            return None  # "block 3 calls": a designator and a number alone
        return at, end

    def _names(self, text: str, low: str, at: int, follow: re.Pattern | None) -> tuple[int, int] | None:
        m = _NAME.match(text, at)
        if m is None:
            return None
        first, second = m.group(1).lower(), (m.group(2) or "").lower()
        ends = [m.end()] + ([m.end(1)] if second else [])
        if second and m.group(1).istitle() and m.group(2).islower() and second not in self.names:
            ends = ends[1:]  # "Ms. Quiroga on": the capitals end with the name
            second = ""
        known = first in self.names or second in self.names and second not in ORDINARY
        dotted = low.endswith(". ", 0, at)  # after "mr. " even an unknown word in lower case is a name
        for end in ends:
            if (follow is None or follow.match(low, end)) and first not in NOT_NAMES:
                if known or follow is not None or text[at].isupper() or dotted:
                    words = second if end == m.end() and end in ends[:1] else ""
                    return at, (m.end(1) if words in NOT_NAMES else end)
        if first in self.names and first not in ORDINARY or first in self.names and second in self.names and self.names[second] != "given":
            return at, (m.end() if second in self.names else m.end(1))
        return None

    def _known(self, text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
        """A known name part by itself: a given name that is no ordinary word, or one with a family name behind."""
        if (start and (low[start - 1].isalnum() or low[start - 1] in "@._+-<#/[")) or (end < len(low) and (low[end].isalnum() or low[end] in "@_+-#/(" or low[end : end + 2].isalnum())):
            return None
        if low[end : end + 1] == "." and low[end + 1 : end + 2].isalnum():
            return None
        word = low[start:end]
        if self.names[word] == "family":
            return None
        m = _NAME.match(text, start)
        second = (m.group(2) or "").lower() if m else ""
        if second in self.names and self.names[second] != "given":
            return start, m.end()
        if word in ORDINARY:
            return None
        return start, end

    def _shaped(self, text: str, low: str, at: int, weak: bool) -> tuple[int, int] | None:
        """After a cue: one or two words in capitals, in a text that isn't all in capitals."""
        m = _NAME.match(text, at)
        if m is None or not m.group(1).istitle():
            return None
        first, second = m.group(1).lower(), m.group(2) or ""
        if first in NOT_NAMES or first in PRODUCTS or len(first) < 3:
            return None
        two = second.istitle() and second.lower() not in NOT_NAMES and second.lower() not in PRODUCTS
        end = m.end() if two else m.end(1)
        return (at, end) if two or (_GOES_ON_NEXT if weak else _GOES_ON_OR_ENDS).match(low, end) else None

    def _identifier(self, low: str, at: int, first: int) -> tuple[int, int] | None:
        """An identifier with letters or check digits around the group of digits that begins at ``first``; ``at``: where its word begins."""
        for start in dict.fromkeys((at, first)):
            for pattern in (_TAX, _PREFIXED, _CODE):
                m = pattern.match(low, start)
                if m:
                    return m.span()
        before = low[max(0, at - 100) : at]
        m = _ACCOUNT.match(low, at)
        if m and account_holds(m.group()):
            return m.span()
        m = _CARD.match(low, first)
        if m and (card_holds(m.group()) or _ID_CUE.search(before)):
            return m.span()
        m = _IDENTITY.match(low, first)
        if m and (identity_holds(m.group()) or _ID_CUE.search(before)):
            return m.span()
        m = _SOCIAL.match(low, first)
        if m and _SOCIAL_CUE.search(before):
            return m.span()
        m = _CUED_CODE.match(low, at)
        return m.span() if m and _CODE_CUE.search(before) else None

    def _digit(self, low: str, at: int) -> tuple[list[tuple[str, int, int]], int]:
        """The numbers from the first digit of a group on, and how far the text is read."""
        word = at
        while word and (low[word - 1].isascii() and low[word - 1].isalpha() or low[word - 1] in "#-:" and word >= 2 and low[word - 2].isascii() and low[word - 2].isalpha()):
            word -= 1
        if not word or not low[word - 1].isalnum():
            found = self._identifier(low, word, at)
            if found:
                return [("id", *found)], found[1]
        start = at - 1 if at and low[at - 1] in "+(" else at
        m = _DIGITS.match(low, start) or _DIGITS.match(low, at)
        if m is None:
            return [], at + 1
        out = []
        if sum(map(str.isdigit, m.group())) >= 7:
            here = m.start()
            while here < m.end():
                number = self._number(low, here, m.end()) if low[here] in "+(0123456789" else None
                if number:
                    out.append(number)
                    here = number[2]
                    continue
                # On to the next group of the digits.
                while here < m.end() and low[here] not in " /":
                    here += 1
                here += 1
        return out, m.end()

    def _number(self, low: str, start: int, end: int) -> tuple[str, int, int] | None:
        """A phone number or identifier within a group of digits; the kind and its place."""
        before = low[max(0, start - 100) : start]  # more than any cue and its gap
        if _OTHER.search(before):
            return None
        at = start
        if low[at] == "(" and not _PHONE_SHAPES[1].match(low, at):
            at += 1
        m = _ID_SHAPES[1].match(low, at)
        if m and _FOLIO.search(before):
            return "id", at, m.end()
        for shape in (_ID_SHAPES[0], _ID_SHAPES[2]):
            m = shape.match(low, at)
            if m:
                return "id", at, m.end()
        for i, shape in enumerate(_PHONE_SHAPES):
            m = shape.match(low, at)
            if m:
                if i >= 4 and _ID_CUE.search(before) and not _PHONE_CUE.search(before):
                    return "id", at, m.end()
                return "phone", at + (1 if low[at] == "(" else 0), m.end()
        m = _ID_CUED.match(low, at)
        if m and re.search(r"(?:a/c|account number|account no|acct|folio|identity number|national id|client id|customer id|order no|ticket|complaint no)[ .:#]*(?:is )?$", before):
            return "id", at, m.end()
        return None

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the values, in order, without overlaps."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        upper = text.isupper()
        found: list[tuple[int, int, int, str]] = []

        def keep(kind: str, span: tuple[int, int] | None) -> None:
            if span is not None and span[1] > span[0]:
                found.append((KINDS.index(kind), span[0], span[1], kind))

        read = 0
        for last, anchors in self.automaton.iter(low):
            end = last + 1
            for what, size in anchors:
                if what == "digit":
                    if last >= read and (not last or low[last - 1] not in "0123456789" or last == read):
                        numbers, read = self._digit(low, last)
                        for kind, *span in numbers:
                            keep(kind, tuple(span))
                    continue
                if what == "shape":
                    start = end - size
                    if not upper and (not start or not (low[start - 1].isalnum() or low[start - 1] == "'")):
                        keep("name", self._shaped(text, low, end, low[start:end] in WEAK_CUES))
                    continue
                if what == "at":
                    keep("email", self._email(low, end - size, end))
                elif what == "known":
                    keep("name", self._known(text, low, end - size, end))
                elif what == "unit":
                    keep("address", self._unit(low, end - size))
                elif what == "way":
                    keep("address", self._way(low, end - size, end))
                elif what == "cue":
                    cue, _ = NAME_CUES[size]
                    start = end - len(cue)
                    if not start or not (low[start - 1].isalnum() or low[start - 1] == "'"):
                        keep("name", self._names(text, low, end, self.rules[size]))
                else:
                    start = end - size
                    m = _SIGNED.match(text, start) if not start else None
                    if m is None:
                        back = start
                        while back and text[back - 1].isspace():
                            back -= 1
                        if back < start and (not back or text[back - 1] in ".!?])" or "\n" in text[back:start]):
                            m = _SIGNED.match(text, back - 1 if back and text[back - 1] in ".!?])" else back)
                    if m and m.group(1).lower() not in NOT_NAMES:
                        keep("name", (m.start(1), m.end()))
        if not found:
            return []
        found.sort(key=lambda v: (v[0], v[1], -v[2]))
        starts: list[int] = []
        taken: list[tuple[str, int, int]] = []
        for _, start, end, kind in found:
            i = bisect_left(starts, end)
            if not i or taken[i - 1][2] <= start:
                starts.insert(i, start)
                taken.insert(i, (kind, start, end))
        return taken

    def find_row(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """The values of each text of a row. Names that aren't known are looked for in the other texts, whatever their case."""
        found = [self.find(t) for t in texts]
        names = {t[s:e].lower() for t, values in zip(texts, found) for kind, s, e in values if kind == "name"}
        names = {n for n in names if len(n) > 3 and n not in ORDINARY and n not in NOT_NAMES and not all(w in self.names for w in n.split())}
        if names and len(texts) > 1:
            pattern = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?![^\W_])")
            for i, t in enumerate(texts):
                low = t.lower() if t else ""
                if not t or len(low) != len(t):
                    continue
                for m in pattern.finditer(low):
                    k = bisect_left(found[i], m.end(), key=lambda v: v[1])
                    if not k or found[i][k - 1][2] <= m.start():
                        found[i].insert(k, ("name", *m.span()))
        return found


def redact(text: str | None, values: list[tuple[str, int, int]]) -> str | None:
    if not values:
        return text
    out, at = [], 0
    for kind, start, end in values:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def name_parts(names: DataFrame) -> dict[str, str]:
    """Lower-cased known name parts; null and empty ones are left out."""
    rows = names.select(F.lower(F.trim("name_part")).alias("p"), "name_kind").filter("p <> ''").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} known name parts")
    found: dict[str, str] = {}
    for r in rows:
        kind = r["name_kind"] or "both"
        found[r["p"]] = kind if found.get(r["p"], kind) == kind else "both"
    return found


_finders: dict[int, Finder] = {}


def _finder(names: dict[str, str]) -> Finder:
    key = hash(frozenset(names.items()))
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(names)
    return _finders[key]


def find_values(df: DataFrame, names: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, kind, start_pos, end_pos): a row for each personal value in the given text columns."""
    parts = df.sparkSession.sparkContext.broadcast(name_parts(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(parts.value)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [batch.column(i + 1).to_pylist() for i in range(len(fields))]
            rows = [(k, f, *v) for k, row in zip(keys, zip(*texts)) for f, values in zip(fields, finder.find_row(row)) for v in values]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "field", "kind", "start_pos", "end_pos"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("k"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields))))
    return rows.mapInArrow(run, f"k {kind}, field string, kind string, start_pos int, end_pos int").withColumnRenamed("k", key)


def redact_columns(df: DataFrame, names: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, *fields, n_values): the text columns with a placeholder such as [EMAIL] for every value, otherwise unchanged."""
    parts = df.sparkSession.sparkContext.broadcast(name_parts(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(parts.value)
        for batch in batches:
            counts = [0] * batch.num_rows
            texts = [batch.column(i + 1).to_pylist() for i in range(len(fields))]
            for j, row in enumerate(zip(*texts)):
                for column, t, values in zip(texts, row, finder.find_row(row)):
                    counts[j] += len(values)
                    column[j] = redact(t, values)
            columns = [pa.array(x, pa.string()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(counts, pa.int32())], names=["k", *(f"f{i}" for i in range(len(fields))), "n_values"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("k"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields))))
    out = rows.mapInArrow(run, f"k {kind}, " + ", ".join(f"f{i} string" for i in range(len(fields))) + ", n_values int")
    return out.select(F.col("k").alias(key), *(F.col(f"f{i}").alias(f) for i, f in enumerate(fields)), "n_values")
