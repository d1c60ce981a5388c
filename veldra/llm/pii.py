"""Personal information inside free text: found, and replaced by typed placeholders.

Method: what is found is validated by its form and put through a format-preserving Feistel network, keyed, so that a
number becomes another number of the same format, the same for equal values in all documents; dates are permuted
among the days of a fixed span. A placeholder names the kind and holds the pseudonym, and every other character
of the text stays as it is.

Detection is a scan per document in order of certainty: e-mails, addresses, phones, id numbers, persons; what is
taken by an earlier kind is not looked at again. Persons come from a lexicon of name parts, which is incomplete: its
parts are cut into beginnings and endings that recur, and a word made of two of those is a name part as well.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import spread

KINDS = ("email", "phone", "id_number", "address", "person")

D = "[0-9\u0966-\u096f]"
W = r"[^\W\d_]"

_AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)"
EMAIL = re.compile(rf"(?<![\w.%+\-])[a-z0-9](?:[a-z0-9._%+\-]*[a-z0-9_+\-])?{_AT}[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:{_DOT}[a-z0-9\-]+)*{_DOT}[a-z]{{2,}}(?![\w\-])", re.I)

# Designations that an address begins with, and kinds of ways.
_UNIT = r"(?:H\.?\s?No\.?|House(?:\s+No\.?)?|Flat(?:\s+No\.?)?|Plot(?:\s+No\.?)?|Door(?:\s+No\.?)?|Shop(?:\s+No\.?)?|Room(?:\s+No\.?)?|Apt\.?|Unit|Qtr\.?|मकान(?:\s+(?:नं|न|संख्या)\.?)?|प्लॉट(?:\s+नं\.?)?|फ्लैट(?:\s+नं\.?)?|फ़्लैट(?:\s+नं\.?)?|घर\s+(?:नं|संख्या)\.?)"
_WAY = r"(?:Street|Lane|Galli|Gali|Marg|Road|Cross|Apartments?|Colony|Layout|Heights|Nagar|Sector|Avenue|Enclave|Towers?|गली|मार्ग|रोड|सड़क|कॉलोनी|अपार्टमेंट्स?|हाइट्स|लेआउट|नगर|सेक्टर)"
_NO = rf"{D}{{1,4}}[A-Za-z]?(?:\s?/\s?{D}{{1,3}}[A-Za-z]?)?"
_START = rf"(?:{_UNIT}\s*[#\-:]?\s*{_NO}|[A-Z]\s?-\s?{D}{{1,3}}\s?/\s?{D}{{1,3}}|{_NO},?\s+(?:[^\W\d_][\w\u0900-\u097f.]*\s+){{1,3}}?{_WAY})"
# Abbreviations inside an address; after other words a full stop before white space ends a sentence.
_ABBREVIATED = r"(?:(?<=\bopp)|(?<=\bNo)|(?<=\bnr)|(?<=\bSt)|(?<=\bRd)|(?<=नं))"
#: Up to the end of the sentence or paragraph, a landmark in parentheses included.
_BODY = rf"(?:[^\n;:|{{}}@!?().।]|[.।](?!\s)|{_ABBREVIATED}[.।]|\([^()\n]*\)|\n(?!\n))*?"
_PIN = rf"(?:PIN(?:\s?code)?\s?[:\-]?\s?|पिन\s?[:\-]?\s?)?(?<!{D})[1-9\u0967-\u096f]{D}{{2}}\s?{D}{{3}}(?!{D})"
ADDRESS = re.compile(rf"(?<![\w/\-.])(?={_START}){_START}\b{_BODY}(?<=[\s,\-–]){_PIN}", re.I)
_INNER_NUMBER = re.compile(rf"(?<!{D}){D}{{5,}}")

_B, _E = rf"(?<![\w+@.\-/:#])(?<!{D} )", rf"(?![\w@/])(?![.\-:]{D})"
PHONE = re.compile(
    rf"(?=[+(]|{D})(?:" + r"|".join(
        [
            rf"(?<![\w+])\(\+{D}{{1,3}}\)\s?{D}{{3,5}}[\s\-]?{D}{{3,5}}(?:[\s\-]?{D}{{3,5}})?{_E}",
            rf"(?<![\w+])\+{D}{{1,3}}\s?\({D}{{2,4}}\)\s?{D}{{3}}[\s\-]?{D}{{4}}{_E}",
            rf"(?<![\w+])\+{D}{{1,3}}[\s\-]?{D}{{3,5}}[\s\-]?{D}{{3,6}}(?:[\s\-]?{D}{{3,4}})?{_E}",
            rf"{_B}[0\u0966]{{2}}{D}{{2,3}}[\s\-]?{D}{{10}}{_E}",
            rf"{_B}[0\u0966]{D}{{2,5}}[\s\-]{D}{{5,8}}{_E}",
            rf"{_B}[5-9\u096b-\u096f]{D}{{4}}[\s\-]{D}{{5}}{_E}",
            rf"{_B}[5-9\u096b-\u096f]{D}{{3}}[\s\-]{D}{{3}}[\s\-]{D}{{3}}{_E}",
            rf"{_B}{D}{{3}}\.{D}{{3}}\.{D}{{4}}{_E}",
            rf"{_B}\({D}{{3}}\)\s?{D}{{3}}-{D}{{4}}{_E}",
            rf"{_B}[0\u0966]?[5-9\u096b-\u096f]{D}{{9}}{_E}",
        ]
    )
    + ")"
)
_IB, _IE = rf"(?<![\w+@\-/#])(?<!{D}[.])", rf"(?![\w@/])(?![.\-]{D})(?! {D}{{4}}\b)"
CARD = re.compile(rf"{_IB}{D}{{4}}(?P<s>[ .\-]?){D}{{4}}(?P=s){D}{{4}}{_IE}")
ACCOUNT = re.compile(rf"{_IB}[A-Z]{{3}}P[A-Z](?P<s>[ .\-]?){D}{{4}}(?P=s)[A-Z](?![\w@])", re.I)
LICENCE = re.compile(rf"{_IB}[A-Z]{{2}}[ \-]?{D}{{2}}[ \-]?(?:19|20|१९|२०){D}{{2}}[ \-]?{D}{{7}}(?![\w@])(?!-{D})", re.I)
#: What a number isn't personal after or before: serial, job and byte numbers, samples of a format.
_NOT_BEFORE = re.compile(r"(?:serial(?:\s+(?:no\.?|number))?|\bjob|\bepoch|\brow|\bwrote|\bhint:?|\bformat:?|\btrace|\bseed|\bhash|\bsample:?|\bexport|\bbatch|\bticket|\bchecksum)\s*[:#]?\s*$", re.I)
_NOT_AFTER = re.compile(r"[ \t]*(?:bytes|of the trace|px|stands for)\b", re.I)
#: Four digits and a blank before a card number: it is part of a longer one.
_MORE = re.compile(rf"(?:^|[^\w.\-/]){D}{{4}} $")
#: What is scanned for first: the sign of an e-mail, a postal code, and runs of digits with what a number may begin with.
_AT_SIGN = re.compile(_AT, re.I)
_AT_HINT = re.compile(r"@|\(\s?at\s?[)\]}]|\[\s?at\s?[)\]}]|\{\s?at\s?[)\]}]", re.I)
_CODE = re.compile(rf"[1-9\u0967-\u096f](?<!{D}{D}){D}{{2}}\s?{D}{{3}}(?!{D})")
_RUN = re.compile(rf"[(+]*{D}+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_SAMPLE = re.compile(r"(?:[AXLNP]{5}[ .\-]?(?:9999|0000|1234)[ .\-]?[AXLNPZ])$", re.I)

# Words before a person that aren't part of the name.
_TITLES = {"mr", "mrs", "ms", "dr", "shri", "smt", "sri", "km", "prof", "miss", "श्री", "श्रीमती", "कुमारी", "डॉ"}
#: A run of letters with their marks: whatever isn't white space, a digit or punctuation.
_WORD = re.compile(r"[^\s\d_!-/:-@\[-`{-¿×÷।॥ -​‎-⁯⸀-⹿　-〿]+")


# Sounds of Devanagari letters; a consonant's own vowel isn't written.
_SOUNDS = dict(zip("अआइईउऊएऐओऔािीुूेैोौंँ", ["", "", "i", "i", "u", "u", "e", "e", "o", "o", "", "i", "i", "u", "u", "e", "e", "o", "o", "n", "n"])) | dict(
    zip("कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh ch chh j jh t th d dh n t th d dh n p ph b bh m y r l v sh sh s h".split())
)


def sound(word: str) -> str:
    """A word's sound for comparison between Latin and Devanagari script: letters a and doublings left out."""
    t = word.lower().replace("ज़", "z").replace("ज\u093c", "z")
    t = "".join(_SOUNDS.get(c, "" if "\u0900" <= c <= "\u097f" else c) for c in t)
    t = t.replace("qu", "kv").replace("w", "v").replace("mb", "nb").replace("mp", "np").replace("a", "")
    return re.sub(r"(.)\1", r"\1", t)


class NameParts:
    """Name parts of a lexicon, and words that are made like them."""

    def __init__(self, rows: Iterable[tuple[str, str]], least: int = 2):
        self.kind: dict[str, str] = {}
        self.known: dict[str, str | None] = {}
        by: dict[tuple[str, bool], list[str]] = defaultdict(list)
        self.places = set()
        for token, kind in rows:
            if not token or not kind:
                continue
            t = token.strip().lower()
            if kind == "place":
                self.places.add(t)
            else:
                self.kind.setdefault(t, kind)
                by[kind, self._indic(t)].append(t)
        self.made: dict[tuple[str, bool], tuple[set[str], set[str]]] = {k: self._learn(v, least) for k, v in by.items()}
        #: Sounds of beginnings and endings of Latin name parts, for those written in Devanagari.
        self.sounds = {kind: ({sound(b) for b in begins}, {sound(e) for e in ends}) for (kind, indic), (begins, ends) in self.made.items() if not indic}
        #: Beginnings of given names that several tokens share.
        self.firm: dict[bool, set[str]] = {}
        for indic in (False, True):
            tokens = set(by.get(("given", indic), ()))
            n = Counter(x[:i] for x in tokens for i in range(3, len(x) + 1))
            self.firm[indic] = {x[:i] for x in tokens for i in range(3, len(x)) if n[x[:i]] >= 2}
        #: Endings of three letters or more, with the longest length.
        self.long_ends = {k: {e for e in ends if len(e) >= 3} for k, (_, ends) in self.made.items()}
        self.longest = max((len(e) for x in self.long_ends.values() for e in x), default=0)

    @staticmethod
    def _indic(t: str) -> bool:
        return any("\u0900" <= c <= "\u097f" for c in t)

    @staticmethod
    def _learn(tokens: list[str], least: int) -> tuple[set[str], set[str]]:
        """Endings that at least ``least`` beginnings share, and the beginnings of all tokens with such an ending."""
        heads: dict[str, set[str]] = defaultdict(set)
        for t in set(tokens):
            for i in range(2, len(t) - 1):
                heads[t[i:]].add(t[:i])
        good = {t[:i] for t in set(tokens) for i in range(2, len(t) - 1) if len(heads[t[i:]]) >= least and len(t) - i >= 3}
        ends = {e for e, h in heads.items() if len(e) >= 2 and len(h & good) >= least}
        return {t[:i] for t in set(tokens) for i in range(2, len(t) - 1) if t[i:] in ends}, ends

    def of(self, word: str) -> str | None:
        """given, surname, either with a question mark if only the ending tells, or None. Answers are kept for up to 200,000 words."""
        kind = self.known.get(word, "")
        if kind == "":
            if len(self.known) >= 200_000:
                self.known.clear()
            t = word.lower()
            kind = self.known[word] = self._of(t) or self.ends_like(t)
        return kind

    def _of(self, t: str) -> str | None:
        if t in self.kind:
            return self.kind[t]
        if t in self.places or len(t) < 4:
            return None
        indic = self._indic(t)
        for kind in ("given", "surname"):
            begins, ends = self.made.get((kind, indic), ((), ()))
            if any(t[:i] in begins and t[i:] in ends for i in range(2, len(t) - 1)):
                return kind
        return self._by_sound(sound(t)) if indic else None

    def _by_sound(self, s: str) -> str | None:
        """A letter that the beginning ends with and the ending begins with is one in the whole."""
        for kind in ("surname", "given"):
            begins, ends = self.sounds.get(kind, ((), ()))
            if any(s[:i] in begins and (s[i:] in ends or s[i - 1 :] in ends) for i in range(1, len(s) + 1)):
                return kind
        return None

    def ends_like(self, word: str) -> str | None:
        """``given?`` or ``surname?`` of a word with the ending of a name part whose beginning isn't known."""
        t = word.lower()
        if len(t) < 5 or t in _TITLES or t in self.places:
            return None
        indic = self._indic(t)
        for n in range(min(self.longest, len(t) - 2), 2, -1):
            for kind in ("given", "surname"):
                if t[-n:] in self.long_ends.get((kind, indic), ()):
                    return kind + "?"
        if indic and len(s := sound(t)) > 4:
            for kind in ("surname", "given"):
                ends = self.sounds.get(kind, ((), ()))[1]
                if any(s[-n:] in ends for n in range(3, len(s) - 1)):
                    return kind + "?"
        return None

    def like(self, word: str) -> bool:
        """Whether a word ends like a name part, or begins like a given name; enough only beside a name part."""
        t = word.lower()
        indic = self._indic(t)
        if t in _TITLES or t in self.places:
            return False
        if len(t) >= 5 and any(t[:i] in self.firm[indic] for i in range(3, len(t) + 1)):
            return True
        return self.ends_like(word) is not None


Span = tuple[int, int, str]


class Taken:
    """Spans that don't overlap, in order; looked up by bisection, as a long text has many."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.spans: list[Span] = sorted(spans)

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.spans, (b,))
        return i == 0 or self.spans[i - 1][1] <= a

    def add(self, a: int, b: int, kind: str) -> None:
        insort(self.spans, (a, b, kind))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign of an e-mail has one place where its local part can begin."""
    at = 0
    for sign in _AT_HINT.finditer(text):
        a = sign.start()
        if a > at and text[a - 1].isspace():
            a -= 1
        while a > at and text[a - 1] in _LOCAL:
            a -= 1
        if a >= at and (m := EMAIL.match(text, a)):
            at = m.end()
            yield m.span()


def _number_matches(text: str) -> dict[re.Pattern, list[re.Match]]:
    """Matches of the four patterns, tried only where a run of digits allows one to begin."""
    out: dict[re.Pattern, list[re.Match]] = {LICENCE: [], ACCOUNT: [], PHONE: [], CARD: []}
    ends = dict.fromkeys(out, 0)

    def attempt(pattern: re.Pattern, at: int) -> bool:
        m = pattern.match(text, at) if at >= ends[pattern] else None
        if m:
            out[pattern].append(m)
            ends[pattern] = m.end()
        return bool(m)

    n = len(text)
    for run in _RUN.finditer(text):
        a, z = run.span()
        digits = a
        while text[digits] in "(+":
            digits += 1
        size = z - digits
        goes_on = z + 1 < n and text[z] in " .-" and text[z + 1].isdigit()
        if digits == a and a > 1 and size >= 2:
            q = a - 1 if text[a - 1] in " .-" else a
            if text[q - 1].isalpha() and text[q - 2].isalpha():
                if size == 4 and q >= 5:
                    attempt(ACCOUNT, q - 5)
                if size > 4 or goes_on:
                    attempt(LICENCE, q - 2)
        if digits > a:
            any(attempt(PHONE, i) for i in range(a, digits + 1))
        elif size >= 10 or (goes_on and size >= 3):
            attempt(PHONE, a)
        if size == 12 or (size == 4 and goes_on):
            attempt(CARD, digits)
    return out


def _numbers(text: str, taken: Taken) -> None:
    for pattern, matches in _number_matches(text).items():
        for m in matches:
            a, b = m.span()
            if not taken.free(a, b) or _NOT_BEFORE.search(text[max(0, a - 24) : a]) or _NOT_AFTER.match(text, b) or (pattern is ACCOUNT and _SAMPLE.match(m[0])) or (pattern is CARD and _MORE.search(text[max(0, a - 6) : a])):
                continue
            taken.add(a, b, "phone" if pattern is PHONE else "id_number")


def _persons(text: str, names: NameParts, taken: Taken) -> None:
    if not any(map(names.of, set(_WORD.findall(text)))):
        return
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    busy = [(a, b) for a, b, _ in taken.spans]
    kinds: list[str | None] = []
    j = 0
    for a, b, w in words:
        while j < len(busy) and busy[j][1] <= a:
            j += 1
        inside = j < len(busy) and busy[j][0] < b
        glued = (a and text[a - 1] in "_@\\") or (b < len(text) and text[b] in "_@\\")
        if inside:
            kinds.append("busy")
        elif glued or (a and text[a - 1].isdigit()) or (b < len(text) and text[b].isdigit()):
            kinds.append(None)
        else:
            initial = len(w) == 1 and w.isalpha() and not names._indic(w) and (a == 0 or text[a - 1] in " \n\t(\"“‘.|:,")
            kinds.append(names.of(w) or ("I" if initial else None))
    n, i = len(words), 0

    def gap(k: int) -> str:
        return text[words[k][1] : words[k + 1][0]]

    def sure(k: int) -> bool:
        return kinds[k] in ("given", "surname")

    def kind(k: int) -> str | None:
        return kinds[k] and kinds[k].rstrip("?")

    def part(k: int) -> bool:
        return kind(k) in ("given", "surname")

    while i < n:
        if not part(i):
            i += 1
            continue
        first = last = i
        # backwards: initials, or a word made like a name
        while first > 0 and ((kinds[first - 1] == "I" and gap(first - 1) in (". ", ".", " ")) or (kinds[first - 1] is None and gap(first - 1) in (" ", "-") and _capital(words[first - 1][2]) and names.like(words[first - 1][2]))):
            if kinds[first - 1] == "I" and gap(first - 1) == " " and words[first - 1][2] in ("A", "a", "I", "i"):
                break
            first -= 1
        while last + 1 < n:
            g = gap(last)
            if part(last + 1) and g in (" ", "-", "  ", "\u00a0"):
                last += 1
            elif kinds[last + 1] == "I" and g == " " and last + 2 < n and part(last + 2) and gap(last + 1) in (". ", " ", "."):
                last += 2
            elif kinds[last + 1] == "I" and g in (". ", ".") and kinds[last] == "I":
                last += 1
            elif g == ", " and first == last and kind(last) == "surname" and kind(last + 1) == "given":
                last += 1
            elif g == ", " and kind(last) == "surname" and kind(last + 1) == "given" and all(kind(x) == "surname" for x in range(first, last + 1)):
                last += 1
            elif kinds[last + 1] is None and g in (" ", "-") and _capital(words[last + 1][2]) and names.like(words[last + 1][2]) and kind(last) == "given":
                last += 1
            else:
                break
        a, b = words[first][0], words[last][1]
        n_sure, n_like = sum(map(sure, range(first, last + 1))), sum(map(part, range(first, last + 1)))
        # endings alone tell a person where two of them or an initial stand together, or after a title or label
        if n_sure:
            person = last > first or _stands_alone(text, a, b)
        else:
            person = n_like > 1 or last > first or (_capital(words[first][2]) and bool(_ANNOUNCED.search(text, max(0, a - 24), a)) and _stands_alone(text, a, b))
        if person:
            if last + 1 < n and kinds[last + 1] == "I" and gap(last) == " " and text[words[last + 1][1] : words[last + 1][1] + 1] == "." and kind(last) == "given" and first == last:
                b = words[last + 1][1] + 1
            if taken.free(a, b):
                taken.add(a, b, "person")
        i = last + 1


def _capital(w: str) -> bool:
    return w[0].isupper() or NameParts._indic(w)


#: Titles and labels right before a person.
_ANNOUNCED = re.compile(r"(?:\b(?:mr|mrs|ms|dr|shri|smt|sri|km|prof|miss)\b\.?|(?:श्री|श्रीमती|कुमारी|डॉ)\.?|\b(?:name|narne|holder|front|back)\b\s*:?|\b[SDWC]/O\b)\s*$", re.I)
_PLACE_AFTER = re.compile(rf"\s+(?:{_WAY}|School|Tank|Market|Temple|Bench|Unit|Annex|Board|Hall|Room|Yard|Crew|Desk|Squad|Shift|Circle|font|filter|model)\b", re.I)


def _stands_alone(text: str, a: int, b: int) -> bool:
    """A single name part is a person unless it names a place or a thing."""
    return not _PLACE_AFTER.match(text, b)


def find(text: str, names: NameParts) -> list[Span]:
    """``(start, end, kind)`` of each mention, in order, none overlapping another."""
    taken = Taken((a, b, "email") for a, b in _emails(text))
    at = 0
    while _CODE.search(text, at) and (m := ADDRESS.search(text, at)):
        a, b = m.span()
        inner = _INNER_NUMBER.search(text, a, m.end() - 7)
        if inner or not taken.free(a, b) or text.count("\n", a, b) > 2:
            at = a + 1
            continue
        taken.add(a, b, "address")
        at = b
    _numbers(text, taken)
    _persons(text, names, taken)
    return taken.spans


class Feistel:
    """A keyed permutation of the numbers below ``size``: a balanced Feistel network over the next even number of
    bits, walked until the value is below ``size`` again."""

    ROUNDS = 8

    def __init__(self, key: bytes, tweak: str, size: int):
        self.key, self.tweak, self.size = hashlib.blake2b(key).digest(), tweak.encode(), size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask, self.bytes = (1 << self.half) - 1, (self.half + 7) // 8

    def _f(self, r: int, x: int) -> int:
        h = hashlib.blake2b(b"%d|%b|%d" % (r, self.tweak, x), key=self.key, digest_size=self.bytes).digest()
        return int.from_bytes(h, "big") & self.mask

    def permute(self, x: int) -> int:
        if self.size < 2:
            return x
        while True:
            a, b = x >> self.half, x & self.mask
            for r in range(self.ROUNDS):
                a, b = b, a ^ self._f(r, b)
            x = (a << self.half) | b
            if x < self.size:
                return x

    def inverse(self, x: int) -> int:
        if self.size < 2:
            return x
        while True:
            a, b = x >> self.half, x & self.mask
            for r in reversed(range(self.ROUNDS)):
                a, b = b ^ self._f(r, a), a
            x = (a << self.half) | b
            if x < self.size:
                return x


FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900 to 2099


def _as_digits(c: str) -> str:
    return str(ord(c) - 0x966) if "\u0966" <= c <= "\u096f" else c


#: Digits of a phone number without country, area or trunk prefix, as they come last.
SUBSCRIBER = 10
_DOTS = re.compile(_DOT, re.I)


@lru_cache(4096)
def _network(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def canonical(value: str, kind: str) -> str:
    """What equal values have in common however they are written: an e-mail without disguise, name parts in alphabetical
    order, letters and digits of an address."""
    low = value.lower()
    if kind == "email":
        return _DOTS.sub(".", _AT_SIGN.sub("@", low))
    if kind == "person":
        return " ".join(sorted(x for x in re.split(r"[\W_]+", low) if x)) if low.isascii() else " ".join(sorted(_WORD.findall(low)))
    return re.sub(r"[^\w\u0900-\u097f]+|_", "", low)


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """``value`` with its digits and letters permuted within their format: separators, letter case and script of the
    digits stay, and equal digits and letters give equal pseudonyms however they are separated. Of a phone number the last ten
    digits are permuted, so a number is the same with and without its country or trunk prefix. Only for values of digits and
    Latin letters (numbers); others get a keyed tag of 128 bits."""
    if kind in ("phone", "id_number"):
        plain = "".join(_as_digits(c) for c in value if c.isalnum()).upper()
        head = plain[:-SUBSCRIBER] if kind == "phone" else ""
        plain = plain[len(head) :]
        shape = re.sub("[A-Z]", "A", re.sub("[0-9]", "9", plain))
        if re.fullmatch("[A9]+", shape):
            size, x = 1, 0
            for c in plain:
                base, v = (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - 65)
                size, x = size * base, x * base + v
            x = _network(key, f"{kind}|{shape}", size).permute(x)
            out = []
            for s in reversed(shape):
                x, v = divmod(x, 10 if s == "9" else 26)
                out.append(chr(48 + v) if s == "9" else chr(65 + v))
            made = iter([*head, *reversed(out)])
            return "".join((lambda p: chr(0x966 + int(p)) if "\u0966" <= c <= "\u096f" else p.lower() if c.islower() else p)(next(made)) if c.isalnum() else c for c in value)
    return hmac.digest(key, f"{kind}|{canonical(value, kind)}".encode(), "sha256").hex()[:32]


_DATE = re.compile(r"(?<![\d/.\-])(?:(\d{1,2})([/.\-])(\d{1,2})\2(\d{4})|(\d{4})-(\d{2})-(\d{2}))(?![\d/.\-]*\d)")


def pseudonym_date(value: str, key: bytes) -> str | None:
    """A valid date of 1900 to 2099 as another day of that span in the same order and with the same separators;
    None if it isn't one. Days and months keep two digits or one as the written ones allow."""
    m = _DATE.fullmatch(value)
    if not m:
        return None
    y, mo, d = (m[4], m[3], m[1]) if m[1] else (m[5], m[6], m[7])
    try:
        day = datetime.date(int(y), int(mo), int(d)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + Feistel(key, "date", DAYS).permute(day))
    if not m[1]:
        return new.isoformat()
    two = "02d" if len(m[1]) == 2 and len(m[3]) == 2 else "d"
    return f"{new.day:{two}}{m[2]}{new.month:{two}}{m[2]}{new.year:04d}"


def mentions(text: str, names: NameParts, key: bytes | None, dates: bool = False) -> list[tuple[int, int, str, str | None]]:
    """``(start, end, kind, pseudonym)`` of each mention in order, with ``dates`` of each valid date as well. Without a key
    there are no pseudonyms."""
    spans = find(text, names)
    if dates:
        own = Taken(spans)
        spans = sorted(spans + [(*m.span(), "date") for m in _DATE.finditer(text) if own.free(*m.span()) and pseudonym_date(m[0], key)])
    made = {"date": lambda v, _, k: pseudonym_date(v, k)}
    return [(a, b, kind, None if key is None else made.get(kind, pseudonym)(text[a:b], kind, key)) for a, b, kind in spans]


def replaced(text: str, found: list[tuple[int, int, str, str | None]]) -> str:
    out, at = [], 0
    for a, b, kind, new in found:
        out += [text[at:a], f"[{kind.upper()}:{new}]"]
        at = b
    return "".join(out) + text[at:]


def redact(text: str, names: NameParts, key: bytes, dates: bool = False) -> str:
    """The text with ``[KIND:pseudonym]`` in place of each mention, and with ``dates`` ``[DATE:...]`` for each valid
    date; all other characters stay."""
    return replaced(text, mentions(text, names, key, dates))


#: Largest lexicon: it goes out with the tasks, so its size is checked.
MOST_PARTS = 200_000


def _lexicon(rows: DataFrame) -> tuple[tuple[str, str], ...]:
    """The lexicon is a fixed table of known name parts; it is read to the driver if it has at most MOST_PARTS rows."""
    known = rows.select("token", "kind").distinct().limit(MOST_PARTS + 1).collect()
    if len(known) > MOST_PARTS:
        raise ValueError(f"the lexicon has more than {MOST_PARTS} name parts")
    return tuple(sorted((r.token, r.kind) for r in known if r.token and r.kind))


_LEARNED: dict[int, NameParts] = {}


def _parts(known: tuple[tuple[str, str], ...]) -> NameParts:
    """What a lexicon teaches; a Python worker learns it once."""
    at = hash(known)
    if at not in _LEARNED:
        _LEARNED.clear()
        _LEARNED[at] = NameParts(known)
    return _LEARNED[at]


def scan_documents(docs: DataFrame, lexicon: DataFrame, key: bytes | None = None, dates: bool = False) -> DataFrame:
    """``(doc_id, kind, mention, start, end, pseudonym)``, one row per mention of each row of ``docs (doc_id, text)``; offsets
    are in characters. Null and empty texts have none. Whole texts are searched whatever their length."""
    if dates and key is None:
        raise ValueError("dates are told by their pseudonyms, which need a key")
    known = docs.sparkSession.sparkContext.broadcast(_lexicon(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _parts(known.value)
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for a, z, kind, new in mentions(text, names, key, dates) if text else ():
                    for c, v in zip(cols, (i, kind, text[a:z], a, z, new)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "kind", "mention", "start", "end", "pseudonym"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id BIGINT, kind STRING, mention STRING, start BIGINT, end BIGINT, pseudonym STRING")


def find_mentions(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(doc_id, kind, mention, start, end)``: ``scan_documents`` without pseudonyms."""
    return scan_documents(docs, lexicon).drop("pseudonym")


def redact_documents(docs: DataFrame, lexicon: DataFrame, key: bytes, dates: bool = False) -> DataFrame:
    """``(doc_id, text)`` with typed placeholders; null texts stay null. Dates are left as they are unless asked for. Who
    knows the key can turn pseudonyms of numbers and dates back, so there is no default."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    known = docs.sparkSession.sparkContext.broadcast(_lexicon(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _parts(known.value)
        for b in batches:
            new = [t and redact(t, names, key, dates) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=["doc_id", "text"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id BIGINT, text STRING")
