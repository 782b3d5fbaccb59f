"""Full term rules: numbers, prices, dates, phrases and runs of capitalised words.

What a token can begin is found once for each distinct token. Where it can begin something, the rules of
that kind are tried in turn: tables of (words, pattern, term). All other tokens stand for themselves. Rules look
ahead and take a varying number of tokens, so they run over a document's tokens in an Arrow batch; nothing is
shuffled for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.functions.stemming import stem_term
from lodestone.functions.text import DROPPED, EDGES, MONTHS, REJECTED, SEPARATORS

# Fixed values of the term rules.
#: Month names as dates have them; "fab" stands where one expects "feb".
MONTH_WORDS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|fab|mar|apr|jun|jul|aug|sep|oct|nov|dec"
#: Names that end a capitalised run when a number follows.
RUN_MONTHS = frozenset(x.capitalize() for m in MONTHS for x in (m, m[:3]))
#: Characters inside a token that make it a joint one, and those that part it.
JOINED_BY = "?/\"\\':)(`*[}|{=&@~%+^;]#!,.<>"
PARTED_BY = "/\"\\`:?)*(|@;&%!=~+^}{#[],'.<>"
#: Words of the longest phrase.
RUN = 6
MONTH_DAY = re.compile(f"(?:{MONTH_WORDS}) (31|30|[0-2][0-9]|[0-9])$")
MONTH_YEAR = re.compile(f"(?:{MONTH_WORDS}) ([1-2][0-9][0-9][0-9]|[0-9][0-9][0-9] )$")
DAY_MONTH = re.compile(f"(31|30|[0-2][0-9]|[0-9]) (?:{MONTH_WORDS})")
BETWEEN = re.compile("[0-9]+ ?and ?[0-9]+")
US_DOLLARS = re.compile("[0-9]+ (million|billion|trillion) U.S dollars")
FRACTION_DOLLARS = re.compile("[0-9]* [0-9]*/[0-9]* Dollars")
FRACTION = re.compile("[0-9]* [0-9]*/[0-9]*$")
AMOUNT = re.compile(r"\$[0-9]+\S* million$|^\S* billion$")
SHORT_DOLLARS = re.compile("[0-9]+(m|bn) Dollars")
SCALED = re.compile("[0-9]+ (Thousand|Million|Billion|Trillion|percent|percentage|Dollars)")
LETTERS_OF_AMOUNTS = re.compile("[mbn]")
DIGITS = re.compile("[0-9]*")
#: A token of more characters than this may be a joint one; of its first part so many make a term.
JOINT_OVER, HEAD_FROM = 5, 3

_SPLIT = re.compile("[" + re.escape(SEPARATORS) + "]")
_PARTS = re.compile("[" + re.escape(PARTED_BY) + "]")
_PARTS_OF_INITIALS = re.compile("[" + re.escape(PARTED_BY.replace(".", "")) + "]")
_JOINT = re.compile("[" + re.escape(JOINED_BY) + "]")
_REJECTED = re.compile("[" + re.escape(REJECTED) + "]")


def tokens_of(text: str) -> list[str]:
    return [t for t in _SPLIT.split(text.replace("\n", " ")) if t]


def clean(token: str) -> str:
    a, b = 0, len(token)
    while a < b:
        front, back = token[a] in EDGES, token[b - 1] in EDGES
        if front and token[a] == "-" and b - a > 1 and token[a + 1].isdecimal():
            break
        if not (front or back):
            break
        a += front
        b -= back and b > a
    return token[a:b]


def is_number(token: str) -> bool:
    bare = token.replace(",", "")
    digits = bare[1:] if bare[:1] == "-" else bare
    return bool(digits) and all(c == "." or c.isdecimal() for c in digits)


def _double(v: float) -> str:
    """A double as the JVM prints it, whole 32-bit numbers without a point."""
    if v == int(v) and abs(v) <= 2147483647:
        return str(int(v))
    if 1e-3 <= abs(v) < 1e7:
        return repr(v)
    mantissa, exponent = f"{v!r}".split("e") if "e" in repr(v) else (None, None)
    if mantissa is None:
        exponent = len(str(int(abs(v)))) - 1 if abs(v) >= 1 else -len(re.match(r"0\.(0*)", repr(abs(v)))[1]) - 1
        digits = repr(abs(v)).replace(".", "").strip("0") or "0"
        mantissa = ("-" if v < 0 else "") + digits[0] + "." + (digits[1:] or "0")
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{int(exponent)}"


def _parse(number: str) -> float:
    try:
        return float(number.replace(",", ""))
    except ValueError:
        return 0.0


NO_TERM = "!"


def number_term(token: str) -> str:
    v = _parse(token)
    for low, high, unit, suffix in ((0, 999, 1, ""), (1e3, 1e6 - 1, 1e3, "K"), (1e6, 1e9 - 1, 1e6, "M"), (1e9, float("inf"), 1e9, "B")):
        if low <= v <= high:
            return _double(v / unit) + suffix
    return NO_TERM


def price_term(v: float, written: str) -> str:
    if 0 <= v <= 1e6 - 1:
        return f"{written.replace('$', '')} Dollars"
    return f"{_double(v / 1e6)} M Dollars" if v >= 1e6 else NO_TERM


def _month_of(word: str) -> str | None:
    for k, name in enumerate(MONTHS, 1):
        if word[:3] == name[:3]:
            return f"{k:02d}"
    return None


class Rule(NamedTuple):
    """So many words that become one term if their text has the pattern; an empty term means that they don't."""

    words: int
    pattern: re.Pattern
    term: Callable[[list[str]], str]
    folded: bool = False
    #: Whether the words are read as they stand, uncleaned.
    raw: bool = False


def _written(w: list[str]) -> str:
    return " ".join(w)


def _month_and(w: list[str], year: bool) -> str:
    month = _month_of(w[0])
    return "" if not month else f"{w[1]}-{month}" if year else f"{month}-{w[1].zfill(2)}"


def _day_and_month(w: list[str]) -> str:
    month = _month_of(w[1].lower())
    return f"{month}-{w[0].zfill(2)}" if month and w[0][0] != "$" and w[0][-1] != "%" else ""


def _in_millions(number: str, factor: float) -> str:
    return f"{_double(_parse(number) * factor)} M Dollars"


def _us_dollars(w: list[str]) -> str:
    if w[1] == "million":
        return f"{w[0]} M Dollars"
    return _in_millions(w[0], 1e3 if w[1] == "billion" else 1e6) if is_number(w[0]) else ""


def _amount(w: list[str]) -> str:
    number = clean(w[0].replace("$", ""))
    return price_term(_parse(number) * {"million": 1e6, "billion": 1e9}[w[1]] if is_number(number) else 0.0, "")


def _short_dollars(w: list[str]) -> str:
    whole, part = w[0].replace("bn", ""), w[0].replace("m", "")
    if w[0].endswith("bn"):
        return price_term(_parse(whole) * 1e9 if DIGITS.fullmatch(whole) else 0.0, "")
    return price_term(_parse(part) * 1e6 if w[0].endswith("m") and is_number(part) else 0.0, "")


SCALES: dict[str, Callable[[str], str]] = {
    "thousand": "{}K".format,
    "million": "{}M".format,
    "billion": "{}B".format,
    "trillion": lambda a: number_term(repr(_parse(a) * 1e12)),
    "percent": "{}%".format,
    "percentage": "{}%".format,
    "dollars": lambda a: price_term(_parse(a), a),
}


def _scaled(w: list[str]) -> str:
    return SCALES[w[1].lower()](w[0]) if is_number(w[0]) and w[1].lower() in SCALES else ""


def _alone(token: str) -> str:
    price = token.replace("$", "")
    if token[:1] == "$" and is_number(price):
        return price_term(_parse(price), token)
    return number_term(token) if is_number(token) else token


TWO = (
    Rule(2, FRACTION, _written),
    Rule(2, AMOUNT, _amount),
    Rule(2, SHORT_DOLLARS, _short_dollars),
    Rule(2, SCALED, _scaled),
    Rule(2, DAY_MONTH, _day_and_month, folded=True),
)
#: By what a token can begin, in the order in which the kinds are tried.
RULES: dict[str, tuple[Rule, ...]] = {
    "range": (Rule(4, BETWEEN, _written, raw=True),),
    "month": (Rule(2, MONTH_DAY, lambda w: _month_and(w, False), folded=True), Rule(2, MONTH_YEAR, lambda w: _month_and(w, True), folded=True)),
    "sign": TWO,
    "number": (Rule(4, US_DOLLARS, _us_dollars), Rule(3, FRACTION_DOLLARS, _written), *TWO),
}


def kinds_of(bare: str) -> tuple[str, ...]:
    """What a cleaned token can begin."""
    number = is_number(bare)
    digits = LETTERS_OF_AMOUNTS.sub("", bare)
    found = {
        "range": bare in ("Between", "between"),
        "month": not number and _month_of(bare.lower()) is not None,
        "sign": bare[:1] in ("$", "%"),
        "number": number or is_number(digits) or DIGITS.fullmatch(clean(digits)) is not None,
    }
    return tuple(k for k in RULES if found[k])


class Token(NamedTuple):
    raw: str
    bare: str
    number: bool
    short: bool
    #: The word if it is capitalised and of two characters at least.
    capital: str
    stop: bool
    kinds: tuple[str, ...]
    #: (first part or nothing, the rest) of a joint token.
    joint: tuple[str, str] | None


#: Distinct tokens that a task keeps.
MOST_TOKENS = 300_000


class TermParser:
    """Terms of a text, in the order in which the rules emit them, as (term, capitalised)."""

    def __init__(self, stop_words: Iterable[str], stemming: bool = False) -> None:
        self.stop = frozenset(stop_words)
        self.stemming = stemming
        self.known: dict[str, Token] = {}

    def token(self, raw: str) -> Token:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) >= MOST_TOKENS:
                self.known.clear()
            bare = clean(raw)
            number, low = is_number(bare), bare.lower()
            short = not number and min(len(raw), len(bare)) < 2
            capital = bare if len(bare) > 1 and bare[0].isupper() else ""
            stop = low != "may" and low in self.stop
            found = self.known[raw] = Token(raw, bare, number, short, capital, stop, kinds_of(bare), None if short else self._joint(raw, bare))
        return found

    @staticmethod
    def _joint(raw: str, bare: str) -> tuple[str, str] | None:
        cased = bare[0].isalpha() and bare[0].lower() != bare[0].upper()
        if len(raw) <= JOINT_OVER or not cased or not _JOINT.search(bare):
            return None
        parts = list(filter(None, _PARTS.split(bare)))
        if any(len(p) == 1 and p.isupper() for p in parts):  # initials keep their points
            parts = list(filter(None, _PARTS_OF_INITIALS.split(bare)))
        return clean(parts[0]) if len(parts[0]) >= HEAD_FROM else "", ".".join(parts[1:])

    @staticmethod
    def stands(term: str) -> bool:
        """Neither too short nor with a rejected character or a part between hyphens of one character."""
        if len(term) < 2 or _REJECTED.search(term):
            return False
        return "-" not in term or all(len(p) != 1 for p in term.split("-"))

    @staticmethod
    def quoted(t: list[Token], i: int) -> str:
        """A phrase in quotation marks that begins here, of RUN tokens at most."""
        if t[i].raw[:1] == '"' and t[i].raw[-1:] != '"':
            last = next((j for j in range(i + 1, min(len(t), i + RUN)) if t[j].raw[-1:] == '"'), None)
            return "" if last is None else clean(" ".join(x.raw for x in t[i : last + 1]))
        return ""

    @staticmethod
    def capitals(t: list[Token], i: int) -> tuple[list[str], int]:
        """Terms of a run of two capitalised words or more, and its length: every growing phrase and every word; the phrase again where another word ends the run."""
        if i + 1 >= len(t) or not t[i].capital or not t[i + 1].capital:
            return [], 0
        following = [*t[i : i + RUN + 1], None]
        ends = (k for k, x in enumerate(following[:RUN]) if x is None or not x.capital or (x.raw in RUN_MONTHS and following[k + 1] and is_number(following[k + 1].raw)))
        n = next(ends, RUN)
        phrases = [clean(" ".join(x.capital for x in t[i : i + k])) for k in range(n + 1)]
        out = [w for k in range(n) for w in ([phrases[k + 1]] if " " in phrases[k + 1] else []) + [t[i + k].capital]]
        by_word = n < RUN and i + n < len(t)
        return out + [phrases[n]] * by_word, n

    @staticmethod
    def ruled(t: list[Token], i: int) -> tuple[str, int]:
        """The term that begins here and how many tokens it takes; none for "may" that begins no date, unless it is the last word."""
        lead = t[i]
        for kind in lead.kinds:
            for rule in RULES[kind]:
                if i + rule.words <= len(t):
                    words = [lead.bare, *(x.raw if rule.raw else x.bare for x in t[i + 1 : i + rule.words])]
                    if rule.folded:
                        words = [w.lower() for w in words]
                    if rule.pattern.search(" ".join(words)) and (term := rule.term(words)):
                        return term, rule.words
            if kind == "month" and lead.bare == "may" and i + 1 < len(t):
                return "", 1
        return _alone(lead.bare), 1

    def raw_terms(self, text: str) -> Iterator[str]:
        t = [self.token(w) for w in tokens_of(text)]
        i = 0
        while i < len(t):
            token = t[i]
            if token.short:
                i += 1
            elif token.joint:
                head, rest = token.joint
                t[i] = self.token(rest)
                if head:  # what stands leaves the rest to be read again
                    term, used = self.ruled(t, i) if is_number(rest) else (head, 1)
                    if self.stands(term):
                        yield term
                        used -= 1
                    i += used
            else:
                if phrase := self.quoted(t, i):
                    yield phrase
                run, used = self.capitals(t, i)
                if used:
                    yield from run
                elif token.stop:
                    used = 1
                else:
                    term, used = self.ruled(t, i) if token.kinds else (token.bare, 1)
                    if self.stands(term):
                        yield term
                i += used

    def parse(self, text: str | None) -> list[tuple[str, bool]]:
        out = []
        for term in self.raw_terms(text or ""):
            if not term:
                continue
            capital = term[0].isupper()
            term = stem_term(term) if self.stemming else term
            if term.lower() in self.stop or term.lower() in DROPPED or not term:
                continue
            out.append((term.lower() if capital else term, capital))
        return out


TERMS = "array<struct<pos:int,term:string,is_upper:boolean>>"


def with_terms(df: DataFrame, text_col: str, stop_words: Iterable[str], stemming: bool = False, out: str = "terms") -> DataFrame:
    """Adds the terms of a text column as an array of (pos, term, is_upper); null texts have none."""
    stop = frozenset(stop_words)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], *T.StructType.fromDDL(f"`{out}` {TERMS}").fields])
    names = [f.name for f in df.schema.fields if f.name != out]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("term", pa.string()), ("is_upper", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = TermParser(stop, stemming)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                made = [[{"pos": p, "term": w, "is_upper": u} for p, (w, u) in enumerate(parser.parse(x))] for x in batch.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, kind)], names=[*names, out])

    return df.mapInArrow(run, schema)
