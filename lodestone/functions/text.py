"""Text normalisation as column expressions: everything that needs no state between tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the term rules.
#: Characters at which a text is cut into tokens.
SEPARATORS = "\\`:)?*(|+@#^;!&=}{[]'<> "
#: Characters that are stripped from both ends of a token.
EDGES = ",}{\\/><()':;\"[]&.?|`*+!~@#^- "
#: A term with one of these is rejected.
REJECTED = "?\"\\':)(`*[}|{=&@~%$+^;]#!<>"
#: Always dropped, besides stop words.
DROPPED = ("xx", "page")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def char_class(chars: str) -> str:
    """A character class of a regular expression in Java's and RE2's syntax."""
    return "[" + "".join("\\" + c if c in "\\[]^-&{}()*+?|.~#" else c for c in chars) + "]"


SPLIT = char_class(SEPARATORS)
EDGE = char_class(EDGES)
REJECT = char_class(REJECTED)
NUMBER = r"^-?[\p{Nd}.]+$"


def tokenize(text: Column) -> Column:
    """Tokens of a text; lines are joined by blanks first."""
    return F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), SPLIT), lambda t: t != "")


def clean_token(token: Column) -> Column:
    """Strips EDGES from both ends; from a negative number on nothing is stripped."""
    negative = F.regexp_extract(token, f"^{EDGE}*?(-[0-9].*)$", 1)
    return F.when(token.contains("-") & token.rlike(f"^{EDGE}*-[0-9]"), negative).otherwise(F.trim(token, F.lit(EDGES)))


def is_number(token: Column) -> Column:
    return F.regexp_replace(token, ",", "").rlike(NUMBER)


def is_capital(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}")


def long_enough(raw: Column, cleaned: Column) -> Column:
    return ((F.length(raw) >= 2) & (F.length(cleaned) >= 2)) | is_number(cleaned)


def hyphens_ok(term: Column) -> Column:
    """No part between hyphens is shorter than two characters."""
    parts = F.filter(F.split(term, "-"), lambda p: p != "")
    return ~term.contains("-") | ~F.exists(parts, lambda p: F.length(p) < 2)


def accepted(term: Column) -> Column:
    return (F.length(term) >= 2) & hyphens_ok(term) & ~term.rlike(REJECT)


def all_upper(token: Column) -> Column:
    """No lower-case letter from a to z."""
    return ~token.rlike("[a-z]")


def is_expression(token: Column) -> Column:
    return token == "U.S."


def has_initial(parts: Column) -> Column:
    return F.exists(parts, lambda p: p.rlike(r"^\p{Lu}$"))


def display(term: Column, is_entity: Column) -> Column:
    return F.when(is_entity, F.upper(term)).otherwise(term)


def _value(v: Column) -> Column:
    """A double as text, without .0 where it is a whole number of 32 bits."""
    whole = (v == F.floor(v)) & (F.abs(v) <= 2147483647)
    return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def number_term(token: Column) -> Column:
    """A plain number in thousands (K), millions (M) or billions (B); null in the gaps between and for negatives. Unparsable: 0."""
    v = F.coalesce(F.regexp_replace(token, ",", "").try_cast("double"), F.lit(0.0))
    return (
        F.when((v >= 0) & (v <= 999), _value(v))
        .when((v >= 1e3) & (v <= 1e6 - 1), F.concat(_value(v / 1e3), F.lit("K")))
        .when((v >= 1e6) & (v <= 1e9 - 1), F.concat(_value(v / 1e6), F.lit("M")))
        .when(v >= 1e9, F.concat(_value(v / 1e9), F.lit("B")))
    )


def price_term(amount: Column) -> Column:
    """A price in dollars: as written below a million, in millions above; null in the gap and for what is no number."""
    plain = F.replace(amount, F.lit("$"), F.lit(""))
    v = F.when(is_number(plain), F.regexp_replace(plain, ",", "").try_cast("double"))
    return F.when((v >= 0) & (v <= 1e6 - 1), F.concat(plain, F.lit(" Dollars"))).when(v >= 1e6, F.concat(_value(v / 1e6), F.lit(" M Dollars")))


def month_number(token: Column) -> Column:
    """Two digits of the month whose first three letters begin the token; null if none."""
    start = F.lower(F.substring(token, 1, 3))
    out = F.when(F.lit(False), F.lit(""))
    for k, name in enumerate(MONTHS, 1):
        out = out.when(start == name[:3], F.lit(f"{k:02d}"))
    return out


def day_term(month: Column, day: Column) -> Column:
    return F.concat(month_number(month), F.lit("-"), F.lpad(day, 2, "0"))


def year_term(month: Column, year: Column) -> Column:
    return F.concat(year, F.lit("-"), month_number(month))


def population_text(people: Column) -> Column:
    """Above a million in millions with two digits, else as it is."""
    millions = F.round(people.cast("double") / 1e6, 2)
    return F.when(people > 1_000_000, F.concat(F.lit("M"), millions.cast("string"))).otherwise(people.cast("string"))
