"""Golden tables of the term rules and the stemmer."""

import pytest

from lodestone.functions.stemming import stem_word
from lodestone.functions.terms import TermParser, clean, is_number
from lodestone.operators.stop_words import STOP_WORDS

CASES = [
    ("10,123", ["10.123K"]),
    ("1010.56", ["1.01056K"]),
    ("10,123,000,000", ["10.123B"]),
    ("5", []),
    ("999.5", []),
    ("-55", []),
    ("55 Thousand", ["55K"]),
    ("55 Million", ["55M"]),
    ("55 Billion", ["55B"]),
    ("55 million", ["55", "million"]),
    ("55 billion", ["55000 M Dollars"]),
    ("7 Trillion", ["7000B"]),
    ("$450,000", ["450,000 Dollars"]),
    ("$450,000,000", ["450 M Dollars"]),
    ("1,000,000 Dollars", ["1 M Dollars"]),
    ("1.7320 Dollars", ["1.7320 Dollars"]),
    ("$100 million", ["100 M Dollars"]),
    ("$100 billion", ["100000 M Dollars"]),
    ("$1.732 million", ["1.732 M Dollars"]),
    ("$0.5 million", [" Dollars"]),
    ("20.6m Dollars", ["20.6 M Dollars"]),
    ("100bn Dollars", ["100000 M Dollars"]),
    ("1 million U.S. dollars", ["1 M Dollars"]),
    ("2 billion U.S. dollars", ["2000 M Dollars"]),
    ("1 trillion U.S. dollars", ["1000000 M Dollars"]),
    ("22 3/4 Dollars", ["22 3/4 Dollars"]),
    ("35 3/4", ["35 3/4"]),
    ("6%", []),
    ("10.6 percent", []),
    ("10.6 percentage", []),
    ("MAY 1994", ["1994-05"]),
    ("JUNE 4", ["06-04"]),
    ("June 16", ["06-16"]),
    ("16 June", ["06-16"]),
    ("Feb 4", ["feb^"]),
    ("12 marched", ["03-12"]),
    ("Between 18 and 24", ["18", "24"]),
    ("pop-pop-pop", ["pop-pop-pop"]),
    ("10-part", ["10-part"]),
    ("15-15", ["15-15"]),
    ("x-ray", []),
    ("U.S.A.", ["u.s.a^"]),
    ("U.S.", ["u.s^"]),
    ("alpha.beta.gamma", ["alpha", "beta", "gamma"]),
    ("grew.123", ["123", "123"]),
    ('"alpha beta gamma"', ["alpha beta gamma", "alpha", "beta", "gamma"]),
    ("Ashley Cummins Brittingham", ["ashley^", "ashley cummins^", "cummins^", "ashley cummins brittingham^", "brittingham^"]),
    ("Ashley Cummins Brittingham, said", ["ashley^", "ashley cummins^", "cummins^", "ashley cummins brittingham^", "brittingham^", "ashley cummins brittingham^"]),
    ("BLA BLA June 16", ["bla^", "bla bla^", "bla^", "bla bla^", "06-16"]),
    ("aren't", ["aren"]),
]


@pytest.mark.parametrize(("text", "terms"), CASES)
def test_rule(text, terms):
    assert [w + "^" * u for w, u in TermParser(STOP_WORDS).parse(text)] == terms


def test_between_without_its_stop_word():
    assert TermParser(set(STOP_WORDS) - {"between"}).parse("Between 18 and 24") == [("between 18 and 24", True)]


@pytest.mark.parametrize(("token", "cleaned"), [("(-5)", "-5"), ("-55,", "-55,"), ("..a,b..", "a,b"), ("--", ""), ("x", "x")])
def test_clean(token, cleaned):
    assert clean(token) == cleaned


def test_numbers():
    assert [is_number(x) for x in ("1,000", "-1.5", "-", "", ",", "1a", "1.2.3")] == [True, True, False, False, False, False, True]


STEMS = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre disabled disabl matting mat mating mate meeting meet milling mill messing mess meetings meet at at relational relat conditional condit vietnamization vietnam hopeful hope adoption adopt controlling control sky sky happy happi".split()


@pytest.mark.parametrize(("word", "stem"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stem(word, stem):
    assert stem_word(word) == stem
