"""Ordinary numbers stay, phone numbers go: precision and recall of the personal data model."""

import random

import pytest

from leadframe.llm import pii

NUMBERS = [
    "978-3-16-148410-0", "10 20 30 40 50 60", "48.8566 2.3522", "1 234 567 890", "2024-01-15 10", "2019 2020 2021 2022", "1999-2003",
    "1999 - 2003", "12 345 678 901", "3.14159 2.71828", "2024-01-15", "15.01.2024 16.01.2024", "100 200 300 400", "1 2 3 4 5 6 7 8 9",
    "12.5 13.7 14.2 15.9 16.1", "979-0-2600-0043-8", "2023 01 15", "1871-1914", "-12 -15 -20 -30 -45", "1.234.567.890",
    "40 000 000", "0 1 2 3 4 5 6 7 8 9", "31/12/2024 01/01/2025", "5000 6000 7000 8000", "12 000 000 - 15 000 000",
]
PHONES = [
    "06 12 34 56 78", "0049 30 12 34 56 78", "00 33 6 12 34 56 78", "(06) 12 34 56 78", "(269) 555-3296", "269-555-3296", "0269 555 3296",
    "030 1234 5678", "1-800-555-0199", "020 7946 0958", "0151 23456789",
]


@pytest.fixture(scope="module")
def learned(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("number", NUMBERS)
def test_ordinary_numbers_stay(learned, number):
    for weights in (pii.PRIOR, learned):
        for text in (number, f"of {number} in all", f"see {number}; and {number}.", f"a | {number} | b"):
            assert pii.all_spans(text, weights) == ([], []), text


@pytest.mark.parametrize("number", PHONES)
def test_phone_numbers_are_found_whole(learned, number):
    for weights in (pii.PRIOR, learned):
        found = pii.all_spans(f"call {number} now", weights)[1]
        assert found == [("phone", 5, 5 + len(number))], (found, weights["phone"])


def test_a_cue_makes_an_ambiguous_number_a_phone(learned):
    """Nine digits in threes are a count, or a phone behind a word that says so."""
    for text in ("tel. 612 34 56 78", "phone: 612 34 56 78", "Fax 612 34 56 78"):
        assert [k for k, _, _ in pii.all_spans(text, learned)[1]] == ["phone"]


def test_precision_and_recall_on_mixed_prose(learned):
    rng = random.Random(14)
    hit = wrong = 0
    for _ in range(400):
        phone = rng.random() < 0.5
        number = rng.choice(PHONES if phone else NUMBERS)
        text = f"{'the figures of ' * rng.randint(0, 2)}{number}{rng.choice([' were', '', '. Then', ', as'])} noted"
        found = pii.all_spans(text, learned)[1]
        whole = [(k, text[a:b]) for k, a, b in found] == [("phone", number)]
        hit += phone and whole
        wrong += not phone and bool(found)
    assert wrong == 0 and hit > 180


def test_base_spans_keep_their_shape_whatever_the_features(learned):
    text = "+49 2024-01-15 1 and +33 6 12 34 56 78 and 10.0.0.1"
    base, spans = pii.all_spans(text, learned)
    assert set(base) <= set(spans) and len(base) == 3
