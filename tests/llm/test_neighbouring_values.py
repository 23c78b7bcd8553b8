"""Personal data that stands right beside other values, numbers and words."""

import re

import pytest

from tests.conftest import SMALL
from vacantia.llm import pseudonyms, queries

VALUES = {
    "mail": "jo.doe@mail.example.com", "iban": "DE89 3704 0044 0532 0130 00", "date": "2021-03-04", "address": "190.137.223.204",
    "ssn": "123-45-6789", "card": "4111 1111 1111 1111", "phone": "+1 (826) 555-4081"}
# kind, value, text after it
PHONES = [("phone", "+1 (826) 555-4081", " 190.137.223.204"), ("phone", "+1 (559) 555-3817", " 42 times"),
          ("phone", "+49 30 1234567", " 190.137.223.204"), ("phone", "+15595553817", " 42"), ("phone", "+49 30 1234567", " 12/31/1999")]

CARDS = [("card", "4111 1111 1111 1111", " 12/25"), ("card", "4111111111111111", " 123"), ("card", "3782 822463 10005", " 2024"),
         ("card", "4111 1111 1111 1111", " 12/31/1999"), ("iban", "BE68 5390 0754 7034", " AND"),
         ("iban", "BE68 5390 0754 7034", " THEM ALL"), ("iban", "DE89370400440532013000", " 2021 and")]


def spans(text):
    return {(text[a:b], kind) for a, b, kind, _ in pseudonyms.found(text, b"key")}


@pytest.mark.parametrize("kind, value, after", PHONES + CARDS)
def test_a_value_ends_before_its_neighbour(kind, value, after):
    assert (value, kind) in spans(f"see {value}{after}.")
    alone = pseudonyms.MAKE[kind](value, b"key")
    assert pseudonyms.pseudonymise(f"see {value}{after}.", b"key")[0].startswith(f"see {alone} ")


@pytest.mark.parametrize("text, kind, value", [
    ("id 17 4111111111111111", "card", "4111111111111111"), ("10.20.30.40 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ("ID12 BE68 5390 0754 7034 AND", "iban", "BE68 5390 0754 7034"), ("41 11 11 11 11 11 11 11 12/25", "card", "41 11 11 11 11 11 11 11")])
def test_a_value_starts_after_its_neighbour(text, kind, value):
    assert (value, kind) in spans(text)


def test_many_groups_of_digits_are_read_in_time():
    text = "4111111111111111 " + "7 " * 50_000 + "12 4111111111111111"
    assert pseudonyms.pseudonymise(text, b"key")[0].count("4111111111111111") == 0


@pytest.mark.parametrize("between", [" ", ", ", "\n", "; "])
@pytest.mark.parametrize("first", VALUES)
@pytest.mark.parametrize("second", VALUES)
def test_two_values_side_by_side(first, second, between):
    assert spans(f"see {VALUES[first]}{between}{VALUES[second]} here") == {(VALUES[first], first), (VALUES[second], second)}


@pytest.mark.parametrize("after", ["", " 7", " jo@example.com"])
def test_a_secret_needs_no_digit_elsewhere(after):
    assert ("correcthorsebatterystaple", "secret") in spans("password: correcthorsebatterystaple" + after)


def test_no_phone_of_the_table_is_left(spark):
    shape = re.compile(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}")
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op3_pii(spark, SMALL).collect():
        assert not {*shape.findall(before[r.doc_id] or "")} & {*shape.findall(r.text or "")}
