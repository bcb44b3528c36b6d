"""Calling codes: the compiled trie against a plain lookup of the longest code."""

import random
import re

from pyspark.sql import functions as F

from amalgam.functions.normalize import phone
from amalgam.functions.numbering import ABROAD, WHOLE, calling_codes, pattern_of, trie


def plain(digits, codes):
    code = next((digits[:k] for k in (3, 2, 1) if digits[:k] in codes), None)
    return code is not None and WHOLE[0] <= len(digits) <= WHOLE[1] and codes[code][0] <= len(digits) - len(code) <= codes[code][1]


def test_no_code_begins_another():
    codes = calling_codes()
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_pattern_equals_plain_lookup():
    rng, codes = random.Random(1), calling_codes()
    for _ in range(50_000):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 17)))
        assert bool(re.match(ABROAD, digits)) == plain(digits, codes), digits


def test_small_tries():
    assert pattern_of(trie({"2": (3, 3)})) == r"2\d{3,3}"
    shared = pattern_of(trie({"21": (3, 4), "22": (3, 4), "3": (1, 2)}))
    assert [bool(re.fullmatch(shared, d)) for d in ("21123", "2212345", "2312", "312", "3123", "3")] == [True, False, False, True, False, False]


def test_numbers_abroad(spark):
    cases = {
        "+33 1 42 68 53 00": "+33142685300", "+33 1 42 68 53": None, "+351 21 123 4567": "+351211234567", "+351 21 123": None, "+45 12 34 56 78": "+4512345678",
        "+45 123 456 789": None, "+999 1234 5678": None, "+210 123 456 78": None, "+259 12345678": None, "+49 30 123456": "+4930123456", "+7 495 123 45 67": "+74951234567",
        "+7 495 123 45 6": None, "011 33 1 42 68 53 00": "+33142685300",
    }
    rows = spark.createDataFrame(list(cases.items()), "raw string, want string").select("raw", "want", phone(F.col("raw"), "US").alias("got")).collect()
    assert {r.raw: r.got for r in rows} == cases
