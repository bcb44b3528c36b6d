import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amalgam.functions import normalize as N


def run(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


PHONES = {
    "+14155550123": "+14155550123", "(415) 555-0123": "+14155550123", "415-555-0123": "+14155550123", "415.555.0123": "+14155550123", "1 415 555 0123": "+14155550123",
    "not-a-phone": None, "": None, "   ": None, None: None, "555-0123": None, "+44 20 7946 0958": "+442079460958", "+91 98765 43210": "+919876543210", "115-555-0123": None,
    "415-555-0123 x22": "+14155550123", "+61 2 9374 4000": "+61293744000", "+1 123 456 7890": None, "011 44 20 7946 0958": "+442079460958", "+49 30 123456": "+4930123456",
}


def test_phones(spark):
    assert run(spark, N.phone, list(PHONES)) == list(PHONES.values())


def test_phones_of_other_regions(spark):
    assert run(spark, lambda c: N.phone(c, "IN"), ["098765 43210", "9876543210", "+1 415 555 0123"]) == ["+919876543210", "+919876543210", "+14155550123"]
    assert run(spark, lambda c: N.phone(c, "GB"), ["020 7946 0958"]) == ["+442079460958"]
    assert run(spark, lambda c: N.phone(c, "AU"), ["02 9374 4000"]) == ["+61293744000"]


def test_a_bare_calling_code_needs_an_area_code_in_use(spark):
    """No plus, so the digits may be others: 22 and 62 are no British area codes."""
    given = ["44 20 7946 0958", "442079460958", "4422\n\n2001 - 2002", "44 62 2001 2002", "+44 20 7946 0958", "22\n\n2001 - 2002"]
    assert run(spark, lambda c: N.phone(c, "GB"), given) == ["+442079460958", "+442079460958", None, None, "+442079460958", "+442220012002"]


def test_phone_lists(spark):
    assert run(spark, N.phones, [["(415) 555-0123", "+14155550123", None, "x", "415-555-0123"]], "array<string>") == [["+14155550123"]]


EMAILS = {"Alex.JOHNSON@Example.COM": "alex.johnson@example.com", "not-an-email": None, "": None, None: None, " a@b.io\t": "a@b.io", "a@b.co.uk": None, "é.x@exämple.org": "é.x@exämple.org", "a@b.c": None}


def test_emails(spark):
    assert run(spark, N.email, list(EMAILS)) == list(EMAILS.values())
    assert run(spark, N.emails, [["Alex@example.com", "alex@example.com", "x"]], "array<string>") == [["alex@example.com"]]
    assert run(spark, N.emails_in_text, ["at A.b@x.com, a.b@x.com or w@t.io; z@b.co.uk"]) == [["a.b@x.com", "w@t.io", "z@b.co"]]


DATES = {
    "2021-03": "2021-03", "March 2021": "2021-03", "Mar 2021": "2021-03", "03/2021": "2021-03", "2021": "2021-01", "present": None, "Current": None, "": None, None: None, "  ": None,
    "garbage": None, "15/03/2021": "2021-03", "2021-2023": "2021-20", "Mar. 2021": "2021-01", "Sept 2021": "2021-01", "2021-99": "2021-99", "since June 2019!": "2019-06", "now": None,
}


def test_dates(spark):
    assert run(spark, N.date, list(DATES)) == list(DATES.values())


SKILLS = {"js": "JavaScript", "  Postgres ": "PostgreSQL", "k8s": "Kubernetes", "node.js": "Node.js", "quantum foo-BAR": "Quantum Foo-Bar", "it's c3po": "It'S C3Po", "Express.js": "Express.Js", "": "", None: None}


def test_skills(spark):
    assert run(spark, N.skill, list(SKILLS)) == list(SKILLS.values())
    assert [s.title() for s in ("quantum foo-BAR", "it's c3po", "中abc ǅx")] == run(spark, N.title_case, ["quantum foo-BAR", "it's c3po", "中abc ǅx"])
    assert run(spark, N.skills, [["JS", "javascript", "", None, " ", "Go"]], "array<string>") == [["JavaScript", "Go"]]


LOCATIONS = {
    "San Francisco, CA, USA": ("San Francisco", "CA", "US"), "London, UK": ("London", None, "GB"), "India": (None, None, "IN"), "Mumbai": ("Mumbai", None, None), None: None, "": None,
    "Toronto, CA": ("Toronto", None, "CA"), "X, Y, Elbonia": ("X", "Y", "Elbonia"), "Remote": (None, None, "REMOTE"), "us": (None, None, "US"), "Austria, Nowhere": ("Austria", None, "AT"),
}


def test_locations(spark):
    got = run(spark, N.location, list(LOCATIONS))
    assert [tuple(r) if r else r for r in got] == list(LOCATIONS.values())


def test_badges(spark):
    assert run(spark, N.badge, [0.8, 0.795, 0.794, 0.5, 0.494, None], "double") == ["high", "high", "mid", "mid", "low", "n/a"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=40))
def test_normalizers_settle(spark, texts):
    once = {}
    for f in (N.email, N.phone, N.date):
        once[f] = run(spark, f, texts)
        assert run(spark, f, once[f]) == once[f]


@pytest.mark.parametrize("text", ["a,, b ,", "", ","])
def test_comma_lists(spark, text):
    assert run(spark, N.comma_list, [text]) == [[x.strip() for x in text.split(",") if x.strip()]]
