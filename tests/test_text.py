from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions import text as T

from .test_normalize import run

RESUME = """Jane Q Public
jane@example.org | 020 7946 0958 | London | https://jane.example/me. https://github.com/orgs github.com/janeq

Experience
Data Engineer at Acme Corp
Jan 2018 - Mar 2020
• built pipelines
- and tools for lots and lots of other people in the company and beyond it
Great Company
Senior Dev | Initech Apr 2020 – Present
Wrote code

Globex
2015 to 2017
Education
MIT College of Engineering, Boston
Bachelor of Science, Physics, 2011 - 2015
Springfield High
CBSE Class XII: 86.8% 2009 - 2011
Skills
Python, Go
"""


def test_jobs(spark):
    (jobs,) = run(spark, T.jobs, [RESUME])
    got = [tuple(j) for j in jobs]
    assert got[0] == ("Acme Corp", "Data Engineer", "2018-01", "2020-03", "built pipelines and tools for lots and lots of other people in the company and beyond it Great Company")
    assert got[1] == ("Wrote code", "Senior Dev | Initech", "2020-04", None, None)
    assert got[2] == ("Globex", None, "2015-01", "2017-01", None)


def test_lines_with_at_but_no_match_are_lost(spark):
    (jobs,) = run(spark, T.jobs, ["Employment\nGreat Company\nReal Inc\n2011 - 2012"])
    assert [tuple(j) for j in jobs] == [("Real Inc", None, "2011-01", "2012-01", None)]


def test_short_bullets_with_section_words_close_the_section(spark):
    (jobs,) = run(spark, T.jobs, ["Career\nAcme\n2011-2012\nused tools\nlost"])
    assert [tuple(j) for j in jobs] == [("Acme", None, "2011-01", "2012-01", None)]


def test_courses(spark):
    (courses,) = run(spark, T.courses, [RESUME])
    assert [tuple(c) for c in courses] == [
        ("MIT College of Engineering", "Bachelor of Science", "Physics, 2011 - 2015", 2015),
        ("Springfield High", "CBSE Class XII: 86.8% 2009 - 2011", None, 2011),
    ]


def test_contacts(spark):
    assert run(spark, T.name, [RESUME, "resume of\nAnn Lee", "My Resume Now\nJean-Luc d'Arc\nÉlan Ünal"]) == ["Jane Q Public", "Ann Lee", "Élan Ünal"]
    assert run(spark, T.region_of, [RESUME, "Milwaukee", "nothing"]) == ["GB", "GB", "US"]
    assert run(spark, T.resume_phones, [RESUME])[0][0] == "+442079460958"
    assert run(spark, T.github_url, [RESUME]) == ["https://github.com/janeq"]
    assert run(spark, T.portfolio_url, [RESUME]) == ["https://jane.example/me."]
    assert run(spark, T.linkedin_url, ["see LinkedIn.com/in/ab-c_d/x", "none"]) == ["https://linkedin.com/in/ab-c_d", None]
    assert run(spark, T.phone_candidates, ["call 415-555-0123 or\n(212) 555 0199 ip 10.0.0.1.22"]) == [["415-555-0123", "(212) 555 0199", "10.0.0.1.22"]]


def test_keywords_in_dictionary_order(spark):
    texts = ["Knows Node.js, REST API, spring boot; C++ and c#", "c++11 golang gopher", "éjs js2 _go R", ""]
    assert run(spark, T.keyword_skills, texts) == [["JavaScript", "Node.js", "Spring", "Spring Boot", "REST API"], ["C++", "Go"], ["R"], []]


def test_no_keyword_hides_another():
    """One pass finds all keywords only if none starts inside another one and ends beyond it."""
    for a in D.SKILLS:
        for b in D.SKILLS:
            for k in range(1, min(len(a), len(b))):
                if a != b and a.endswith(b[:k]) and b not in a:
                    before = a[-k - 1 : -k]
                    assert before.isalnum() or before == "_", (a, b)


def test_years(spark):
    jobs = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
    rows = [[("a", "b", "2019-06", "2021-02", None), ("c", "d", "2021-03", None, None)], [("a", None, "2020-01", "2019-01", None)], [], None]
    assert run(spark, lambda c: T.years_of(c, "2026-06", True), rows, jobs) == [6.9, None, None, None]
    assert run(spark, lambda c: T.years_of(F.concat(c, c), "2026-06", False), rows[:2], jobs) == [13.8, None]
