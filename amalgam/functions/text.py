"""What free text says about a person: contacts, handles, name, skills, jobs and education. Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions.normalize import U, date, let, literal, phone, strip

LETTER = r"[\p{L}\p{N}_]"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(U + pattern), F.lit(group))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def phone_candidates(text: Column) -> Column:
    return F.filter(F.transform(all_matches(text, D.PHONE_PATTERN), strip), lambda p: F.length(p) >= 7)


def region_of(text: Column) -> Column:
    low = F.lower(text)
    out = F
    for hint, region in D.REGION_HINTS.items():
        out = out.when(low.contains(hint), region)
    return out.otherwise(D.DEFAULT_REGION)


def resume_phones(text: Column) -> Column:
    """The first five numbers, normalised for the text's own region, as they stand where that fails."""
    read = lambda region: F.transform(phone_candidates(text), lambda p: F.coalesce(phone(p, region), p))
    return F.slice(let(region_of(text), read), 1, 5)


def linkedin_url(text: Column) -> Column:
    return F.concat(F.lit("https://linkedin.com/in/"), F.get(all_matches(text, D.LINKEDIN_PATTERN, 1), 0))


def github_url(text: Column) -> Column:
    own = F.filter(all_matches(text, D.GITHUB_PATTERN, 1), lambda h: ~F.lower(h).isin(*D.RESERVED_HANDLES))
    return F.concat(F.lit("https://github.com/"), F.get(own, 0))


def portfolio_url(text: Column) -> Column:
    return F.get(F.filter(all_matches(text, D.URL_PATTERN), lambda u: ~u.contains("linkedin") & ~u.contains("github")), 0)


def name(text: Column) -> Column:
    """The first of the first five lines that has two to four words, all starting in upper case, and no heading word."""

    def is_name(line: Column) -> Column:
        word = r"\p{Lu}\S*"
        heading = None
        for h in D.NOT_NAMES:
            test = F.lower(line).contains(h)
            heading = test if heading is None else heading | test
        return line.rlike(U + rf"^{word}(?:\s+{word}){{1,3}}$") & ~heading

    return F.get(F.filter(F.transform(F.slice(lines_of(text), 1, 5), strip), is_name), 0)


def _keyword_pattern(word: str) -> str:
    return re.escape(word) + (rf"(?!{LETTER})" if re.match(r"\w", word[-1]) else rf"(?={LETTER})")


def _inner_keywords() -> dict[str, list[str]]:
    """Keywords that stand inside another one, at word ends."""
    edge = lambda k, inner: re.search(rf"\b{re.escape(inner)}\b", k) is not None
    return {k: found for k in D.SKILLS if (found := [i for i in D.SKILLS if i != k and edge(k, i)])}


def keyword_skills(text: Column) -> Column:
    """Canonical names of the dictionary's keywords that stand in the text, in the dictionary's order.

    One pass over the text finds keywords, longest first; those inside a found one are added. No keyword ends with the
    start of another, so none is hidden.
    """
    longest = sorted(D.SKILLS, key=len, reverse=True)
    pattern = rf"(?<!{LETTER})(?:" + "|".join(map(_keyword_pattern, longest)) + ")"
    inner = _inner_keywords()
    inside = F.create_map(*[x for k, v in inner.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = F.expr("array(" + ", ".join(f"named_struct('k', {literal(k)}, 'v', {literal(v)})" for k, v in D.SKILLS.items()) + ")")

    def named(found: Column) -> Column:
        more = F.flatten(F.array_compact(F.transform(found, lambda k: F.try_element_at(inside, k))))
        return let(F.array_union(found, more), lambda every: F.array_distinct(F.transform(F.filter(known, lambda s: F.array_contains(every, s["k"])), lambda s: s["v"])))

    return let(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))), named)


def is_header(line: Column, *sections: str) -> Column:
    low, out = F.lower(line), None
    for s in sections:
        for word in D.SECTIONS[s]:
            out = low.contains(word) if out is None else out | low.contains(word)
    return out & (F.length(line) < D.SECTION_LENGTH)


def has_degree(line: Column) -> Column:
    return F.lower(line).rlike(U + r"\b(?:" + "|".join(map(re.escape, D.DEGREES)) + r")\b")


JOB = "struct<company:string,title:string,start:string,end:string,summary:string>"
COURSE = "struct<institution:string,degree:string,field:string,end_year:int>"


def jobs(text: Column) -> Column:
    """Jobs of the experience sections: one fold over the lines, with the job being read as its state."""
    none = F.lit(None).cast("string")
    fields = ("company", "title", "start", "end", "summary")
    empty = F.struct(*[none.alias(f) for f in fields])

    def state(open_: Column, going: Column, job: Column, out: Column) -> Column:
        return F.struct(open_.alias("open"), going.alias("going"), job.alias("job"), out.alias("out"))

    def step(acc: Column, line: Column) -> Column:
        job, out = acc["job"], acc["out"]
        flushed = F.when(acc["going"], F.concat(out, F.array(job))).otherwise(out)
        no, yes = F.lit(False), F.lit(True)
        put = lambda base, **new: F.struct(*[new.get(f, base[f]).alias(f) for f in fields])
        # a date range starts a job, unless the one being read has no start yet
        dated = line.rlike(U + D.RANGE_PATTERN)
        again = job["start"].isNotNull()
        base = F.when(again, empty).otherwise(job)
        before = F.regexp_replace(F.regexp_extract(line, U + "(?s)^(.*?)(?:" + D.RANGE_PATTERN + ")", 1), r"^[ \-|–—]+|[ \-|–—]+$", "")
        until = F.regexp_extract(line, U + D.RANGE_PATTERN, 2)
        with_dates = put(
            base, title=F.when(before != "", before).otherwise(base["title"]), start=date(F.regexp_extract(line, U + D.RANGE_PATTERN, 1)),
            end=F.when(~F.lower(until).isin("present", "current"), date(until)),
        )
        at = r"(?is)^(.+?)\s+at\s+(.+)"
        bar, comma = F.split(line, r"\|"), F.split(line, ",", 2)
        named = (
            F.when(line.contains("|"), put(job, title=strip(F.get(bar, 0)), company=strip(F.get(bar, 1))))
            .when(F.lower(line).contains("at "), F.when(line.rlike(U + at), put(job, title=strip(F.regexp_extract(line, U + at, 1)), company=strip(F.regexp_extract(line, U + at, 2)))).otherwise(job))
            .when(line.contains(","), put(job, title=strip(F.get(comma, 0)), company=strip(F.get(comma, 1))))
            .otherwise(put(job, company=line))
        )
        lost = ~line.contains("|") & F.lower(line).contains("at ") & ~line.rlike(U + at)
        snippet = strip(F.regexp_replace(line, r"^[•\-* ]+", ""))
        told = F.when(snippet != "", put(job, summary=strip(F.concat(F.coalesce(job["summary"], F.lit("")), F.lit(" "), snippet)))).otherwise(job)
        return (
            F.when(line == "", state(acc["open"], no, empty, flushed))
            .when(~acc["open"] & is_header(line, "experience"), state(yes, no, empty, flushed))
            .when(acc["open"] & is_header(line, "education", "skills"), state(no, no, empty, flushed))
            .when(~acc["open"], acc)
            .when(dated, state(yes, yes, with_dates, F.when(again, flushed).otherwise(out)))
            .when(F.coalesce(job["company"], F.lit("")) == "", state(yes, acc["going"] | ~lost, named, out))
            .otherwise(state(yes, yes, told, out))
        )

    start = state(F.lit(False), F.lit(False), empty, F.array().cast(f"array<{JOB}>"))
    return F.aggregate(F.transform(lines_of(text), strip), start, step, lambda acc: F.when(acc["going"], F.concat(acc["out"], F.array(acc["job"]))).otherwise(acc["out"]))


def courses(text: Column) -> Column:
    """Institutions of the education sections, each with the line that follows it."""
    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("institution"), none.alias("degree"), none.alias("field"), F.lit(None).cast("int").alias("end_year"))

    def state(open_: Column, going: Column, detail: Column, course: Column, out: Column) -> Column:
        return F.struct(open_.alias("open"), going.alias("going"), detail.alias("detail"), course.alias("course"), out.alias("out"))

    def step(acc: Column, line: Column) -> Column:
        course, out = acc["course"], acc["out"]
        flushed = F.when(acc["going"], F.concat(out, F.array(course))).otherwise(out)
        no, yes = F.lit(False), F.lit(True)
        # leaving or entering a section forgets a pending detail only if an institution is being read
        pending = acc["detail"] & ~acc["going"]
        first = strip(F.get(F.split(line, ",", 2), 0))
        institution = F.struct(first.alias("institution"), none.alias("degree"), none.alias("field"), F.lit(None).cast("int").alias("end_year"))
        years = F.transform(all_matches(line, r"\b((?:19|20)\d{2})\b", 1), lambda y: y.try_cast("int"))
        year = F.try_element_at(years, F.lit(-1))
        rest = F.when(has_degree(line) & line.contains(","), strip(F.get(F.split(line, ",", 2), 1))).otherwise(course["field"])
        detailed = F.struct(course["institution"].alias("institution"), first.alias("degree"), rest.alias("field"), F.coalesce(year, course["end_year"]).alias("end_year"))
        return (
            F.when(line == "", acc)
            .when(~acc["open"] & is_header(line, "education"), state(yes, no, pending, empty, flushed))
            .when(acc["open"] & is_header(line, "experience", "skills"), state(no, no, pending, empty, flushed))
            .when(~acc["open"], acc)
            .when(~acc["detail"], state(yes, yes, yes, institution, flushed))
            .otherwise(state(yes, yes, no, detailed, out))
        )

    start = state(F.lit(False), F.lit(False), F.lit(False), empty, F.array().cast(f"array<{COURSE}>"))
    return F.aggregate(F.transform(lines_of(text), strip), start, step, lambda acc: F.when(acc["going"], F.concat(acc["out"], F.array(acc["course"]))).otherwise(acc["out"]))


def months_between(start: Column, end: Column, as_of: str) -> Column:
    """Months from ``start`` to ``end``, or to the month of ``as_of`` (both YYYY-MM) where there is no end."""
    at = lambda x: F.substring(x, 1, 4).try_cast("int") * 12 + F.substring(x, 6, 2).try_cast("int")
    return at(F.coalesce(end, F.lit(as_of))) - at(start)


def years_of(entries: Column, as_of: str, only_forward: bool) -> Column:
    """Years in jobs with a start, to one decimal; null if not above zero. Jobs at the same time count each."""

    def add(total: Column, e: Column) -> Column:
        months = F.coalesce(months_between(e["start"], e["end"], as_of), F.lit(0))
        return total + (F.greatest(months, F.lit(0)) if only_forward else months)

    total = F.aggregate(F.filter(entries, lambda e: F.coalesce(e["start"], F.lit("")) != ""), F.lit(0), add)
    return let(total, lambda t: F.when(t > 0, F.bround(t / 12, 1)))
