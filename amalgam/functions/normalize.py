"""Normalizers: Column in, Column out, all in built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions.numbering import ABROAD

def once_a_session(build: Callable) -> Callable:
    """Remember what a builder of columns returns, for each session. Columns only name fields and hold no data, and the large ones take thousands of calls to the JVM."""
    known: dict[tuple, object] = {}

    @wraps(build)
    def remembered(*given):
        now = (SparkSession.active().sparkContext.applicationId, *given)
        if now not in known:
            for other in [k for k in known if k[0] != now[0]]:  # of a session that has ended
                del known[other]
            known[now] = build(*given)
        return known[now]

    return remembered


U = "(?U)"  # \w, \d and \s mean what they mean in Unicode


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def literal(x: str | float | int) -> str:
    """A value in SQL. Long lists of literals are parsed at once, which is far quicker than to build each in the JVM."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)


def literal_map(pairs: dict[str, str] | dict[str, float] | dict[str, int]) -> Column:
    return F.expr("map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in pairs.items()) + ")")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, U + r"^\s+|\s+$", "")


def blank(x: Column) -> Column:
    """True for null and for white space only."""
    return x.isNull() | ~x.rlike(U + r"\S")


def filled(x: Column) -> Column:
    """Null instead of the empty string."""
    return F.when(x != "", x)


def distinct_values(x: Column) -> Column:
    """Distinct values that aren't null, in order."""
    return F.array_distinct(F.array_compact(x))


def email(x: Column) -> Column:
    cleaned = F.lower(strip(x))
    return F.when(cleaned.rlike(U + "^(?:" + D.EMAIL_PATTERN + ")$"), cleaned)


def emails(xs: Column) -> Column:
    return distinct_values(F.transform(xs, email))


def emails_in_text(text: Column) -> Column:
    return distinct_values(F.transform(F.regexp_extract_all(text, F.lit(U + D.EMAIL_PATTERN), F.lit(0)), F.lower))


#: Calling code, trunk prefix and form of the national number of the regions that bare numbers can be read in.
PLANS = {
    "US": ("1", "1", r"^[2-9][0-8]\d[2-9]\d{6}$"),
    "CA": ("1", "1", r"^[2-9][0-8]\d[2-9]\d{6}$"),
    "IN": ("91", "0", r"^[1-9]\d{9}$"),
    "GB": ("44", "0", r"^(?:[1-35789]\d{9}|[18]\d{8})$"),
    "AU": ("61", "0", r"^(?:[23478]\d{8}|1[38]00\d{6})$"),
}
#: Digits that begin with a calling code, but without a plus, may be any others (two years and a house number). Behind such a code
#: the national number must have an area code that is in use, where these are told; else PLANS decides.
BARE = {"44": r"^(?:1\d{8,9}|2[03489]\d{8}|3[0347]\d{8}|5[56]\d{8}|[789]\d{9}|8\d{8})$"}


def phone(x: Column, region: Column | str = D.DEFAULT_REGION) -> Column:
    """E.164 form, or null where it isn't a number. The numbering plans of PLANS are checked, others by calling code and length."""
    region = F.lit(region) if isinstance(region, str) else region
    # from the first digit or plus on, without an extension
    core = F.regexp_replace(F.regexp_extract(strip(x), U + r"(?s)[+\d(].*", 0), r"(?i)[\s,;]*(?:ext\.?|extension|x|#)\s*\d{1,7}$", "")

    def national(digits: Column, calling: str, trunk: str, form: str) -> Column:
        own = F.regexp_replace(digits, "^" + trunk, "") if trunk else digits
        full = F.regexp_replace(digits, "^" + calling + trunk + "?", "")
        as_e164 = lambda n: F.concat(F.lit("+" + calling), n)
        return F.when(digits.rlike(form), as_e164(digits)).when((own != digits) & own.rlike(form), as_e164(own)).when((full != digits) & full.rlike(BARE.get(calling, form)), as_e164(full))

    def foreign(digits: Column) -> Column:
        out = None
        for calling, trunk, form in dict.fromkeys(PLANS.values()):
            rest = F.regexp_replace(F.substring(digits, len(calling) + 1, 20), "^0" if trunk == "0" else "^$", "")
            valid = F.when(rest.rlike(form), F.concat(F.lit("+" + calling), rest))
            out = F.when(digits.startswith(calling), valid) if out is None else out.when(digits.startswith(calling), valid)
        return out.when(digits.rlike(ABROAD), F.concat(F.lit("+"), digits))

    def resolved(c: Column) -> Column:
        digits = F.regexp_replace(c, r"\D", "")
        home = None
        for name, plan in PLANS.items():
            home = F.when(region == name, national(digits, *plan)) if home is None else home.when(region == name, national(digits, *plan))
        abroad = F.when(region.isin("US", "CA") & digits.startswith("011"), F.substring(digits, 4, 20)).when(~region.isin("US", "CA") & digits.startswith("00"), F.substring(digits, 3, 20))
        return F.when(c.rlike(r"[A-Za-z]") | (digits == ""), F.lit(None)).when(c.rlike(r"^\(?\+"), foreign(digits)).otherwise(F.coalesce(home, foreign(abroad)))

    return let(core, resolved)


def phones(xs: Column, region: Column | str = D.DEFAULT_REGION) -> Column:
    return distinct_values(F.transform(xs, lambda x: phone(x, region)))


def date(x: Column) -> Column:
    """``YYYY-MM`` of the first form that is found, else null. The month's range is not checked."""

    def parsed(raw: Column) -> Column:
        part = lambda pattern, k: F.regexp_extract(raw, U + pattern, k)
        found = lambda pattern, *ks: F.when(raw.rlike(U + pattern), F.concat_ws("-", *[part(pattern, k) for k in ks]))
        word = r"([A-Za-z]+)\s+(\d{4})"
        month = F.try_element_at(literal_map(D.MONTHS), F.lower(part(word, 1)))
        named = F.when(raw.rlike(U + word) & month.isNotNull(), F.concat(part(word, 2), F.lit("-"), month))
        year = F.when(raw.rlike(U + r"\d{4}"), F.concat(part(r"(\d{4})", 1), F.lit("-01")))
        value = F.coalesce(found(r"(\d{4})-(\d{2})", 1, 2), found(r"(\d{2})/(\d{4})", 2, 1), named, year)
        return F.when(~F.lower(raw).isin(*D.ONGOING), value)

    return let(strip(x), parsed)


def title_case(x: Column) -> Column:
    """Upper case for the first letter of each run of cased letters, lower case for the rest."""
    runs = F.regexp_extract_all(x, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def skill(x: Column) -> Column:
    return let(strip(x), lambda s: F.coalesce(F.try_element_at(literal_map(D.SKILLS), F.lower(s)), title_case(s)))


def skills(xs: Column) -> Column:
    return F.filter(distinct_values(F.transform(xs, skill)), lambda s: s != "")


def location(x: Column) -> Column:
    """A struct of city, region and country; null for null and empty."""
    names: dict[str, str] = {}
    for name, code in D.COUNTRIES.items():
        names.setdefault(name.lower(), code)
    codes = sorted(c for c in set(D.COUNTRIES.values()) if len(c) == 2)

    def country(part: Column) -> Column:
        return F.when((F.length(part) == 2) & F.upper(part).isin(codes), F.upper(part)).otherwise(F.try_element_at(literal_map(names), F.lower(part)))

    def placed(raw: Column) -> Column:
        parts = F.transform(F.split(raw, ","), strip)
        code = F.get(F.array_compact(F.transform(F.reverse(parts), country)), 0)

        def out(p: Column) -> Column:
            n, none = F.size(p), F.lit(None).cast("string")
            several = F.coalesce(code, F.element_at(p, -1))
            shaped = lambda a, b, c: F.struct(a.alias("city"), b.alias("region"), c.alias("country"))
            return F.when(n >= 3, shaped(F.get(p, 0), F.get(p, 1), several)).when(n == 2, shaped(F.get(p, 0), none, several)).when(code.isNotNull(), shaped(none, none, code)).otherwise(shaped(raw, none, none))

        return let(parts, out)

    return F.when(x != "", let(strip(x), placed))


def comma_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), strip), lambda s: s != "")


def badge(score: Column) -> Column:
    """How a confidence is shown: high from 80 %, mid from 50 %, else low."""
    percent = F.round(score * 100)
    return F.when(score.isNull(), "n/a").when(percent >= 80, "high").when(percent >= 50, "mid").otherwise("low")
