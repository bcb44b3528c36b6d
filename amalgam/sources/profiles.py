"""Public developer profiles and identity-provider profiles, from JSON that was landed before."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions import normalize as N
from amalgam.sources.hr_json import at, first_filled
from amalgam.sources.schema import raw_records

TOP_LANGUAGES = 10


def username(url: Column) -> Column:
    """The user of an https URL of an allowed host, else null."""
    u = N.strip(url)
    host = F.regexp_extract(u, r"^https://([^/?#]*)", 1)
    user = F.regexp_extract(u, r"github\.com/([^/?#]+)", 1)
    return F.when(host.isin(*D.PROFILE_HOSTS) & (user != "") & ~user.isin(*D.RESERVED_USERS), user)


def top_languages(repositories: DataFrame, limit: int = TOP_LANGUAGES) -> DataFrame:
    """(username, languages) from (username, seq, language): the most frequent ones, earliest first among equals."""
    counted = repositories.filter("coalesce(language, '') <> ''").groupBy("username", "language").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("username").orderBy(F.desc("n"), "first"))).filter(F.col("rank") <= limit)
    return ranked.groupBy("username").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "language"))), lambda x: x["language"]).alias("languages"))


def from_developer_urls(rows: DataFrame, users: DataFrame, repositories: DataFrame) -> DataFrame:
    """One record from each URL in ``content``, by the landed (username, profile JSON) and (username, seq, language)."""
    named = rows.withColumn("_user", username(F.col("content")))
    landed = users.select(F.col("username").alias("_user"), F.try_parse_json("profile").alias("_v")).filter("_v is not null").dropDuplicates(["_user"])
    known = named.join(landed, "_user", "left").join(top_languages(repositories).withColumnRenamed("username", "_user"), "_user", "left")
    v, there = F.col("_v"), F.col("_v").isNotNull()
    blog = N.strip(at(v, "blog", "string"))
    mail = N.filled(at(v, "email", "string"))
    return raw_records(
        known, full_name=at(v, "name", "string"), headline=at(v, "bio", "string"), location_raw=at(v, "location", "string"), github_url=F.when(there, N.strip(F.col("content"))),
        emails=F.when(mail.isNotNull(), F.array(mail)), portfolio_url=F.when(blog.startswith("http"), blog).when(blog != "", F.concat(F.lit("https://"), blog)), skills_raw=F.when(there, F.col("languages")),
    )


def from_identity_profiles(rows: DataFrame) -> DataFrame:
    """One record from each identity provider's profile in ``content``."""
    table = rows.withColumn("_v", F.try_parse_json("content"))
    v = F.col("_v")
    composed = N.filled(N.strip(F.concat_ws(" ", N.filled(at(v, "given_name", "string")), N.filled(at(v, "family_name", "string")))))
    mail = N.filled(at(v, "email", "string"))
    return raw_records(
        table, full_name=F.coalesce(N.filled(at(v, "name", "string")), composed), emails=F.when(mail.isNotNull(), F.array(mail)),
        headline=first_filled(v, ("headline", "localizedHeadline")), linkedin_url=first_filled(v, ("public_profile_url", "profile_url")),
    )


def landed_users(usernames: DataFrame, service: str = "https://api.github.com", timeout: float = 5.0, retry_after: float = 1.0) -> DataFrame:
    """Fetch (username, profile, repositories JSON) for landing; null where the service has none. One retry if it is busy.

    Each task reuses its worker; the token comes from the worker's environment. Land the result before reading it.
    """

    def get(path: str):
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        token = os.environ.get("GITHUB_TOKEN")
        headers = {"Accept": "application/vnd.github.v3+json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        for attempt in (0, 1):
            try:
                with urlopen(Request(service + path, headers=headers), timeout=timeout) as answer:
                    return answer.read().decode()
            except HTTPError as e:
                if e.code not in (403, 429) or attempt:
                    return None
                time.sleep(retry_after)
            except (URLError, TimeoutError, OSError):
                return None

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["profile"] = [get(f"/users/{u}") for u in pdf["username"]]
            pdf["repositories"] = [get(f"/users/{u}/repos?per_page=30&sort=updated") if p else None for u, p in zip(pdf["username"], pdf["profile"], strict=True)]
            yield pdf

    return usernames.select("username").distinct().mapInPandas(run, "username string, profile string, repositories string")


def repository_languages(landed: DataFrame) -> DataFrame:
    """(username, seq, language) from landed repositories JSON."""
    rows = F.from_json("repositories", "array<struct<language:string>>")
    return landed.select("username", F.posexplode(rows).alias("seq", "repository")).select("username", "seq", "repository.language")


