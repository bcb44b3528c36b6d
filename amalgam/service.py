"""A small HTTP service over the library, for single candidates: every request is a job of the session it is given.

    POST /transform             multipart form: csv_file, ats_json_file, resume_file, notes_file, github_url, save_to_db
    GET  /candidates            all stored candidates, the most recent first
    GET  /candidates/{id}       one of them
    GET  /auth/linkedin/login   sends the browser to the identity provider; /auth/linkedin/callback takes its answer
    GET  /health

A store that fails while a candidate is saved becomes a warning of the result; values are never logged.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import PurePath
from urllib.error import URLError
from urllib.parse import parse_qs, unquote, urlencode, urlsplit
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.operators.store import CandidateStore
from amalgam.plans.consolidate import answer, evaluated
from amalgam.sources.files import text_of

logger = logging.getLogger(__name__)
ITEM = "run_id string, src_seq int, source_type string, content binary"
FORM_FILES = {"csv_file": "csv", "ats_json_file": "ats_json", "resume_file": "resume_pdf", "notes_file": "recruiter_txt"}
AUTHORIZE, TOKEN, USER = "https://www.linkedin.com/oauth/v2/authorization", "https://www.linkedin.com/oauth/v2/accessToken", "https://api.linkedin.com/v2/userinfo"


class Refused(Exception):
    """An answer other than 200."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def fetched(request: Request, timeout: float = 10.0) -> dict:
    with urlopen(request, timeout=timeout) as got:
        return json.loads(got.read())


@dataclass
class IdentityProvider:
    client_id: str
    client_secret: str
    redirect_uri: str
    scopes: str = "openid profile email"
    fetch: Callable[[Request], dict] = fetched

    def login_url(self) -> str:
        return f"{AUTHORIZE}?" + urlencode({"response_type": "code", "client_id": self.client_id, "redirect_uri": self.redirect_uri, "scope": self.scopes})

    def asked(self, what: str, request: Request) -> dict:
        try:
            return self.fetch(request)
        except (URLError, TimeoutError, ValueError) as e:
            raise Refused(502, f"the identity provider's {what} failed") from e

    def profile(self, code: str) -> dict:
        """The profile that its owner released with this code."""
        form = {"grant_type": "authorization_code", "code": code, "redirect_uri": self.redirect_uri, "client_id": self.client_id, "client_secret": self.client_secret}
        token = self.asked("token exchange", Request(TOKEN, urlencode(form).encode())).get("access_token")
        return self.asked("profile fetch", Request(USER, headers={"Authorization": f"Bearer {token}"}))


@dataclass
class Service:
    spark: SparkSession
    store: CandidateStore | None = None
    provider: IdentityProvider | None = None
    as_of: str | None = None
    landed: dict[str, DataFrame] = field(default_factory=dict)

    def transform(self, sources: list[tuple[str, bytes | None]], save: bool) -> dict:
        """Consolidate sources of one candidate, (type, content) in order, and save the profile if asked."""
        if not sources:
            raise Refused(400, "No sources provided")
        as_of = self.as_of or f"{datetime.now(UTC):%Y-%m}"
        rows = self.spark.createDataFrame([("1", i, kind, content) for i, (kind, content) in enumerate(sources)], ITEM)
        items = rows.select("run_id", "src_seq", "source_type", text_of(F.col("source_type"), F.col("content")).alias("content"))
        results, profiles = evaluated(items, as_of, **self.landed)
        out = answer(results)
        if save and "error" not in out:
            try:
                self.stored().save(profiles, f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S}", as_of)
            except Exception as e:  # the result stands, whatever became of the store
                logger.error("saving failed: %s", type(e).__name__)
                out.setdefault("_warnings", []).append(f"DB save failed: {type(e).__name__}")
        return out

    def stored(self) -> CandidateStore:
        if self.store is None:
            raise Refused(500, "no store is configured")
        return self.store

    def candidates(self, candidate_id: str | None = None) -> list[dict] | dict:
        store = self.stored()
        if store.current() is None:
            rows = []
        else:
            found = store.list() if candidate_id is None else store.get(candidate_id)
            rows = [json.loads(r[0]) for r in found.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        if candidate_id is None:
            return rows
        if not rows:
            raise Refused(404, "Candidate not found")
        return rows[0]

    def called_back(self, query: dict[str, list[str]]) -> dict:
        if "error" in query:
            raise Refused(400, f"the identity provider says: {query['error'][0]}")
        if "code" not in query:
            raise Refused(400, "Missing authorization code")
        if self.provider is None:
            raise Refused(500, "no identity provider is configured")
        profile = self.provider.profile(query["code"][0])
        save = query.get("save_to_db", ["true"])[0].lower() not in ("false", "0")
        return {"linkedin_profile_raw": profile, "canonical_record": self.transform([("linkedin_url", json.dumps(profile).encode())], save)}


def form(content_type: str, body: bytes) -> tuple[list[tuple[str, bytes | None]], bool]:
    """The sources of a multipart form, in the order of FORM_FILES, and whether to save."""
    parsed = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    if not parsed.is_multipart():
        raise Refused(400, "a multipart form is expected")
    parts = {p.get_param("name", header="content-disposition"): p for p in parsed.iter_parts()}
    sources: list[tuple[str, bytes | None]] = []
    for name, kind in FORM_FILES.items():
        if name in parts:
            suffix = PurePath(parts[name].get_filename() or "").suffix.lower() or ".pdf"
            sources.append(("resume_docx" if name == "resume_file" and suffix != ".pdf" else kind, parts[name].get_payload(decode=True)))
    text = lambda name: (parts[name].get_payload(decode=True) or b"").strip() if name in parts else b""
    if text("github_url"):
        sources.append(("github_url", text("github_url")))
    return sources, text("save_to_db").lower() in (b"true", b"1", b"on")


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answered(self, make: Callable[[], object]) -> None:
            try:
                status, out = 200, make()
            except Refused as e:
                status, out = e.status, {"detail": e.detail}
            except Exception as e:
                logger.error("a request failed: %s", type(e).__name__)
                status, out = 500, {"detail": "internal error"}
            body = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json"), ("Access-Control-Allow-Origin", "*"), ("Content-Length", str(len(body)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/auth/linkedin/login" and service.provider:
                self.send_response(307)
                self.send_header("Location", service.provider.login_url())
                self.end_headers()
                return
            self.answered(lambda: self.got(url.path, parse_qs(url.query)))

        def got(self, path: str, query: dict[str, list[str]]) -> object:
            if path == "/health":
                return {"status": "ok"}
            if path == "/candidates":
                return service.candidates()
            if path.startswith("/candidates/"):
                return service.candidates(unquote(path.removeprefix("/candidates/")))
            if path == "/auth/linkedin/callback":
                return service.called_back(query)
            if path == "/auth/linkedin/login":
                raise Refused(500, "no identity provider is configured")
            raise Refused(404, "Not Found")

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))

            def made() -> dict:
                if urlsplit(self.path).path != "/transform":
                    raise Refused(404, "Not Found")
                return service.transform(*form(self.headers.get("Content-Type") or "", body))

            self.answered(made)

        def log_message(self, *args: object) -> None:
            """Requests may hold personal data, so they are not logged."""

    return Handler


def serving(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(service))
