"""The HTTP service: form, candidates, identity provider, and a store that fails."""

import json
import threading
from urllib.error import HTTPError, URLError
from urllib.request import HTTPRedirectHandler, Request, build_opener, urlopen

import pytest

from amalgam.operators.store import CandidateStore
from amalgam.service import IdentityProvider, Refused, Service, form, serving

AS_OF = "2026-06"


class Stays(HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def multipart(**parts):
    """(content type, body) of a form; a tuple is a file's name and content."""
    out = b""
    for name, value in parts.items():
        file, content = value if isinstance(value, tuple) else (None, value)
        named = f'; filename="{file}"' if file else ""
        out += f'--edge\r\nContent-Disposition: form-data; name="{name}"{named}\r\n\r\n'.encode() + content + b"\r\n"
    return "multipart/form-data; boundary=edge", out + b"--edge--\r\n"


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    def fetch(request):
        if "accessToken" in request.full_url:
            if b"code=bad" in request.data:
                raise URLError("no")
            return {"access_token": "t"}
        assert request.get_header("Authorization") == "Bearer t"
        return {"given_name": "Bob", "family_name": "Ray", "email": "bob@x.io"}

    provider = IdentityProvider("id", "secret", "http://here.example/auth/linkedin/callback", fetch=fetch)
    return Service(spark, CandidateStore(spark, "file://" + str(tmp_path_factory.mktemp("service"))), provider, AS_OF)


@pytest.fixture(scope="module")
def call(service):
    server = serving(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path, form=None):
        url = f"http://127.0.0.1:{server.server_port}{path}"
        request = Request(url, form[1], {"Content-Type": form[0]}) if form else Request(url)
        try:
            with urlopen(request, timeout=120) as got:
                return got.status, json.loads(got.read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    get.port = server.server_port
    yield get
    server.shutdown()


def test_health_and_unknown_paths(call):
    assert call("/health") == (200, {"status": "ok"})
    assert call("/nothing")[0] == 404 and call("/candidates") == (200, [])


def test_transform_and_candidates(call):
    csv = ("c.csv", b"name,email\nAnn Lee,ann@x.io\n")
    status, out = call("/transform", multipart(csv_file=csv, notes_file=("n.txt", b"Ann Lee\nknows Kafka"), save_to_db=b"true"))
    assert status == 200 and out["full_name"] == "Ann Lee" and [s["name"] for s in out["skills"]] == ["Apache Kafka"]
    status, rows = call("/candidates")
    assert [r["full_name"] for r in rows] == ["Ann Lee"] and call(f"/candidates/{rows[0]['candidate_id']}") == (200, rows[0])
    assert call("/candidates/none") == (404, {"detail": "Candidate not found"})


def test_forms_without_sources(call):
    assert call("/transform", multipart(save_to_db=b"true")) == (400, {"detail": "No sources provided"})
    assert call("/transform", ("application/json", b"{}"))[0] == 400
    assert form(*multipart(github_url=b" https://github.com/u ", resume_file=("cv.DOCX", b"x"))) == ([("resume_docx", b"x"), ("github_url", b"https://github.com/u")], False)


def test_identity_provider(call):
    with pytest.raises(HTTPError) as e:
        build_opener(Stays).open(f"http://127.0.0.1:{call.port}/auth/linkedin/login")
    assert e.value.code == 307 and "client_id=id" in e.value.headers["Location"]
    status, out = call("/auth/linkedin/callback?code=good")
    assert status == 200 and out["linkedin_profile_raw"]["given_name"] == "Bob" and out["canonical_record"]["full_name"] == "Bob Ray"
    assert sorted(r["full_name"] for r in call("/candidates")[1]) == ["Ann Lee", "Bob Ray"]
    assert call("/auth/linkedin/callback?code=bad")[0] == 502 and call("/auth/linkedin/callback")[0] == 400 and call("/auth/linkedin/callback?error=denied")[0] == 400


def test_a_store_that_fails_is_a_warning(spark):
    class Broken(CandidateStore):
        def save(self, *args, **more):
            raise OSError("disk")

    out = Service(spark, Broken(spark, "file:///nowhere"), as_of=AS_OF).transform([("csv", b"name\nAnn Lee\n")], True)
    assert out["full_name"] == "Ann Lee" and out["_warnings"] == ["DB save failed: OSError"]
    with pytest.raises(Refused):
        Service(spark, as_of=AS_OF).candidates()
