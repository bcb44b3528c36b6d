"""Sources, merge, scores, projection, store, batches and the stream."""

import itertools
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from amalgam.__main__ import main as command
from amalgam.functions import dictionaries as D
from amalgam.operators.fold import fold_pairs
from amalgam.operators.merge import merge
from amalgam.operators.project import project, render, validate
from amalgam.operators.store import CandidateStore
from amalgam.plans.consolidate import batch, consolidate, extract, landed_by_type, profiles_of, write_batch
from amalgam.sources import files, hr_json, profiles, prose, spreadsheet
from amalgam.sources.schema import RAW
from amalgam.streaming.landing import fold_into, landed_items

AS_OF = "2026-06"
DDL = "run_id string, src_seq int, source_type string, " + ", ".join(f"{k} {v}" for k, v in RAW.items())


@pytest.fixture(scope="module")
def raw(spark):
    def make(*records, run="r"):
        rows = []
        for i, r in enumerate(records):
            row = {"run_id": run, "src_seq": i, **{k: [] if v.startswith("array") else None for k, v in RAW.items()}, **r}
            rows.append(tuple(row[c.split(" ")[0]] for c in ("run_id", "src_seq", "source_type", *RAW)))
        return spark.createDataFrame(rows, DDL)

    return make


def items(spark, *contents):
    return spark.createDataFrame([("r", i, t, c) for i, (t, c) in enumerate(contents)], "run_id string, src_seq int, source_type string, content string")


def one(df):
    (row,) = df.collect()
    return row


def job(company=None, title=None, start=None, end=None, summary=None):
    return (company, title, start, end, summary)


# ---- sources ----


def test_spreadsheet(spark):
    text = '﻿name,email,phone,current_company,title,location\r\n"Lee, ""Ann""",a@b.io,415,Acme,Dev,"Paris,\nFrance"\r\nOther,x,y,z,w,v\r\n'
    r = one(spreadsheet.from_text(items(spark, ("csv", text))))
    assert (r.full_name, r.emails, r.phones, r.location_raw, r.experience[0].company, r.experience[0].title) == ('Lee, "Ann"', ["a@b.io"], ["415"], "Paris,\nFrance", "Acme", "Dev")


@pytest.mark.parametrize("text", ["", "nothing,here\n1,2", "/no/such/file.csv", "name", "name\n"])
def test_spreadsheet_without_anything(spark, text):
    r = one(spreadsheet.from_text(items(spark, ("csv", text))))
    assert r.full_name is None and r.emails == [] and r.experience == []


def test_hr_export(spark):
    doc = {"firstName": "A", "lastName": "B", "email": ["x@y.io", "", None], "phone": 5, "mobile": "415", "location": "Rome", "skills": [{"name": "Go"}, "SQL", {"skill": "R"}, {}],
           "workHistory": [{"organization": "O", "role": "P", "start": "", "startDate": "2020-01"}, 7], "education": [{"university": "U", "year": "2010"}, {"school": "S", "end_year": "soon"}]}
    r = one(hr_json.from_json(items(spark, ("ats_json", json.dumps(doc)))))
    assert (r.full_name, r.emails, r.phones, r.location_raw, r.skills_raw) == ("A B", ["x@y.io"], ["415"], "Rome", ["Go", "SQL", "R"])
    assert tuple(r.experience[0]) == ("O", "P", "2020-01", None, None) and [tuple(e) for e in r.education] == [("U", None, None, 2010), ("S", None, None, None)]


def test_hr_export_that_is_broken_or_mapped(spark):
    assert one(hr_json.from_json(items(spark, ("ats_json", "{broken")))).full_name is None
    own = '{"who is it\'s": "Z"}'
    assert one(hr_json.from_json(items(spark, ("ats_json", own)), {"who is it's": "full_name"})).full_name == "Z"
    assert one(hr_json.from_json(items(spark, ("ats_json", own)))).full_name is None


def test_developer_profile(spark):
    users = spark.createDataFrame([("u", json.dumps({"name": "N", "bio": "B", "location": "L", "email": None, "blog": " me.example "}), json.dumps([{"language": x} for x in ["Go", None, "C", "Go", "C", "R"]]))], "username string, profile string, repositories string")
    rows = items(spark, ("github_url", "https://github.com/u"), ("github_url", "https://github.com/login"), ("github_url", "http://github.com/u"), ("github_url", "https://evil.example/github.com/u"))
    out = sorted(profiles.from_developer_urls(rows, users, profiles.repository_languages(users)).collect(), key=lambda r: r.src_seq)
    assert (out[0].full_name, out[0].headline, out[0].portfolio_url, out[0].skills_raw, out[0].emails) == ("N", "B", "https://me.example", ["Go", "C", "R"], [])
    assert all(r.full_name is None and r.github_url is None for r in out[1:])


def test_developer_profiles_are_landed(spark):
    """One retry where the service is busy, null where it has nothing, and the page that is asked for."""
    seen = []

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            user = self.path.split("/")[2]
            busy = user == "busy" and seen.count(self.path) == 1
            self.send_response(404 if user == "gone" else 403 if busy or user == "shut" else 200)
            self.end_headers()
            self.wfile.write(json.dumps([{"language": "Go"}, {"language": None}] if "/repos" in self.path else {"name": user}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    names = spark.createDataFrame([("ann",), ("busy",), ("gone",), ("shut",), ("ann",)], "username string")
    rows = profiles.landed_users(names, f"http://127.0.0.1:{server.server_port}", retry_after=0.01)
    got = {r.username: r for r in rows.collect()}
    server.shutdown()
    assert {u: r.profile and json.loads(r.profile)["name"] for u, r in got.items()} == {"ann": "ann", "busy": "busy", "gone": None, "shut": None}
    assert seen.count("/users/ann") == 1 and seen.count("/users/busy") == 2 and seen.count("/users/shut") == 2 and "/users/ann/repos?per_page=30&sort=updated" in seen
    landed = spark.createDataFrame(list(got.values()), rows.schema)
    assert sorted(map(tuple, profiles.repository_languages(landed).collect())) == [("ann", 0, "Go"), ("ann", 1, None), ("busy", 0, "Go"), ("busy", 1, None)]


def test_notes_without_anything(spark):
    r = one(prose.from_notes(items(spark, ("recruiter_txt", ""))))
    assert r.full_name is None and r.emails == [] and r.skills_raw == []


def docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", xml)


def test_docx_and_damaged_files(tmp_path):
    docx(tmp_path / "a.docx", ["Ann Lee", " ", "ann@x.io"])
    assert files.docx_text((tmp_path / "a.docx").read_bytes()) == "Ann Lee\nann@x.io"
    assert files.docx_text(b"no zip") == "" and files.docx_text(None) == "" and files.pdf_text(b"no pdf") == ""


def test_admission(spark):
    rows = items(spark, (None, "what.xyz"), ("linkedin_url", "https://linkedin.com/in/x"))
    r = one(consolidate(rows, AS_OF))
    assert r.error == "No usable sources" and r._warnings[0] == "Unknown source type: what.xyz" and r._warnings[1].startswith("LinkedIn source skipped")
    profile = items(spark, (None, "what.xyz"), ("linkedin_url", json.dumps({"given_name": "A", "family_name": "B", "email": "a@b.io", "profile_url": "https://l.example"})))
    r = one(consolidate(profile, AS_OF))
    assert r.error is None and r.full_name == "A B" and len(r._warnings) == 1 and r.links.linkedin == "https://l.example"


# ---- merge ----


def test_scalars_by_priority_with_conflicts(raw):
    m = one(merge(raw({"source_type": "csv", "full_name": "C"}, {"source_type": "ats_json", "full_name": "A"}, {"source_type": "other", "full_name": "A"}, {"source_type": "csv", "full_name": " "}), AS_OF))
    assert m.full_name == "A"
    assert [tuple(p) for p in m.provenance] == [("full_name", "csv", "direct", "conflict: overridden by ats_json"), ("full_name", "other", "direct", "conflict: overridden by ats_json"), ("full_name", "ats_json", "direct", None)]


def test_equal_raw_values_belong_to_the_first_source(raw):
    m = one(merge(raw({"source_type": "csv", "emails": ["A@x.io", "a@x.io", "bad", ""]}, {"source_type": "ats_json", "emails": ["a@x.io"]}), AS_OF))
    assert m.emails == ["a@x.io"] and m.provenance[0].source == "ats_json,csv"


def test_jobs_keep_the_dated_entry_where_the_pair_first_stood(raw):
    m = one(merge(raw({"source_type": "csv", "experience": [job("Acme", "Dev")]}, {"source_type": "ats_json", "experience": [job("Zed", "Boss", "2020-01", "2021-01")]},
                      {"source_type": "resume_pdf", "experience": [job(" ACME ", "dev", "March 2019", "now", "s"), job("acme", "dev", "2001", "2002")]}), AS_OF))
    assert [tuple(e) for e in m.experience] == [("Zed", "Boss", "2020-01", "2021-01", None), (" ACME ", "dev", "2019-03", None, "s")]
    assert m.years_experience == pytest.approx(8.2) and m.provenance[-1].method == "computed_from_experience"


def test_told_years_win(raw):
    m = one(merge(raw({"source_type": "csv", "years_experience": 0.0, "experience": [job("A", "B", "2001-01", None)]}), AS_OF))
    assert m.years_experience == 0.0


def test_courses_skills_and_links(raw):
    m = one(merge(raw({"source_type": "csv", "skills_raw": ["py", "Go"], "education": [("U", "B", None, 2001), ("U", None, "x", 1)], "other_urls": ["b", "", "a"]},
                      {"source_type": "ats_json", "skills_raw": ["Python", " "], "education": [("U", "B", "f", 2002)], "other_urls": ["a"]}), AS_OF))
    assert [(s.name, s.sources) for s in m.skills] == [("Python", ["ats_json", "csv"]), ("Go", ["csv"])]
    assert [tuple(e) for e in m.education] == [("U", "B", "f", 2002), ("U", None, "x", 1)] and m.links.other == ["a", "b"]


def test_nothing_scores_what_links_score(raw):
    r = one(profiles_of(raw({"source_type": "csv"}), AS_OF))
    assert (r.candidate_id, r.overall_confidence) == ("d41d8cd98f00b204", 0.029)


def test_order_of_distinct_sources_does_not_matter(spark, raw):
    records = [{"source_type": s, "full_name": s, "emails": [f"{s}@x.io".replace("_", "")], "skills_raw": [s, "Go"]} for s in D.SOURCES[:4]]
    frames = [raw(*order, run=str(i)) for i, order in enumerate(itertools.permutations(records))]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.union(f)
    got = {json.dumps(r.asDict(True) | {"run_id": ""}, sort_keys=True) for r in profiles_of(whole, AS_OF).collect()}
    assert len(got) == 1 and 0 <= json.loads(got.pop())["overall_confidence"] <= 1


# ---- projection ----


@pytest.fixture(scope="module")
def profile(raw):
    return profiles_of(raw({"source_type": "csv", "full_name": "Ann Lee", "emails": ["a@x.io", "b@x.io"], "phones": ["415-555-0123"], "location_raw": "Rome, Italy", "skills_raw": ["go", "sql"]}), AS_OF)


def shaped(profile, **config):
    return json.loads(one(render(project(profile, config))).json)


def test_paths(profile):
    paths = {"full_name": "Ann Lee", "emails[1]": "b@x.io", "emails[7]": None, "skills[].name": ["Go", "SQL"], "location.country": "IT", "full_name[0]": None, "a[0].b": None, "nothing": None, "location.city.x": None, "nope[].x": None}
    out = shaped(profile, fields=[{"path": f"p{i}", "from": p} for i, p in enumerate(paths)], include_confidence=False)
    assert out == {f"p{i}": v for i, v in enumerate(paths.values())} | {"_errors": out["_errors"]}
    assert out["_errors"] == ["Validation error at '$.p3': value is not of type string"]


def test_normalize_and_missing(profile):
    fields = [{"path": "up", "from": "full_name", "normalize": "LOWERCASE"}, {"path": "tel", "from": "phones", "type": "string[]", "normalize": "E164"}, {"path": "headline", "required": True}]
    assert shaped(profile, fields=fields, include_confidence=False) == {"up": "ann lee", "tel": ["+14155550123"], "headline": None}
    assert shaped(profile, fields=fields, include_confidence=False, on_missing="omit") == {"up": "ann lee", "tel": ["+14155550123"], "_errors": ["Validation error at '$': 'headline' is a required property"]}
    assert shaped(profile, fields=fields, include_confidence=False, on_missing="error")["_errors"] == ["Field 'headline' (from 'headline') is required but resolved to null/empty"]


def test_null_in_a_list_of_texts(profile):
    out = shaped(profile, fields=[{"path": "tel", "from": "emails", "type": "string[]", "normalize": "E164"}], include_confidence=False)
    assert out == {"tel": [None, None], "_errors": ["Validation error at '$.tel[0]': None is not of type 'string'"]}


def test_toggles(profile):
    plain = shaped(profile, include_confidence=False)
    assert "overall_confidence" not in plain and "provenance" not in plain and plain["skills"] == [{"name": "Go"}, {"name": "SQL"}] and plain["links"] == {"other": []}
    assert set(shaped(profile, fields=[{"path": "full_name"}])) == {"full_name", "_confidence", "_provenance"}
    assert one(validate(profile))._valid


# ---- store, batches, stream ----


def test_store_folds_and_lists(spark, raw, tmp_path):
    store = CandidateStore(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    a = profiles_of(raw({"source_type": "csv", "full_name": "Ann", "emails": ["a@x.io"], "headline": "Old", "location_raw": "Rome, Italy"}), AS_OF)
    b = profiles_of(raw({"source_type": "ats_json", "full_name": "Ann", "emails": ["a@x.io"], "headline": "New", "phones": ["415-555-0123"], "skills_raw": ["go"]}), AS_OF)
    c = profiles_of(raw({"source_type": "csv", "full_name": "Bob", "emails": ["b@x.io"]}), AS_OF)
    store.save(a, "2026-01-01 00:00:00", AS_OF)
    store.save(b.unionByName(c), "2026-02-01 00:00:00", AS_OF)
    rows = store.list().collect()
    assert [r.full_name for r in rows] == ["Bob", "Ann"]
    ann = one(store.get(rows[1].candidate_id))
    assert (ann.headline, ann.phones, ann.location.country, ann.skills[0].sources) == ("Old", ["+14155550123"], "IT", ["csv"])
    sources = [p.source for p in ann.provenance]
    assert sources[: len(one(a).provenance)] == ["csv"] * len(one(a).provenance) and "ats_json" in sources
    assert store.get("none").collect() == []


def test_fold_of_one_side_changes_nothing(raw):
    a = profiles_of(raw({"source_type": "csv", "full_name": "Ann", "emails": ["a@x.io"]}), AS_OF).drop("run_id")
    assert one(fold_pairs(a, a.limit(0), AS_OF)) == one(a)


def test_batch_of_folders(spark, tmp_path):
    for name in ("ann", "bob", "void"):
        (tmp_path / name).mkdir()
    (tmp_path / "ann/data.csv").write_text("name,email\nAnn Lee,a@x.io\n")
    (tmp_path / "ann/notes.txt").write_text("Ann Lee\nknows Kafka")
    docx(tmp_path / "bob/resume.docx", ["Bob Ray", "bob@x.io"])
    (tmp_path / "bob/resume.pdf").write_bytes(b"damaged")
    (tmp_path / "void/other.bin").write_bytes(b"x")
    lines, told = batch(spark, f"file://{tmp_path}", AS_OF)
    assert [(r.folder, r.status) for r in told.collect()] == [("ann", "ok"), ("bob", "ok"), ("void", "skipped")]
    ann = {r.run_id: json.loads(r.json) for r in lines.collect()}["ann"]
    assert ann["full_name"] == "Ann Lee" and ann["skills"][0]["name"] == "Apache Kafka"
    write_batch(lines, told, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out/profiles").count() == 2


def test_folders_are_told_by_their_place_not_by_their_name_alone(spark, tmp_path):
    for name in ("ann/deep/x", "bob", "void", ".hidden"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "ann/data.csv").write_text("name\nAnn Lee\n")
    (tmp_path / "ann/deep/data.csv").write_text("name\nNo One\n")
    (tmp_path / "bob/data.csv").write_text("name\nBob Ray\n")
    (tmp_path / "data.csv").write_text("name\nNo One\n")
    lines, told = batch(spark, f"file://{tmp_path}", AS_OF)
    assert [(r.folder, r.status) for r in told.collect()] == [("ann", "ok"), ("bob", "ok"), ("void", "skipped")]
    assert {r.run_id: json.loads(r.json)["full_name"] for r in lines.collect()} == {"ann": "Ann Lee", "bob": "Bob Ray"}
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        batch(spark, f"file://{tmp_path}/none", AS_OF)


def test_reader_errors_are_data(spark):
    rows = [("a", 0, "csv", None, None), ("a", 1, "recruiter_txt", "Ann Lee", None), ("b", 0, "csv", None, None), ("b", 1, "ats_json", "{}", "timeout"), ("c", 0, "recruiter_txt", "Bob Ray", None)]
    items = spark.createDataFrame(rows, "run_id string, src_seq int, source_type string, content string, extract_error string")
    got = {r.run_id: r for r in consolidate(items, AS_OF).collect()}
    assert (got["a"].error, got["a"]._errors, got["a"].full_name) == (None, ["Extractor csv failed: its content could not be read"], "Ann Lee")
    assert (got["b"].error, got["b"]._errors, got["b"].full_name) == ("All extractors failed", ["Extractor csv failed: its content could not be read", "Extractor ats_json failed: timeout"], None)
    assert (got["c"].error, got["c"]._errors) == (None, [])


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in/ann").mkdir(parents=True)
    (tmp_path / "in/void").mkdir()
    (tmp_path / "in/ann/data.csv").write_text("name,email\nAnn Lee,a@x.io\n")
    (tmp_path / "notes.txt").write_text("Ann Lee\nknows Kafka")
    (tmp_path / "shape.json").write_text(json.dumps({"fields": [{"path": "who", "from": "full_name"}, {"path": "mail", "from": "emails[0]", "required": True}], "on_missing": "omit"}))
    common = ["--as-of", AS_OF]
    assert command([*common, "--csv", f"{tmp_path}/in/ann/data.csv", "--notes", f"{tmp_path}/notes.txt", "--output", f"{tmp_path}/o/out.json", "--store", f"file://{tmp_path}/store"], spark) == 0
    assert json.loads((tmp_path / "o/out.json").read_text())["skills"][0]["name"] == "Apache Kafka"
    capsys.readouterr()
    assert command([*common, "--notes", f"{tmp_path}/notes.txt", "--config", f"{tmp_path}/shape.json"], spark) == 1
    assert json.loads(capsys.readouterr().out)["who"] == "Ann Lee"
    assert command(common, spark) == 2
    assert command([*common, "--batch", f"file://{tmp_path}/in", "--output", f"file://{tmp_path}/results", "--store", f"file://{tmp_path}/store"], spark) == 0
    assert [json.loads(r.value)["profile"]["full_name"] for r in spark.read.text(f"file://{tmp_path}/results/profiles").collect()] == ["Ann Lee"]
    assert [r.full_name for r in CandidateStore(spark, f"file://{tmp_path}/store").list().collect()] == ["Ann Lee"]
    assert command([*common, "--batch", f"file://{tmp_path}/in/void"], spark) == 2


def nobody(raw, n):
    return profiles_of(raw(*[]).unionByName(raw({"source_type": "csv", "headline": "x"})).crossJoin(raw({"source_type": "csv"}).sparkSession.range(n)).withColumn("run_id", F.col("id").cast("string")).drop("id"), AS_OF)


def test_strangers_without_mail_and_name_are_not_folded(spark, raw, tmp_path):
    store = CandidateStore(spark, f"file://{tmp_path}/store", buckets=8).init().init()
    many = nobody(raw, 100_000).withColumn("headline", F.concat(F.lit("job "), "run_id"))
    store.save(many, "2026-01-01 00:00:00", AS_OF)
    ann = profiles_of(raw({"source_type": "csv", "full_name": "Ann", "emails": ["a@x.io"]}), AS_OF)
    stored = store.save(ann.unionByName(nobody(raw, 1)), "2026-02-01 00:00:00", AS_OF)
    assert stored.count() == 100_002 and stored.select("headline").distinct().count() == 100_002
    rows = stored.groupBy(F.input_file_name()).count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 20_000
    assert one(store.get(one(ann).candidate_id)).full_name == "Ann" and store.get("d41d8cd98f00b204").count() == 1


class Overtaken(CandidateStore):
    """Lets another saver commit between this one's reading and its commit, once."""

    other = None

    def _commit(self, manifest):
        if self.other:
            other, self.other = self.other, None
            other()
        return super()._commit(manifest)


def test_two_savers_lose_nothing(spark, raw, tmp_path):
    path = f"file://{tmp_path}/store"
    mail = {"source_type": "csv", "full_name": "Ann", "emails": ["a@x.io"]}
    a, b, c = (profiles_of(raw(r), AS_OF) for r in (mail | {"headline": "A"}, mail | {"phones": ["415-555-0123"]}, mail | {"skills_raw": ["go"]}))
    CandidateStore(spark, path).save(a, "2026-01-01 00:00:00", AS_OF)
    late = Overtaken(spark, path)
    late.other = lambda: CandidateStore(spark, path).save(b, "2026-02-01 00:00:00", AS_OF)
    late.save(c, "2026-03-01 00:00:00", AS_OF)
    r = one(late.list())
    assert (r.headline, r.phones, [s.name for s in r.skills], str(r.created_at)) == ("A", ["+14155550123"], ["Go"], "2026-01-01 00:00:00")
    late.vacuum()
    assert one(CandidateStore(spark, path).list()) == r


def test_a_save_rewrites_its_own_buckets_only(spark, raw, tmp_path):
    store = CandidateStore(spark, f"file://{tmp_path}/store", buckets=16)
    people = [profiles_of(raw({"source_type": "csv", "full_name": f"P{i}", "emails": [f"p{i}@x.io"]}, run=str(i)), AS_OF) for i in range(3)]
    store.save(people[0].unionByName(people[1]), "2026-01-01 00:00:00", AS_OF)
    before = store._manifest()["folders"]
    store.save(people[0], "2026-01-02 00:00:00", AS_OF)
    after = store._manifest()["folders"]
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1


def test_a_replayed_batch_changes_nothing(spark, raw, tmp_path):
    store = CandidateStore(spark, f"file://{tmp_path}/store")
    a = profiles_of(raw({"source_type": "csv", "full_name": "Ann", "emails": ["a@x.io"]}), AS_OF).unionByName(nobody(raw, 1))
    for number, rows in ((0, 2), (0, 2), (1, 3), (1, 3), (0, 3)):
        assert store.save(a, "2026-01-01 00:00:00", AS_OF, batch=("stream", number)).count() == rows
    assert store.save(a, "2026-01-01 00:00:00", AS_OF, batch=("another", 0)).count() == 4


def test_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    line = {"run_id": "1", "src_seq": 0, "source_type": "csv", "content": "name,email\nAnn,a@x.io\n", "submitted_at": "2026-01-01T00:00:00Z"}
    notes = line | {"run_id": "2", "source_type": "ats_json", "content": json.dumps({"name": "Ann", "email": "a@x.io", "skills": "Go"})}
    (landing / "a.json").write_text("\n".join(json.dumps(x) for x in (line, line, notes)))
    store = CandidateStore(spark, f"file://{tmp_path}/store")
    fold_into(store, landed_items(spark, f"file://{landing}"), AS_OF, f"file://{tmp_path}/checkpoint").awaitTermination()
    r = one(store.list())
    assert (r.full_name, [s.name for s in r.skills]) == ("Ann", ["Go"])


def test_extract_shuffles_nothing_and_merge_once(spark):
    rows = items(spark, ("csv", "name\nA"))
    plan = profiles_of(extract(rows, AS_OF), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(run_id") == 1
    assert one(extract(rows, AS_OF).filter(F.col("source_type") == "csv")).full_name == "A"


def test_landed_items_give_the_same_profiles(spark, tmp_path):
    rows = items(spark, ("csv", "name,email\nAnn Lee,a@x.io"), (None, "what.xyz"), ("recruiter_txt", "Ann Lee\nknows Kafka"), ("csv", None))
    landed = landed_by_type(rows, f"file://{tmp_path}/items")
    assert one(consolidate(landed, AS_OF)) == one(consolidate(rows, AS_OF))
    plan = extract(landed.filter("source_type = 'csv'"), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan


def test_readers_scan_their_own_partition(spark, tmp_path):
    rows = items(spark, ("csv", "name\nA"), ("ats_json", "{}"), ("recruiter_txt", "x"))
    rows.write.partitionBy("source_type").parquet(f"file://{tmp_path}/landing")
    landed = spark.read.parquet(f"file://{tmp_path}/landing")
    plan = extract(landed, AS_OF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("PartitionFilters: [" in s and "source_type" in s.split("PartitionFilters: [")[1] for s in scans)


def test_folders_are_read_by_one_scan_and_one_python_operator(spark, tmp_path):
    """Only documents go to Python, each file is opened by one scan, and readers scan what was landed of their type."""
    from amalgam.sources.files import folder_files, folder_items

    (tmp_path / "ann").mkdir()
    (tmp_path / "ann/data.csv").write_text("name\nAnn Lee\n")
    (tmp_path / "ann/notes.txt").write_text("Ann Lee knows docker")
    root = f"file://{tmp_path}"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    read = plan(folder_files(spark, root))
    assert read.count("FileScan binaryFile") == 1 and read.count("ArrowEvalPython") <= 2
    items, _ = folder_items(spark, root)
    everything = plan(consolidate(items, AS_OF))
    assert "binaryFile" not in everything and "ArrowEvalPython" not in everything and "BatchEvalPython" not in everything


def test_a_resume_in_pdf_excludes_the_one_in_docx(spark, tmp_path):
    from amalgam.sources.files import folder_items

    for name, files in (("a", ["resume.docx"]), ("b", ["resume.docx", "resume.pdf"]), ("c", ["resume.pdf", "data.csv"])):
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_bytes(b"damaged")
    items, folders = folder_items(spark, f"file://{tmp_path}")
    assert sorted((r.run_id, r.source_type) for r in items.collect()) == [("a", "resume_docx"), ("b", "resume_pdf"), ("c", "csv"), ("c", "resume_pdf")]
    assert sorted(r.run_id for r in folders.collect()) == ["a", "b", "c"]


def test_many_folder_names_are_landed_in_parts(spark, tmp_path, monkeypatch):
    from amalgam.sources import files

    for i in range(25):
        (tmp_path / "in" / f"c{i:02d}").mkdir(parents=True)
    monkeypatch.setattr(files, "NAMES", 10)
    names = files.landed_names(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/names")
    assert sorted(r.run_id for r in names.collect()) == [f"c{i:02d}" for i in range(25)]


def test_a_save_evaluates_its_profiles_once(spark, raw, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        seen.add(1)
        return name

    people = profiles_of(raw({"source_type": "csv", "full_name": "Ann", "emails": ["a@x.io"]}), AS_OF).withColumn("headline", F.udf(counted, "string")("headline"))
    store = CandidateStore(spark, f"file://{tmp_path}/store")
    for saves in (1, 2, 3):
        assert store.save(people, "2026-01-01 00:00:00", AS_OF).count() == 1
        assert seen.value == saves
    store.vacuum()
    assert [p.name for p in (tmp_path / "store/manifests").glob("0*")] == [f"{3:012d}.json"]
    assert store.current().count() == 1
