"""Detectors on values assembled at run time, overlaps, windows and guards."""

import pytest

from lessonlake.operators.scrub import DETECTORS, Detector, Scrubber, check, scrub

RUN = Scrubber()
HEX = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a"
ALNUM = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hJ6"
CASES = [
    ("-----BEGIN RSA PRIVATE" + " KEY-----\nabc\n-----END RSA PRIVATE" + " KEY-----", "pem_key"),
    ("x " + "eyJ" + "hbGciOi." + "eyJ" + "zdWIi.sig-1", "jwt"),
    ("AKIA" + "ABCDEFGHIJKLMNOP", "aws_key"),
    ("ghp" + "_" + ALNUM, "github_token"),
    ("github" + "_pat_" + ALNUM, "github_pat"),
    ("glpat" + "-" + ALNUM[:20], "gitlab_pat"),
    ("AIza" + ALNUM[:35], "google_api_key"),
    ("npm" + "_" + ALNUM, "npm_token"),
    ("sk" + "_live_" + ALNUM[:24], "stripe_key"),
    ("xoxb" + "-" + ALNUM[:24], "slack_token"),
    ("sk-" + "ant-" + ALNUM + ALNUM, "anthropic_key"),
    ("sk-" + ALNUM, "openai_key"),
    ("Authorization: Bearer " + HEX, "bearer_token"),
    ('token = "' + HEX + '"', "assignment_secret"),
    ("postgres://me:" + "hunter2x" + "@host/db", "url_credential"),
    ("call +14155550123 now", "phone"),
    ("at 192.168.1.20 inside", "private_ipv4"),
    ("write to jo@mail.example.org", "email"),
]


@pytest.mark.parametrize("text,name", CASES)
def test_positive(text, name):
    out, counts = RUN(text)
    assert counts == {name: 1}
    assert {d.name: d.token for d in DETECTORS}[name] in out


@pytest.mark.parametrize("text", ["AKIA" + "ABCDEFGHIJKLMNO", "gh" + "p_short", "token budget is small", "password: aaaaaaaaaaaa", "call +0155", "192.168.1.999", "a@b", "8.8.8.8", "", "token " + "x" * 70 + " = " + HEX])
def test_negative(text):
    assert RUN(text) == (text, {})


def test_longest_span_wins_and_text_around_stays():
    text = "é https://user:" + "pa55word" + "@mail.example.com/x"
    out, counts = RUN(text)
    assert sum(counts.values()) == 1 and out.startswith("é ")


def test_bad_declarations():
    for bad in (Detector("a", "[A]", "a", (), 1), Detector("a", "[A]", "a", (), window=9), Detector("a", "[A]", "a", ("a",), guard=":")):
        with pytest.raises(ValueError):
            check((bad,))


def test_dataframe_keeps_all_rows(spark):
    rows = spark.createDataFrame([(1, "plain"), (2, "mail jo@mail.example.org"), (3, None), (4, "")], "id long, text string")
    got = {r.id: (r.text, r.redactions) for r in scrub(rows, "text").collect()}
    assert got == {1: ("plain", 0), 2: ("mail [EMAIL]", 1), 3: (None, 0), 4: ("", 0)}


def test_reports_over_fields(spark):
    from pyspark.sql import functions as F

    from lessonlake.operators import scrub as P

    mail, ip = "jo" + "@" + "example.org", "10.0.0.1"
    rows = [(1, mail, f"{ip} and {mail}", "plain"), (2, "é", "nothing", None), (3, "a", "b", f"at {ip}")]
    table = spark.createDataFrame(rows, "id long, title string, what string, learned string").withColumns({"task_type": F.lit("t"), "kind": F.lit("k")})
    fields = P.scrub_fields(table, ("title", "what", "learned"))
    got = {r.id: (r.counts, r.fields_redacted, r.redactions, r.title, r.what, r.learned) for r in fields.collect()}
    assert got[1] == ({"email": 2, "private_ipv4": 1}, ["title", "what"], 3, "[EMAIL]", "[PRIVATE_IP] and [EMAIL]", "plain")
    assert got[2] == ({}, [], 0, "é", "nothing", None) and got[3][:3] == ({"private_ipv4": 1}, ["learned"], 1)
    assert {r.pattern: r.n for r in P.by_pattern(fields).collect()} == {"email": 2, "private_ipv4": 2}
    assert P.stats(fields).first().asDict() == {"rows": 3, "redacted_rows": 2, "redactions": 4, "rate": round(2 / 3, 6)}
    once = P.rescrub(table)
    assert P.rescrub(once.drop("counts", "fields_redacted")).select("id", "fingerprint").exceptAll(once.select("id", "fingerprint")).isEmpty()


def test_offenders_are_words_or_the_whole(spark):
    from lessonlake.operators import scrub as P

    key, bearer = "AK" + "IA" + "ABCDEFGHIJKLMNOP", "Bear" + "er x9Kq2LmZ81vBn"
    table = spark.createDataFrame([(1, f"a {key} b"), (2, bearer), (3, "plain tags")], "id long, tags string")
    assert {(r.id, r.offender) for r in P.offenders(table, "tags", "id").collect()} == {(1, key), (2, bearer)}


def test_many_matches_in_one_text():
    import time

    from lessonlake.operators.scrub import Scrubber

    began = time.monotonic()
    text, counts = Scrubber()(("jo" + "@" + "example.org ") * 20000)
    assert counts == {"email": 20000} and text == "[EMAIL] " * 20000 and time.monotonic() - began < 20
