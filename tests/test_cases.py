"""Operators over inputs written out here: what has to come out is worked out by hand from the rules."""

from __future__ import annotations

from collections.abc import Callable

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.operators import advice, classify, detect, doctype, keywords, score
from exposark.plans import history, reports, sessions, store
from exposark.sources import corpus as C
from exposark.sources import pages as P

CASES: dict[str, tuple[str, Callable[[SparkSession], DataFrame]]] = {}


def case(sql: str):
    def add(f):
        CASES[f.__name__] = (sql, f)
        return f

    return add


def expected(columns: str, *rows: tuple) -> str:
    """SQL of the rows that have to come out."""
    quoted = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({columns})"


def given(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


@case("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{v}', {len(n)}, {len(m)})" for i, (s, v, n, m) in enumerate(tables.SCENARIOS)) + ") AS t(seq, scenario, severity, n_required, n_optional)")
def scenario_catalogue(spark):
    return advice.catalogue(spark).select("seq", "scenario", "severity", F.size("required").alias("n_required"), F.size("optional").alias("n_optional"))


@case(expected(
    "id, type, value",
    (1, "email", "a.b@example.org"), (2, "phone", "9876543210"), (3, "aadhaar", "2345 6789 0123"), (4, "pan_card", "ABCDE1234F"), (5, "credit_card", "4532 0151 1283 0366"), (5, "aadhaar", "4532 0151 1283"), (6, "cvv", "123"), (7, "dob", "15/08/1995"), (8, "otp", "482913"),
    (9, "password", "Secret@123"), (10, "otp", "2024"), (12, "person_name", "Asha Rao"), (13, "id_number", "AB-1234"), (14, "password", "KX7mq2zt94"), (15, "password", "sujay1234"), (16, "email", "sujay1234@mail.com"),
))
def document_profile(spark):
    """The document profile, one text a type: labelled and unlabelled passwords too, and what must give nothing."""
    texts = given(
        spark, "id int, text string",
        (1, "write to a.b@example.org"), (2, "call 9876543210 today"), (3, "id 2345 6789 0123"), (4, "ABCDE1234F"), (5, "4532 0151 1283 0366"), (6, "CVV: 123"), (7, "DOB: 15/08/1995"), (8, "Your OTP is 482913"), (9, "password: Secret@123"), (10, "year after phrase: OTP 2024"), (11, "é9876543210"),
        (12, "Full Name: Asha Rao, here"), (13, "Passport No: AB-1234."), (14, "the wifi key KX7mq2zt94 works"), (15, "New password  sujay1234 confirm"), (16, "password of sujay1234@mail.com"), (17, "synopsis KX7mq2zt94"), (18, "Room B-12 is well-known in 2024-25, 4SU22CS099"), (19, None),
    )
    return detect.exploded(texts, detect.document_findings(F.col("text")), "id")


@case(expected(
    "id, type, value",
    (1, "aadhaar", "1234 5678 9012"), (2, "pan", "ABCDE1234F"), (3, "credit_card", "4532 0151 1283 0366"), (3, "aadhaar", "0151 1283 0366"), (4, "email", "a@b.co"), (5, "phone", "9876543210"), (6, "password", "hunter22"), (7, "otp", "code is 48291"), (8, "dob", "15/08/1995"),
    (10, "aadhaar", "0345-6789-0123"), (11, "aadhaar", "2345 6789 0123"), (12, "password", "abcd1"), (13, "otp", "verification code 998877"),
))
def screen_profile(spark):
    texts = given(
        spark, "id int, text string",
        (1, "aadhaar: 1234 5678 9012"), (2, "xABCDE1234F"), (3, "4532 0151 1283 0366"), (4, "a@b.co"), (5, "9876543210"), (6, "pwd = hunter22"), (7, "OTP: code is 48291"), (8, "on 15/08/1995"), (9, "on 15/08/2015 and 5123 4567 8901"), (10, "0345-6789-0123"), (11, "2345 6789 0123 and 4532015112"), (12, "pass: abcd1"), (13, "verification code 998877"), (14, None),
    )
    return detect.exploded(texts, detect.screen_findings(F.col("text")), "id")


@case(expected(
    "id, type, value",
    (1, "aadhaar", "2000 0000 0009"), (2, "credit_card", "4532015112830366"), (4, "password", "letmein9"), (6, "otp", "4821"), (8, "phone", "9876543210"), (10, "http_only", "http://a.com"),
))
def web_profile(spark):
    texts = given(
        spark, "id int, text string, url string",
        (1, "no 2000 0000 0009 here", "https://a.com"), (2, "4532 0151 1283 0366", "https://a.com"), (3, "4532 0151 1283 0367", "https://a.com"), (4, "passcode: letmein9", "https://a.com"), (5, "password: inter-department", "https://a.com"), (6, "login code 4821", "https://a.com"),
        (7, "login code 2024", "https://a.com"), (8, "ring 9876543210", "https://a.com"), (9, "1 9876543210 2", "https://a.com"), (10, "nothing", "http://a.com"), (11, "token = true", "https://a.com"), (12, None, "https://a.com"),
    )
    return detect.exploded(detect.with_url_findings(texts), F.col("findings"), "id")


@case(expected(
    "id, allowed",
    (1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False), (8, True), (9, False), (10, False), (11, True), (12, False),
))
def url_guard(spark):
    urls = given(
        spark, "id int, url string",
        (1, "https://example.org/a"), (2, " example.org/b "), (3, "http://localhost/x"), (4, "http://169.254.169.254/"), (5, "http://10.1.2.3/"), (6, "http://172.31.0.1"), (7, "https://192.168.1.9:8080/a"), (8, "http://172.32.0.1"), (9, "https://example.org/latest/meta-data/x"), (10, "http://0.0.0.0"), (11, "https://10.example.org"), (12, "https://user:pw@127.0.0.1/"),
    )
    return urls.select("id", C.is_allowed(F.col("url")).alias("allowed"))


@case(expected("id, title, text", (1, "A page", "A page\nWelcome to the page of a museum\nOpen daily\nWelcome to the page of a museum\nTickets & more"), (2, "Untitled Page", "x < y"), (3, "Untitled Page", "")))
def page_text(spark):
    html = "<html><head><title> A page </title><style>p{}</style></head><body><nav><a>Tours</a></nav><p>Welcome to the page of a museum</p><p>Open daily</p><div>Login</div><p>open daily</p><p>Welcome to the page of a museum</p><script>var x = 1</script><p>Tickets &amp;   more</p><footer>imprint</footer></body></html>"
    pages = given(spark, "id int, html string", (1, html), (2, "<p>x &lt; y</p>"), (3, None))
    return pages.select("id", P.title(P.page(F.col("html"))).alias("title"), P.lines(P.page(F.col("html"))["text"]).alias("text"))


@case(expected(
    "id, provider, download",
    (1, "gdrive", "https://drive.google.com/uc?export=download&id=abc_1"), (2, "dropbox", "https://www.dropbox.com/s/x/a.pdf?dl=1"), (3, "onedrive", "https://1drv.ms/b/x?download=1"), (4, "direct_url", "https://example.org/a.pdf"), (5, None, None),
))
def links(spark):
    urls = given(spark, "id int, url string", (1, "https://drive.google.com/file/d/abc_1/view"), (2, "https://www.dropbox.com/s/x/a.pdf?dl=0"), (3, "https://1drv.ms/b/x"), (4, "https://example.org/a.pdf"), (5, "ftp://example.org/a.pdf"))
    return urls.select("id", C.resolved_link(F.col("url")).alias("l")).select("id", "l.*")


@case(expected("id, kind, extension, readable", (1, ".pdf", ".pdf", True), (2, ".png", ".png", True), (3, ".html", ".html", False), (4, None, ".pdf", True), (5, ".docx", ".docx", True)))
def file_kinds(spark):
    files = given(
        spark, "id int, content binary, content_type string, url string",
        (1, bytearray(b"%PDF-1.7"), "application/pdf; charset=x", "https://a.org/x"), (2, bytearray(b"\x89PNG\r\n"), None, "https://a.org/x.png?y=1"), (3, bytearray(b" <!DOCTYPE html>"), "text/html", "https://a.org/"), (4, bytearray(b"plain"), None, "https://a.org/x"), (5, bytearray(b"PK\x03\x04"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "u"),
    )
    ext = C.guessed_extension(F.col("content_type"), F.col("url"))
    return files.select("id", C.sniffed(F.col("content")).alias("kind"), ext.alias("extension"), C.is_readable(ext, F.length("content"), "metadata").alias("readable"))


META = ((1, "author", "A B"), (2, "author", "A B"), (2, "software", "W 1"), (3, "gps_full", "1,2"), (3, "gps_latitude", "1"), (3, "gps_longitude", "2"), (4, "subject", "x@y.org"), (5, "page_count", "7"), (5, "creator", " (unknown) "), (6, "title", "C:\\Users\\ann\\a.docx"), (7, "keywords", "call 98765 43210"), (8, "tracked_changes", "ACTIVE"))


@case(expected(
    "file_id, score, n_sensitive, risk",
    (1, 15.0, 1, "LOW"), (2, 20.0, 2, "MEDIUM"), (3, 60.0, 3, "HIGH"), (4, 20.0, 1, "MEDIUM"), (5, 0.0, 0, "SAFE"), (6, 25.0, 1, "MEDIUM"), (7, 20.0, 1, "MEDIUM"), (8, 20.0, 1, "MEDIUM"),
))
def metadata_score(spark):
    return score.metadata_scores(given(spark, "file_id int, field string, value string", *META))


@case(expected(
    "file_id, field, label, risk",
    (1, "author", "Document Creator", "HIGH"), (2, "author", "Document Creator", "HIGH"), (2, "software", "Creation Software", "MEDIUM"), (3, "gps_full", "GPS Physical Location", "CRITICAL"), (3, "gps_latitude", "GPS Latitude", "HIGH"), (3, "gps_longitude", "GPS Longitude", "HIGH"),
    (4, "subject", "Document Subject", "HIGH"), (5, "page_count", "Total Pages", None), (6, "local_path", "Local File Location", "CRITICAL"), (7, "keywords", "Tags / Keywords", "HIGH"), (8, "tracked_changes", "Tracked Changes", "HIGH"),
))
def metadata_fields(spark):
    return score.metadata_fields(given(spark, "file_id int, field string, value string", *META)).select("file_id", "field", "label", "risk")


@case(expected("file_id, title, severity", *((i, "Strip Metadata Before Sharing", "HIGH") for i in (1, 2, 3, 4, 6, 7, 8)), (3, "Disable Camera GPS", "CRITICAL")))
def metadata_advice(spark):
    return advice.metadata_advice(given(spark, "file_id int, field string, value string", *META))


@case(expected("file_id, text", (2, "Sensitive:\nCreation Software: W 1\nDocument Creator: A B\nOther:\n"), (5, "Sensitive:\n\nOther:\nTotal Pages: 7")))
def metadata_text(spark):
    return reports.metadata_text(score.metadata_fields(given(spark, "file_id int, field string, value string", *(r for r in META if r[0] in (2, 5)))))


@case(expected("path, field, value", ("a.docx", "author", "Ann Lee"), ("a.docx", "last_modified_by", "Bo"), ("a.docx", "company", "Acme"), ("a.docx", "word_count", "812"), ("a.docx", "tracked_changes", "ACTIVE (Privacy Risk: Edit history is visible)")))
def office_fields(spark):
    core = "<cp:coreProperties><dc:creator>Ann Lee</dc:creator><cp:lastModifiedBy>Bo</cp:lastModifiedBy><dc:title>None</dc:title></cp:coreProperties>"
    app = "<Properties><Company>Acme</Company><Words>812</Words><Sheets>x</Sheets></Properties>"
    return C.office_fields(given(spark, "path string, core string, app string, settings string", ("a.docx", core, app, '<w:settings><w:trackRevisions w:val="1"/></w:settings>'), ("b.docx", None, None, None)))


@case(expected("id, degrees", (1, 12.582222), (2, -12.582222), (3, -77.5), (4, 0.0)))
def degrees(spark):
    rows = given(spark, "id int, d double, m double, s double, side string", (1, 12.0, 34.0, 56.0, "N"), (2, 12.0, 34.0, 56.0, "S"), (3, 77.0, 30.0, 0.0, "W"), (4, 0.0, 0.0, 0.0, "E"))
    return rows.select("id", C.decimal_degrees(F.col("d"), F.col("m"), F.col("s"), F.col("side")).alias("degrees"))


@case(expected("value, garbage, date_like, confidence", ("Ravi Kumar", False, False, 0.75), ("ravi", True, False, 0.0), ("EE Sie", True, False, 0.49), ("Room 42", True, False, 0.54), ("India 2024", False, False, 0.67), ("Variou Thing", True, False, 0.77), ("Sujay Bhat - Facebook", True, False, 1.0), ("Inter-Department", True, True, 0.73), ("18-Apr-2026", True, True, 0.5), ("2026-27", False, True, 0.32), ("Ledger Station", True, False, 0.86), ("AB CD", True, False, 0.45)))
def entities(spark):
    """Named entities: noise, dates, and confidence as a place's name has it; Ravi Kumar as a person's."""
    rows = given(spark, "value string, label string", *((v, "PERSON" if v == "Ravi Kumar" else "GPE") for v in ("Ravi Kumar", "ravi", "EE Sie", "Room 42", "India 2024", "Variou Thing", "Sujay Bhat - Facebook", "Inter-Department", "18-Apr-2026", "2026-27", "Ledger Station", "AB CD")))
    v = F.col("value")
    return rows.select("value", detect.is_entity_garbage(v).alias("garbage"), detect.is_date_like(v).alias("date_like"), detect.entity_confidence(v, F.col("label")).alias("confidence"))


PROFILES = (
    (1, "linkedin", {"username": "ann", "display_name": "Ann Lee", "bio": "I write about rivers"}, []),
    (2, "github", {"username": "bo", "display_name": "Bo K", "bio": "Founder of things", "company": "X"}, []),
    (3, "reddit", {"username": "carla", "display_name": "Carla", "location": "Pune", "website": "c.example"}, [("email", "c@gmail.com"), ("phone", "9876543210")]),
    (4, "reddit", {"username": "user77", "display_name": "user77"}, []),
    (5, "twitter", {"username": "dev", "display_name": "Dev Rao", "bio": "runner"}, [("email", "d@work.example")]),
)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), "id int, platform string, fields map<string,string>, findings array<struct<type:string,value:string>>")


@case(expected("id, exposure", (1, "public_business"), (2, "public_business"), (3, "personal_exposure"), (4, "anonymous"), (5, "professional_public")))
def profile_class(spark):
    return profiles(spark).select("id", classify.exposure_class(F.col("platform"), F.col("fields"), F.col("findings")).alias("exposure"))


@case(expected(
    "id, type, value",
    (1, "username", "ann"), (1, "display_name", "Ann Lee"), (1, "bio", "I write about rivers"), (2, "username", "bo"), (2, "display_name", "Bo K"), (2, "bio", "Founder of things"), (3, "username", "carla"), (3, "location", "Pune"), (3, "website", "c.example"), (4, "username", "user77"), (5, "username", "dev"), (5, "display_name", "Dev Rao"),
))
def profile_fields(spark):
    return detect.exploded(profiles(spark), detect.profile_findings(F.col("fields"), F.lit(False)), "id")


@case(expected("id, text", (1, "I climb hills\nand write"), (2, "")))
def profile_text(spark):
    rows = given(spark, "id int, text string", (1, "Log in\nI climb hills\n\nok\nPrivacy Policy\nenter your password\nand write"), (2, None))
    return rows.select("id", detect.profile_text(F.col("text")).alias("text"))


@case(expected("id, points", (1, 28.0), (2, 15.0), (3, 32.8), (4, 36.0), (5, 0.0)))
def entity_points(spark):
    """Points of named entities: soft types are capped in calm documents only; two ids of 18 count 1.7 times."""
    rows = given(
        spark, "id int, doc_type string, entities array<struct<type:string,weight:int>>",
        (1, "passport", [("person_name", 20)]), (2, "generic", [("person_name", 20), ("location", 12)]), (3, "passport", [("location", 12), ("location", 12), ("demographic", 3)]), (4, "generic", [("financial", 15), ("person_name", 20)]), (5, "generic", []),
    )
    return rows.select("id", doctype.entity_points(F.col("entities"), F.col("doc_type")).alias("points"))


@case(expected("id, n, points", (1, 2, 38.64), (2, 0, 0.0), (3, 0, 0.0), (4, 4, 60.0)))
def vision(spark):
    """What detectors saw as findings and points: 22 for faces, 30 for a sure id document, 12 for a signature, 15 for codes, times confidence times 1.2."""
    rows = given(
        spark, "id int, seen struct<faces:int,face_confidence:double,id_document:boolean,id_confidence:double,signature:boolean,signature_confidence:double,codes:int,code_confidence:double>",
        (1, (2, 0.85, False, 0.0, False, 0.0, 1, 0.9)), (2, (0, 0.0, True, 0.55, False, 0.0, 0, 0.0)), (3, (0, 0.0, False, 0.0, False, 0.0, 0, 0.0)), (4, (3, 0.97, True, 0.9, True, 0.6, 1, 0.9)),
    )
    rows = rows.withColumn("found", doctype.vision_findings(F.col("seen")))
    return rows.select("id", F.size("found").alias("n"), F.round(doctype.vision_points(F.col("found")), 2).alias("points"))


@case(expected("id, score, risk", (1, 55.0, "HIGH"), (2, 40.0, "LOW"), (3, 95.0, "CRITICAL"), (4, 18.0, "MEDIUM")))
def agent_score(spark):
    rows = given(spark, "id int, document double, boost int, risk string", (1, 40.0, 15, "HIGH"), (2, 40.0, 0, "LOW"), (3, 80.0, 15, "HIGH"), (4, 13.0, 5, "LOW"))
    return rows.select("id", doctype.agent_score(F.col("document"), F.col("boost"), F.col("risk")).alias("a")).select("id", "a.*")


@case(expected("id, label, extracted_text", (1, "Passport", "body"), (2, "Mine", "body"), (3, None, "no prefix"), (4, None, None)))
def legacy_prefix(spark):
    rows = given(spark, "id int, label string, extracted_text string", (1, None, "[Document Type: Passport]\nbody"), (2, "Mine", "[Document Type: Other]\nbody"), (3, None, "no prefix"), (4, None, None))
    return store.without_prefix(rows)


@case(expected("word, hide", ("mail", False), ("ann@x.org", True), ("or", False), ("9876543210", True), ("sujay8277", True), ("the", False), ("key", False), ("sujay8277#", True)))
def redaction(spark):
    rows = given(spark, "text string, found array<string>", ("mail ann@x.org or 9876543210 sujay8277 the key sujay8277# a", ["sujay8277#"]))
    return rows.select(F.explode(detect.redacted(F.col("text"), F.col("found"))).alias("w")).select("w.*")


@case(expected("id, snippet", (1, "Document: a.txt\n\nHead body"), (2, "x y"), (3, "")))
def snippet(spark):
    rows = given(spark, "id int, text string, filename string", (1, "Head ======= 0123456789abcdef body", "a.txt"), (2, "x é   y", None), (3, None, ""))
    return rows.select("id", classify.snippet(F.col("text"), F.col("filename")).alias("snippet"))


@case(expected("id, scenario", (1, "phishing_email"), (2, "credential_stuffing"), (2, "phishing_email"), (3, "aadhaar_impersonation"), (3, "pan_financial_fraud"), (3, "full_kyc_theft"), (4, "card_cloning"), (5, "birthday_social_eng"), (5, "data_broker_profile"), (6, "impersonation"), (6, "data_broker_profile")))
def scenarios(spark):
    """Scenarios of findings that a client posts, with aliases; dynamic ones among them."""
    rows = given(spark, "id int, types array<string>", (1, ["email"]), (2, ["email", "password"]), (3, ["aadhaar", "pan"]), (4, ["credit_card"]), (5, ["dob", "author"]), (6, ["artist", "company", "location"]), (7, []))
    return rows.select("id", F.explode(advice.fired(F.col("types"))).alias("s")).select("id", "s.scenario")


@case(expected("id, threat", (1, 48.0), (2, 63.0), (3, 55.0), (4, 55.0), (5, 20.0)))
def threat(spark):
    rows = given(spark, "id int, base double, types array<string>", (1, 40.0, ["email"]), (2, 40.0, ["email", "password"]), (3, 10.0, ["aadhaar", "pan_card"]), (4, 40.0, ["credit_card"]), (5, 40.0, []))
    return rows.select("id", advice.threat(F.col("base"), advice.fired(F.col("types"))).alias("threat"))


@case(expected("type, value, confidence, label", ("email", "a@b.co", 0.95, "HIGH"), ("phone", "9876543210", 0.9, "HIGH"), ("pan_card", "ABCDE1234F", 1.0, "HIGH"), ("credit_card", "4532015112830366", 0.78, "HIGH"), ("cvv", "123", 0.72, "MEDIUM"), ("otp", "482913", 0.65, "MEDIUM"), ("password", "Secret@123", 0.667, "MEDIUM"), ("person_name", "Ann", 0.5, "MEDIUM")))
def confidence(spark):
    rows = given(spark, "type string, value string", ("email", "a@b.co"), ("phone", "9876543210"), ("pan_card", "ABCDE1234F"), ("credit_card", "4532015112830366"), ("cvv", "123"), ("otp", "482913"), ("password", "Secret@123"), ("person_name", "Ann"))
    sure = score.confidence(F.col("type"), F.col("value"))
    return rows.select("type", "value", sure.alias("confidence"), score.confidence_label(sure).alias("label"))


@case(expected("session_id, frame_id", (1, 1), (1, 4), (1, 6), (2, 7)))
def cooldown(spark):
    """Alerts at 0, 10, 29, 30, 45 and 61 seconds: those at 0, 30 and 61 pass."""
    rows = given(spark, "session_id long, frame_id long, s long", (1, 1, 0), (1, 2, 10), (1, 3, 29), (1, 4, 30), (1, 5, 45), (1, 6, 61), (2, 7, 5)).withColumn("ts", F.timestamp_seconds("s"))
    return sessions.with_cooldown(rows)


@case(expected("id, class", (1, "passport"), (2, "passport"), (3, "generic"), (4, "invoice")))
def keyword_class(spark):
    """Keywords count in file names too."""
    rows = given(spark, "id int, text string, filename string", (1, "passport", None), (2, "nothing", "passport scan.pdf"), (3, "guide build", "x.txt"), (4, "Invoice for you, bill to Ann", None))
    return rows.select("id", classify.keyword_class(F.col("text"), F.col("filename"))["doc_type"].alias("class"))


@case(expected("score, label", (0.9, "HIGH"), (0.5, "MEDIUM"), (0.1, "LOW"), (None, "LOW")))
def confidence_labels(spark):
    return given(spark, "score double", (0.9,), (0.5,), (0.1,), (None,)).select("score", F.when(F.col("score") >= 0.70, "HIGH").when(F.col("score") >= 0.45, "MEDIUM").otherwise("LOW").alias("label"))


@case(expected("id, i, part", (1, 0, "a" * 500), (1, 1, "b" * 20), (2, 0, "x")))
def text_parts(spark):
    """A fetched text in parts of 500 characters, 8000 at most in all."""
    rows = given(spark, "id int, text string", (1, "a" * 500 + "b" * 20), (2, "x"), (3, ""))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.least(F.length("text"), F.lit(8000)) - 1) / 500).cast("int")), lambda i: F.substring(F.col("text"), i * 500 + 1, F.lit(500)))
    return rows.where(F.length("text") > 0).select("id", F.posexplode(parts).alias("i", "part"))


def plainly(rows, names, columns):
    """Rows as texts, in order; numbers of other types but the same value are equal."""
    value = lambda x: float(x) if type(x).__name__ in ("int", "float", "Decimal") else x
    return sorted(repr([value(r[names.index(c)]) for c in columns]) for r in rows)


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    sql, run = CASES[name]
    theirs, ours = duckdb.sql(sql), run(spark)
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert plainly([tuple(r) for r in ours.collect()], ours.columns, columns) == plainly(theirs.fetchall(), theirs.columns, columns)
