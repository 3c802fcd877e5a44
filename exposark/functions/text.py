"""Text functions as column expressions; none runs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposark.functions import tables

# The dihedral group's multiplication and the position permutation of the Verhoeff check.
VERHOEFF_D = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6), (3, 4, 0, 1, 2, 8, 9, 5, 6, 7), (4, 0, 1, 2, 3, 9, 5, 6, 7, 8), (5, 9, 8, 7, 6, 0, 4, 3, 2, 1), (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3), (8, 7, 6, 5, 9, 3, 2, 1, 0, 4), (9, 8, 7, 6, 5, 4, 3, 2, 1, 0))
VERHOEFF_P = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2), (8, 9, 1, 6, 0, 4, 3, 5, 2, 7), (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1), (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often it is used, inside other lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches, first seen first."""
    return F.array_distinct(all_matches(text, pattern, group))


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(c, "")
    n = F.length(c).cast("double")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(-F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a + share(x) * F.log2(share(x))))


def luhn(c: Column) -> Column:
    """Whether the digits of c pass the Luhn check."""
    reverse = F.split(F.reverse(digits(c)), "")
    weighed = F.transform(reverse, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return (F.length(digits(c)) > 0) & (F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0)


def verhoeff(c: Column) -> Column:
    """Whether the digits of c pass the Verhoeff check."""
    table = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    reverse = F.split(F.reverse(digits(c)), "")
    permuted = F.transform(reverse, lambda x, i: F.get(F.get(table(VERHOEFF_P), i % 8), x.cast("int")))
    return (F.length(digits(c)) > 0) & (F.aggregate(permuted, F.lit(0), lambda a, x: F.get(F.get(table(VERHOEFF_D), a), x)) == 0)


def letter_digit_ratio(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / F.length(c))


def first_of_each(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first of the values of each key, in their order; by sorting, so that long arrays take no quadratic time."""
    placed = F.array_sort(F.transform(values, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("value"))))
    kept = let(placed, lambda a: F.filter(a, lambda x, j: (j == 0) | (F.get(a, j - 1)["key"] != x["key"])))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["value"].alias("value")))), lambda x: x["value"])


def clean_lines(text: Column) -> Column:
    """Lines without the white space at their ends, of 3 characters or more and 35 % letters or digits, the first of equal ones (in any case) only."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), stripped), lambda x: (F.length(x) >= 3) & (letter_digit_ratio(x) >= 0.35))
    # equal lines stand together once sorted, the first of them first; what is kept is sorted back
    placed = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("i"), x.alias("line"))))
    first = F.transform(F.array(placed), lambda a: F.filter(a, lambda x, j: (j == 0) | (F.get(a, j - 1)["key"] != x["key"])))
    back = F.array_sort(F.transform(F.get(first, F.lit(0)), lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"))))
    return F.array_join(F.transform(back, lambda x: x["line"]), "\n")


def masked(text: Column) -> Column:
    """Text with addresses, cards and labelled credentials replaced by their kinds."""
    out = F.regexp_replace(text, EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, WHOLE_CARD, "[CARD]")
    return F.regexp_replace(out, r"(?i)((?:password|passwd|pwd|secret|token|apikey|api_key)\s*[=:]\s*)\S+", "$1[SECRET]")


# The detectors' patterns and words.
NO_NAMES, PLACEHOLDERS = tables.NO_NAMES, tables.PLACEHOLDERS
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
TOKEN = r"\b[A-Za-z0-9@#$!%^&*_\-]{6,30}\b"
MIXED_TOKEN = r"\b(?=[A-Za-z0-9@#$!%^&*_\-]*[A-Z])(?=[A-Za-z0-9@#$!%^&*_\-]*[a-z])(?=[A-Za-z0-9@#$!%^&*_\-]*[0-9@#$!%^&*_\-])[A-Za-z0-9@#$!%^&*_\-]{6,30}\b"
NO_PASSWORD = (
    r"^[0-9]+$|(?i)^[a-z]+-[a-z]+$|^\d{1,2}[-/](?:" + MONTHS + r")[-/]\d{2,4}\b|^(?:19|20)\d{2}-\d{2,4}\b|^(?:19|20)\d{2}$"
    r"|^\d[a-z]{2}\d{2}[a-z]{2}\d{3}$|^[a-z]{2,4}\d{2}[a-z]{2}\d{3}$|^[up]\d{2}[a-z]{2,4}\d{2}[a-z]{1,2}\d{3,6}$|(?-i)_|[a-z][A-Z]"
)
PASSWORD_LABEL = r"(?is)(?:password|passwd|pwd|passcode|secret|credential)(?=(.{0,142}))"
YEAR = r"\b(?:19|20)\d{2}\b"
FISCAL_YEAR = r"\b(?:19|20)\d{2}[-–](?:19|20)?\d{2}\b"
NOISE_DATE = rf"(?i)\b\d{{1,2}}[-/](?:{MONTHS})[-/]\d{{2,4}}\b|\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b"
ACADEMIC_LABEL = r"(?i)\b(?:batch|session|semester|academic|term|inter[-\s]department|roll\s*no|enrollment|admission|june[-–]july|july[-–]august)\b"
WEB_EMAIL = r"\b[A-Za-z0-9._%+\-]{2,}@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
WEB_AADHAAR = r"\b[2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}\b"
WEB_PHONE = r"(?<!\d\s)\b[6-9][0-9]{9}\b|\b[6-9][0-9]{9}\b(?!\s\d)"
WEB_CARD = r"\b(?:\d[ \-]?){13,16}\b"
WEB_CREDENTIAL = r"(?i)(?:password|passwd|pwd|pass|passcode|secret|token|api[-_]?key|auth[-_]?key)\s*[=:]\s*([^\s,\"'<>{}\[\]\n]{4,30})"
WEB_OTP = r"(?i)(?:otp|one[-\s]time\s+(?:password|passcode|pin)|verification\s+code|auth(?:entication)?\s+code|login\s+code|security\s+code|confirm(?:ation)?\s+code)\D{0,50}(\d{4,6})"
WEB_CVV = r"(?i)\b(?:CVV|CVC|CVV2|security\s+code)\b\D{0,20}(\d{3,4})"
SCREEN_AADHAAR = r"(?i)(?:aadhaar|aadhar|uid|:)\s*(?:\d{4}[\s\-]){2}\d{4}|(?<!\d)[0-36-9]\d{3}[\s\-]\d{4}[\s\-]\d{4}(?![\s\-]\d)(?!\d)"
SCREEN_CARD = r"(?<!\d)\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}(?!\d)"
SCREEN_PASSWORD = r"(?i)(?:password|passwd|pwd|pass)\s*[=:\-]\s*\S{4,}"
SCREEN_OTP = r"(?i)\b(?:otp|one[\s\-]time[\s\-](?:password|pin|code)|verification\s+code)\b.{0,30}\b\d{4,8}\b"
SCREEN_DOB = r"(?<!\d)(?:0[1-9]|[12]\d|3[01])[/\-](?:0[1-9]|1[0-2])[/\-](?:19\d{2}|200\d)(?!\d)"
PROFILE_NOISE = (
    r"(?i)\b(?:log\s*in|sign\s*in|sign\s*up|create\s*account|register)\b|\b(?:forgot\s*password|reset\s*password|change\s*password)\b|\b(?:cookie|privacy\s*policy|terms\s*of\s*service|terms\s*of\s*use)\b"
    r"|\b(?:help\s*center|support\s*center|report\s*abuse|contact\s*us)\b|\b(?:account\s*safety|two.factor|authenticat(?:ion|or))\b|\b(?:download\s*the\s*app|get\s*the\s*app|available\s*on)\b"
    r"|\b(?:reddit\s*inc|instagram\s*llc|twitter\s*inc|meta\s*platforms)\b|\bone.time\s*password\b|\benter\s*your\s*(?:username|email|password)\b|\bwe\s*will\s*never\s*ask\b|\bwe\s*won.t\s*ask\b"
    r"|\bvia\s*direct\s*message\b.{0,40}(?:password|code)\b|\bverif(?:y|ication)\s*code\b"
)
CUT_ENDINGS = "ica|ton|eare|tion|ting|iver|ator|ware|orm|ork|ess|ment|ance|ence|ling|ered"
SURNAME_ENDINGS = "arma|erma|umar|ingh|atre|ance|erce"
CUT_NAMES = ("variovs", "variou", "vario", "conn", "cosm", "appl", "goog", "whats", "micro", "amazo", "faceb", "twitt", "insta", "telgr", "notif", "setti", "dialer", "messag", "camer", "galery", "galer")
TAB_TITLES = "facebook|instagram|twitter|whatsapp|telegram|snapchat|youtube|linkedin|reddit|tiktok|pinterest|discord|google|gmail|outlook|yahoo|hotmail"
SCREEN_WORDS = ("variovs applica", "conn ledton", "cosm jooeare", "various applications", "connection ledton", "cosmic jooeare", "whatsapp", "google", "android", "samsung", "settings", "notifications", "battery", "camera", "gallery", "ball bl", "foe ball bl", "foe ball", "ball", "bl")
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
CARD = r"\b(?:\d[ -]?){15,16}\b"
WHOLE_CARD = r"\b\d(?:[ -]?\d){14,15}\b"
AADHAAR = r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
PHONE = r"\b[6-9][0-9]{9}\b"
CVV = r"(?i)\bCVV\b.*?(\d{3,4})"
CREDENTIAL = r"(?i)(?:password|passwd|pwd|pass|secret|token|apikey|api_key|auth)\s*[=:]\s*(\S+)"
OTP = r"(?i)(?:otp|one[-\s]time\s+(?:password|passcode|pin|code)|verification\s+(?:code|pin)|auth(?:entication)?\s+(?:code|pin|token)|login\s+(?:code|pin)|security\s+code|confirm(?:ation)?\s+(?:code|pin)|passcode|access\s+code)\D{0,60}(\d{4,6})"
DOB = r"(?i)\b(?:dob|date\s+of\s+birth|born\s+on|birth\s+date)[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"
BIRTH = r"(?i)d\.?o\.?b|born\s+on|birth"
BIRTH_WINDOW = r"(?is)(?:(?:date of birth|dob|d\.o\.b):?|born on|birth ?date)(?=(.{0,80}))"
NUMERIC_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
MONTH_DATE = r"(?i)\b\d{1,2}(?:\s+|[/-])(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)(?:\s+|[/-])\d{2,4}\b"
BIRTH_INLINE = r"(?i)\b(?:dob|date\s+of\s+birth|born\s+on|birthdate)[:\s|/=\[\]()-]+(" + MONTH_DATE[6:] + "|" + NUMERIC_DATE[2:] + ")"
BIRTH_YEAR = r"\b(?:19\d{2}|20[01]\d|202[0-5]|[01]\d|2[0-5]|[3-9]\d)\b"
NAME = r"(?i:\b(?:full name|given names|surname|cardholder name|holder's name|holder name|name)\b)\s*[:\-|/=\[\]()][:\s\-|/=\[\]()]{0,20}([A-Z][a-zA-Z\s]{2,30})\b"
ID_NUMBER = r"(?i)\b(?:id number|identity number|card number|document number|passport no|passport number|dl no|licence no|license no|id no|id num|identity doc no|doc number|id doc)\b\s*[:\-|/=\[\]()][:\s\-|/=\[\]()]{0,20}([A-Z0-9\-]{4,20})\b"
