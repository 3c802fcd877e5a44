"""Detectors: a text column becomes an array of (type, value) findings, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposark.functions import text as T
from exposark.operators import keywords
from exposark.sources.pages import near_words


def typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


def emails(text: Column) -> Column:
    return T.matches(text, T.EMAIL)


def cards(text: Column) -> Column:
    """Runs of 15 or 16 digits; separators at the end are cut before equal ones are merged."""
    return F.array_distinct(F.transform(T.all_matches(text, T.CARD), lambda v: F.regexp_replace(v, "[ -]+$", "")))


def credentials(text: Column) -> Column:
    """Values after a label, without quotes and closing punctuation, of 4 characters or more, that are in no address."""
    values = F.filter(F.transform(T.all_matches(text, T.CREDENTIAL, 1), lambda v: F.regexp_replace(v, "^[\"']+|[\"'.,;:!?]+$", "")), lambda v: F.length(v) >= 4)
    apart = lambda kept: T.let(emails(text), lambda found: F.array_distinct(F.filter(kept, lambda v: ~F.exists(found, lambda e: F.contains(e, v) | F.contains(v, e)))))
    return T.let(values, lambda kept: F.when(F.size(kept) == 0, kept).otherwise(apart(kept)))


def phones(text: Column) -> Column:
    return F.array_except(T.matches(text, T.PHONE), F.transform(T.matches(text, T.AADHAAR), T.digits))


def otps(text: Column) -> Column:
    hidden = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), T.AADHAAR, "XXXX"), T.PHONE, "XXXX")
    return T.let(T.matches(hidden, T.OTP, 1), lambda codes: F.when(F.size(codes) > 0, F.array_except(codes, phones(text))).otherwise(codes))


def birth_dates(text: Column) -> Column:
    """The first plausible date within 80 characters after a label, with a month's name if there is one; at most one. A date of under 6 digits does not count."""
    in_window = F.transform(T.all_matches(text, T.BIRTH_WINDOW, 1), lambda w: F.coalesce(F.nullif(F.regexp_extract(w, T.MONTH_DATE, 0), F.lit("")), F.regexp_extract(w, T.NUMERIC_DATE, 0)))
    every = F.concat(in_window, T.all_matches(text, T.BIRTH_INLINE, 1))
    good = F.filter(every, lambda d: (F.length(T.digits(d)) >= 6) & d.rlike(T.BIRTH_YEAR))
    return F.when(F.coalesce(text, F.lit("")).rlike(T.BIRTH), F.slice(good, 1, 1)).otherwise(F.array().cast("array<string>"))


def labelled_names(text: Column, no_names: tuple[str, ...] = T.NO_NAMES) -> Column:
    """Names after a label. no_names: words that are no names there; the default is short, a deployment passes its own."""
    values = F.transform(T.all_matches(text, T.NAME, 1), T.stripped)
    return F.array_distinct(F.filter(values, lambda v: (F.size(F.split(v, r"\s+")) <= 4) & ~F.lower(v).isin(*no_names)))


def labelled_ids(text: Column) -> Column:
    return F.array_distinct(F.filter(T.all_matches(text, T.ID_NUMBER, 1), lambda v: ~v.rlike("^[0-9]+$")))


def heuristic_passwords(text: Column, academic: Column) -> Column:
    """Tokens that look like passwords without a label: mixed and random ones anywhere, plainer ones up to 120 characters after a word such as password. None in academic texts."""
    hidden = F.regexp_replace(F.coalesce(text, F.lit("")), T.EMAIL, "EMAIL_MASKED")

    def plausible(token: Column) -> Column:
        shape = token.rlike(r"[0-9@#$!%^&*_\-]") & ~token.rlike(T.NO_PASSWORD)
        return shape & ~is_garbage(token)

    strict = lambda t: t.rlike("[A-Z]") & t.rlike("[a-z]") & (F.length(t) >= 8) & ~(F.contains(t, F.lit("@")) & ~F.contains(F.substring_index(t, "@", -1), F.lit("."))) & plausible(t) & (T.entropy(t) >= 3.2)
    relaxed = lambda t: t.rlike("[a-zA-Z]") & plausible(t) & (T.entropy(t) >= 2.2)

    def tokens(masked: Column) -> Column:
        anywhere = F.filter(F.array_distinct(F.regexp_extract_all(masked, F.lit(T.MIXED_TOKEN), F.lit(0))), strict)
        # what follows a label, without the rest of the word that the label is in; a token counts if it begins within the reach
        after = F.transform(F.regexp_extract_all(masked, F.lit(T.PASSWORD_LABEL), F.lit(1)), lambda w: F.regexp_replace(w, r"^[A-Za-z0-9@#$!%^&*_\-]+", ""))
        near_label = F.flatten(F.transform(after, lambda w: F.filter(F.regexp_extract_all(w, F.lit(T.TOKEN), F.lit(0)), lambda t: relaxed(t) & (F.instr(w, t) <= 112))))
        return F.array_distinct(F.concat(anywhere, near_label))

    def checked(found: Column) -> Column:  # what is dear is asked only of texts that have such tokens
        outside = T.let(emails(text), lambda mails: F.filter(found, lambda t: ~F.exists(mails, lambda e: F.contains(e, t))))
        return F.when(F.size(found) == 0, found).when(academic, F.array().cast("array<string>")).otherwise(outside)

    return T.let(T.let(hidden, tokens), checked)


def academic_by_words(text: Column) -> Column:
    """Whether a text is academic by its words and by the keyword classifier."""
    from exposark.operators import classify

    return T.let(F.lower(F.coalesce(text, F.lit(""))), classify.calm_in_row)


def _has(low: Column, *words: str) -> Column:
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def document_findings(text: Column, academic: Column | None = None) -> Column:
    """The document profile: an array of (type, value).

    The text is bound once, and a pattern is tried only where a sign or word that it cannot do without occurs.
    """
    none = F.array().cast("array<string>")
    gated = lambda test, values: F.when(test, values).otherwise(none)

    def found(row: Column) -> Column:
        t, low, digits = row["text"], row["low"], row["digits"]
        papers = academic_by_words(t) if academic is None else academic
        labelled = gated(_has(low, ":", "=") & _has(low, "pass", "pwd", "secret", "token", "apikey", "api_key", "auth"), credentials(t))
        tokens = gated(t.rlike(r"[0-9@#$!%^&*_\-]"), heuristic_passwords(t, papers))
        secrets = T.let(labelled, lambda own: F.concat(own, F.filter(tokens, lambda x: ~F.exists(own, lambda v: F.lower(v) == F.lower(x)))))
        return F.concat(
            typed("email", gated(F.contains(t, F.lit("@")), emails(t))),
            typed("phone", gated(digits, phones(t))),
            typed("password", secrets),
            typed("aadhaar", gated(digits, T.matches(t, T.AADHAAR))),
            typed("pan_card", gated(digits, T.matches(t, T.PAN))),
            typed("credit_card", gated(digits, cards(t))),
            typed("cvv", gated(digits & _has(low, "cvv"), T.all_matches(t, T.CVV, 1))),
            typed("dob", gated(_has(low, "dob", "d.o.b", "do.b", "d.ob", "birth", "born"), birth_dates(t))),
            typed("otp", gated(digits & _has(low, "otp", "code", "pass", "pin", "token"), otps(t))),
            typed("person_name", gated(_has(low, "name"), labelled_names(t))),
            typed("id_number", gated(_has(low, " no", " num", "id doc"), labelled_ids(t))),
        )

    whole = F.coalesce(text, F.lit(""))
    return T.let(F.struct(whole.alias("text"), F.lower(whole).alias("low"), whole.rlike(r"\d{3}").alias("digits")), found)


CONTACT = r"contact|reach\s+us|email\s+us|write\s+to|mail\s+us|enquir|inquiry|admissions?|registrar|helpdesk|helpline|principal|director|dean|office|department|institute|college|university|school|faculty|placement|for\s+more\s+info|get\s+in\s+touch|send\s+us|feel\s+free\s+to"
PHONE_CONTACT = "admission|enquiry|office|contact|helpdesk|registrar|placement|fax|tel|call|support|info|desk|college|institute|university|school|principal|dean|campus|department|helpline|customer|service|agent"
PUBLIC_PREFIXES = (
    "info", "support", "contact", "admin", "hello", "help", "enquiry", "inquiry", "noreply", "no-reply", "donotreply", "do-not-reply", "office", "team", "mail", "webmaster", "postmaster", "editor", "news", "press", "media",
    "feedback", "service", "care", "hr", "recruitment", "jobs", "sales", "marketing", "billing", "accounts", "finance", "legal", "privacy", "security",
)


def url_host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def email_class(email: Column, near: Column, url: Column) -> Column:
    """public_contact or personal_email: addresses of the site or named like it, of offices, of institutions, or near contact words are public."""
    full = url_host(url)
    host = F.regexp_replace(full, r"^www\.", "")
    root = F.substring_index(host, ".", 1)
    low = F.lower(email)
    local, domain = F.substring_index(low, "@", 1), F.regexp_replace(low, "^[^@]*@", "")
    public = (
        ((host != "") & F.contains(domain, host))
        | ((F.length(root) >= 4) & F.contains(local, root))
        | local.isin(*PUBLIC_PREFIXES)
        | domain.rlike(r"\.(edu|gov|ac\.in|edu\.in|nic\.in|mil|int)$")
        | near
        | (low.rlike(r"@(gmail|yahoo|hotmail|outlook|protonmail|icloud|rediffmail|ymail)\.\w+") & full.rlike(r"\.(ac\.in|edu\.in|edu|gov|nic\.in|org)$"))
    )
    return F.when(public, "public_contact").otherwise("personal_email")


def phone_class(near: Column, url: Column) -> Column:
    """public_phone on the site of an institution or near contact words, else phone."""
    return F.when(url_host(url).rlike(r"\.edu|\.gov|\.ac\.in|\.nic\.in|jssmca|college|university") | near, "public_phone").otherwise("phone")


def noise(text: Column) -> Column:
    """Years, fiscal years and dates by month name in a text: never personal data."""
    return F.array_distinct(F.concat(*(T.all_matches(text, p) for p in (T.YEAR, T.FISCAL_YEAR, T.NOISE_DATE))))


def false_positive(kind: Column, value: Column, noise: Column) -> Column:
    """Whether a finding is empty, noise, a fiscal year, a date for a password or code, or a label for a password."""
    v = F.trim(value)
    label = v.rlike(r"^[A-Za-z]+-[A-Za-z]+$") | v.rlike(T.ACADEMIC_LABEL)
    return (v == "") | F.array_contains(noise, v) | v.rlike("^(?:" + T.FISCAL_YEAR + ")$") | (kind.isin("password", "otp") & v.rlike(T.NOISE_DATE)) | ((kind == "password") & label)


def with_url_findings(pages: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """pages with findings by the web profile: cards need Luhn, 12-digit ids need Verhoeff, plain http is a finding; addresses and phones are typed by class;
    PANs in technical text need a label; years and dates are no findings; one of each (type, value in any case), the first."""
    none = F.array().cast("array<string>")
    gated = lambda test, pattern: F.when(test, T.matches(F.col(text), pattern)).otherwise(none)
    rows = pages.withColumn("__mails", gated(F.contains(F.col(text), F.lit("@")), T.WEB_EMAIL)).withColumn("__calls", gated(F.col(text).rlike("[0-9]{10}"), T.WEB_PHONE))
    rows = rows.withColumn("__near_mails", near_words(F.col(text), F.col("__mails"), CONTACT, 200)).withColumn("__near_calls", near_words(F.col(text), F.col("__calls"), PHONE_CONTACT, 120))
    # what a Python pass gave stays an argument of the functions below: it could not be computed within their lambdas
    classed = lambda values, near: F.transform(F.arrays_zip(F.col(values).alias("value"), F.col(near).alias("near")), lambda z: F.struct(z["value"].alias("value"), F.coalesce(z["near"], F.lit(False)).alias("near")))
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.struct(whole.alias("text"), F.lower(whole).alias("low"), whole.rlike("[0-9]{3}").alias("digits"), classed("__mails", "__near_mails").alias("mails"), classed("__calls", "__near_calls").alias("calls"))
    found = T.let(parts, lambda x: _url_findings(x, F.col(url)))
    return rows.withColumn("findings", found).drop("__mails", "__calls", "__near_mails", "__near_calls")


def _url_findings(row: Column, url: Column) -> Column:
    """row: text, low (in small letters), digits (whether there are three in a row), mails and calls with whether words of contact are near. A pattern is tried only where what it needs occurs, and noise is looked for only where there is a finding."""
    text, low, digits, mails, every_call = (row[k] for k in ("text", "low", "digits", "mails", "calls"))
    none = F.array().cast("array<string>")
    gated = lambda test, values: F.when(test, values).otherwise(none)
    ids = F.filter(gated(digits, T.matches(text, T.WEB_AADHAAR)), T.verhoeff)
    labelled = _has(low, ":", "=") & _has(low, "pass", "pwd", "secret", "token", "api", "auth")
    secrets = F.transform(gated(labelled, T.matches(text, T.WEB_CREDENTIAL, 1)), lambda v: F.regexp_replace(v, "^[\"'`]+|[\"'`]+$", ""))
    secrets = F.array_distinct(F.filter(secrets, lambda v: (F.length(v) >= 4) & ~F.lower(v).isin("true", "false", "null", "none", "undefined", "yes", "no")))
    classed = lambda values, kind: F.transform(values, lambda v: F.struct(kind(v).alias("type"), v["value"].alias("value")))
    technical = (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(RFC|HTTP|HTML|JSON|XML|API|URL|SQL|CSS|TCP|UDP|IP)\b")) > 5) & ~F.coalesce(text, F.lit("")).rlike(r"(?i)\b(pan\s*card|pan\s*number|permanent\s*account)\b")

    def numbers(ids_: Column) -> Column:
        calls = T.let(F.transform(ids_, T.digits), lambda taken: F.filter(every_call, lambda p: ~F.array_contains(taken, p["value"])))
        cards_ = F.array_distinct(F.filter(F.transform(gated(digits, T.all_matches(text, T.WEB_CARD)), T.digits), lambda d: F.length(d).between(13, 16) & T.luhn(d)))
        return F.concat(classed(calls, lambda p: phone_class(p["near"], url)), typed("aadhaar", ids_), typed("credit_card", cards_))

    every = F.concat(
        classed(mails, lambda m: email_class(m["value"], m["near"], url)),
        T.let(ids, numbers),
        typed("pan", T.let(gated(digits, T.matches(text, T.PAN)), lambda pans: F.when((F.size(pans) > 0) & technical, none).otherwise(pans))),
        typed("password", secrets),
        typed("otp", gated(digits & _has(low, "otp", "code", "one"), T.matches(text, T.WEB_OTP, 1))),
        typed("cvv", gated(digits & _has(low, "cvv", "cvc", "code"), T.matches(text, T.WEB_CVV, 1))),
        typed("dob", gated(_has(low, "dob", "birth", "born"), T.matches(text, T.DOB, 1))),
    )
    plain = F.when(F.startswith(F.lower(url), F.lit("http://")), typed("http_only", F.array(url))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    good = T.let(every, lambda a: F.when(F.size(a) == 0, a).otherwise(T.let(noise(text), lambda never: F.filter(a, lambda f: ~false_positive(f["type"], f["value"], never)))))
    return F.concat(T.first_of_each(good, lambda f: F.struct(f["type"].alias("type"), F.lower(F.trim(f["value"])).alias("value"))), plain)


def screen_findings(text: Column) -> Column:
    """The screen profile. A label at the start of a value is cut, values end after 80 characters, a phone inside a 12-digit id is dropped, and so is an id that begins a card."""
    cut = lambda v: F.regexp_replace(v, r"^[A-Za-z]\w*\s*[:=\-]\s*|^:\s*", "")
    short = lambda values: F.transform(values, lambda v: F.substring(F.coalesce(F.nullif(T.stripped(cut(T.stripped(v))), F.lit("")), T.stripped(v)), 1, 80))

    def numbers(cards_: Column) -> Column:
        ids = F.filter(F.array_distinct(short(T.all_matches(text, T.SCREEN_AADHAAR))), lambda a: ~F.exists(cards_, lambda c: F.substring(T.digits(c), 1, 12) == T.digits(a)))
        calls = T.matches(text, r"(?<!\d)[6-9]\d{9}(?!\d)")
        return T.let(ids, lambda found: F.concat(typed("aadhaar", found), typed("credit_card", cards_), typed("phone", F.filter(calls, lambda p: ~F.exists(found, lambda a: F.contains(T.digits(a), p))))))

    return F.concat(
        T.let(T.matches(text, T.SCREEN_CARD), numbers),
        typed("pan", T.matches(text, r"(?<![A-Z])[A-Z]{5}\d{4}[A-Z](?![A-Z])")),
        typed("email", T.matches(text, r"(?<!\w)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}(?!\w)")),
        typed("password", F.array_distinct(short(T.all_matches(text, T.SCREEN_PASSWORD)))),
        typed("otp", F.array_distinct(short(T.all_matches(text, T.SCREEN_OTP)))),
        typed("dob", T.matches(text, T.SCREEN_DOB)),
    )


def social_findings(texts: Column) -> Column:
    """The profile-page patterns: at most 3 of each type, values up to 200 characters. A pattern is tried only where what it needs occurs."""
    none = F.array().cast("array<string>")
    cut = lambda values: F.transform(F.slice(values, 1, 3), lambda v: F.substring(v, 1, 200))

    def found(text: Column) -> Column:
        gated = lambda test, values: F.when(test, values).otherwise(none)
        sites = F.filter(gated(F.contains(text, F.lit("http")), T.matches(text, r"https?://[^\s\"'<>]+")), lambda v: ~v.rlike(r"(?i)//([a-z0-9-]+\.)*(twitter|x|linkedin|reddit|instagram|github|facebook|youtube)\.com"))
        calls = gated(text.rlike("[0-9]{4}"), T.matches(text, r"(?<!\d)(?:[6-9]\d{9}|\+?\d{1,3}[ -]\d{3}[ -]\d{3}[ -]\d{4})(?!\d)"))
        return F.concat(typed("email", cut(gated(F.contains(text, F.lit("@")), T.matches(text, T.EMAIL)))), typed("phone", cut(calls)), typed("website", cut(sites)))

    return T.let(F.array_join(texts, "\n"), found)


def profile_findings(fields: Column, website_found: Column) -> Column:
    """What a profile's fields expose, as (type, value). fields: a map by field name."""
    field = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names), F.lit(""))
    user, shown, place, site, bio, firm = field("username"), field("display_name"), field("location"), field("website"), field("bio", "headline"), field("company")
    found = lambda test, kind, value: F.when(test, F.struct(F.lit(kind).alias("type"), value.alias("value")))
    return F.array_compact(
        F.array(
            found((user != "") & (user != "unknown"), "username", user),
            found((shown != "") & (F.lower(F.trim(shown)) != F.lower(F.trim(user))), "display_name", F.substring(shown, 1, 100)),
            found(F.length(place) > 2, "location", F.substring(place, 1, 100)),
            found((site != "") & ~website_found, "website", F.substring(site, 1, 200)),
            found(F.length(F.trim(bio)) > 10, "bio", F.substring(bio, 1, 150)),
            found(F.length(firm) > 1, "company", F.substring(firm, 1, 100)),
        )
    )


def profile_text(text: Column) -> Column:
    """The lines of a scraped profile that are no boilerplate of its platform and have 4 characters or more."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), T.stripped)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= 4) & ~x.rlike(T.PROFILE_NOISE)), "\n")


def meaningful(value: Column) -> Column:
    """A metadata value without the white space around it, null where it is a placeholder."""
    v = T.stripped(value)
    return F.when((v != "") & ~F.lower(v).isin(*T.PLACEHOLDERS), v)


def metadata_findings(value: Column) -> Column:
    """What leaks in a metadata value: a local path, an address or a phone number; the first that is there."""
    return F.when(value.rlike(r"[a-zA-Z]:\\[^/:\"*?<>|]+\\|^/home/"), "local_path").when(value.rlike(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"), "embedded_email").when(F.replace(value, F.lit(" "), F.lit("")).rlike(r"[6-9]\d{9}"), "embedded_phone")


def redacted(text: Column, values: Column) -> Column:
    """Words of a text as (word, hide): a word goes if it is in a finding, holds one, or has the form of personal data."""
    found = F.filter(F.transform(values, lambda v: F.lower(T.stripped(v))), lambda v: v != "")
    parts = F.array_distinct(F.filter(F.flatten(F.transform(found, lambda v: F.split(v, r"[^a-zA-Z0-9@#$!%^&*_\-]"))), lambda w: F.length(w) >= 3))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.length(w) >= 2)

    def hide(word: Column) -> Column:
        low = F.lower(word)
        return F.array_contains(parts, low) | ((F.length(low) >= 3) & F.exists(found, lambda v: F.contains(v, low) | F.contains(low, v))) | word.rlike("|".join((T.EMAIL, T.PHONE, T.AADHAAR, T.PAN, T.CARD)))

    return F.transform(words, lambda w: F.struct(w.alias("word"), hide(w).alias("hide")))


def mentions_secrets(text: Column) -> Column:
    """Whether a text has a word of credentials or documents at all."""
    return mentions_secrets_of(keywords.found(text))


def mentions_secrets_of(found: Column) -> Column:
    return keywords.any_of(found, keywords.ids(keywords.SECRET_WORDS, keywords.ANYWHERE))


def exploded(docs: DataFrame, findings: Column, key: str = "doc_id") -> DataFrame:
    """(key, type, value), a row for each finding."""
    # an outer explode, so that no filter on the array's size makes Spark compute the findings twice
    return docs.select(key, F.explode_outer(findings).alias("f")).where(F.col("f").isNotNull()).select(key, "f.type", "f.value")


def is_garbage(token: Column) -> Column:
    """Whether a token is what is read off noise: short, mostly signs, four equal characters in a row, three rare letters or signs at the start, or a control character."""
    t = T.stripped(token)
    return (F.length(t) < 3) | (T.letter_digit_ratio(t) < 0.5) | t.rlike(r"(.)\1{3,}") | t.rlike(r"^[xzqjXZQJ]{3,}") | t.rlike(r"^[^a-zA-Z0-9]{3,}") | t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def is_entity_garbage(value: Column) -> Column:
    """Whether a named entity is noise: signs, repetitions, lower case first, digits that are no year, short fragments, capitals, cut words, titles of browser tabs, and words of screens."""
    v = T.stripped(value)
    words = F.regexp_extract_all(v, F.lit("[a-zA-Z]+"), F.lit(0))
    first, last = F.lower(F.coalesce(F.get(words, F.lit(0)), F.lit(""))), F.lower(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))
    cut = (F.size(words) >= 2) & last.rlike("(?:" + T.CUT_ENDINGS + ")$") & ~last.rlike("(?:" + T.SURNAME_ENDINGS + ")$")
    return (
        (F.length(v) < 2) | (T.letter_digit_ratio(v) < 0.4) | v.rlike(r"(.)\1{3,}") | v.rlike(r"^[\W_]{2,}$") | v.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") | v.rlike(r"[|:\\{}\[\]<>@#$%^*+=`~]") | v.rlike(r"^\p{Ll}")
        | (v.rlike(r"\d") & ~v.rlike(r"(19|20)\d{2}")) | ((F.size(words) > 0) & F.forall(words, lambda w: F.length(w) <= 3)) | v.rlike(r"^[A-Z]{1,4}(\s+[A-Z]{1,4})+$")
        | first.isin(*T.CUT_NAMES) | cut | F.lower(v).rlike("(?m)[-–] (?:" + T.TAB_TITLES + r")\s*$") | F.lower(v).isin(*T.SCREEN_WORDS)
    )


def confident(findings: Column, least: float = 0.7) -> Column:
    """Findings (with method and confidence) but for those of a model below a confidence; one without a confidence stays."""
    return F.filter(findings, lambda f: (F.coalesce(f["method"], F.lit("")) != "ai") | (F.coalesce(f["confidence"], F.lit(1.0)) >= least))


def is_date_like(token: Column) -> Column:
    """Whether a token is a date by month name, a fiscal year, or two words with a hyphen."""
    return token.rlike(r"(?i)^\d{1,2}[-/](?:" + T.MONTHS + r")[-/]\d{2,4}\b|^(?:19|20)\d{2}-\d{2,4}\b|^[A-Za-z]+-[A-Za-z]+$")


def entity_confidence(value: Column, label: Column, stop_words: tuple[str, ...] = (), least: int = 3) -> Column:
    """Confidence of a named entity: by its length, with a bonus for several words; none for stop words and short ones."""
    v = T.stripped(value)
    words = F.filter(F.split(v, r"\s+"), lambda w: F.length(w) >= 2)
    bonus = F.when((label == "PERSON") & (F.size(words) >= 2), 0.3).when(F.size(words) >= 2, 0.22).otherwise(0.0)
    nothing = (F.length(v) < least) | ((F.size(F.split(v, r"\s+")) == 1) & (F.length(v) < 5))
    if stop_words:
        nothing = nothing | F.lower(v).isin(*stop_words)
    return F.when(nothing, 0.0).otherwise(F.round(F.least(F.least(F.length(v) / 22.0, F.lit(0.8)) + bonus, F.lit(1.0)), 2))
