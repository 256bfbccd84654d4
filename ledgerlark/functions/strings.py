"""Text normalisation as column expressions; no Python runs but for fold()."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal forms dropped from company names.
COMPANY_FORMS = ("private limited", "pvt ltd", "pvt limited", "limited", "ltd", "llp", "inc", "incorporated", "llc", "corp", "corporation", "gmbh", "plc", "co")
#: Words of a tri-state flag.
TRUE_WORDS = ("true", "yes", "y", "1", "open", "allowed", "available")
FALSE_WORDS = ("false", "no", "n", "0", "closed", "not allowed", "unavailable", "none")
#: The entities that a snippet's text is freed of.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'))


def blank(c: Column) -> Column:
    """NULL or only white space."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def present(c: Column) -> Column:
    return ~blank(c)


def clean_text(c: Column, limit: int | None = 4000) -> Column:
    """One line without control characters, cut to the limit if there is one; NULL is empty."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    line = F.trim(F.regexp_replace(spaced, r"\p{C}", ""))
    return line if limit is None else F.left(line, F.lit(limit))


def strip_html(c: Column, limit: int | None = 4000) -> Column:
    """Text of a snippet: without scripts, styles and tags, six entities decoded."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return clean_text(out, limit)


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def fold(c: Column) -> Column:
    """ASCII form by NFKD; Spark has no function for it, so this is the one Arrow UDF of the module."""
    return _fold(c)


def ascii_key(c: Column) -> Column:
    """Lower-case letters and digits of ASCII text: the key of fingerprints."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def name_key(c: Column) -> Column:
    """ascii_key() after folding accents."""
    return ascii_key(fold(clean_text(c, None)))


def slug(c: Column, limit: int = 120) -> Column:
    dashed = F.regexp_replace(fold(clean_text(c)), "[^a-zA-Z0-9]+", "-")
    return F.left(F.lower(F.regexp_replace(dashed, "^-+|-+$", "")), F.lit(limit))


def parse_bool(c: Column) -> Column:
    """True, false, or NULL where the source doesn't say."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def as_list(c: Column) -> Column:
    """Distinct clean parts of a list written with commas, semicolons or bars."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;|]"), lambda x: clean_text(x, 200))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def company_key(c: Column) -> Column:
    """Letters and digits of a company name without its legal forms."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    short = words
    for _ in range(2):  # "Pvt Ltd" behind "Co"
        short = F.regexp_replace(short, f" ({'|'.join(COMPANY_FORMS)}) $", " ")
    return F.replace(F.when(F.trim(short) == "", words).otherwise(short), F.lit(" "), F.lit(""))


def url_key(c: Column) -> Column:
    """A URL without query, fragment and trailing slashes, in lower case."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[?#].*$", ""))), "/+$", "")


def host(c: Column) -> Column:
    """Host of a URL (a scheme may be missing) without www., NULL without a dot."""
    full = F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), F.regexp_replace(c, "^/+", "")))
    name = F.lower(F.regexp_extract(full, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    name = F.regexp_replace(F.regexp_replace(name, r"\.+$", ""), r"^www\.", "")
    return F.when(name.contains("."), name)


#: Suffixes of two labels.
PAIRED_SUFFIXES = ("co.in", "co.uk")


def registrable(c: Column) -> Column:
    """Last two labels of a host, three where the last two are a suffix by themselves."""
    name = host(c)
    labels = F.split(name, r"\.")
    short = F.substring_index(name, ".", -2).isin(*PAIRED_SUFFIXES)
    return F.array_join(F.slice(labels, -F.least(F.size(labels), F.when(short, 3).otherwise(2)), F.lit(3)), ".")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def mobile_e164(c: Column) -> Column:
    """+91 numbers of ten digits; others with a plus and 8 to 15 digits stay; NULL otherwise."""
    d = F.regexp_replace(digits(c), "^0+", "")
    return (
        F.when(d.rlike("^[6-9][0-9]{9}$"), F.concat(F.lit("+91"), d))
        .when(d.rlike("^91[6-9][0-9]{9}$"), F.concat(F.lit("+"), d))
        .when(F.trim(c).startswith("+") & d.rlike("^[0-9]{8,15}$"), F.concat(F.lit("+"), d))
    )


def contact_identity(email: Column, phone: Column, linkedin: Column) -> Column:
    """Hash of the strongest locator: e-mail, the last ten digits of a phone, the profile's name."""
    number = digits(phone)
    tail = ascii_key(F.element_at(F.split(F.regexp_replace(F.coalesce(linkedin, F.lit("")), "/+$", ""), "/"), -1))

    def of(kind: str, value: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(kind), value), 256)

    return (
        F.when(email.contains("@"), of("email", F.lower(F.trim(email))))
        .when(F.length(number) >= 8, of("phone", F.right(number, F.lit(10))))
        .when(tail != "", of("linkedin", tail))
    )


def fingerprint(company: Column, title: Column, url: Column) -> Column:
    """Identity of a posting: company and title without punctuation, and the URL's host."""
    site = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))
    return F.sha2(F.concat_ws("|", ascii_key(company), ascii_key(title), site), 256)


def college_fingerprint(name: Column, state: Column, code: Column, website: Column) -> Column:
    """Identity of an institution: its official code, else name, state and host."""
    own = F.concat_ws("|", ascii_key(name), ascii_key(state), F.coalesce(host(website), F.lit("")))
    return F.sha2(F.when(ascii_key(code) != "", F.concat_ws("|", F.lit("aishe"), ascii_key(code))).otherwise(own), 256)


def event_fingerprint(name: Column, organizer: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", ascii_key(name), ascii_key(organizer), F.coalesce(host(url), F.lit(""))), 256)


def checksum(*parts: Column, payload: Column) -> Column:
    """Hash of a raw record's identifying parts, or of its payload where all are blank."""
    key = F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))
    return F.sha2(F.when(F.replace(key, F.lit("|"), F.lit("")) == "", F.coalesce(payload, F.lit(""))).otherwise(key), 256)


def redact(c: Column) -> Column:
    """E-mail addresses, URLs and phone numbers masked."""
    out = F.regexp_replace(c, r"https?://[^\s]+", "[url]")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    return F.regexp_replace(out, r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[phone]")


def formula_guard(c: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(c.rlike("^[-+=@|\\t\\r\\n]"), F.concat(F.lit("'"), c)).otherwise(c)


def header_key(c: Column) -> Column:
    """A column header as a key: lower case, spaces, dashes and underscores as one underscore, no final dots or colons."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[.:]+$", ""), r"[\s_-]+", "_")


def like_escaped(term: str) -> str:
    """A term for LIKE in which % and _ stand for themselves."""
    return "".join("\\" + ch if ch in "\\%_" else ch for ch in term)


def is_role_address(email: Column) -> Column:
    """Mailboxes that reach a desk, not a person."""
    local = F.regexp_replace(F.lower(F.trim(F.split_part(email, F.lit("@"), F.lit(1)))), r"\+.*$", "")
    desks = ("info", "contact", "admin", "administrator", "webmaster", "postmaster", "noreply", "no-reply", "donotreply", "abuse", "support", "helpdesk")
    starts = "placement|tpo|principal|director|dean|hod|admission|office|career|hr|recruit"
    return F.coalesce(email.contains("@") & (local != "") & (local.isin(*desks) | local.rlike(f"^({starts})")), F.lit(False))


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), F.lit(False))


def sendable_phone(c: Column) -> Column:
    """10 to 15 digits, more than three different ones."""
    d = digits(c)
    return (F.length(d) >= 10) & (F.length(d) <= 15) & (F.size(F.array_distinct(F.split(d, ""))) > 3)


#: Words that no person's name has.
NO_NAMES = (
    "the", "and", "or", "of", "to", "in", "on", "at", "for", "team", "will", "group", "contact", "contacting", "other", "tasks", "screen", "virtual", "interview", "class", "span",
    "div", "icon", "logo", "white", "blue", "color", "onecolor", "import", "about", "more", "career", "careers", "hiring", "recruiting", "human", "resources", "company", "people",
    "talent", "acquisition", "manager", "lead", "form", "page", "section", "header", "footer", "nav", "menu", "click", "here", "learn", "view", "join", "apply", "explore", "san",
    "francisco", "tokyo", "london", "paris", "berlin", "dublin", "amsterdam", "singapore", "sydney", "remote", "office", "location", "site", "hub", "center", "campus",
    "eligibility", "check", "benefits", "administrator", "new", "york", "boston", "austin", "chicago", "denver", "atlanta", "miami", "portland", "raleigh", "durham", "palo",
    "alto", "mountain", "sunnyvale", "cupertino", "redwood", "city", "foster", "head", "script",
)


def person_name(c: Column) -> Column:
    """Two or more capitalised words of two or more characters, letters with - . _ among them, none all capitals or in NO_NAMES."""
    words = F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+")

    def fits(w: Column) -> Column:
        bare = F.translate(w, "-._", "")
        return w.rlike(r"^\p{Lu}.+$") & bare.rlike(r"^\p{L}+$") & ~((F.length(w) >= 3) & (w == F.upper(w))) & ~F.lower(bare).isin(*NO_NAMES)

    return F.coalesce((F.size(words) >= 2) & F.forall(words, fits), F.lit(False))


def email_pattern(email: Column, name: Column) -> Column:
    """How an address is made from a name: first.last, flast, first, firstlast or NULL."""
    local = F.lower(F.split_part(email, F.lit("@"), F.lit(1)))
    words = F.split(F.lower(F.trim(name)), r"\s+")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    return (
        F.when(local == F.concat(first, F.lit("."), last), "first.last")
        .when(local == F.concat(F.left(first, F.lit(1)), last), "flast")
        .when(local == F.concat(first, last), "firstlast")
        .when(local == first, "first")
    )
