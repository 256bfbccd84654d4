"""Classes of postings, institutions, events and addresses by ordered word rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions.strings import blank, is_role_address

#: Words of a posting for beginners.
FRESHER_WORDS = (
    "fresher", "0-1 years", "0-1yr", "0-2 years", "0-2yr", "0-3 years", "0-3yr", "no experience", "no-experience", "entry level", "entry-level", "graduate trainee",
    "graduate engineer trainee", "campus hire", "0 years", "management trainee", "trainee", "intern", "internship", "new grad", "new-grad", "early career", "early careers",
    "walk-in", "walk in", "walk-in drive", "off-campus", "off campus", "apprentice", "apprenticeship", "any graduate", "final year", "passout", "pass-out", "junior",
    "graduate", "undergraduate", "freshers",
)
#: Sources that only have postings in India.
INDIA_SOURCES = (
    "naukri", "shine", "internshala", "freshersworld", "instahyre", "cutshort", "foundit", "adzuna", "jooble", "indeed", "workday", "unstop", "jobinsider", "iimjobs",
    "timesjobs", "apna", "workindia", "hirist", "classicjobs", "hackerearth", "ambitionbox", "freshershunt", "offcampusjobs4u", "job4freshers", "jobbinge", "hasjob", "amazon",
)
#: Places in India, and places and words that say elsewhere.
INDIA_PLACES = (
    "india", "भारत", "bengaluru", "bangalore", "mumbai", "delhi", "new delhi", "ncr", "gurgaon", "gurugram", "noida", "hyderabad", "chennai", "pune", "kolkata", "ahmedabad",
    "surat", "jaipur", "kochi", "cochin", "chandigarh", "bhubaneswar", "indore", "nagpur", "vadodara", "visakhapatnam", "mysore", "mysuru", "thiruvananthapuram", "trivandrum",
    "coimbatore", "lucknow", "kanpur", "patna", "bhopal", "rajkot", "goa", "manali", "dehradun", "remote - india", "remote/india", "remote (india)", "work from india", "wfo india",
    "wfh india", "+91", "west bengal", "tamil nadu", "karnataka", "maharashtra", "telangana", "andhra", "gujarat", "rajasthan", "uttar pradesh", "madhya pradesh", "kerala",
    "harayana", "haryana", "punjab india", "bihar", "odisha", "assam", "jharkhand", "chhattisgarh", "uttarakhand", "himachal", "arunachal", "meghalaya", "mizoram", "nagaland",
    "tripura", "sikkim", "manipur", "jammu", "kashmir", "ladakh", "andaman", "nicobar", "puducherry", "pondicherry", "dadra", "nagar haveli", "daman", "diu", "lakshadweep",
    "vijayawada", "guwahati", "ranchi", "raipur", "madurai", "srinagar", "shimla", "gangtok", "imphal", "shillong", "aizawl", "kohima", "agartala", "itanagar", "delhi ncr",
)
FOREIGN_PLACES = (
    "united states", "usa", "u.s.a", "u.s.", "us only", "us-based", "us based", "california", "new york", "texas", "washington dc", "seattle", "san francisco", "austin", "boston",
    "chicago", "united kingdom", "uk only", "u.k.", "london", "england", "germany", "berlin", "munich", "france", "paris", "netherlands", "amsterdam", "spain", "madrid",
    "barcelona", "italy", "rome", "poland", "warsaw", "portugal", "lisbon", "ireland", "dublin", "canada", "toronto", "vancouver", "montreal", "australia", "sydney", "melbourne",
    "brazil", "sao paulo", "mexico", "singapore", "japan", "tokyo", "china", "beijing", "shanghai", "south korea", "seoul", "dubai", "uae", "saudi", "qatar", "israel", "tel aviv",
    "turkey", "istanbul", "nigeria", "lagos", "kenya", "nairobi", "south africa", "johannesburg", "cape town", "europe", "emea", "apac", "north america", "latam", "worldwide",
    "global", "anywhere", "remote - us", "remote - europe", "remote - uk", "remote - canada",
)
#: What written employment types, work modes, currencies and pay periods mean.
EMPLOYMENT = {
    "fulltime": "full_time", "permanent": "full_time", "fulltimemployee": "full_time", "parttime": "part_time", "contract": "contract", "contractual": "contract", "contractor": "contract",
    "internship": "internship", "intern": "internship", "apprenticeship": "apprenticeship", "trainee": "apprenticeship", "freelance": "freelance", "freelancer": "freelance",
    "temporary": "temporary", "temp": "temporary", "unspecified": "unspecified",
}
WORKPLACE = {"remote": "remote", "workfromhome": "remote", "wfh": "remote", "onsite": "onsite", "office": "onsite", "field": "field", "hybrid": "hybrid", "flexible": "hybrid"}
CURRENCY = {"inr": "INR", "rs": "INR", "rupee": "INR", "rupees": "INR", "usd": "USD", "dollar": "USD", "dollars": "USD", "eur": "EUR", "euro": "EUR", "gbp": "GBP", "pound": "GBP"}
PERIOD = {
    "year": "year", "yearly": "year", "annual": "year", "annum": "year", "pa": "year", "lpa": "year", "perannum": "year", "month": "month", "monthly": "month", "permonth": "month",
    "week": "week", "weekly": "week", "perweek": "week", "day": "day", "daily": "day", "perday": "day", "hour": "hour", "hourly": "hour", "perhour": "hour",
}
STATUSES = ("DISCOVERED", "ANNOUNCED", "CONFIRMED", "UPCOMING", "REGISTRATION_OPEN", "REGISTRATION_CLOSED", "ONGOING", "COMPLETED", "HISTORICAL", "CANCELLED")
GUESSES = ("PREDICTED", "LOW_CONFIDENCE_PREDICTION", "RECURRING_PATTERN")


def any_word(words: Iterable[str]) -> str:
    """A pattern for any of the words as whole words; one scan finds them all."""
    escaped = ("".join("\\" + c if not (c.isalnum() or c == " ") else c for c in w) for w in words)
    return r"(?U)\b(" + "|".join(escaped) + r")\b"


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s_.-]+", "")


def mapped(c: Column, names: dict[str, str], other: str | None = None) -> Column:
    """The meaning of a written value; `other` for values that have none, NULL for blank ones."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.when(~blank(c), F.coalesce(F.try_element_at(table, _folded(c)), F.lit(other).cast("string")))


def employment_type(c: Column) -> Column:
    return mapped(c, EMPLOYMENT, "unspecified")


def location_type(declared: Column, location: Column) -> Column:
    """Work mode as declared, else from the location's words."""
    key, place = _folded(declared), F.lower(F.coalesce(location, F.lit("")))
    said = (
        F.when(key.isin(*WORKPLACE), mapped(declared, WORKPLACE))
        .when(key.contains("remote"), "remote")
        .when(key.rlike("hybrid|flexible"), "hybrid")
        .when(key.rlike("onsite|office|field"), "onsite")
        .otherwise("unspecified")
    )
    read = F.when(place.contains("remote") & ~place.rlike("onsite|on-site|office"), "remote").when(place.contains("hybrid"), "hybrid")
    return F.when(key != "", said).otherwise(read)


def is_fresher(*texts: Column) -> Column:
    """Whether a posting is for beginners; '0 to 2 year(s)' reads as '0-2 years'."""
    text = F.lower(F.concat_ws(" ", *texts))
    text = F.regexp_replace(F.regexp_replace(text, r"\((es|s)\)", "$1"), r"\b(\d+)\s*to\s*(\d+)\b", "$1-$2")
    return text.rlike(any_word(FRESHER_WORDS)) | text.rlike(r"\b20\d\d\s+graduates?\b|\bclass of 20\d\d\b")


def india_relevant(location: Column, text: Column, source: Column) -> Column:
    """The location decides, then the text, then the source; without a sign it isn't."""
    place, said = F.lower(F.coalesce(location, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    here, there = place.rlike(any_word(INDIA_PLACES)), place.rlike(any_word(FOREIGN_PLACES))
    native = F.lower(F.coalesce(source, F.lit(""))).rlike("|".join(INDIA_SOURCES))
    return F.when(here, True).when(there, False).otherwise(said.rlike(any_word(INDIA_PLACES)) | native)


def ownership(text: Column) -> Column:
    """Who runs an institution; prefixes of words, so that 'unaided' isn't 'aided'."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.contains("autonomous"), "autonomous")
        .when(t.rlike(r"\b(government|govt|public)"), "government")
        .when(t.rlike(r"\bdeemed"), "deemed")
        .when(t.rlike(r"\b(private|self-financ|unaided)"), "private")
        .when(t.rlike(r"\b(aided|grant-in-aid)"), "aided")
    )


def institution_type(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike(r"\bdeemed"), "deemed_university")
        .when(t.contains("university"), "university")
        .when(t.rlike("institute|institution"), "institute")
        .when(t.contains("college"), "college")
    )


def event_mode(mode: Column, text: Column, place: Column) -> Column:
    said, t = F.lower(F.trim(mode)), F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(said.isin("online", "offline", "hybrid"), said)
        .when(t.rlike("virtual|online"), "online")
        .when(t.contains("hybrid"), "hybrid")
        .when(~blank(place), "offline")
    )


def event_status(said: Column, start: Column, end: Column, deadline: Column, as_of: Column) -> Column:
    """Status by dates or by the source's word; a source can't predict, nor confirm without a date."""
    word = F.upper(F.trim(F.coalesce(said, F.lit(""))))
    dated = start.isNotNull() | deadline.isNotNull()
    return (
        F.when(end < as_of, "HISTORICAL")
        .when((word == "CONFIRMED") & ~dated, "ANNOUNCED")
        .when(word.isin(*GUESSES), "ANNOUNCED")
        .when(word.isin(*STATUSES), word)
        .when(deadline >= as_of, "REGISTRATION_OPEN")
        .when(start >= as_of, "UPCOMING")
        .when(dated, "ANNOUNCED")
        .otherwise("DISCOVERED")
    )


def email_class(c: Column) -> Column:
    """role for a desk's mailbox, person for a name's, NULL without an address."""
    return F.when(F.coalesce(c.contains("@"), F.lit(False)), F.when(is_role_address(c), "role").otherwise("person"))


def email_grade(status: Column, email: Column) -> Column:
    """A for a verified person, B for a verified desk, C for unproven ones, NULL for dead ones."""
    return F.when(status == "verified", F.when(is_role_address(email), "B").otherwise("A")).when(status.isin("catch_all", "unknown"), "C")


def flat_location(c: Column, limit: int = 120) -> Column:
    """A location written as text, as a JSON object or as a list of either, in one line."""
    text = F.trim(F.coalesce(c, F.lit("")))

    def of(x: Column) -> Column:
        whole = F.coalesce(*(F.nullif(F.trim(F.get_json_object(x, f"$.{k}")), F.lit("")) for k in ("fullLocation", "address", "name", "label", "displayName")))
        parts = F.array(*(F.nullif(F.trim(F.get_json_object(x, f"$.{k}")), F.lit("")) for k in ("city", "region", "state", "country")))
        return F.when(x.startswith("{") & F.try_parse_json(x).isNotNull(), F.coalesce(whole, F.array_join(F.array_distinct(F.array_compact(parts)), ", "))).otherwise(x)

    items = F.transform(F.from_json(text, "array<string>"), of)
    listed = F.array_join(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))), ", ")
    return F.left(F.when(text.startswith("["), F.coalesce(listed, text)).otherwise(F.coalesce(of(text), text)), F.lit(limit))


def employer_domain(url: Column, company: Column, boards: Iterable[str]) -> Column:
    """Registrable host of a posting, or the company's name as .com where the host is a job board."""
    from ledgerlark.functions.strings import company_key, registrable

    host = registrable(url)
    made = F.concat(company_key(company), F.lit(".com"))
    return F.when(host.isNull() | host.isin(*boards), F.when(company_key(company) != "", made)).otherwise(host)
