"""Text patterns as Spark columns: personal data, placeholders, checksums, match offsets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: ASCII word boundary: Java's ``\b`` also knows other letters.
_B = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# The patterns of each kind of personal data, in order of emission.
PATTERNS = {
    "l2_email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "l2_phone_nanp": r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
    "l2_phone_e164": r"\b\+?[1-9]\d{1,14}\b",
    "l2_credit_card": r"\b(?:\d[ -]*?){13,16}\b",
    "l2_ssn": r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b",
    "l2_address": r"(?i)\b\d+\s+[A-Za-z0-9\s.,'-]+(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd|court|ct|place|pl|way|circle|cir|highway|hwy)\b",
    "l2_pobox": r"(?i)\b(?:PO Box|P\.O\. Box)\s+\d+\b",
}
# See the patterns.
KINDS = {"l2_email": "email", "l2_phone_nanp": "phone", "l2_phone_e164": "phone", "l2_credit_card": "credit_card", "l2_ssn": "ssn", "l2_address": "address", "l2_pobox": "address"}
#: Detection sources by layer, and confidences of the layers that have a fixed one.
SOURCES = {1: "layer1_typed_field", 2: "layer2_regex", 3: "layer3_visual", 4: "layer4_ocr"}
CONFIDENCES = {1: 0.95, 2: 0.8}
# See the patterns.
SEVERITY = {"password": "critical", "credit_card": "critical", "ssn": "critical", "email": "high", "phone": "high", "address": "medium", "name": "medium", "face": "critical"}
# See the patterns.
PLACEHOLDERS = {
    "email": "[EMAIL]", "phone": "[PHONE]", "password": "[PASSWORD]", "credit_card": "[CREDIT_CARD]", "ssn": "[SSN]", "address": "[ADDRESS]", "name": "[NAME]", "face": "[FACE]", "unknown": "[REDACTED]",
}
# See the patterns.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
# The patterns of the sanitizer's tail.
SANITIZE_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SANITIZE_PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"
# The leak check's own pattern of phone numbers.
LEAK_PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{3}\)[\s.-]|\d{3}[\s.-])\d{3}[\s.-]\d{4}\b"


#: What a match of a pattern can begin with. Looked at first, it spares the dear look-arounds at most places.
_FIRST = {
    "l2_phone_nanp": "[0-9+(]", "l2_phone_e164": "[1-9+]", "l2_credit_card": "[0-9]", "l2_ssn": "[0-9]", "l2_address": "[0-9]", "l2_pobox": "[Pp]",
}


def portable(pattern: str, first: str = "") -> str:
    """The pattern for Java's engine, with ASCII word boundaries; ``first`` holds all that a match can begin with."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return flags + (f"(?={first})" if first else "") + pattern[len(flags) :].replace(r"\b", _B)


def bind(value: Column, body) -> Column:
    """``body`` of a lambda variable that holds ``value``, which is so evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the checksum; other characters are ignored."""
    d = F.regexp_replace(digits, "[^0-9]", "")
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def _found(text: Column, name: str) -> Column:
    """All matches of a pattern, in order. Texts without a character that each match has are not searched."""
    body = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(body, F.lit(portable(PATTERNS[name], _FIRST.get(name, ""))), F.lit(0))
    able = F.contains(body, F.lit("@")) if name == "l2_email" else body.rlike("[0-9]")
    return F.when(able, found).otherwise(F.array().cast("array<string>"))


def matches(text: Column, name: str) -> Column:
    """All matches of a pattern, in order; card numbers only with a right checksum."""
    found = _found(text, name)
    return F.filter(found, luhn) if name == "l2_credit_card" else found


_SPANS = "array<struct<start:int,end:int,match:string>>"


def spans(text: Column, name: str) -> Column:
    """Matches as structs of start (0-based code points), end and match.

    The lengths of the pieces between the matches and of the matches add up to the offsets.
    """
    pattern = portable(PATTERNS[name], _FIRST.get(name, ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def placed(m: Column, pieces: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            match, at = F.get(m, i), s["at"] + F.length(F.get(pieces, i))
            span = F.struct(at.alias("start"), (at + F.length(match)).alias("end"), match.alias("match"))
            return F.struct((at + F.length(match)).alias("at"), F.array_append(s["found"], span).alias("found"))

        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, step, lambda s: s["found"])

    def body(m: Column) -> Column:
        between = bind(F.split(F.coalesce(text, F.lit("")), pattern, -1), lambda pieces: placed(m, pieces))
        return F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(between)

    found = bind(_found(text, name), body)
    return F.filter(found, lambda x: luhn(x["match"])) if name == "l2_credit_card" else found


def placeholder(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    return F.coalesce(F.element_at(table, kind), F.lit("[REDACTED]"))


def sanitize(text: Column) -> Column:
    """The tail of text sanitizing: e-mail addresses, then phone numbers, to placeholders."""
    mails = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, SANITIZE_EMAIL, "[EMAIL]")).otherwise(text)
    return F.regexp_replace(mails, portable(SANITIZE_PHONE, "[0-9+(]"), "[PHONE]")


def leaks(text: Column) -> Column:
    """Fail closed: true where an address or number is left, or where the text is not known."""
    mail = F.contains(text, F.lit("@")) & text.rlike(SANITIZE_EMAIL)
    return F.coalesce(mail | text.rlike(portable(LEAK_PHONE, "[0-9+(]")), F.lit(True))


def url_origin(url: Column) -> Column:
    """Scheme, host and non-default port of a web address; 'null' of other schemes; 'unknown' where it is no address."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.regexp_replace(authority, ":[0-9]*$", ""))
    port = F.regexp_extract(authority, ":([0-9]+)$", 1)
    default = (port == "")
    for name, number in DEFAULT_PORTS.items():
        default = default | ((scheme == name) & (port == number))
    origin = F.concat(scheme, F.lit("://"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    known = scheme.isin(*DEFAULT_PORTS) & (host != "")
    opaque = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.coalesce(scheme.isin(*DEFAULT_PORTS), F.lit(False))
    return F.when(known, origin).when(opaque, F.lit("null")).otherwise(F.lit("unknown"))
