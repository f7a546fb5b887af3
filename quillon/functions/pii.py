"""Sensitive classes of values and fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.binding import bound

# The published dihedral-group tables of the Verhoeff checksum, row by row.
VERHOEFF_D = "0123456789" "1234067895" "2340178956" "3401289567" "4012395678" "5987604321" "6598710432" "7659821043" "8765932104" "9876543210"
VERHOEFF_P = "0123456789" "1576283094" "5803796142" "8916043527" "9453126870" "4286573901" "2793806415" "7046913258"
#: Classes by rank of protection, their tiers, and those that get a token.
RANKS = ("UNKNOWN", "NAME", "DOB", "PHONE", "AADHAAR", "OTP")
TIERS = {"OTP": "CRITICAL", "AADHAAR": "SENSITIVE", "PHONE": "PERSONAL", "DOB": "PERSONAL", "NAME": "PERSONAL", "UNKNOWN": "PUBLIC"}
TOKENISABLE = ("AADHAAR", "PHONE", "DOB", "NAME")
#: White space as JavaScript's \s and trim see it.
JS_SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
# What autocomplete, type and words of a name or label say about a field.
AUTOCOMPLETE = {"tel": "PHONE", "tel-national": "PHONE", "tel-local": "PHONE", "name": "NAME", "bday": "DOB", "bday-day": "DOB", "bday-month": "DOB", "bday-year": "DOB", "one-time-code": "OTP"}
AUTOCOMPLETE_OTHER = ("username", "email", "current-password", "new-password", "given-name", "family-name", "organization")
FIELD_TYPES = {"tel": "PHONE", "date": "DOB"}
FIELD_TYPES_OTHER = ("password", "email", "hidden")
KEYWORDS = (
    ("OTP", r"(?i)\b(otp|one[- ]time (?:password|code)|verification code)\b"),
    ("AADHAAR", r"(?i)\b(aadhaa?r|uid(?:ai)?)\b"),
    ("DOB", r"(?i)\b(date of birth|dob|birth ?date)\b"),
    ("PHONE", r"(?i)\b(mobile|phone|telephone|contact number)\b"),
    ("FREE_TEXT", r"(?i)\b(feedback|comments?|remarks?|message|purpose|description)\b"),
    ("NAME", r"(?i)\bname\b"),
)
NAME_QUALIFIER = r"(?i)\b(father'?s?|mother'?s?|spouse'?s?|guardian'?s?|nominee'?s?|company|organi[sz]ation|business|file|user|display|first|last|middle)\b"
# Shapes of sensitive values in any text.
TRIPWIRES = (("PHONE", r"\b[6-9]\d{9}\b"), ("AADHAAR", r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b"), ("DOB", r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b"), ("OTP", r"\b\d{6}\b"))
# Shapes of secrets, by name.
SECRET_SHAPES = (
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("github_pat", r"github_pat_[A-Za-z0-9_]{20,}"),
    ("hf_token", r"hf_[A-Za-z0-9]{30,}"),
    ("aws_key", r"AKIA[0-9A-Z]{16}"),
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----"),
)


def trim(v: Column) -> Column:
    return F.regexp_replace(v, rf"^{JS_SPACE}+|{JS_SPACE}+$", "")


def one_of(v: Column, *values: str) -> Column:
    return v.isin(*values)


def verhoeff_valid(v: Column) -> Column:
    """Checksum of a string of digits; false for anything else."""
    d, p = F.lit(VERHOEFF_D), F.lit(VERHOEFF_P)

    def checked(digits: Column) -> Column:
        def step(c: Column, i: Column) -> Column:
            digit = F.substr(digits, i, F.lit(1)).cast("int")
            permuted = F.substr(p, ((i - 1) % 8) * 10 + digit + 1, F.lit(1)).cast("int")
            return F.substr(d, c * 10 + permuted + 1, F.lit(1)).cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) == 0

    return F.when(v.rlike("^[0-9]+$"), bound(F.reverse(v), checked)).otherwise(F.lit(False))


def digits_only(v: Column) -> Column:
    return F.regexp_replace(v, f"{JS_SPACE}|-", "")


def is_aadhaar(v: Column) -> Column:
    return bound(digits_only(v), _aadhaar_digits)


def _aadhaar_digits(d: Column) -> Column:
    return F.when(d.rlike("^[2-9][0-9]{11}$"), verhoeff_valid(d)).otherwise(F.lit(False))


def normalise_aadhaar(v: Column) -> Column:
    return F.when(is_aadhaar(v), digits_only(v))


def normalise_mobile(v: Column) -> Column:
    """Ten digits of an Indian mobile number, or null."""
    return bound(digits_only(v), _mobile_digits)


def _mobile_digits(d: Column) -> Column:
    return F.when(d.rlike("^[6-9][0-9]{9}$"), d).when(d.rlike(r"^(?:\+91|0091|91|0)[6-9][0-9]{9}$"), F.right(d, F.lit(10)))


def is_birth_date(v: Column, today: str) -> Column:
    """An ISO date that exists, from 1900 to the day given."""
    return _date_text(trim(v), today)


def _date_text(t: Column, today: str) -> Column:
    day = F.to_date(F.try_to_timestamp(F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t), F.lit("yyyy-MM-dd")))
    return F.coalesce(day.between(F.lit("1900-01-01").cast("date"), F.lit(today).cast("date")), F.lit(False))


def is_name(v: Column) -> Column:
    return bound(trim(v), _name_text)


def _name_text(t: Column) -> Column:
    return F.length(t).between(3, 60) & t.rlike(rf"^\p{{Lu}}\p{{L}}+(?:{JS_SPACE}+\p{{Lu}}\p{{L}}+){{1,3}}$")


def is_otp_shaped(v: Column) -> Column:
    return trim(v).rlike("^[0-9]{4,8}$")


def digit_fold(v: Column) -> Column:
    """Digits of a text, with letters that look like digits taken for them."""
    return F.regexp_replace(F.translate(v, "oOlIiSs", "0011155"), "[^0-9]", "")


def text_fold(v: Column) -> Column:
    return F.regexp_replace(F.lower(v), r"[^\p{L}\p{N}]", "")


def contains_secret(candidate: Column, secret: Column) -> Column:
    """Whether a text holds a secret after folding; secrets of under four folded characters are not looked for."""
    d, t = digit_fold(secret), text_fold(secret)
    return ((F.length(d) >= 4) & F.contains(digit_fold(candidate), d)) | ((F.length(t) >= 4) & F.contains(text_fold(candidate), t))


def classify_value(v: Column, today: str) -> Column:
    """The class of a value by itself. The trimmed text and its digits are worked out once, whatever filter or branch asks for the class."""
    def by_digits(t: Column) -> Column:
        return bound(digits_only(t), lambda d: F.when(_aadhaar_digits(d), "AADHAAR").when(_mobile_digits(d).isNotNull(), "PHONE").when(_date_text(t, today), "DOB").when(_name_text(t), "NAME").otherwise("UNKNOWN"))

    return bound(trim(v), by_digits)


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def tier_of(c: Column) -> Column:
    return lookup(TIERS, c)


def rank_of(c: Column) -> Column:
    return lookup({k: i for i, k in enumerate(RANKS)}, c)


def is_tokenisable(c: Column) -> Column:
    return c.isin(*TOKENISABLE)


def as_class(c: Column) -> Column:
    return F.when(c == "FREE_TEXT", "UNKNOWN").otherwise(c)


def most_protective(a: Column, b: Column) -> Column:
    return F.when(rank_of(b) > rank_of(a), b).otherwise(a)


def signals(text: Column) -> Column:
    def found(words: Column) -> Column:
        return F.array_compact(F.array(*[F.when(words.rlike(p), F.when(words.rlike(NAME_QUALIFIER), "OTHER").otherwise("NAME") if cls == "NAME" else F.lit(cls)) for cls, p in KEYWORDS]))

    return bound(F.regexp_replace(F.coalesce(text, F.lit("")), "[_-]+", " "), found)


def classify_field(tag: Column, kind: Column, autocomplete: Column, name: Column, label: Column) -> Column:
    """The class that autocomplete, type, name and label agree on; UNKNOWN if they do not or say something else."""
    auto = bound(F.lower(trim(F.coalesce(autocomplete, F.lit("")))), lambda a: F.coalesce(lookup(AUTOCOMPLETE, a), F.when(a.isin(*AUTOCOMPLETE_OTHER), "OTHER")))
    typed = F.lower(F.coalesce(kind, F.lit("")))
    own = F.array_compact(F.array(auto, F.coalesce(lookup(FIELD_TYPES, typed), F.when(typed.isin(*FIELD_TYPES_OTHER), "OTHER"))))
    agreed = lambda every: F.when(F.array_contains(every, "OTHER") | (F.size(every) > 1), "UNKNOWN").when(F.size(every) == 1, F.get(every, F.lit(0))).when(tag == "textarea", "FREE_TEXT").otherwise("UNKNOWN")
    return bound(F.array_distinct(F.concat(own, signals(name), signals(label))), agreed)


def field_role(autocomplete: Column, kind: Column) -> Column:
    auto, typed = F.lower(trim(F.coalesce(autocomplete, F.lit("")))), F.lower(trim(F.coalesce(kind, F.lit(""))))
    return F.when(auto != "", auto).when(~typed.isin("", "text"), typed)


def hint(cls: Column, value: Column, role: Column) -> Column:
    t = trim(value)
    kind = F.when(cls == "DOB", "date").when(t.rlike(rf"^(?:[0-9-]|{JS_SPACE})+$"), "numeric").when(t.rlike(rf"^(?:[\p{{L}}.'-]|{JS_SPACE})+$"), "alpha").otherwise("alphanumeric")
    return F.struct(F.length(t).alias("len"), kind.alias("kind"), role.alias("field_role"))


def format_token(cls: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("<PII:"), cls, F.lit(":"), ordinal.cast("string"), F.lit(">"))


def parse_token(ref: Column) -> Column:
    """struct<cls, ordinal> of a well-formed token of a tokenisable class, or null."""
    p = r"^<PII:([A-Z]+):([1-9][0-9]*)>$"
    cls, n = F.regexp_extract(ref, p, 1), F.expr("try_cast(null as bigint)") if ref is None else F.regexp_extract(ref, p, 2).try_cast("bigint")
    return F.when(cls.isin(*TOKENISABLE) & (n > 0) & (n <= 2**53 - 1), F.struct(cls.alias("cls"), n.alias("ordinal")))


def preview(cls: Column, value: Column) -> Column:
    """A phone shows its last two digits, everything else nothing."""
    mobile = normalise_mobile(value)
    dots = F.expr("repeat('•', 8)")
    return F.when((cls == "PHONE") & mobile.isNotNull(), F.concat(dots, F.right(mobile, F.lit(2)))).otherwise(F.lit("••••••"))


def class_marker(cls: Column) -> Column:
    return F.concat(F.lit("⟨redacted:"), cls, F.lit("⟩"))


def tripwire(body: Column) -> Column:
    return F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(c)) for c, p in TRIPWIRES]))


def secret_shapes(body: Column) -> Column:
    return F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(c)) for c, p in SECRET_SHAPES]))


def field_fit(accepts: Column, cls: Column) -> Column:
    return (
        F.when(tier_of(cls) == "CRITICAL", "CRITICAL_NEVER_AGENT_TYPED").when(accepts == "OTP", "CRITICAL_FIELD")
        .when(accepts.isin("UNKNOWN", "FREE_TEXT"), "AMBIGUOUS_FIELD").when(accepts != cls, "CLASS_MISMATCH").otherwise("FITS")
    )
