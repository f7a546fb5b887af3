"""Strict readers of JSON records as column expressions: every rule reads the record itself, and the first that fails names its cause."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.binding import bound

# Keys of the two kinds of findings, classes and causes.
UNREAD_KEYS = ("kind", "box", "score", "regionId", "treatment")
READ_KEYS = ("kind", "box", "length", "piiClass", "ref")
BOX_KEYS = ("x", "y", "w", "h")
CLASSES = ("OTP", "AADHAAR", "PHONE", "DOB", "NAME", "UNKNOWN")
FAILURES = ("UNAVAILABLE", "ERROR", "TIMEOUT", "MALFORMED")


def listed(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def type_at(v: Column, path: str) -> Column:
    """The type's name of what a variant holds at a path, as Spark writes it; null if there is nothing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def kind_of(v: Column, path: str) -> Column:
    """The type of what a variant holds at a path: OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, VOID for null; null if there is nothing."""
    # one pass over the name: a branch for each kind would look the type up anew
    return F.regexp_replace(F.regexp_replace(type_at(v, path), "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "NUMBER"), "(?s)^(OBJECT|ARRAY)<.*$", "$1")


def is_number(v: Column, path: str) -> Column:
    """Whether a number stands at a path; null if nothing does. Every numeric type's name begins with one of these."""
    return type_at(v, path).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")


def text_at(v: Column, path: str) -> Column:
    """A string at a path, null if there is something else."""
    return F.when(type_at(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    return F.when(is_number(v, path), F.try_variant_get(v, path, "double"))


def key_difference(keys: Column, allowed: tuple[str, ...]) -> tuple[Column, Column]:
    """(keys that are not allowed, sorted; allowed keys that are not there, in their order)."""
    return F.array_sort(F.array_except(keys, listed(allowed))), F.array_except(listed(allowed), keys)


def box_is_sound(json: Column, v: Column, path: str) -> Column:
    """Whether there is a rectangle of exactly x, y, w, h at the path, finite and with an extent."""
    keys = F.json_object_keys(F.get_json_object(json, path))
    extra, missing = key_difference(keys, BOX_KEYS)
    numbers = [number_at(v, f"{path}.{k}") for k in BOX_KEYS]
    sound = type_at(v, path).startswith("OBJECT<") & (F.size(extra) == 0) & (F.size(missing) == 0) & (numbers[2] > 0) & (numbers[3] > 0)
    for n in numbers:
        sound &= n.isNotNull() & (F.abs(n) != float("inf"))
    return F.coalesce(sound, F.lit(False))


def parsed(json: Column) -> Column:
    """A record parsed once: v, its variant, and keys, those of its top."""
    return F.struct(F.try_parse_json(json).alias("v"), F.json_object_keys(json).alias("keys"))


def finding_cause(json: Column) -> Column:
    """OK, or the code of the first defect of a text finding."""
    return bound(parsed(json), lambda r: _finding_cause(json, r["v"], r["keys"]))


def _finding_cause(json: Column, v: Column, keys: Column) -> Column:
    kind = text_at(v, "$.kind")

    def fields(prefix: str, allowed: tuple[str, ...]) -> Column:
        extra, missing = key_difference(keys, allowed)
        return F.when(F.size(extra) > 0, F.concat(F.lit(prefix + "_EXTRA_FIELD:"), F.array_join(extra, ","))).when(F.size(missing) > 0, F.concat(F.lit(prefix + "_MISSING_FIELD:"), F.array_join(missing, ",")))

    sound, score, length = box_is_sound(json, v, "$.box"), number_at(v, "$.score"), number_at(v, "$.length")
    unread = (
        F.when(F.coalesce(text_at(v, "$.treatment"), F.lit("")) != "REDACT_UNREAD", "UNREAD_REGION_TREATMENT").when(~sound, "UNREAD_REGION_GEOMETRY")
        .when(score.isNull() | ~score.between(0, 1), "UNREAD_REGION_SCORE").when(F.coalesce(text_at(v, "$.regionId"), F.lit("")) == "", "UNREAD_REGION_REGION")
    )
    cls = F.coalesce(type_at(v, "$.piiClass") == "VOID", F.lit(False)) | F.coalesce(text_at(v, "$.piiClass").isin(*CLASSES), F.lit(False))
    read = (
        F.when(~sound, "READ_TEXT_GEOMETRY").when(length.isNull() | (length != F.floor(length)) | (length < 0), "READ_TEXT_LENGTH")
        .when(~cls, "READ_TEXT_UNKNOWN_CLASS").when(~F.coalesce(type_at(v, "$.ref").isin("VOID", "STRING"), F.lit(False)), "READ_TEXT_REF")
    )
    return (
        F.when(F.coalesce(~type_at(v, "$").startswith("OBJECT<"), F.lit(True)), "NOT_AN_OBJECT").when(~F.array_contains(keys, "kind"), "MISSING_KIND")
        .when(kind == "UNREAD_REGION", F.coalesce(fields("UNREAD_REGION", UNREAD_KEYS), unread, F.lit("OK")))
        .when(kind == "READ_TEXT", F.coalesce(fields("READ_TEXT", READ_KEYS), read, F.lit("OK"))).otherwise("UNKNOWN_KIND")
    )


def must_redact(json: Column) -> Column:
    """What is unread always; what was read if it has a class."""
    return bound(F.try_parse_json(json), lambda v: F.when(text_at(v, "$.kind") == "UNREAD_REGION", True).otherwise(text_at(v, "$.piiClass").isNotNull()))


def answer_cause(answer: Column, request: dict[str, Column], bound_keys: tuple[tuple[str, str], ...], yes: str, more: tuple[str, ...], no: str, malformed: str, declined: str) -> Column:
    """OK, or why an answer does not accept a request.

    An answer of kind yes has exactly the bound keys, kind and more, all strings, and repeats the request's values, each
    with its cause if it does not; one of kind no has the first bound key and kind.
    """
    return bound(parsed(answer), lambda r: _answer_cause(r["v"], r["keys"], request, bound_keys, yes, more, no, malformed, declined))


def _answer_cause(v: Column, keys: Column, request: dict[str, Column], bound_keys: tuple[tuple[str, str], ...], yes: str, more: tuple[str, ...], no: str, malformed: str, declined: str) -> Column:
    kind, first = F.coalesce(text_at(v, "$.kind"), F.lit("")), bound_keys[0]

    def exact(allowed: tuple[str, ...]) -> Column:
        strings = F.lit(True)
        for k in allowed:
            strings &= text_at(v, f"$.{k}").isNotNull()
        return F.coalesce(F.array_sort(keys) == listed(tuple(sorted(allowed))), F.lit(False)) & strings

    found = F.when(F.coalesce(~type_at(v, "$").startswith("OBJECT<"), F.lit(True)), malformed)
    found = found.when((kind == no) & ~exact((first[0], "kind")), malformed).when((kind == no) & (text_at(v, f"$.{first[0]}") != request[first[0]]), first[1]).when(kind == no, declined)
    found = found.when((kind != yes) | ~exact((*(k for k, _ in bound_keys), "kind", *more)), malformed)
    for name, cause in bound_keys:
        found = found.when(text_at(v, f"$.{name}") != request[name], cause)
    return found.otherwise("OK")


# What an answer to a request for consent must repeat, with the cause if it does not.
CONSENT_BOUND = (("consentId", "NOT_THIS_CONSENT"), ("sessionId", "SESSION_MISMATCH"), ("origin", "ORIGIN_MISMATCH"), ("documentId", "DOCUMENT_CHANGED"), ("target", "TARGET_MISMATCH"))


def consent_cause(answer: Column, request: dict[str, Column]) -> Column:
    """OK, or why an answer gives no consent to the request."""
    return answer_cause(answer, request, CONSENT_BOUND, "ALLOW_ONCE", (), "DENY", "MALFORMED_CONSENT", "CONSENT_DENIED")


def output_cause(dims: Column, data: Column, height: Column, width: Column) -> Column:
    """OK, or why a map of probabilities is refused: its dimensions, its length or a value."""
    bad = F.when(dims.isNull(), "NO_DIMS").when((F.size(dims) != 4) | (F.get(dims, F.lit(0)) != 1) | (F.get(dims, F.lit(1)) != 1), "NOT_ONE_MAP")
    bad = bad.when((F.get(dims, F.lit(2)) != height) | (F.get(dims, F.lit(3)) != width), "OTHER_SIZE").when(F.size(data) != height * width, "OTHER_LENGTH")
    return bad.when(~F.forall(data, lambda x: F.coalesce(~F.isnan(x) & x.between(0, 1), F.lit(False))), "NOT_A_PROBABILITY").otherwise("OK")


def exact_record(json: Column, allowed: tuple[str, ...]) -> Column:
    """array<string>: fields of a record of numbers that are not permitted, or not finite numbers."""
    return bound(parsed(json), lambda r: _exact_record(r["v"], r["keys"], allowed))


def _exact_record(v: Column, keys: Column, allowed: tuple[str, ...]) -> Column:
    reasons = [F.when(F.array_contains(keys, k) & number_at(v, f"$.{k}").isNull(), f"box field {k} is not a finite number") for k in allowed]
    extra = F.transform(F.array_sort(F.array_except(keys, listed(allowed))), lambda k: F.concat(F.lit("box field "), k, F.lit(" is not permitted")))
    return F.concat(extra, F.array_compact(F.array(*reasons)))
