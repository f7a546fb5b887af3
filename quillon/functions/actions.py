"""Rules of acting on a page as column expressions over structs: freshness of a claim, verification after the act, binding, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.geometry import Box

# What may be done, how far a target may move, and the roles and names that need a confirmation.
ALLOWED = ("click", "focus", "scroll")
MAX_SHIFT, MIN_IOU = 2.0, 0.8
# Names of controls that a human confirms.
CONFIRMED_NAMES = (
    r"\bsubmit\b",
    r"\bsend\b",
    r"\bpay\b|\bpayment\b",
    r"\bpurchase\b|\bbuy\b|\border\b|\bcheckout\b",
    r"\bdelete\b|\bremove\b|\berase\b",
    r"\btransfer\b|\bwithdraw\b|\bdeposit\b",
    r"\bsign\s?in\b|\bsign\s?out\b|\blog\s?in\b|\blog\s?out\b|\blogin\b|\blogout\b",
    r"\bauthorise\b|\bauthorize\b|\bauthenticate\b",
    r"\bconfirm\b|\bapprove\b|\baccept\b|\bagree\b",
)


def finite(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        d = c.cast("double")
        out &= d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return out


def freshness(kind: Column, claim: Column, point: Column, graph: Column, node: Column) -> Column:
    """ALLOW, or the first reason why a claim must be observed again.

    claim: frame, role, name, box, seq; point: x, y or null; graph: frame, seq, watching; node: the current node of the
    claim (null: gone) with frame, role, name, enabled, evidence, box. A scroll takes no target.
    """
    b, now = Box.within(claim["box"]), Box.within(node["box"])
    shift = F.sqrt(F.pow(b.x + b.w / 2 - now.x - now.w / 2, F.lit(2)) + F.pow(b.y + b.h / 2 - now.y - now.h / 2, F.lit(2)))
    inside = (point["x"] >= now.x) & (point["x"] <= now.x + now.w) & (point["y"] >= now.y) & (point["y"] <= now.y + now.h)
    untargeted = kind == "scroll"
    return (
        F.when(~kind.isin(*ALLOWED), "ACTION_NOT_ALLOWLISTED").when(untargeted & claim.isNotNull(), "MALFORMED_CLAIM").when(untargeted, "ALLOW")
        .when(~graph["watching"] | (graph["seq"] != claim["seq"]), "OBSERVATION_STALE")
        .when(claim.isNull() | ~finite(b.x, b.y, b.w, b.h) | (b.w <= 0) | (b.h <= 0) | (F.coalesce(claim["role"], F.lit("")) == "") | (F.coalesce(claim["name"], F.lit("")) == ""), "MALFORMED_CLAIM")
        .when(point.isNotNull() & ~finite(point["x"], point["y"]), "MALFORMED_CLAIM").when(claim["frame"] != graph["frame"], "FRAME_MISMATCH").when(node.isNull(), "TARGET_MISSING")
        .when(node["role"] != claim["role"], "ROLE_CHANGED").when(node["name"] != claim["name"], "NAME_CHANGED").when(~node["enabled"], "NOT_ENABLED")
        .when(~node["evidence"].isin("OBSERVED", "CLIPPED"), "NOT_VISIBLE").when((now.w <= 0) | (now.h <= 0), "MALFORMED_CLAIM").when(node["frame"] != graph["frame"], "FRAME_MISMATCH")
        .when(shift > MAX_SHIFT, "MOVED_BEYOND_TOLERANCE").when(b.iou(now) < MIN_IOU, "GEOMETRY_MISMATCH").when(point.isNotNull() & ~inside, "POINT_OUTSIDE_TARGET").otherwise("ALLOW")
    )


def hit_agreement(target: Column, topmost: Column, elapsed_ms: Column, timeout_ms: int = 2000) -> Column:
    """Whether the page's topmost element at a point is the target; no answer in time is no answer."""
    return F.when(topmost.isNull() | elapsed_ms.isNull() | (elapsed_ms > timeout_ms), "UNKNOWN").when(topmost == target, "MATCH").otherwise("MISMATCH")


def holds_now(kind: Column, expected: Column, enabled: Column, name: Column, selector: Column, focus_seen: Column, focused: Column) -> Column:
    """HOLDS, DOES_NOT_HOLD or UNKNOWN of a postcondition. focus_seen: whether focus was observed; focused: null if nothing has it."""
    def either(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), "HOLDS").otherwise("DOES_NOT_HOLD")

    return F.when(kind == "TARGET_ENABLED", either(enabled == (expected == "true"))).when(kind == "TARGET_NAME", either(name == expected)).when(kind == "FOCUS_ON_TARGET", F.when(~focus_seen, "UNKNOWN").otherwise(either(focused == selector)))


# The order of a run's states; a run may be refused from any of them but the last two, which nothing follows.
STATES = ("IDLE", "OBSERVE", "SANITIZE", "VERIFY_PAYLOAD", "AWAIT_CLARIFICATION", "SEND", "VALIDATE_PLAN", "AWAIT_GRANT", "REHYDRATE", "ACT", "VERIFY_RESULT", "DONE", "REFUSED")
FOLLOWS = {
    "IDLE": ("OBSERVE",), "OBSERVE": ("SANITIZE",), "SANITIZE": ("VERIFY_PAYLOAD",), "VERIFY_PAYLOAD": ("AWAIT_CLARIFICATION", "SEND"), "AWAIT_CLARIFICATION": ("SEND",), "SEND": ("VALIDATE_PLAN",),
    "VALIDATE_PLAN": ("DONE", "AWAIT_GRANT"), "AWAIT_GRANT": ("REHYDRATE",), "REHYDRATE": ("ACT",), "ACT": ("VERIFY_RESULT",), "VERIFY_RESULT": ("DONE",), "DONE": (), "REFUSED": (),
}


def transition(before: Column, after: Column) -> Column:
    """START, OK, AFTER_TERMINAL or NOT_A_TRANSITION."""
    table = F.create_map(*[x for s in STATES for x in (F.lit(s), F.array(*map(F.lit, FOLLOWS[s])).cast("array<string>"))])
    follows = F.array_contains(table[before], after) | (after == "REFUSED")
    return F.when(before.isNull(), F.when(after == "IDLE", "START").otherwise("NOT_A_TRANSITION")).when(before.isin("DONE", "REFUSED"), "AFTER_TERMINAL").when(follows, "OK").otherwise("NOT_A_TRANSITION")


SENSITIVE = ("AADHAAR", "DOB")


def bind_decision(s: Column) -> Column:
    """Of a step joined with what it names: BIND_OK, NEEDS_HUMAN_GRANT, or REFUSE and NEEDS_USER with the first cause.

    s: destroyed, vault_session, session, view, live_view, document, live_document, accepts and field_origin (null:
    no such field), ref, cls and origin (null: no such reference), consumed, class_grant, use_grant.
    """
    return (
        F.when(s["destroyed"], "REFUSE:VAULT_DESTROYED").when(s["vault_session"] != s["session"], "REFUSE:SESSION_MISMATCH").when(s["view"] != s["live_view"], "REFUSE:STALE_VIEW").when(s["document"] != s["live_document"], "REFUSE:STALE_BINDING")
        .when(s["accepts"].isNull(), "REFUSE:UNKNOWN_TARGET").when(~F.coalesce(s["ref"].rlike("^<PII:[A-Z]+:[1-9][0-9]*>$"), F.lit(False)) | s["cls"].isNull(), "REFUSE:UNKNOWN_TOKEN")
        .when(s["accepts"] == "OTP", "NEEDS_USER:CRITICAL_FIELD").when(s["accepts"].isin("UNKNOWN", "FREE_TEXT"), "NEEDS_USER:AMBIGUOUS_FIELD").when(s["accepts"] != s["cls"], "REFUSE:CLASS_MISMATCH")
        .when(s["field_origin"] != s["origin"], "REFUSE:ORIGIN_MISMATCH").when(s["consumed"], "REFUSE:CONSUMED").when(~s["class_grant"], "NEEDS_USER:CLASS_ORIGIN_GRANT_REQUIRED")
        .when(s["cls"].isin(*SENSITIVE) & ~s["use_grant"], "NEEDS_HUMAN_GRANT").otherwise("BIND_OK")
    )
