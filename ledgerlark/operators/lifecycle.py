"""Stage machine: which moves are legal, as expressions and as a table of moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranks of the stages of progress.
RANKS = {
    "discovered": 0, "enriching": 1, "enriched": 2, "verifying": 3, "verified": 4, "ready_for_outreach": 5, "message_generated": 6, "drafted": 7,
    "send_pending": 8, "sent": 9, "contacted": 9, "delivered": 10, "replied": 11, "converted": 12,
}
TERMINAL = ("suppressed", "converted")
#: Stages from which a failure can come, and those a failure can go back to.
INTO = {
    "enrichment_failed": ("discovered", "enriching"),
    "verification_failed": ("enriched", "verifying"),
    "contact_unavailable": ("discovered", "enriching", "enriched", "verifying", "verification_failed"),
    "send_failed": ("verified", "ready_for_outreach", "message_generated", "drafted", "send_pending"),
    "provider_error": ("verified", "ready_for_outreach", "message_generated", "drafted", "send_pending"),
    "bounced": ("sent", "contacted", "delivered"),
    "retry_pending": ("bounced", "send_failed", "provider_error", "verification_failed", "enrichment_failed", "drafted", "send_pending"),
}
OUT_OF = {
    "enrichment_failed": ("enriching", "enriched"),
    "verification_failed": ("verifying", "verified", "enriching"),
    "contact_unavailable": ("enriching", "enriched"),
    "send_failed": ("send_pending", "drafted"),
    "provider_error": ("send_pending", "drafted"),
    "retry_pending": ("enriching", "enriched", "verifying", "verified", "drafted", "send_pending"),
}
STAGES = tuple(RANKS) + tuple(INTO) + ("suppressed",)


def legal(old: str, new: str) -> bool:
    if old == new:
        return True
    if old in TERMINAL:
        return False
    if new == "suppressed":
        return True
    if old in RANKS and new in RANKS:
        return RANKS[new] > RANKS[old]
    return old in INTO.get(new, ()) or new not in INTO and new in OUT_OF.get(old, ())


def moves() -> list[tuple[str, str]]:
    return [(a, b) for a in STAGES for b in STAGES if legal(a, b)]


def rank(stage: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, r in RANKS.items():
        out = F.when(stage == name, r).otherwise(out)
    return out


def transition_ok(old: Column, new: Column) -> Column:
    """Whether a move is legal; a lookup among a few hundred literal pairs."""
    return F.concat_ws(">", old, new).isin([f"{a}>{b}" for a, b in moves()])


def moves_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(moves(), "old_stage string, new_stage string")


def advance(old: Column, new: Column) -> Column:
    """The stage after a proposed move: the new one if legal."""
    return F.when(transition_ok(old, new), new).otherwise(old)


#: How far an event's status has come; a source can't say that it is predicted.
STATUS_RANKS = {"ANNOUNCED": 1, "REGISTRATION_OPEN": 2, "REGISTRATION_CLOSED": 3, "ONGOING": 4, "COMPLETED": 5, "HISTORICAL": 6}


def advance_status(old: Column, new: Column) -> Column:
    """The later status; HISTORICAL stays, PREDICTED from a source is ANNOUNCED."""
    said = F.when(F.upper(new) == "PREDICTED", "ANNOUNCED").otherwise(F.upper(new))

    def place(c: Column) -> Column:
        out = F.lit(0)
        for name, r in STATUS_RANKS.items():
            out = F.when(c == name, r).otherwise(out)
        return out

    return F.when(old == "HISTORICAL", old).when(place(said) >= place(F.coalesce(old, F.lit(""))), said).otherwise(old)
