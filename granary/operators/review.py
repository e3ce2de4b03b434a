"""Review queues: priorities, locks, states, pages and validation of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.fold import CHUNK, folded

#: Weight of a queue's reasons and the levels that the weights stand for, and minutes that a lock holds.
WEIGHT = {"contradiction_detected": 3, "ai_parse_failed": 3, "ai_provider_error": 3, "rule_collision": 2, "low_confidence": 1, "requested": 0}
LEVELS = ["low", "medium", "high", "critical"]
LOCK_MINUTES, STALE_MINUTES = 15, 30
#: States and the actions that lead from one to another.
EDGES = [
    ("in_queue", "claim", "reviewing"), ("reviewing", "claim", "reviewing"), ("reviewing", "release", "in_queue"), ("in_queue", "accept", "accepted"), ("reviewing", "accept", "accepted"),
    ("in_queue", "change", "changed"), ("reviewing", "change", "changed"), ("in_queue", "defer", "deferred"), ("reviewing", "defer", "deferred"), ("deferred", "reopen", "in_queue"),
]
#: Where an action leads, states that take no decision, and categories that reviewers can't set.
STATUS_AFTER = {"claim": "reviewing", "refresh": "reviewing", "release": "in_queue", "accept": "accepted", "change": "changed", "defer": "deferred", "reopen": "in_queue"}
DECIDED = ["accepted", "changed", "deferred"]
SYSTEM_STATES = ["out_of_scope", "unknown"]
TERMINAL = ["done", "failed", "cancelled"]


def weight(reason: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv]), reason), F.lit(0))


def priority(w: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.least(F.lit(3), F.greatest(F.lit(0), w)).cast("int") + 1)


def page(queue: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    """A page of 1 to 200 rows of a queue in a total order."""
    return queue.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 200))


def expired(locked_at: Column, now: Column) -> Column:
    return locked_at.isNull() | (locked_at + F.expr(f"interval {LOCK_MINUTES} minutes") <= now)


def stale(jobs: DataFrame, now: Column) -> DataFrame:
    """Unfinished jobs without an update in half an hour."""
    return jobs.filter(~F.col("status").isin(TERMINAL) & (F.col("updated_at") < now - F.expr(f"interval {STALE_MINUTES} minutes")))


def latest(rows: DataFrame, keys: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """The row of each key that is last by some columns."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("x")).select(*keys, "x.*")


def checked_transitions(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add previous (the item's state before an event, in_queue at first) and valid: whether an edge leads from it to the event's state.

    An event that isn't valid leaves the item in the state it was in.
    """
    edges = {(a, b) for a, _, b in EDGES}

    def step(state: str, event: dict) -> tuple[str, tuple]:
        valid = (state, event["state"]) in edges
        return event["state"] if valid else state, (state, valid)

    ends = {a for _, a in edges} - {a for a, _ in edges}
    return folded(events, keys, order, "in_queue", step, "previous string, valid boolean", final=lambda state: F.get_json_object(state, "$").isin(*ends))


def review_step(state: list, event: dict) -> tuple[list, tuple]:
    """One action on an item. State: status, holder and end (microseconds) of its lock, category."""
    status, holder, until, category = state
    action, user, now, to = event["action"], event["user"], event["at"], event["category"]
    held = holder is not None and until > now
    target = STATUS_AFTER.get(action)
    if target is None:
        refusal = "unknown_action"
    elif action == "reopen":
        refusal = "illegal_transition" if status != "deferred" else None
    elif status in DECIDED:
        refusal = "illegal_transition"
    elif action == "refresh":
        refusal = "locked" if holder is None or holder != user else "lock_expired" if not held else None
    elif held and holder != user:
        refusal = "locked"
    elif action == "change" and to in SYSTEM_STATES:
        refusal = "system_state"
    elif action == "change" and (to is None or to == category):
        refusal = "same_category"
    else:
        refusal = None
    if refusal is None:
        locked = action in ("claim", "refresh")
        state = [status if action == "refresh" else target, user if locked else None, now + LOCK_MINUTES * 60_000_000 if locked else None, to if action == "change" else category]
    return state, (status, refusal is None, refusal, state[0], state[3])


def review_final(state: Column) -> Column:
    """Whether no action leads out of a state."""
    return F.get_json_object(state, "$[0]").isin("accepted", "changed")


def reviewed(actions: DataFrame, keys: list[str], order: list[str], category: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Add status_before, accepted, refusal, status_after and category_after to actions (action, user, at in microseconds, category).

    Actions are claim, refresh, release, accept, change, defer and reopen. A refused one changes nothing: an item that is decided, or locked by another
    for 15 minutes from the claim, takes no decision; a change needs another category, which is no system state.
    """
    added = "status_before string, accepted boolean, refusal string, status_after string, category_after string"
    return folded(actions, keys, order, ["in_queue", None, None, category], review_step, added, chunk, review_final)


def decision_errors(decision: Column, priority_: Column, override: Column, chosen: Column) -> Column:
    """Codes of what is wrong with a review row, in order."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(decision.isin("accept", "change", "reject", "defer"), F.lit(False)), "unknown_decision"),
            F.when((decision == "accept") & (priority_ == "P0") & ~F.coalesce(override, F.lit(False)), "p0_needs_override"),
            F.when((decision == "change") & chosen.isNull(), "missing_choice"),
        )
    )


def top_reasons(queue: DataFrame, n: int = 5) -> DataFrame:
    return queue.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def disposition(records: DataFrame, key: str = "product_id") -> DataFrame:
    """What to do with a planned write, by what a product already has of the nutrient (kind, nutrient, value).

    A manual record, one of version 2, or a value of version 1 is never overwritten; a product without any is written.
    """
    own = F.col("nutrient") == "protein_pct"
    has = lambda c: F.coalesce(F.bool_or(own & c), F.lit(False))
    flags = records.groupBy(key).agg(has(F.col("kind") == "manual").alias("m"), has(F.col("kind") == "v2").alias("v2"), has((F.col("kind") == "v1") & F.col("value").isNotNull()).alias("v1"))
    return flags.select(key, F.when(F.col("m"), "skip_manual").when(F.col("v2"), "skip_v2").when(F.col("v1"), "skip_v1").otherwise("write").alias("disposition"))
