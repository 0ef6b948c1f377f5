"""Rows of the timelock model: roles, delays, operations and their calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import u256
from rollcall.functions.scalars import role_label

#: Events that name an operation.
OPERATION_EVENTS = ("CallScheduled", "CallExecuted", "CallSalt", "Cancelled")


def role_rows(events: DataFrame) -> DataFrame:
    """Role events with labels. ``events``: id, event_name, role, account, sender, previous_admin_role, new_admin_role."""
    admin = F.col("event_name") == "RoleAdminChanged"
    one = lambda c, of_admin: F.when(admin if of_admin else ~admin, F.lower(c)).alias(c)
    roles = events.where(F.col("event_name").isin("RoleGranted", "RoleRevoked", "RoleAdminChanged"))
    kept = roles.select("id", "event_name", F.lower("role").alias("role"), one("account", False), one("sender", False), one("previous_admin_role", True), one("new_admin_role", True))
    return kept.withColumns({f"{c}_label": role_label(F.col(c)) for c in ("role", "previous_admin_role", "new_admin_role")})


def min_delay_rows(events: DataFrame) -> DataFrame:
    """``events``: id, event_name, old_value, new_value."""
    return events.where("event_name = 'MinDelayChange'").select("id", F.col("old_value").alias("old_duration"), F.col("new_value").alias("new_duration"))


def operation_hints(events: DataFrame) -> DataFrame:
    """A hint for every event that names an operation. ``events``: id, event_name, operation_id."""
    named = events.where(F.col("event_name").isin(*OPERATION_EVENTS) & F.col("operation_id").isNotNull())
    return named.select(F.concat("id", F.lit(":operation-hint")).alias("id"), F.lower(F.trim("operation_id")).alias("operation_id"), "event_name")


def ready_at(timestamp: Column, delay: Column) -> Column:
    """When a scheduled call may run: decimal texts of any size; null if either is."""
    return u256.added(timestamp, delay)


def delay_between(eta: Column, timestamp: Column) -> Column:
    """eta - timestamp, or null if that is negative or one isn't known."""
    return F.when(u256.compared(eta, timestamp) >= 0, u256.subtracted(eta, timestamp))


def operation_id(proposal_id: Column) -> Column:
    """The 32-byte form of a proposal's id, which is hexadecimal or decimal text."""
    hexadecimal = F.lower(F.trim(proposal_id))
    return F.when(hexadecimal.startswith("0x"), hexadecimal).otherwise(F.concat(F.lit("0x"), F.lpad(F.substring(u256.decimal_to_hex(proposal_id), 3, 64), 64, "0")))


def with_operation(links: DataFrame) -> DataFrame:
    """Adds operation_id, operation_ref and delay_seconds."""
    delay = F.when(F.col("queue_eta").isNotNull() & F.col("queue_timestamp").isNotNull(), delay_between(F.col("queue_eta"), F.col("queue_timestamp")))
    rows = links.withColumns({"operation_id": operation_id(F.col("proposal_id")), "delay_seconds": delay})
    return rows.withColumn("operation_ref", F.concat_ws(":", F.lit("timelock-operation"), "contract_set_id", "operation_id"))


def control_calls(links: DataFrame) -> DataFrame:
    """The calls that a governor's own timelock control stands for: one for each action of a queued proposal.

    ``links``: contract_set_id, proposal_id, action_index, target, value, calldata, queue_tx, queue_timestamp, queue_eta, and
    execution_tx, which is null until the proposal is executed. Timestamps and values are decimal texts.
    """
    state = F.when(F.col("execution_tx").isNotNull(), "Done").otherwise("Scheduled")
    return with_operation(links).select(
        F.concat_ws(":", "operation_ref", F.lit("call"), F.col("action_index").cast("string")).alias("id"), "operation_ref", "operation_id", "proposal_id", "action_index", "target", "value",
        F.col("calldata").alias("data"), "delay_seconds", state.alias("state"), F.col("queue_tx").alias("scheduled_tx"), F.col("execution_tx").alias("executed_tx"), "queue_eta",
    )


#: Fixed value: the type of operations that a governor's own control stands for.
CONTROL_TYPE = "GovernorTimelockControl"


def control_operations(links: DataFrame) -> DataFrame:
    """The operations of those calls: an executed one is done, the counts are sums over its actions.

    ``links`` may also have queue_block, execution_block and execution_timestamp; what comes from the queueing and the execution is that of
    the last action. Actions that agree in all of that are one row with a count before any text is made, sorted or compared.
    """
    bounds = ("queue_block", "execution_block", "execution_timestamp")
    bounded = set(bounds) <= set(links.columns)
    alike = links.groupBy("contract_set_id", "proposal_id", "queue_tx", "queue_timestamp", "queue_eta", "execution_tx", *(bounds if bounded else ())).agg(F.count("*").alias("n"), F.max("action_index").alias("action_index"))
    executed = F.col("execution_tx").isNotNull()
    done = F.sum(F.when(executed, F.col("n")))
    of = lambda c, when=None: F.max_by(c, "action_index" if when is None else F.when(when, F.col("action_index")))
    last = {
        "queued_block_number": of("queue_block"), "queued_block_timestamp": of("queue_timestamp"), "queued_transaction_hash": of("queue_tx"),
        "executed_block_number": of("execution_block", executed), "executed_block_timestamp": of("execution_timestamp", executed), "executed_transaction_hash": of("execution_tx", executed),
    }
    ends = [F.max("action_index").alias("_last"), F.max(F.when(executed, F.col("action_index"))).alias("_last_done"), *(x.alias(c) for c, x in last.items())] if bounded else []
    grouped = with_operation(alike).groupBy(F.col("operation_ref").alias("id"), "operation_id", "proposal_id").agg(
        F.when(done > 0, "Done").otherwise("Queued").alias("state"), F.sum("n").alias("call_count"), done.alias("executed_call_count"),
        of("delay_seconds").alias("delay_seconds"), of("queue_eta").alias("ready_at"), F.max("execution_tx").alias("executed_tx"), *ends,
    )
    if not bounded:
        return grouped
    operation = Window.partitionBy("id")  # of several spellings of a proposal's id
    return grouped.withColumns({c: F.max_by(c, "_last" if c.startswith("queued") else "_last_done").over(operation) for c in last}).drop("_last", "_last_done").withColumn("timelock_type", F.lit(CONTROL_TYPE))
