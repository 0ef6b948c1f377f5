"""From delivered logs to typed events."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import u256
from rollcall.functions.keccak import keccak256
from rollcall.functions.scalars import seconds_to_millis

#: The events of each contract role, with their parameters; a star marks those that are topics.
EVENTS = {
    "governor": (
        "ProposalCreated(uint256 proposal_id,address proposer,address[] targets,uint256[] values,string[] signatures,bytes[] calldatas,uint256 vote_start,uint256 vote_end,string description)",
        "ProposalQueued(uint256 proposal_id,uint256 eta_seconds)",
        "ProposalExtended(uint256* proposal_id,uint64 extended_deadline)",
        "ProposalExecuted(uint256 proposal_id)",
        "ProposalCanceled(uint256 proposal_id)",
        "VotingDelaySet(uint256 old_value,uint256 new_value)",
        "VotingPeriodSet(uint256 old_value,uint256 new_value)",
        "ProposalThresholdSet(uint256 old_value,uint256 new_value)",
        "QuorumNumeratorUpdated(uint256 old_value,uint256 new_value)",
        "LateQuorumVoteExtensionSet(uint64 old_value,uint64 new_value)",
        "TimelockChange(address old_timelock,address new_timelock)",
        "VoteCast(address* voter,uint256 proposal_id,uint8 support,uint256 weight,string reason)",
        "VoteCastWithParams(address* voter,uint256 proposal_id,uint8 support,uint256 weight,string reason,bytes params)",
    ),
    "token": (
        "DelegateChanged(address* delegator,address* from_delegate,address* to_delegate)",
        "DelegateVotesChanged(address* delegate,uint256 previous_votes,uint256 new_votes)",
        "Transfer(address* from,address* to,uint256 value)",
    ),
    "timelock": (
        "CallScheduled(bytes32* id,uint256* index,address target,uint256 value,bytes data,bytes32 predecessor,uint256 delay)",
        "CallExecuted(bytes32* id,uint256* index,address target,uint256 value,bytes data)",
        "CallSalt(bytes32* id,bytes32 salt)",
        "Cancelled(bytes32* id)",
        "MinDelayChange(uint256 old_value,uint256 new_value)",
        "RoleGranted(bytes32* role,address* account,address* sender)",
        "RoleRevoked(bytes32* role,address* account,address* sender)",
        "RoleAdminChanged(bytes32* role,bytes32* previous_admin_role,bytes32* new_admin_role)",
    ),
}


def parameters(signature: str) -> list[tuple[str, str, bool]]:
    """(name, type, whether it is a topic) of each parameter."""
    inner = signature[signature.index("(") + 1 : -1]
    found = [p.split(" ") for p in inner.split(",") if p]
    return [(name, kind.rstrip("*"), kind.endswith("*")) for kind, name in found]


def topic0(signature: str) -> str:
    kinds = ",".join(kind for _, kind, _ in parameters(signature))
    return "0x" + keccak256(f"{signature[: signature.index('(')]}({kinds})".encode()).hex()


def _topics() -> dict[str, tuple[str, str]]:
    """(role, signature) by topic."""
    return {topic0(s): (role, s) for role, signatures in EVENTS.items() for s in signatures}


TOPICS = _topics()


def _word(data: bytes, at: int) -> bytes:
    if at + 32 > len(data):
        raise ValueError("the data end early")
    return data[at : at + 32]


def _number(data: bytes, at: int) -> int:
    return int.from_bytes(_word(data, at), "big")


def _static(kind: str, word: bytes) -> str | int:
    if kind == "address":
        return "0x" + word[12:].hex()
    if kind == "bytes32":
        return "0x" + word.hex()
    return int.from_bytes(word, "big") if kind == "uint8" else str(int.from_bytes(word, "big"))


def _dynamic(kind: str, data: bytes, at: int) -> str | list:
    n = _number(data, at)
    if kind.endswith("[]"):
        inner = kind[:-2]
        if inner in ("string", "bytes"):
            return [_dynamic(inner, data, at + 32 + _number(data, at + 32 + 32 * k)) for k in range(n)]
        return [_static(inner, _word(data, at + 32 + 32 * k)) for k in range(n)]
    if at + 32 + n > len(data):
        raise ValueError("the data end early")
    raw = data[at + 32 : at + 32 + n]
    return raw.decode("utf-8", "replace") if kind == "string" else "0x" + raw.hex()


def decoded_log(topics: list[str], data: str) -> dict | None:
    """The parameters of one log by name; null if its event isn't known or it can't be read."""
    known = TOPICS.get(topics[0]) if len(topics) else None
    if known is None:
        return None
    raw, found, at, topic = bytes.fromhex((data or "0x")[2:]), {}, 0, 1
    signature = known[1]
    nft = signature.startswith("Transfer(") and len(topics) == 4
    try:
        for name, kind, indexed in parameters(signature):
            if indexed or (nft and name == "value"):
                found[name] = _static(kind, bytes.fromhex(topics[topic][2:]))
                topic += 1
            elif kind in ("string", "bytes") or kind.endswith("[]"):
                found[name] = _dynamic(kind, raw, _number(raw, at))
                at += 32
            else:
                found[name] = _static(kind, _word(raw, at))
                at += 32
    except (ValueError, IndexError):
        return None
    if signature.startswith("Transfer("):
        found["standard"] = "erc721" if nft else "erc20"
    return found


@F.pandas_udf(T.StringType())
def abi_json(topics: pd.Series, data: pd.Series) -> pd.Series:
    """The decoded parameters as JSON."""
    found = (decoded_log(t, d) for t, d in zip(topics, data, strict=True))
    return pd.Series([None if f is None else json.dumps(f) for f in found], dtype=object)


def payload_type(signature: str) -> T.StructType:
    """The struct of an event's parameters; numbers are decimal text, but for one byte."""

    def kind(name: str) -> T.DataType:
        if name.endswith("[]"):
            return T.ArrayType(T.StringType())
        return T.IntegerType() if name == "uint8" else T.StringType()

    fields = [T.StructField(n, kind(k)) for n, k, _ in parameters(signature)]
    return T.StructType(fields + ([T.StructField("standard", T.StringType())] if signature.startswith("Transfer(") else []))


def normalized(logs: DataFrame, chain_id: int) -> DataFrame:
    """Logs that weren't removed, lower-cased, with id, chain, topic0 and milliseconds."""
    kept = logs.where(~F.coalesce(F.col("removed"), F.lit(False)))
    kept = kept.withColumns({c: F.lower(c) for c in ("transaction_hash", "address")} | {"topics": F.transform(F.coalesce("topics", F.array().cast("array<string>")), F.lower)})
    ident = F.concat_ws(":", F.lit("evm"), F.lit(str(chain_id)), *(F.col(c).cast("string") for c in ("block_number", "transaction_hash", "transaction_index", "log_index")))
    return kept.withColumns({"id": ident, "chain_id": F.lit(chain_id), "topic0": F.get("topics", F.lit(0)), "block_timestamp_ms": seconds_to_millis(F.col("block_timestamp"))})


def deduplicated(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key; rows that repeat a key but differ are an error."""
    content = F.xxhash64(*(c for c in rows.columns if c != key))
    marked = rows.withColumn("_content", content)
    seen = marked.groupBy(key).agg(F.min("_content").alias("_lo"), F.max("_content").alias("_hi"), *(F.first(c).alias(c) for c in rows.columns if c != key))
    checked = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.concat(F.lit("rows differ under "), F.col(key).cast("string")))).otherwise(F.col(key))
    return seen.withColumn(key, checked).select(*rows.columns)


def one_chain(rows: DataFrame, column: str = "chain_id") -> DataFrame:
    """The rows, if they share one chain; checked by an aggregate of one row."""
    bounds = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))  # one row
    checked = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.concat_ws(" ", F.lit("rows of chains"), "_lo", F.lit("to"), "_hi"))).otherwise(F.col(column))
    return rows.join(F.broadcast(bounds)).select(*(checked.alias(c) if c == column else F.col(c) for c in rows.columns))


def routed(logs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Logs with the role and event that they decode as; ``contracts``: (address, role), few rows. Unknown events have no event_name."""
    spark = logs.sparkSession
    known = spark.createDataFrame([(t, role, s[: s.index("(")]) for t, (role, s) in TOPICS.items()], "topic0 string, role string, event_name string")
    able = contracts.select(F.lower("address").alias("address"), "role").join(F.broadcast(known), "role").groupBy("address", "topic0").agg(F.min(F.struct("role", "event_name")).alias("as"))
    return logs.join(able, ["address", "topic0"], "left").select(*logs.columns, "as.role", "as.event_name")


def decoded(routed_logs: DataFrame) -> DataFrame:
    """Adds the parameters as JSON (null for unsupported events)."""
    return routed_logs.withColumn("payload", F.when(F.col("event_name").isNotNull(), abi_json("topics", "data")))


def event_fields(signature: str, topics: Column, data: Column) -> tuple[dict[str, Column], Column]:
    """The parameters of an event by built-in functions, and whether the log holds them all.

    Offsets of arrays and of their elements are followed by higher-order functions; a list that would end after the data is never opened.
    """

    def value(kind: str, word: Column) -> Column:
        if kind == "address":
            return F.concat(F.lit("0x"), F.substring(word, 25, 40))
        if kind == "bytes32":
            return F.concat(F.lit("0x"), word)
        return F.conv(F.substring(word, 63, 2), 16, 10).cast("int") if kind == "uint8" else u256.from_hex(word)

    def small(start: Column) -> Column:
        """A length or an offset in bytes; one that is no such thing is beyond any data."""
        word = F.substring(data, start.cast("int"), F.lit(64))
        return F.when(F.substring(word, 1, 50) == "0" * 50, F.conv(F.substring(word, 51, 14), 16, 10).cast("long")).otherwise(F.lit(1 << 40))

    def fits(end: Column) -> Column:
        return F.coalesce(end <= F.length(data) + 1, F.lit(False))

    def text(kind: str, start: Column) -> tuple[Column, Column]:
        """The text or bytes at a place, and whether the data hold them."""
        size = small(start)
        raw = F.substring(data, (start + 64).cast("int"), (2 * size).cast("int"))
        return F.make_valid_utf8(F.unhex(raw).cast("string")) if kind == "string" else F.concat(F.lit("0x"), raw), fits(start + 64 + 2 * size)

    def several(kind: str, start: Column) -> tuple[Column, Column]:
        """The elements of the array at a place, and whether the data hold them all."""
        n = small(start)
        inside = fits(start + 64 + 64 * n)
        first = F.when(inside & (n > 0), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
        places = F.transform(first, lambda k: start + 64 + 64 * k)
        if kind not in ("string", "bytes"):
            return F.transform(places, lambda p: value(kind, F.substring(data, p.cast("int"), F.lit(64))).cast("string")), inside
        held = F.transform(places, lambda p: start + 64 + 2 * small(p))
        return F.transform(held, lambda p: text(kind, p)[0]), inside & F.forall(held, lambda p: fits(p + 64) & text(kind, p)[1])

    fields: dict[str, Column] = {}
    checks, head, topic = [], 0, 1
    nft = F.size(topics) == 4 if signature.startswith("Transfer(") else F.lit(False)
    for name, kind, indexed in parameters(signature):
        if indexed:
            fields[name] = value(kind, F.substring(F.get(topics, F.lit(topic)), 3, 64))
            topic += 1
            continue
        own = 3 + 64 * head
        head += 1
        if kind in ("string", "bytes") or kind.endswith("[]"):
            start = F.lit(3).cast("long") + 2 * small(F.lit(own))
            found, whole = several(kind[:-2], start) if kind.endswith("[]") else text(kind, start)
            fields[name] = found
            checks.append(fits(start + 64) & whole)
        elif signature.startswith("Transfer("):
            fields[name] = F.when(nft, value(kind, F.substring(F.get(topics, F.lit(3)), 3, 64))).otherwise(value(kind, F.substring(data, own, 64)))
        else:
            fields[name] = value(kind, F.substring(data, own, 64))
    if signature.startswith("Transfer("):
        fields["standard"] = F.when(nft, "erc721").otherwise("erc20")
    whole = (F.size(topics) >= topic) & (nft | (F.length(data) >= 2 + 64 * head))
    for check in checks:
        whole = whole & check
    return fields, whole


def typed_events(routed_logs: DataFrame, signatures: tuple[str, ...]) -> DataFrame:
    """The logs of some events that can be read, with one struct ``event`` of the parameters of all of them; those that a log's event doesn't have are null.

    One pass over the logs: a case for each event makes an array of one struct or none, which is exploded, so that nothing of it is computed
    again where the struct's fields are used or filtered.
    """
    kinds = {f.name: f.dataType for s in signatures for f in payload_type(s).fields}
    found = F.lit(None)
    for s in signatures:
        fields, whole = event_fields(s, F.col("topics"), F.col("data"))
        struct = F.struct(*(fields.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()))
        found = F.when(F.col("event_name") == s[: s.index("(")], F.when(whole, F.array(struct))).otherwise(found)
    return routed_logs.select("*", F.explode(found).alias("event"))


def with_event(routed_logs: DataFrame, signature: str) -> DataFrame:
    """The logs of one signature that can be read, with the struct ``event``."""
    return typed_events(routed_logs, (signature,))


def events_of(decoded_logs: DataFrame, signature: str) -> DataFrame:
    """The events of one signature, with typed columns."""
    name = signature[: signature.index("(")]
    rows = decoded_logs.where((F.col("event_name") == name) & F.col("payload").isNotNull())
    return rows.withColumn("event", F.from_json("payload", payload_type(signature)))
