"""Queries of contract logs, proposals and the timelock, and of rules that work on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import descriptions, scalars, u256
from rollcall.functions.keccak import keccak_hex
from rollcall.operators import decode, folds, overlay, proposals, status, timelock
from rollcall.operators.intervals import interval_join
from rollcall.plans import analogues as a
from rollcall.plans.registry import query
from rollcall.sources import logs, sinks
from rollcall.streaming import state


def hex_word(column):
    return F.lpad(F.lower(F.hex(column)), 64, "0")


def hex_text(column):
    return F.lower(F.hex(F.encode(column, "UTF-8")))


def static_word(kind, i):
    source = {"address": F.col("delegator"), "bytes32": F.col("pos"), "uint8": F.col("value") % 3}.get(kind, F.col("value") + i)
    return hex_word(source)


def tail_words(kind, i):
    """The words of a dynamic parameter and how many they are; texts of one word at most."""
    text = [hex_word(F.length("kind")), F.rpad(hex_text(F.col("kind")), 64, "0")]
    if kind in ("string", "bytes"):
        return text, 2
    number = lambda n: hex_word(F.lit(n))
    if kind in ("string[]", "bytes[]"):
        return [number(2), number(64), number(128), *text, number(0)], 6
    return [number(2), static_word(kind[:-2], i), hex_word(F.col("pos"))], 3


def call_log(signature):
    """(topics, data) of one event as its contract emits it, from the columns of the event table."""
    topics, head, tail, at = [F.lit(decode.topic0(signature))], [], [], 0
    inner = [(k, i, x) for i, (_, k, x) in enumerate(decode.parameters(signature))]
    size = sum(not x for _, _, x in inner)
    for kind, i, indexed in inner:
        if indexed:
            topics.append(F.concat(F.lit("0x"), static_word(kind, i)))
        elif kind in ("string", "bytes") or kind.endswith("[]"):
            words, n = tail_words(kind, i)
            head.append(hex_word(F.lit(32 * (size + at))))
            tail += words
            at += n
        else:
            head.append(static_word(kind, i))
    return F.array(*topics), F.concat(F.lit("0x"), *head, *tail)


def emitted_logs(spark, d, role):
    """A log of the role's contract for every row of the event table, its events in turn."""
    rows, signatures = a.logged(spark, d), decode.EVENTS[role]
    topics, data = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for k, s in enumerate(signatures):
        t, b = call_log(s)
        here = F.col("pos") % len(signatures) == k
        topics, data = F.when(here, t).otherwise(topics), F.when(here, b).otherwise(data)
    raw = rows.select("pos", topics.alias("topics"), data.alias("data"), F.lit(f"0x{role}").alias("address"), F.get(topics, F.lit(0)).alias("topic0"))
    return decode.routed(raw, spark.createDataFrame([(f"0x{role}", role)], "address string, role string"))


def events_text(spark, d, role):
    """All events of a role's logs with their parameters as one text, in one scan of the log."""
    rows = decode.typed_events(emitted_logs(spark, d, role), decode.EVENTS[role])
    text = F.lit(None).cast("string")
    for s in decode.EVENTS[role]:
        shown = [F.array_join(F.col(f"event.{n}"), ",") if k.endswith("[]") else F.col(f"event.{n}").cast("string") for n, k, _ in decode.parameters(s)]
        text = F.when(F.col("event_name") == s[: s.index("(")], F.concat_ws("|", *shown)).otherwise(text)
    return rows.select("pos", "event_name", text.alias("fields"))


def events_sql(role):
    signatures = decode.EVENTS[role]

    def value(kind, i):
        word = lambda x, n: f"'0x' || lpad(lower(to_hex({x})), {n}, '0')"
        simple = {"address": word("delegator", 40), "bytes32": word("pos", 64), "uint8": "CAST(value % 3 AS VARCHAR)", "string": "kind", "bytes": "'0x' || lower(hex(kind))"}
        if kind.endswith("[]"):
            first = value(kind[:-2], i)
            second = {"address": word("pos", 40), "string": "''", "bytes": "'0x'"}.get(kind[:-2], "CAST(pos AS VARCHAR)")
            return f"{first} || ',' || {second}"
        return simple.get(kind, f"CAST(value + {i} AS VARCHAR)")

    name = " ".join(f"WHEN {k} THEN '{s[: s.index('(')]}'" for k, s in enumerate(signatures))
    fields = " ".join(f"WHEN {k} THEN concat_ws('|', {', '.join(value(t, i) for i, (_, t, _) in enumerate(decode.parameters(s)))})" for k, s in enumerate(signatures))
    return f"SELECT pos, CASE pos % {len(signatures)} {name} END AS event_name, CASE pos % {len(signatures)} {fields} END AS fields FROM logged"


@query(events_sql("governor"))
def dec_governor(spark, d):
    return events_text(spark, d, "governor")


@query(events_sql("timelock"))
def dec_timelock(spark, d):
    return events_text(spark, d, "timelock")


@query(f"SELECT pos, event_name, fields || CASE WHEN event_name = 'Transfer' THEN '|erc20' ELSE '' END AS fields FROM ({events_sql('token')})")
def dec_token(spark, d):
    found = events_text(spark, d, "token")
    return found.withColumn("fields", F.when(F.col("event_name") == "Transfer", F.concat("fields", F.lit("|erc20"))).otherwise(F.col("fields")))


def mixed_logs(spark, d):
    """Logs of three addresses (one is governor and timelock, one the token, one unknown) with four topics, some of them removed."""
    topic = {"ProposalCanceled": "governor", "Transfer": "token", "Cancelled": "timelock"}
    found = {s[: s.index("(")]: decode.topic0(s) for s in (x for xs in decode.EVENTS.values() for x in xs) if s[: s.index("(")] in topic}
    t0 = F.when(F.col("pos") % 4 == 0, found["ProposalCanceled"]).when(F.col("pos") % 4 == 1, found["Transfer"]).when(F.col("pos") % 4 == 2, found["Cancelled"]).otherwise("0x00")
    return a.logged(spark, d).select(
        "pos", F.col("pos").alias("block_number"), (F.col("at_ms") / 1000).cast("long").alias("block_timestamp"), F.lit("0xAB").alias("transaction_hash"), F.col("delegator").alias("transaction_index"), F.lit(0).cast("long").alias("log_index"),
        F.concat(F.lit("0xA"), (F.col("delegator") % 3).cast("string")).alias("address"), F.array(F.upper(t0)).alias("topics"), F.lit("0x").alias("data"), (F.col("kind") == "error").alias("removed"),
    )


def routed_logs(spark, d):
    contracts = spark.createDataFrame([("0xA0", "governor"), ("0xa0", "timelock"), ("0xA1", "token")], "address string, role string")
    return decode.routed(decode.normalized(mixed_logs(spark, d).withColumn("topics", F.transform("topics", lambda t: F.concat(F.lit("0x"), F.substring(t, 3, 64)))), 1), contracts)


ROUTED = """SELECT pos, CASE WHEN delegator % 3 = 0 AND pos % 4 = 0 THEN 'governor' WHEN delegator % 3 = 0 AND pos % 4 = 2 THEN 'timelock' WHEN delegator % 3 = 1 AND pos % 4 = 1 THEN 'token' END AS role,
  CASE WHEN delegator % 3 = 0 AND pos % 4 = 0 THEN 'ProposalCanceled' WHEN delegator % 3 = 0 AND pos % 4 = 2 THEN 'Cancelled' WHEN delegator % 3 = 1 AND pos % 4 = 1 THEN 'Transfer' END AS event_name FROM logged WHERE kind <> 'error'"""


@query("SELECT pos FROM logged WHERE kind <> 'error'")
def dec_removed(spark, d):
    return decode.normalized(mixed_logs(spark, d), 1).select("pos")


@query(ROUTED)
def dec_route(spark, d):
    return routed_logs(spark, d).select("pos", "role", "event_name")


@query(f"SELECT pos FROM ({ROUTED}) WHERE event_name IS NULL")
def dec_unsupported(spark, d):
    return routed_logs(spark, d).where("event_name IS NULL").select("pos")


@query("SELECT kind AS finality, pos AS block_number, pos // 2000 * 2000 AS from_block FROM logged WHERE kind = 'view' AND pos // 2000 % 2 = 0")
def src_provisional_scan(spark, d):
    rows = a.logged(spark, d).select(F.col("kind").alias("finality"), F.col("pos").alias("block_number"))
    starts = rows.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.max("block_number"), F.lit(0)), F.lit(4000).cast("long"))).alias("from_block"))
    ranges = starts.select("from_block", (F.col("from_block") + 1999).alias("to_block"))
    return logs.provisional_scan(rows, ranges, "view").select("finality", "block_number", "from_block")


@query("SELECT chain_id, proposer AS arg, CAST(max(CASE WHEN state <> 'P' THEN proposal_id END) AS VARCHAR) AS value, count(*) FILTER (WHERE state <> 'P') AS answers FROM proposal GROUP BY chain_id, proposer")
def src_chain_reads(spark, d):
    asked = a.proposals(spark, d).select("chain_id", F.col("proposer").alias("arg"))
    reads = a.proposals(spark, d).where("state <> 'P'").select("chain_id", F.col("proposer").alias("arg"), F.col("proposal_id").alias("read_index"), F.col("proposal_id").cast("string").alias("value"))
    return proposals.planned_reads(asked, reads, ["chain_id", "arg"])


@query("SELECT pos AS block_number, '0x' || lower(to_hex(pos)) AS transaction_hash, kind = 'error' AS removed FROM logged")
def src_page_unwrap(spark, d):
    """Pages of one log each, half of them arrays and half objects."""
    log = F.struct(F.col("pos").alias("block_number"), F.concat(F.lit("0x"), F.lower(F.hex("pos"))).alias("transaction_hash"), (F.col("kind") == "error").alias("removed"))
    array = F.to_json(F.array(log))
    pages = a.logged(spark, d).select(F.when(F.col("pos") % 2 == 0, array).otherwise(F.concat(F.lit(' {"rows":'), array, F.lit("}"))).alias("payload"))
    return logs.unwrapped_pages(pages).select("block_number", "transaction_hash", "removed")


@query("""SELECT 'votes{state="' || state || '",mode="' || mode || '"} ' || CAST(count(*) AS VARCHAR) AS line FROM proposal GROUP BY state, mode""")
def snk_metrics_text(spark, d):
    return sinks.metrics_text(a.proposals(spark, d).groupBy("state", "mode").agg(F.count("*").alias("n")), "votes", "n", ["state", "mode"])


ROLE_OF = "[" + ", ".join(f"'{r}'" for r in scalars.ROLES) + ", '0x01'][pos % 5 + 1]"
LABEL_OF = "[" + ", ".join(f"'{r}'" for r in scalars.ROLES.values()) + ", NULL][pos % 5 + 1]"


def role_column():
    return F.get(F.array(*(F.lit(r) for r in scalars.ROLES), F.lit("0x01")), (F.col("pos") % 5).cast("int"))


@query(f"SELECT pos, {LABEL_OF} AS label FROM logged")
def fn_role_label(spark, d):
    return a.logged(spark, d).select("pos", scalars.role_label(F.upper(role_column()).substr(3, 64)).alias("none"), scalars.role_label(role_column()).alias("label")).drop("none")


@query("SELECT pos, value * 1000 AS ms FROM logged")
def fn_sec_to_ms(spark, d):
    return a.logged(spark, d).select("pos", scalars.seconds_to_millis(F.col("value")).alias("ms"))


@query("SELECT proposal_id, CASE WHEN quorum * 7 < 1000 THEN '0' ELSE CAST(quorum * 7 // 1000 AS VARCHAR) END AS compact, '-' || CASE WHEN quorum * 7 < 1000 THEN '0' ELSE CAST(quorum * 7 // 1000 AS VARCHAR) END AS negative FROM proposal WHERE quorum > 0")
def fn_compact_amount(spark, d):
    text = (F.col("quorum") * 7).cast("string")
    return a.proposals(spark, d).where("quorum > 0").select("proposal_id", u256.compact_amount(text, 3).alias("compact"), u256.compact_amount(F.concat(F.lit("-"), text), 3).alias("negative"))


@query("""SELECT pos FROM logged WHERE pos IN (SELECT pos FROM logged ORDER BY pos LIMIT 10) UNION ALL SELECT pos FROM (
  SELECT pos, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('seed:' || CAST(pos AS VARCHAR) || kind, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS score
  FROM logged WHERE pos NOT IN (SELECT pos FROM logged ORDER BY pos LIMIT 10) ORDER BY score, pos LIMIT 25)""")
def fn_fnv_sample(spark, d):
    """A sampling operator: ten rows in order and 25 by their seeded hash."""
    return scalars.sampled(a.logged(spark, d).select("pos", "kind"), "pos", F.concat(F.col("pos").cast("string"), "kind"), 10, 25, "seed").select("pos")


@query()
def fn_keccak(spark, d):
    """Of the whole texts of all documents."""
    return a.table(spark, d, "documents").select("doc_id", keccak_hex("text").alias("hash"))


WHITE_SQL = "'" + descriptions.WHITE + "'"
TAGGED_SQL = """(SELECT doc_id, '# T' || chr(10) || '<discussion>' || coalesce(text, '') || '</discussion>' || chr(10) || '<signature>["' || doc_id || '"]</signature> <discussion>' || doc_id % 7 || '</discussion>' AS t FROM documents)"""


def taken_out_sql(source, name, left, content):
    opening, closing = f"<{name}>", f"</{name}>"
    after = f"substr({left}, strpos({left}, '{opening}') + {len(opening)})"
    hit = f"strpos({left}, '{opening}') > 0 AND strpos({after}, '{closing}') > 0"
    cut = f"substr({left}, 1, strpos({left}, '{opening}') - 1) || substr({after}, strpos({after}, '{closing}') + {len(closing)})"
    return f"(SELECT * REPLACE (CASE WHEN {hit} THEN trim({cut}, {WHITE_SQL}) ELSE {left} END AS {left}), CASE WHEN {hit} THEN trim(substr({after}, 1, strpos({after}, '{closing}') - 1), {WHITE_SQL}) END AS {content} FROM {source})"


@query(
    f"SELECT doc_id, trim(t, {WHITE_SQL}) AS body, discussion, CASE WHEN s = '[\"' || doc_id || '\"]' THEN CAST(doc_id AS VARCHAR) END AS signature FROM " + taken_out_sql(taken_out_sql(TAGGED_SQL, "discussion", "t", "discussion"), "signature", "t", "s"), views=False
)
def fn_body_tags(spark, d):
    """The texts of all documents within tags, and what is left when the tags are taken out; of a second tag of a name nothing is taken."""
    ident = F.col("doc_id").cast("string")
    tagged = F.concat(F.lit("# T\n<discussion>"), F.coalesce("text", F.lit("")), F.lit('</discussion>\n<signature>["'), ident, F.lit('"]</signature> <discussion>'), (F.col("doc_id") % 7).cast("string"), F.lit("</discussion>"))
    rows = descriptions.with_tags(a.table(spark, d, "documents").select("doc_id", tagged.alias("tagged")), "tagged")
    return rows.select("doc_id", "body", "discussion", F.get("signature", F.lit(0)).alias("signature"))


@query("""SELECT account, CASE WHEN abs(power) >= 1000 THEN CASE WHEN power < 0 THEN '-' ELSE '' END || regexp_replace(regexp_replace(CAST((abs(power) + 5) // 10 // 100 AS VARCHAR) || '.' || lpad(CAST((abs(power) + 5) // 10 % 100 AS VARCHAR), 2, '0'), '0+$', ''), '\\.$', '') || 'K' ELSE CAST(power AS VARCHAR) END AS shown FROM contributor""")
def fn_display_number(spark, d):
    return a.contributors(spark, d).select("account", scalars.display_number(F.col("power").cast("double")).alias("shown"))


CREATED = """SELECT proposal_id, '0x' || lpad(lower(to_hex(proposer)), 40, '0') AS proposer, CASE WHEN big THEN 'timestamp' ELSE 'blocknumber' END AS clock_mode, CASE WHEN NOT big AND chain_id = 1 THEN '12' END AS block_interval,
    vs AS vote_start, ve AS vote_end, CASE WHEN big THEN vs * 1000 WHEN chain_id = 1 AND created + (vs - proposal_id) * 12000 >= 0 THEN created + (vs - proposal_id) * 12000 ELSE vs END AS vote_start_timestamp,
    CASE WHEN big THEN ve * 1000 WHEN chain_id = 1 AND created + (ve - proposal_id) * 12000 >= 0 THEN created + (ve - proposal_id) * 12000 ELSE ve END AS vote_end_timestamp, 'Pending' AS current_state, '0' AS quorum
  FROM (SELECT *, proposal_id + CASE WHEN state = 'P' THEN 1000000000 ELSE 10 END AS vs, proposal_id + CASE WHEN state = 'P' THEN 1000000500 ELSE 500 END AS ve, state = 'P' AS big FROM proposal)"""


def created_events(spark, d):
    late = F.when(F.col("state") == "P", 1_000_000_000).otherwise(0)
    return a.proposals(spark, d).select(
        "proposal_id", "chain_id", F.concat(F.lit("0x"), F.lpad(F.hex("proposer"), 40, "0")).alias("proposer"), (F.col("proposal_id") + late + F.when(F.col("state") == "P", 0).otherwise(10)).alias("vote_start"),
        (F.col("proposal_id") + late + 500).alias("vote_end"), F.col("proposal_id").alias("block_number"), F.col("created").alias("block_timestamp_ms"), "mode",
    )


CREATED_COLUMNS = ("proposal_id", "proposer", "clock_mode", "block_interval", "vote_start", "vote_end", "vote_start_timestamp", "vote_end_timestamp", "current_state", "quorum")


@query(CREATED)
def prj_proposal_created(spark, d):
    return proposals.created(created_events(spark, d)).select(*CREATED_COLUMNS)


@query("SELECT coalesce(p.proposal_id, v.proposal_id) AS proposal_id, p.state, p.proposal_id IS NULL AS stub FROM (SELECT * FROM proposal WHERE chain_id <> 0) p FULL JOIN (SELECT DISTINCT proposal_id FROM vote) v USING (proposal_id)")
def prj_lifecycle_stub(spark, d):
    return proposals.with_stubs(a.proposals(spark, d).where("chain_id <> 0").select("proposal_id", "state"), a.votes(spark, d), "proposal_id").select("proposal_id", "state", "stub")


UPSERT = """, stored AS (
  SELECT proposal_id AS id, '0x' || CAST(proposer AS VARCHAR) AS proposer, state AS title, CASE WHEN chain_id = 1 THEN [mode] ELSE [] END AS targets, proposal_id AS vote_start, quorum AS vote_end, created AS vote_start_timestamp, 'a' AS description_hash, 'a' AS description,
    CASE WHEN chain_id = 0 THEN 'timestamp' ELSE 'blocknumber' END AS clock_mode, CASE WHEN chain_id = 1 THEN '12' END AS block_interval, CASE WHEN chain_id = 2 THEN 'm' END AS counting_mode, CAST(quorum AS VARCHAR) AS quorum FROM proposal WHERE proposal_id % 4 <> 0
), incoming AS (
  SELECT proposal_id AS id, CASE WHEN state = 'O' THEN '' ELSE '0xn' END AS proposer, CASE WHEN state = 'P' THEN '' ELSE 'n' END AS title, CASE WHEN state = 'F' THEN ['n'] ELSE [] END AS targets, quorum AS vote_start, proposal_id AS vote_end, CASE WHEN chain_id = 1 THEN 0 ELSE 7 END AS vote_start_timestamp,
    CASE WHEN chain_id = 1 THEN 'n' END AS description_hash, CASE WHEN state = 'O' THEN '' ELSE 'n' END AS description, CASE WHEN created % 7 = 0 THEN 'timestamp' ELSE 'blocknumber' END AS clock_mode, CASE WHEN chain_id = 2 THEN '2' END AS block_interval,
    CASE WHEN state = 'F' THEN 'n' END AS counting_mode, CASE WHEN chain_id = 0 THEN '0' ELSE '9' END AS quorum FROM proposal WHERE proposal_id % 3 <> 1
)"""


@query("SELECT * FROM (WITH" + UPSERT.replace(",", " ", 1) + """
SELECT o.* FROM stored o WHERE id NOT IN (SELECT id FROM incoming) UNION ALL SELECT n.* FROM incoming n WHERE id NOT IN (SELECT id FROM stored) UNION ALL
SELECT o.id, CASE WHEN n.proposer = '' THEN o.proposer ELSE n.proposer END, CASE WHEN n.title = '' THEN o.title ELSE n.title END, CASE WHEN len(n.targets) = 0 THEN o.targets ELSE n.targets END, greatest(o.vote_start, n.vote_start), greatest(o.vote_end, n.vote_end),
  CASE WHEN n.vote_start_timestamp = 0 THEN o.vote_start_timestamp ELSE n.vote_start_timestamp END, CASE WHEN n.proposer = '' AND n.description = '' THEN o.description_hash ELSE coalesce(n.description_hash, o.description_hash) END, CASE WHEN n.description = '' THEN o.description ELSE n.description END,
  CASE WHEN n.proposer = '' AND n.clock_mode = 'blocknumber' AND o.clock_mode <> 'blocknumber' THEN o.clock_mode ELSE n.clock_mode END,
  CASE WHEN n.proposer = '' AND n.clock_mode = 'blocknumber' AND o.clock_mode <> 'blocknumber' THEN NULL WHEN n.clock_mode <> 'blocknumber' THEN n.block_interval ELSE coalesce(n.block_interval, o.block_interval) END,
  coalesce(n.counting_mode, o.counting_mode), CASE WHEN n.quorum = '0' THEN o.quorum ELSE n.quorum END FROM stored o JOIN incoming n ON n.id = o.id)""")
def fld_proposal_upsert(spark, d):
    p, text = a.proposals(spark, d), F.lit
    none, of = F.array().cast("array<string>"), lambda c, v: F.when(c, v)
    chain, state = F.col("chain_id"), F.col("state")
    stored = p.where("proposal_id % 4 <> 0").select(
        F.col("proposal_id").alias("id"), F.concat(text("0x"), F.col("proposer").cast("string")).alias("proposer"), state.alias("title"), F.when(chain == 1, F.array("mode")).otherwise(none).alias("targets"), F.col("proposal_id").alias("vote_start"),
        F.col("quorum").alias("vote_end"), F.col("created").alias("vote_start_timestamp"), text("a").alias("description_hash"), text("a").alias("description"), F.when(chain == 0, "timestamp").otherwise("blocknumber").alias("clock_mode"),
        of(chain == 1, "12").alias("block_interval"), of(chain == 2, "m").alias("counting_mode"), F.col("quorum").cast("string").alias("quorum"),
    )
    incoming = p.where("proposal_id % 3 <> 1").select(
        F.col("proposal_id").alias("id"), F.when(state == "O", "").otherwise("0xn").alias("proposer"), F.when(state == "P", "").otherwise("n").alias("title"), F.when(state == "F", F.array(text("n"))).otherwise(none).alias("targets"),
        F.col("quorum").alias("vote_start"), F.col("proposal_id").alias("vote_end"), F.when(chain == 1, 0).otherwise(7).cast("long").alias("vote_start_timestamp"), of(chain == 1, "n").alias("description_hash"),
        F.when(state == "O", "").otherwise("n").alias("description"), F.when(F.col("created") % 7 == 0, "timestamp").otherwise("blocknumber").alias("clock_mode"), of(chain == 2, "2").alias("block_interval"),
        of(state == "F", "n").alias("counting_mode"), F.when(chain == 0, "0").otherwise("9").alias("quorum"),
    )
    return proposals.upserted(stored, incoming)


@query("SELECT v.proposal_id || ':' || CAST(v.log_index AS VARCHAR) AS child, CASE WHEN p.chain_id = 1 THEN 'new:' ELSE 'old:' END || v.proposal_id AS proposal_ref, CASE WHEN p.chain_id = 1 THEN 'new:' ELSE 'raw:' END || v.proposal_id AS proposal_id FROM vote v JOIN proposal p USING (proposal_id)")
def fld_proposal_relink(spark, d):
    p = a.proposals(spark, d).withColumn("governor", F.when(F.col("state") != "P", "g"))
    stored = p.select(F.concat(F.lit("old:"), F.col("proposal_id").cast("string")).alias("id"), "proposal_id", "chain_id", "governor")
    incoming = p.where("chain_id = 1").select(F.concat(F.lit("new:"), F.col("proposal_id").cast("string")).alias("id"), "proposal_id", "chain_id", "governor")
    known = a.votes(spark, d).join(p.select("proposal_id"), "proposal_id").withColumn("n", F.col("proposal_id").cast("string"))
    children = known.select(F.concat_ws(":", "n", F.col("log_index").cast("string")).alias("child"), F.concat(F.lit("old:"), "n").alias("proposal_ref"), F.concat(F.lit("raw:"), "n").alias("proposal_id"))
    return proposals.relinked_children(children, proposals.relinked(stored, incoming, ["proposal_id", "chain_id", "governor"]))


@query(f"""SELECT proposal_id, CASE chain_id WHEN 0 THEN 'timestamp' ELSE clock_mode END AS clock_mode, CASE chain_id WHEN 0 THEN NULL ELSE block_interval END AS block_interval, CASE WHEN chain_id = 1 THEN 'support=bravo' END AS counting_mode, CASE WHEN chain_id = 2 THEN '18' ELSE '0' END AS decimals,
  CASE WHEN state = 'F' THEN 'Executed' ELSE 'Pending' END AS current_state, CASE WHEN state = 'O' THEN '77' WHEN state = 'F' THEN CAST(proposal_id + 1 AS VARCHAR) ELSE '0' END AS quorum,
  CASE WHEN vote_start % 5 = 0 THEN 5000 + vote_start WHEN chain_id = 0 THEN vote_start * 1000 ELSE vote_start_timestamp END AS vote_start_timestamp FROM ({CREATED}) c JOIN (SELECT proposal_id, chain_id, state FROM proposal) p USING (proposal_id)""")
def fld_chain_enrich(spark, d):
    p = a.proposals(spark, d)
    rows = proposals.created(created_events(spark, d)).withColumns({"governor": F.concat(F.lit("0xG"), F.col("chain_id").cast("string")), "counting_mode": F.lit(None).cast("string"), "proposal_snapshot": F.concat(F.lit("s"), F.col("proposal_id").cast("string")), "token": F.concat(F.lit("0xT"), F.col("chain_id").cast("string"))})
    rows = rows.withColumn("proposal_id", F.col("proposal_id").cast("string"))
    read = lambda rows, method, arg, value, at=0: rows.select("chain_id", F.concat(F.lit("0xg"), F.col("chain_id").cast("string")).alias("contract"), F.lit(method).alias("method"), arg.cast("string").alias("arg"), F.lit(at).alias("read_index"), value.cast("string").alias("value"))
    of_chain = p.select("chain_id").distinct()
    e = created_events(spark, d).select("chain_id", "vote_start").where("vote_start % 5 = 0")
    reads = [
        read(of_chain.where("chain_id = 0"), "clockMode", F.lit(""), F.lit("blocknumber"), 1), read(of_chain.where("chain_id = 0"), "clockMode", F.lit(""), F.lit("timestamp"), 2), read(of_chain.where("chain_id = 1"), "countingMode", F.lit(""), F.lit("support=bravo")),
        read(p.where("state = 'F'"), "state", F.col("proposal_id"), F.lit(7)), read(p.where("state = 'F'"), "quorum", F.col("proposal_id"), F.col("proposal_id") + 1),
        read(p.where("state <> 'P'"), "quorum", F.concat(F.lit("s"), F.col("proposal_id").cast("string")), F.lit(77)), read(e, "blockTimestamp", F.col("vote_start"), F.col("vote_start") + 5000),
    ]
    every = read(of_chain.where("chain_id = 2"), "decimals", F.lit(""), F.lit(18)).withColumn("contract", F.lit("0xt2"))
    for r in reads:
        every = every.unionByName(r)
    found = proposals.enriched(rows, every)
    return found.select(F.col("proposal_id").cast("long").alias("proposal_id"), "clock_mode", "block_interval", "counting_mode", "decimals", "current_state", "quorum", "vote_start_timestamp")


@query("SELECT pos, CASE pos % 6 WHEN 0 THEN 'voting_delay' WHEN 1 THEN 'voting_period' WHEN 2 THEN 'proposal_threshold' WHEN 3 THEN 'quorum_numerator' WHEN 4 THEN 'late_quorum_extension' ELSE 'timelock' END AS parameter, CAST(lag(value) OVER (PARTITION BY pos % 6 ORDER BY pos) AS VARCHAR) AS old_value, CAST(value AS VARCHAR) AS new_value FROM logged WHERE kind IN ('click', 'view')")
def prj_param_change(spark, d):
    """The old values are those before; a parameter's history may be long, so that they are found by ranges."""
    names = F.array(*(F.lit(n) for n in folds.PARAMETERS))
    rows = a.logged(spark, d).where("kind IN ('click', 'view')").select(F.col("pos").alias("id"), F.get(names, (F.col("pos") % 6).cast("int")).alias("event_name"), F.col("value").cast("string").alias("new_value"))
    typed = folds.parameter_changes(folds.spread_previous(rows, ["event_name"], "id", "new_value", "old_value"))
    return typed.select(F.col("id").alias("pos"), "parameter", "old_value", "new_value")


@query("SELECT voter, max(cast_ms) AS last_vote, arg_max(proposal_id, (cast_ms, proposal_id, log_index)) AS last_tx, count(*) AS n FROM vote GROUP BY voter")
def fld_vote_signal(spark, d):
    return folds.vote_signals(a.votes(spark, d).withColumn("at", F.struct("cast_ms", "proposal_id", "log_index")), "voter", "cast_ms", "proposal_id", "at")


def transfers(spark, d):
    who = lambda c: F.concat(F.lit("d"), c.cast("string"))
    rows = a.logged(spark, d).where("kind IN ('view', 'click')")
    return rows.select("pos", who(F.col("delegator")).alias("from"), who(F.col("pos") % 50).alias("to"), "value", F.when(F.col("kind") == "view", "erc20").otherwise("erc721").alias("standard"))


MOVES = """SELECT 'd' || CAST(delegator AS VARCHAR) AS account, pos * 2 AS at, -CASE kind WHEN 'view' THEN value ELSE 1 END AS delta FROM logged WHERE kind IN ('view', 'click')
  UNION ALL SELECT 'd' || CAST(pos % 50 AS VARCHAR), pos * 2 + 1, CASE kind WHEN 'view' THEN value ELSE 1 END FROM logged WHERE kind IN ('view', 'click')"""


@query(f"""SELECT m.account, sum(m.delta)::BIGINT AS power FROM ({MOVES}) m JOIN (SELECT 'd' || CAST(delegator AS VARCHAR) AS account, min(pos) * 2 AS since FROM logged WHERE kind = 'signup' GROUP BY delegator) c ON c.account = m.account AND m.at > c.since GROUP BY m.account""")
def fld_transfer_delta(spark, d):
    """The power of each edge, where every delegator delegates at its first sign-up; transfers before that move nothing."""
    moves = folds.transfer_deltas(transfers(spark, d), zero="none")
    first = a.logged(spark, d).where("kind = 'signup'").groupBy("delegator").agg(F.min("pos").alias("pos"))
    changes = first.select(F.concat(F.lit("d"), F.col("delegator").cast("string")).alias("delegator"), F.struct("pos", F.lit(0).alias("side")).alias("pos"), F.lit("change").alias("kind"), F.lit("zero").alias("from_delegate"), F.lit("x").alias("to_delegate"), F.lit(0).cast("long").alias("delta"))
    edges = folds.mappings(folds.delegation_fold(changes.unionByName(moves), zero="zero"))
    moved = moves.join(first.select(F.concat(F.lit("d"), F.col("delegator").cast("string")).alias("delegator"), F.struct("pos", F.lit(0).alias("side")).alias("since")), "delegator").where("pos > since").select("delegator").distinct()
    return edges.join(moved, "delegator", "left_semi").select(F.col("delegator").alias("account"), F.col("power").cast("long").alias("power"))


@query(f"""SELECT * FROM (WITH e AS ({events_sql("token")}) SELECT pos, CASE event_name WHEN 'DelegateChanged' THEN 'delegate_changed' WHEN 'DelegateVotesChanged' THEN 'delegate_votes_changed' ELSE 'token_transfer' END AS entity,
  fields || CASE WHEN event_name = 'Transfer' THEN '|erc20' ELSE '' END AS fields FROM e UNION ALL SELECT pos, 'delegate_rolling', fields || '|-|-|-|-' FROM e WHERE event_name = 'DelegateChanged')""")
def prj_token_rows(spark, d):
    """The raw rows of the token's three events with all their columns, and a rolling row for each delegation."""
    tables = folds.token_rows(decode.typed_events(emitted_logs(spark, d, "token"), decode.EVENTS["token"]), "pos")
    found = [rows.select("pos", F.lit(name).alias("entity"), F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`"), F.lit("-")) for c in rows.columns if c != "pos")).alias("fields")) for name, rows in tables.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("SELECT scope, CASE WHEN bool_or(power > 9900) THEN count(*) END AS profiles FROM contributor GROUP BY scope")
def fld_profile_sync(spark, d):
    rolled_out = status.profile_count(F.col("power") > 9900)
    return a.contributors(spark, d).groupBy("scope").agg(rolled_out.alias("profiles"))


@query("SELECT pos, CAST(at_ms // 1000 + value AS VARCHAR) AS ready_at FROM logged")
def prj_timelock_ready(spark, d):
    return a.logged(spark, d).select("pos", timelock.ready_at(F.floor(F.col("at_ms") / 1000).cast("string"), F.col("value").cast("string")).alias("ready_at"))


def timelock_events(spark, d):
    names = F.array(*(F.lit(s[: s.index("(")]) for s in decode.EVENTS["timelock"]))
    rows = a.logged(spark, d).withColumn("event_name", F.get(names, (F.col("pos") % 8).cast("int")))
    text = F.col("pos").cast("string")
    return rows.select(text.alias("id"), "event_name", role_column().alias("role"), F.upper(F.concat(F.lit("0xa"), text)).alias("account"), F.lit("0xS").alias("sender"), role_column().alias("previous_admin_role"), F.lit("0x01").alias("new_admin_role"),
        F.concat(F.lit(" 0xOP"), text).alias("operation_id"), F.lit("1").alias("old_value"), F.col("value").cast("string").alias("new_value"))


@query(f"""SELECT CAST(pos AS VARCHAR) AS id, CASE pos % 8 WHEN 5 THEN 'RoleGranted' WHEN 6 THEN 'RoleRevoked' ELSE 'RoleAdminChanged' END AS event_name, {ROLE_OF} AS role, {LABEL_OF} AS role_label, CASE WHEN pos % 8 < 7 THEN '0xa' || CAST(pos AS VARCHAR) END AS account, CASE WHEN pos % 8 < 7 THEN '0xs' END AS sender,
  CASE WHEN pos % 8 = 7 THEN {ROLE_OF} END AS previous_admin_role, CASE WHEN pos % 8 = 7 THEN {LABEL_OF} END AS previous_admin_role_label, CASE WHEN pos % 8 = 7 THEN '0x01' END AS new_admin_role, CAST(NULL AS VARCHAR) AS new_admin_role_label, CAST(NULL AS VARCHAR) AS old_duration, CAST(NULL AS VARCHAR) AS new_duration FROM logged WHERE pos % 8 >= 5
  UNION ALL SELECT CAST(pos AS VARCHAR), 'MinDelayChange', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '1', CAST(value AS VARCHAR) FROM logged WHERE pos % 8 = 4""")
def prj_timelock_rows(spark, d):
    events = timelock_events(spark, d)
    return timelock.role_rows(events).unionByName(timelock.min_delay_rows(events).withColumn("event_name", F.lit("MinDelayChange")), allowMissingColumns=True)


@query("SELECT CAST(pos AS VARCHAR) || ':operation-hint' AS id, '0xop' || CAST(pos AS VARCHAR) AS operation_id, CASE pos % 8 WHEN 0 THEN 'CallScheduled' WHEN 1 THEN 'CallExecuted' WHEN 2 THEN 'CallSalt' ELSE 'Cancelled' END AS event_name FROM logged WHERE pos % 8 < 4")
def prj_op_hint(spark, d):
    return timelock.operation_hints(timelock_events(spark, d))


@query("""SELECT '0x' || lpad(lower(to_hex(proposal_id)), 64, '0') AS operation_id, CASE WHEN any_value(done) THEN 'Done' ELSE 'Queued' END AS state, count(*) AS call_count, CASE WHEN any_value(done) THEN count(*) END AS executed_call_count,
  any_value(CASE WHEN quorum >= queued THEN CAST(quorum - queued AS VARCHAR) END) AS delay_seconds, CAST(any_value(quorum) AS VARCHAR) AS ready_at, 'GovernorTimelockControl' AS timelock_type,
  CAST(proposal_id + 1 AS VARCHAR) AS queued_block_number, CAST(any_value(queued) AS VARCHAR) AS queued_block_timestamp, CASE WHEN any_value(done) THEN CAST(proposal_id + 9 AS VARCHAR) END AS executed_block_number,
  CASE WHEN any_value(done) THEN CAST(any_value(queued) + 5 AS VARCHAR) END AS executed_block_timestamp, CASE WHEN any_value(done) THEN '0xx' END AS executed_transaction_hash FROM (SELECT v.proposal_id, p.quorum, p.created // 10000000 AS queued, p.state = 'F' AS done FROM vote v JOIN proposal p USING (proposal_id)) GROUP BY proposal_id""")
def prj_governor_control(spark, d):
    p = a.proposals(spark, d).select("proposal_id", F.floor(F.col("created") / 10_000_000).cast("string").alias("queue_timestamp"), F.col("quorum").cast("string").alias("queue_eta"), F.when(F.col("state") == "F", "0xx").alias("execution_tx"),
        (F.col("proposal_id") + 1).cast("string").alias("queue_block"), F.when(F.col("state") == "F", (F.col("proposal_id") + 9).cast("string")).alias("execution_block"), F.when(F.col("state") == "F", (F.floor(F.col("created") / 10_000_000) + 5).cast("string")).alias("execution_timestamp"))
    acts = a.votes(spark, d).select("proposal_id", F.col("log_index").alias("action_index"), F.col("voter").cast("string").alias("target"), F.col("weight").cast("string").alias("value"))
    links = acts.join(p, "proposal_id").withColumns({"contract_set_id": F.lit("s"), "calldata": F.lit("0x"), "queue_tx": F.lit("0xq"), "proposal_id": F.col("proposal_id").cast("string")})
    return timelock.control_operations(links).select("operation_id", "state", "call_count", "executed_call_count", "delay_seconds", "ready_at", "timelock_type", "queued_block_number", "queued_block_timestamp", "executed_block_number", "executed_block_timestamp", "executed_transaction_hash")


@query("SELECT kind, pos, count(*) OVER (PARTITION BY kind ORDER BY pos) AS n FROM logged")
def agg_metric_event_rows(spark, d):
    """Kinds are few and large: totals of position ranges first, then windows within a range."""
    return folds.spread_timeline(a.logged(spark, d).select("kind", "pos"), ["kind"], "pos", {"n": F.lit(True)})


@query("SELECT account, power, row_number() OVER (ORDER BY power DESC, account) AS rank FROM contributor")
def win_rank_members(spark, d):
    """All members; ranks by sorted ranges and their sizes."""
    return status.ranked_overall(a.contributors(spark, d).select("account", "power"), [F.desc_nulls_last("power"), F.asc("account")])


@query("SELECT proposal_id, voter, weight, cast_ms, log_index, row_number() OVER (ORDER BY weight DESC, cast_ms DESC, proposal_id, log_index, voter) AS place FROM vote")
def ord_votes_client(spark, d):
    votes = a.votes(spark, d).select("proposal_id", "voter", "weight", "cast_ms", "log_index")
    return status.ranked_overall(votes, [F.desc_nulls_last("weight"), F.desc_nulls_last("cast_ms"), F.asc("proposal_id"), F.asc("log_index"), F.asc("voter")], "place")


@query("SELECT c.account, c.power, p.proposal_id FROM contributor c JOIN proposal p ON p.proposer = c.account")
def jn_lateral_lookup(spark, d):
    return a.proposals(spark, d).join(a.contributors(spark, d).select("account", "power"), F.col("proposer") == F.col("account")).select("account", "power", "proposal_id")


@query("SELECT proposal_id, state, chain_id FROM proposal WHERE chain_id = 1 AND mode = '5-LOW'")
def flt_scope_implicit(spark, d):
    from rollcall.operators import filters

    return filters.scoped(a.proposals(spark, d), chain_id=1, mode="5-LOW", proposer=None).select("proposal_id", "state", "chain_id")


@query("SELECT l.pos, min(s.segment) AS segment FROM logged l JOIN (SELECT range AS segment, range * 1000 AS first, range * 1000 + 1199 AS last FROM range(0, (SELECT max(pos) // 1000 + 1 FROM logged))) s ON l.pos BETWEEN s.first AND s.last GROUP BY l.pos")
def jn_range_segment(spark, d):
    """Segments overlap and reach to the greatest position; each position takes the first that holds it."""
    rows = a.logged(spark, d).select("pos")
    s = rows.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.max("pos") / 1000))).alias("segment")).select("segment", (F.col("segment") * 1000).alias("first"), (F.col("segment") * 1000 + 1199).alias("last"))
    return interval_join(rows, "pos", s).groupBy("pos").agg(F.min("segment").alias("segment"))


@query("""SELECT segment, count(l.pos) AS n, min(l.pos) AS lowest, max(l.pos) AS highest FROM (SELECT pos AS segment, pos * 7 % 1000 + pos AS first, pos * 7 % 1000 + pos + (CASE pos % 4 WHEN 0 THEN 2 WHEN 1 THEN 40 WHEN 2 THEN 900 ELSE 3000 END) - 1 AS last FROM logged WHERE pos % 50 < 4) s
  JOIN logged l ON l.pos BETWEEN s.first AND s.last GROUP BY segment""")
def jn_interval_overlap(spark, d):
    """What segments hold that begin anywhere, overlap each other and are from two to 3000 blocks long."""
    rows = a.logged(spark, d).select("pos")
    length = F.element_at(F.array(*map(F.lit, (2, 40, 900, 3000))), (F.col("pos") % 4 + 1).cast("int"))
    first = F.col("pos") * 7 % 1000 + F.col("pos")
    s = rows.where("pos % 50 < 4").select(F.col("pos").alias("segment"), first.alias("first"), (first + length - 1).alias("last"))
    return interval_join(rows, "pos", s).groupBy("segment").agg(F.count("*").alias("n"), F.min("pos").alias("lowest"), F.max("pos").alias("highest"))


@query("SELECT c.account, c.power, t.total FROM contributor c, (SELECT CAST(sum(power) AS BIGINT) AS total FROM contributor) t")
def jn_cross_scalar(spark, d):
    c = a.contributors(spark, d)
    return c.join(F.broadcast(c.agg(F.sum("power").alias("total")))).select("account", "power", "total")  # one row


@query("SELECT account, floor(abs(power) * 10000 // t.total)::DOUBLE / 100.0::DOUBLE AS share FROM contributor, (SELECT CAST(sum(abs(power)) AS BIGINT) AS total FROM contributor) t")
def web_power_share(spark, d):
    c = a.contributors(spark, d)
    return c.join(F.broadcast(c.agg(F.sum(F.abs("power")).alias("total")))).select("account", status.power_share(F.abs("power"), F.col("total")).alias("share"))  # one row


@query("SELECT segment, account, row_number() OVER (ORDER BY account) - 1 AS place, n AS next_offset FROM (SELECT lower(segment) AS segment, min(account) AS account FROM contributor GROUP BY 1), (SELECT count(*) AS n FROM contributor)")
def topk_infinite_page(spark, d):
    """Pages that hold a member again under another spelling show it once; the next offset counts the rows as delivered."""
    rows = a.contributors(spark, d)
    shown = rows.groupBy(F.lower("segment").alias("segment")).agg(F.min("account").alias("account"))
    placed = status.ranked_overall(shown, [F.asc("account")], "place").withColumn("place", F.col("place") - 1)
    return placed.join(F.broadcast(rows.agg(F.count("*").alias("next_offset")))).select("segment", "account", "place", "next_offset")


@query("""SELECT account, coalesce(power, 0) AS power, delegates_power FROM (SELECT c.account, coalesce(l.power, c.power) AS power FROM contributor c LEFT JOIN live l USING (account)) LEFT JOIN (
  SELECT p.proposer AS account, CAST(sum(l.power) AS BIGINT) AS delegates_power FROM (SELECT DISTINCT proposer, chain_id * 7 + proposer - proposer % 7 AS delegator FROM proposal) p JOIN live l ON l.account = p.delegator GROUP BY p.proposer) USING (account)""")
def ovl_live_power(spark, d):
    """Overlays from refreshed values: a contributor's power is its own, a delegate's the sum of its delegators' balances."""
    fresh = overlay.available(a.live_contributors(spark, d)).select("account", "power")
    edges = a.proposals(spark, d).select(F.col("proposer").alias("delegate"), (F.col("chain_id") * 7 + F.col("proposer") - F.col("proposer") % 7).alias("delegator")).distinct()
    own = overlay.patched(a.contributors(spark, d).select("account", "power"), fresh, ["account"], ["power"])
    delegated = overlay.delegated_power(edges, fresh.withColumnRenamed("power", "balance"))
    return own.join(delegated.withColumnRenamed("delegate", "account"), "account", "left").select("account", F.coalesce("power", F.lit(0)).cast("long").alias("power"), F.col("power_of_delegators").alias("delegates_power"))


@query("SELECT coalesce(x.kind, y.kind) AS kind, CASE WHEN y.n IS NULL THEN 'missing' WHEN x.n IS NULL THEN 'unexpected' WHEN x.n = y.n AND x.s = y.s THEN 'matched' ELSE 'mismatched' END AS status FROM (SELECT kind, count(*) AS n, sum(value) AS s FROM logged WHERE pos % 2 = 0 GROUP BY kind) x FULL JOIN (SELECT kind, count(*) AS n, sum(value) AS s FROM logged WHERE (pos % 2 = 1 AND kind NOT IN ('error', 'view')) OR (pos % 2 = 0 AND kind = 'view') GROUP BY kind) y ON x.kind = y.kind")
def aud_parity(spark, d):
    """Tables (here one for each kind) by their digests."""
    rows = a.logged(spark, d)
    expected = rows.where("pos % 2 = 0").select("kind", "value")
    found = rows.where("(pos % 2 = 1 AND kind NOT IN ('error', 'view')) OR (pos % 2 = 0 AND kind = 'view')").select("kind", "value")
    return status.parity(expected, found, ["kind"])


@query("SELECT p.proposal_id, coalesce(CASE WHEN p.chain_id <> 2 THEN p.created END, v.first_ms) AS created FROM proposal p LEFT JOIN (SELECT proposal_id, min(cast_ms) AS first_ms FROM vote GROUP BY proposal_id) v USING (proposal_id)")
def bkf_timestamps(spark, d):
    first = a.votes(spark, d).groupBy("proposal_id").agg(F.min("cast_ms").alias("first_ms"))
    rows = a.proposals(spark, d).join(first, "proposal_id", "left")
    return rows.select("proposal_id", F.coalesce(F.when(F.col("chain_id") != 2, F.col("created")), "first_ms").alias("created"))


BOUNDS = f"""b AS (SELECT c.proposal_id AS id, p.chain_id, c.clock_mode, c.vote_start, c.vote_end, c.vote_start_timestamp, c.vote_end_timestamp, c.proposal_id % 3 = 0 AS sr, c.proposal_id % 4 = 0 AS er FROM ({CREATED}) c JOIN proposal p USING (proposal_id)
), t AS (SELECT DISTINCT chain_id, vote_start AS block, vote_start * 12000 + 7 AS time_ms FROM b WHERE vote_start % 2 = 0
), h AS (SELECT max(id) // 2 AS height FROM b
), u AS (SELECT b.*, s.time_ms AS st, e.time_ms AS et, clock_mode = 'blocknumber' AND ((vote_start <= height AND NOT sr) OR (vote_end <= height AND NOT er)) AS due FROM b CROSS JOIN h LEFT JOIN t s ON s.chain_id = b.chain_id AND s.block = b.vote_start LEFT JOIN t e ON e.chain_id = b.chain_id AND e.block = b.vote_end)"""


def bounded_proposals(spark, d):
    """Proposals with their bounds, whether those are resolved and the height, and the times of some blocks."""
    rows = proposals.created(created_events(spark, d)).select(
        F.col("proposal_id").alias("id"), "chain_id", "clock_mode", "vote_start", "vote_end", "vote_start_timestamp", "vote_end_timestamp", (F.col("proposal_id") % 3 == 0).alias("vote_start_resolved"), (F.col("proposal_id") % 4 == 0).alias("vote_end_resolved"),
    )
    times = rows.where("vote_start % 2 = 0").select("chain_id", F.col("vote_start").alias("block"), (F.col("vote_start") * 12000 + 7).alias("time_ms")).distinct()
    height = rows.agg(F.floor(F.max("id") / 2).alias("height"))  # one row
    return rows.crossJoin(F.broadcast(height)), times


@query(f"""SELECT * FROM (WITH {BOUNDS} SELECT id, CASE WHEN due THEN coalesce(st, vote_start_timestamp) ELSE vote_start_timestamp END AS vote_start_timestamp, CASE WHEN due THEN coalesce(et, vote_end_timestamp) ELSE vote_end_timestamp END AS vote_end_timestamp,
  sr OR due AND st IS NOT NULL AS vote_start_resolved, er OR due AND et IS NOT NULL AS vote_end_resolved, due AND (st IS NOT NULL AND (NOT sr OR st <> vote_start_timestamp) OR et IS NOT NULL AND (NOT er OR et <> vote_end_timestamp)) AS changed FROM u)""")
def bkf_block_times(spark, d):
    """Times of blocks take the place of estimates, where a bound that isn't resolved lies below the height."""
    rows, times = bounded_proposals(spark, d)
    found = proposals.backfilled_times(rows, times, F.col("height"))
    return found.select("id", "vote_start_timestamp", "vote_end_timestamp", "vote_start_resolved", "vote_end_resolved", "changed")


@query(f"""SELECT * FROM (WITH {BOUNDS}, e AS (SELECT id, vote_start AS first, vote_end AS last, due, st, et, vote_start, vote_end FROM u UNION ALL SELECT id, vote_end, NULL, due, st, et, vote_start, vote_end FROM u UNION ALL SELECT id, id, vote_start, due, st, et, vote_start, vote_end FROM u)
SELECT id AS proposal_id, first AS start_timepoint, CASE WHEN due AND st IS NOT NULL AND first = vote_start THEN st WHEN due AND et IS NOT NULL AND first = vote_end THEN et ELSE -1 END AS start_timestamp,
  CASE WHEN due AND st IS NOT NULL AND last = vote_start THEN st WHEN due AND et IS NOT NULL AND last = vote_end THEN et END AS end_timestamp FROM e)""")
def bkf_epoch_times(spark, d):
    """State epochs that begin or end at a bound follow its time."""
    rows, times = bounded_proposals(spark, d)
    found = proposals.bounds_to_fill(rows, times, F.col("height"))
    none = F.lit(None).cast("long")
    epoch = lambda first, last: F.struct(first.alias("start_timepoint"), last.alias("end_timepoint"), F.lit(-1).cast("long").alias("start_timestamp"), none.alias("end_timestamp"))
    epochs = rows.select(F.col("id").alias("proposal_id"), F.explode(F.array(epoch(F.col("vote_start"), F.col("vote_end")), epoch(F.col("vote_end"), none), epoch(F.col("id"), F.col("vote_start")))).alias("e")).select("proposal_id", "e.*")
    return proposals.backfilled_epochs(epochs, found).select("proposal_id", "start_timepoint", "start_timestamp", "end_timestamp")


@query("SELECT delegator, pos, CAST(value AS VARCHAR) AS power, CAST(coalesce(lag(value) OVER (PARTITION BY delegator ORDER BY pos), 0) AS VARCHAR) AS previous, CAST(value - coalesce(lag(value) OVER (PARTITION BY delegator ORDER BY pos), 0) AS VARCHAR) AS delta FROM logged")
def bkf_checkpoints(spark, d):
    rows = a.logged(spark, d).select("delegator", "pos", F.col("value").cast("string").alias("power"))
    return folds.value_checkpoints(rows, "delegator", "pos", "power")


@query("""SELECT * FROM (WITH RECURSIVE n AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn FROM conversations)),
t AS (SELECT id, 0 AS depth, id AS root FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, t.depth + 1, t.root FROM n JOIN t ON n.parent = t.id) SELECT id, depth, root FROM t)""", views=False)
def web_comment_tree(spark, d):
    """Each turn answers the one before."""
    turns = a.table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t")).distinct()
    nodes = turns.select((F.col("c") * 1000 + F.col("t")).alias("id"), F.when(F.col("t") > 0, F.col("c") * 1000 + F.col("t") - 1).alias("parent"))
    return status.comment_tree(nodes, "id", "parent").select("id", "depth", "root")


@query("""SELECT * FROM (WITH RECURSIVE n AS (SELECT id, parent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size, parent NULLS FIRST) AS k FROM (
  SELECT CAST(conv_id AS BIGINT) * 1000 + turn AS id, CASE WHEN turn > 0 THEN CAST(conv_id AS BIGINT) * 1000 + (turn - 1) // 2 END AS parent, length(coalesce(text, '')) AS size FROM conversations)) WHERE k = 1
), o AS (SELECT n.id, n.parent, m.size FROM n JOIN (SELECT CAST(conv_id AS BIGINT) * 1000 + turn AS id, min(length(coalesce(text, ''))) AS size FROM conversations GROUP BY 1) m USING (id)
), t AS (
  SELECT id, 0 AS depth, id AS root, NULL::BIGINT AS parent, [lpad(CAST(size AS VARCHAR), 12, '0') || lpad(CAST(id AS VARCHAR), 19, '0')] AS path FROM o WHERE parent IS NULL OR parent NOT IN (SELECT id FROM o)
  UNION ALL SELECT o.id, t.depth + 1, t.root, o.parent, list_append(t.path, lpad(CAST(o.size AS VARCHAR), 12, '0') || lpad(CAST(o.id AS VARCHAR), 19, '0')) FROM o JOIN t ON o.parent = t.id
) SELECT id, depth, root, parent, row_number() OVER (ORDER BY path) AS place FROM t)""", views=False)
def web_comment_threads(spark, d):
    """Turns answer one of the turns before, two at most the same; shorter texts come first."""
    turns = a.table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("at"))
    rows = turns.select((F.col("c") * 1000 + F.col("t")).alias("id"), F.when(F.col("t") > 0, F.col("c") * 1000 + F.floor((F.col("t") - 1) / 2)).alias("parent"), "at")
    return status.comment_threads(rows, "id", "parent", ["at", "id"])


@query("""SELECT delegator, list_reduce(list_prepend(1000::BIGINT, list(CASE WHEN value >= 30 THEN -1 ELSE 1 END::BIGINT ORDER BY pos)), lambda s, x: CASE WHEN x < 0 THEN greatest(100, s // 2) ELSE s END) AS size FROM logged GROUP BY delegator""")
def str_adaptive(spark, d):
    """The chunk size of each delegator's log read after all its chunks: slow ones halve it, here nothing lets it grow."""
    chunks = a.logged(spark, d).select("delegator", "pos", F.when(F.col("value") >= 30, 20.0).otherwise(5.0).alias("read_s"), F.lit(5.0).alias("local_s"), F.lit(500).alias("rows"))
    return state.chunk_sizes(chunks, "delegator", "pos", 1000)
