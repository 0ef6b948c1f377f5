"""Rules that queries over the driver's tables reach only in part."""

from pyspark.sql import functions as F

from rollcall.functions import descriptions
from rollcall.operators import overlay, proposals, status, timelock


def test_segments_are_final_when_range_and_anchor_are_passed(spark):
    shape = "id string, dao string, source string, status string, range_start long, range_end long, anchor long"
    rows = [("a", "x", "t", "available", 0, 10, None), ("b", "x", "t", "available", 0, 10, 11), ("c", "x", "t", "available", 5, 11, 3), ("d", "x", "t", "invalid", 0, 1, None), ("e", "x", "t", "available", -1, 1, None), ("f", "x", "t", "available", 4, 3, None), ("g", None, "u", "available", 0, 1, None), ("h", "y", "t", "available", 0, 1, None)]
    segments = spark.createDataFrame(rows, shape)
    heights = spark.createDataFrame([("x", 10), (None, 1), ("z", 99)], "dao string, height long")
    assert sorted(r.id for r in overlay.final_segments(segments, heights, ["dao"]).collect()) == ["a", "g"]
    assert [r.id for r in overlay.final_segments(segments, heights, ["dao"], "t").collect()] == ["a"]
    overlays = spark.createDataFrame([(1, "x", "a", "available"), (2, "x", "a", "invalid"), (3, "x", "b", "available"), (4, "y", "a", "available"), (5, None, "g", "available"), (6, "x", None, "available")], "k int, dao string, segment_id string, status string")
    marked = overlay.marked_final(overlays, overlay.final_segments(segments, heights, ["dao"]), ["dao"]).orderBy("k").collect()
    assert [r.status for r in marked] == ["finalized", "invalid", "available", "available", "finalized", "available"]


def test_what_to_say_of_a_missing_proposal(spark):
    half_hour = 30 * 60 * 1000
    rows = [(True, True, "x", 1, half_hour + 1), (True, False, None, 1, half_hour), (True, None, None, None, 10**12), (False, True, "nonexistent proposal", 1, 2), (False, False, "GovernorNonexistentProposal(5)", 1, 2), (None, None, "NONEXISTENT PROPOSAL", 1, 2), (False, False, "timeout", 1, 10**12), (False, False, None, 1, 2)]
    df = spark.createDataFrame(rows, "e boolean, p boolean, err string, seen long, now long").coalesce(1)
    found = [r.s for r in df.select(status.missing_state(*(F.col(c) for c in ("e", "p", "err", "seen", "now"))).alias("s")).collect()]
    assert found == ["problem", "indexing", "indexing", "checking", "not-found", "not-found", "checking", "checking"]


def test_contracts_that_can_be_indexed(spark):
    ok = [("governor", "method", n) for n in (*status.GOVERNOR_METHODS, *status.OPTIONAL_METHODS)] + [("governor", "event", n) for n in status.GOVERNOR_EVENTS] + [("token", "event", n) for n in status.TOKEN_EVENTS]
    ok += [("token", "method", n) for n in (*status.TOKEN_METHODS["ERC20"], "getVotes", "getPastVotes")]
    daos = [("full", "g", "t", "ERC20", 2), ("old", "g", "t", "ERC20", 2), ("torn", None, "", "ERC1155", 2), ("nft", "g", "t", "ERC721", None)]
    probes = [("full", *p, "ok") for p in ok] + [("nft", *p, "ok") for p in ok]
    probes += [("old", *p, "ok") for p in ok if p[2] not in ("getVotes", "getPastVotes", "timelock", "quorum")] + [("old", "token", "method", "getCurrentVotes", "ok"), ("old", "token", "method", "getPriorVotes", "ok"), ("old", "governor", "method", "quorum", "reverts"), ("old", "token", "method", "other", "ok")]
    found = {r.code: r for r in status.compatibility(spark.createDataFrame(daos, "code string, governor string, token string, standard string, transfer_topics int"), spark.createDataFrame(probes, "code string, owner string, kind string, name string, state string")).collect()}
    assert (found["full"].support, found["full"].errors, found["full"].warnings, found["full"].current) == ("supported", [], [], "getVotes")
    assert found["old"].errors == ["governor.quorum reverts"] and found["old"].historical == "getPriorVotes"
    assert found["old"].warnings == ["token.getVotes missing; using getCurrentVotes fallback", "token.getPastVotes missing; using getPriorVotes fallback", "governor.timelock missing; indexing without timelock projection"]
    assert found["torn"].errors[:4] == ["dao.governor missing", "dao.token.contract missing", "dao.token.standard ERC1155 unsupported", "governor.hashProposal missing"] and found["torn"].support == "unsupported"
    assert found["nft"].errors == ["token.ownerOf missing", "dao.token.standard declares ERC721 but Transfer has unknown indexed arguments"]


def test_tags_are_taken_out_once(spark):
    rows = [("# T\n<discussion>  http://d 　</discussion> mid <discussion>2</discussion><signature>[\"f()\", \"g\"]</signature>\n",), ("<discussion>open only",), ("</discussion><discussion>x</discussion>",), ("a <signature>no json</signature> b",), (None,), ("",)]
    found = [tuple(r)[1:] for r in descriptions.with_tags(spark.createDataFrame(rows, "t string").coalesce(1), "t").select("t", "body", "discussion", "signature").collect()]
    assert found == [("# T\n mid <discussion>2</discussion>", "http://d", ["f()", "g"]), ("<discussion>open only", None, []), ("</discussion>", "x", []), ("a  b", None, []), (None, None, []), ("", None, [])]


def test_block_times_fill_what_is_asked_for(spark):
    shape = "id int, chain_id int, clock_mode string, vote_start long, vote_end long, vote_start_timestamp long, vote_end_timestamp long, vote_start_resolved boolean, vote_end_resolved boolean"
    rows = [(1, 1, "blocknumber", 10, 20, 1, 2, False, False), (2, 1, "timestamp", 10, 20, 1, 2, False, False), (3, 1, "blocknumber", 10, 20, 100, 2, True, True), (4, 1, "blocknumber", 30, 40, 1, 2, False, False), (5, 2, "blocknumber", 10, 20, 1, 2, False, False), (6, 1, "blocknumber", 20, 99, 7, 8, True, False)]
    times = spark.createDataFrame([(1, 10, 100), (1, 20, 200), (1, 30, 300)], "chain_id int, block long, time_ms long")
    found = [tuple(r)[5:] for r in proposals.backfilled_times(spark.createDataFrame(rows, shape), times, F.lit(25)).orderBy("id").collect()]
    assert found == [(100, 200, True, True, True), (1, 2, False, False, False), (100, 2, True, True, False), (1, 2, False, False, False), (1, 2, False, False, False), (7, 8, True, False, False)]


def test_control_operations_tell_their_blocks(spark):
    shape = "contract_set_id string, proposal_id string, action_index int, target string, value string, calldata string, queue_tx string, queue_timestamp string, queue_eta string, execution_tx string, queue_block string, execution_block string, execution_timestamp string"
    rows = [("s", "5", k, "t", "0", "0x", "q", "100", "150", "e" if k < 2 else None, "7", "9" if k < 2 else None, "120" if k < 2 else None) for k in range(3)]
    found = timelock.control_operations(spark.createDataFrame(rows, shape)).collect()
    assert len(found) == 1 and (found[0].state, found[0].call_count, found[0].executed_call_count, found[0].delay_seconds) == ("Done", 3, 2, "50")
    assert (found[0].timelock_type, found[0].queued_block_number, found[0].queued_block_timestamp, found[0].executed_block_number, found[0].executed_transaction_hash) == ("GovernorTimelockControl", "7", "100", "9", "e")


def test_actions_that_agree_are_counted_before_texts_are_sorted(spark):
    shape = "contract_set_id string, proposal_id string, action_index long, target string, value string, calldata string, queue_tx string, queue_timestamp string, queue_eta string, execution_tx string, queue_block string, execution_block string, execution_timestamp string"
    rows = [("s", "1", k, "t", "0", "0x", "q", "5", "9", "x", "2", "3", "4") for k in range(40)] + [("s", "01", 40, "t", "0", "0x", "r", "6", "9", None, "7", None, None)]
    found = timelock.control_operations(spark.createDataFrame(rows, shape))
    assert {(r.proposal_id, r.call_count, r.executed_call_count, r.state, r.queued_block_number, r.executed_block_number) for r in found.collect()} == {("1", 40, 40, "Done", "7", "3"), (rows[-1][1], 1, None, "Queued", "7", "3")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(n" in plan and "Join" not in plan
