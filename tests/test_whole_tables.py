"""Queries that must work on every row of their table, at a size where a fixed prefix would not hold them."""

BIG = "/root/testdata/sf0.1"


def test_every_position_has_its_first_segment(spark):
    from rollcall.plans import analogues as a
    from rollcall.plans import registry

    pos = sorted(r.pos for r in a.logged(spark, BIG).select("pos").collect())
    found = sorted((r.pos, r.segment) for r in registry.QUERIES["jn_range_segment"](spark, BIG).collect())
    assert found == [(p, p // 1000 - (p >= 1000 and p % 1000 < 200)) for p in pos] and pos[-1] > 20_199


def test_every_proposal_gets_its_timestamp(spark):
    from rollcall.plans import analogues as a
    from rollcall.plans import registry

    first = {}
    for r in a.votes(spark, BIG).select("proposal_id", "cast_ms").toLocalIterator():
        if r.cast_ms is not None:
            first[r.proposal_id] = min(first.get(r.proposal_id, r.cast_ms), r.cast_ms)
    expected = [(r.proposal_id, r.created if r.chain_id is not None and r.chain_id != 2 and r.created is not None else first.get(r.proposal_id)) for r in a.proposals(spark, BIG).select("proposal_id", "chain_id", "created").collect()]
    found = [tuple(r) for r in registry.QUERIES["bkf_timestamps"](spark, BIG).select("proposal_id", "created").collect()]
    assert sorted(found) == sorted(expected) and len(found) > 100_000
