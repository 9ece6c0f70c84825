"""Supersession chains longer than any of the given tables, against a walk link by link."""

from factloom.operators import lookup, spine


def walked(links, start):
    """(start, id, step) in both directions; a walk ends where it meets a fact again."""
    out = {(s, s, 0) for s in start}
    for sign, pairs in ((1, links), (-1, [(b, a) for a, b in links])):
        following = {}
        for a, b in pairs:
            following.setdefault(a, []).append(b)
        for s in start:
            seen, ring, step = {s}, [s], 0
            while ring:
                step += sign
                ring = {b for a in ring for b in following.get(a, ()) if b not in seen}
                seen |= ring
                out |= {(s, b, step) for b in ring}
    return out


def found(spark, links, start):
    ids = {i for link in links for i in link} | set(start)
    to = dict(links)
    facts = spark.createDataFrame([(i, to.get(i)) for i in sorted(ids)], "id long, superseded_by long")
    rows = [tuple(r) for r in spine.chains(facts, spark.createDataFrame([(s,) for s in start], "id long")).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_chains_of_any_length(spark):
    long = [(i, i + 1) for i in range(200)]
    others = [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2001), (2002, 2001), (2003, 2002)]
    start = [0, 100, 200, 1000, 1064, 2001, 3000]
    rows = found(spark, long + others, start)
    assert rows == walked(long + others, start)
    assert (0, 200, 200) in rows and (200, 0, -200) in rows


def test_chains_end_at_cycles(spark):
    ring = [(i, (i + 1) % 70) for i in range(70)]
    tail = [(500, 501), (501, 0), (900, 900)]
    start = [500, 3, 900]
    assert found(spark, ring + tail, start) == walked(ring + tail, start)


def test_fact_detail_shows_the_whole_chain(spark):
    facts = spark.createDataFrame([(i, i + 1 if i < 150 else None, 7, 1) for i in range(151)], "id long, superseded_by long, subject_id long, episode_id long")
    entities = spark.createDataFrame([(7, "user")], "id long, name string")
    chain = lookup.fact_detail(facts, entities, spark.createDataFrame([(1,)], "id long"), 75)[1]
    assert [(r["step"], r["id"]) for r in chain.collect()] == [(i - 75, i) for i in range(151)]
