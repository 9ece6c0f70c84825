"""Update integrity: what current, past and retired facts a namespace shows after a few messages."""

import pytest

from factloom.memory import Memory

T0, HOUR = 1_000_000_000_000, 3_600_000
#: key: messages two hours apart, top fact, retired text, as-of offset and its top, texts of exactly the latest facts
SCENARIOS = {
    "employer": (["I work at Acme.", "I work at Zorbex now."], "Zorbex", "Acme", (HOUR, "Acme"), None),
    "identity": (["I am an engineer.", "I am a designer now."], "designer", "engineer", (HOUR, "engineer"), None),
    "city": (["I live in Berlin.", "I live in Munich now."], "Munich", "Berlin", (HOUR, "Berlin"), None),
    "editor": (["I am a vim user.", "I am an emacs user now."], "emacs", "vim", (HOUR, "vim"), None),
    "additive": (["I work at Acme.", "I also work at Globex."], "work", None, None, ["Acme", "Globex"]),
    "replaced": (["I work at Acme.", "I also work at Globex.", "I work at Zorbex now."], "Zorbex", "Acme", None, ["Zorbex"]),
    "music": (["I like jazz.", "I also like blues."], "like", None, None, ["jazz", "blues"]),
    "before": (["I live in Berlin."], "Berlin", None, (-HOUR, None), None),
    "again": (["I live in Berlin.", "I live in Berlin."], "Berlin", None, None, ["Berlin"]),
    "back": (["I work at Acme.", "I work at Zorbex now.", "I work at Acme."], "Acme", "Zorbex", None, ["Acme"]),
    "marks": (["I work at Acme.", "I work at Acme,", "I WORK AT Acme.", "I  work at\tAcme."], "Acme", None, None, ["Acme"]),
    "amounts": (["My budget is 10,5 euros.", "My budget is 105 euros."], "budget", "10,5", None, ["105"]),
}


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('memory')}"
    for step in range(4):  # each step of all scenarios is one batch, and each batch opens the store anew
        rows = [(key, texts[step], T0 + 2 * step * HOUR, "user") for key, (texts, *_) in SCENARIOS.items() if step < len(texts)]
        Memory(spark, root).add_batch(spark.createDataFrame(rows, "namespace string, raw string, t_ref long, source string"))
    return Memory(spark, root)


@pytest.mark.parametrize("key", SCENARIOS)
def test_scenario(memory, key):
    texts, top, retired, past, latest = SCENARIOS[key]
    now = T0 + 2 * len(texts) * HOUR
    hits = memory.search(key, "where does the user work?", k=10, now=now).collect()
    assert top in hits[0]["fact_text"]
    facts = memory.history(key).collect()
    if retired:
        old = [f for f in facts if retired in f["fact_text"] and not f["is_latest"]]
        assert old and all(f["superseded_by"] and f["valid_to"] for f in old)
    if past:
        seen = memory.search(key, "where?", k=10, as_of=T0 + past[0], is_latest_only=False, now=T0 + past[0]).collect()
        assert (past[1] in seen[0]["fact_text"]) if past[1] else not seen
    if latest:
        found = [f["fact_text"] for f in facts if f["is_latest"]]
        assert len(found) == len(latest) and all(any(x in f for f in found) for x in latest)


def test_parity_pools_agree_on_small_stores(memory):
    a, b = (memory.search("employer", "Zorbex", now=T0 + 9 * HOUR, pool=p, touch=False).select("id", "final_score").collect() for p in ("exact", "parity"))
    assert a == b


def test_single_add_and_touch(memory):
    assert len(memory.add("solo", "I work at Initech. Bob likes tea.", t_ref=T0)) == 2
    assert memory.search("solo", "Initech", now=T0 + 1, touch=True).count() == 2
    assert {f["access_count"] for f in memory.history("solo").collect()} == {1}
    assert "employer" in {r["namespace"] for r in memory.store.namespaces().collect()}
