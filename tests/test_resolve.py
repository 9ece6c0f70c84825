"""The slot state machine: bands, resets and restatements."""

import numpy as np
import pytest

from factloom.operators.resolve import Slot, fold


def unit(cos):
    return [cos, float(np.sqrt(1 - cos * cos))]


@pytest.mark.parametrize("old, new, multivalued, additive, cos, label, route", [
    ("Acme", "Globex", False, False, 0.85, "supersedes", "high_supersedes"),
    ("Acme", "Globex", False, True, 0.85, "supersedes", "high_supersedes"),
    ("jazz", "blues", True, True, 0.85, "extends", "high_extends_additive"),
    ("Acme", "Acme platform team", False, False, 0.9, "extends", "high_extends"),
    ("Berlin", "Munich", False, False, 0.3, "supersedes", "low_supersedes"),
    ("Berlin", "Munich", False, True, 0.3, "extends", "low_extends"),
    ("Berlin", "Munich", False, False, 0.6, "supersedes", "ambiguous_default"),
    ("Berlin", "Munich", False, True, 0.6, "extends", "mid_extends"),
])
def test_bands(old, new, multivalued, additive, cos, label, route):
    slot = Slot()
    assert slot.take(1, "a", old, additive, multivalued, [1.0, 0.0])[0] == "asserts"
    assert slot.take(2, "b", new, additive, multivalued, unit(cos))[:2] == (label, route)


def test_functional_reset_closes_all_and_multivalued_one():
    slot = Slot()
    for i, (obj, additive) in enumerate([("Acme", False), ("Globex", True)]):
        slot.take(i, obj, obj, additive, False)
    assert slot.take(2, "Zorbex", "Zorbex", False, False)[4] == [0, 1]
    assert slot.take(3, "Zorbex", "Zorbex", False, False)[0] == "skip"
    assert slot.take(4, "", "x", False, False)[0] == slot.take(5, "", "y", False, False)[0] == "supersedes"


def test_fold_equals_one_slot_at_a_time(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(5)), i, o := f"o{rng.integers(4)}", o, bool(rng.integers(2)), bool(rng.integers(2))) for i in range(300)]
    df = spark.createDataFrame(rows, "slot_id int, seq long, key string, object string, additive boolean, multivalued boolean")
    found = {r["seq"]: (r["label"], sorted(r["closed"])) for r in fold(df, ["slot_id"]).collect()}
    slots = {s: Slot() for s in range(5)}
    for s, i, key, obj, additive, multivalued in rows:
        label, _, _, _, closed = slots[s].take(i, key, obj, additive, multivalued)
        assert found[i] == (label, sorted(closed))


def test_prior_facts_come_first(spark):
    schema = "s int, seq long, key string, object string, additive boolean, multivalued boolean"
    prior = spark.createDataFrame([(1, 7, "k", "o", False, False)], schema)
    new = spark.createDataFrame([(1, 9, "k", "o", False, False), (1, 10, "k2", "p", False, False)], schema)
    found = {r["seq"]: (r["label"], r["closed"]) for r in fold(new, ["s"], prior=prior).collect()}
    assert found == {9: ("skip", []), 10: ("supersedes", [7])}
