"""Chat formatting and quality rules against plain Python."""

import hashlib
import random
import re
from itertools import groupby

from pyspark.sql import functions as F

from factloom.llm import chat, rules
from tests.oracle import assert_same

DATA = "/root/testdata/sf0.001"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|next|>", "<|end|>", "<", "[", "\\", "<\\", "<\\s>", "[\\\\INST]", "\n", "ok", " ", "|", "s>", "$1", "é"]


def test_op2_equals_sql(spark):
    assert_same(chat.chat_format(spark, DATA), chat.ORACLES["op2_chat_format"])


def test_chats_can_be_read_back(spark):
    rng = random.Random(1)
    said = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))
    turns = [(c, t, rng.choice(["user", "assistant", "system", said()]), said()) for c in range(60) for t in range(rng.randint(1, 9))]
    turns += [(100, t, "user" if t % 2 else "assistant", f"{t}") for t in range(1500)] + [(101, None, None, None), (101, 1, "user", "a"), (101, 1, "user", "a"), (None, 1, "assistant", "b")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, block int")
    out = chat.format_chats(df).withColumn("turns", chat.parse_chats(F.col("formatted"))).collect()
    key = lambda t: (t[1] is not None, t[1] or 0, chat_escape(t[2] or ""), chat_escape(t[3] or ""))
    for r in out:
        mine = sorted((t for t in turns if t[0] == r["conv_id"]), key=key)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in mine]
        assert [s["piece"] for s in r["segments"] if s["loss"]] == [chat_escape(t[3] or "") for t in mine if t[2] == "assistant"]
        assert r["formatted"].count(chat.TURN) == len(list(groupby(mine, key=lambda t: t[2] or "")))
        assert "".join(s["piece"] for s in r["segments"]) == r["formatted"]
    assert len(out) == len({t[0] for t in turns})
    assert chat.format_chats(df.limit(0)).count() == 0


def chat_escape(text):
    return re.sub(rf"([<\[])(\\*)({chat.REST})", r"\1\\\2\3", text)


def test_conversation_of_control_strings(spark):
    row = chat.chat_format(spark, DATA).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said)
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_op7_equals_sql(spark):
    assert_same(rules.quality_rules(spark, DATA), rules.ORACLES["op7_quality_rules"])


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice)


def test_counts(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "#", "a b a b ", " ", "<|>", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " \n ", "a", "a a", "a a a", "a a a a", "x y z x y z", "same\nsame\n\n\nsame", "w " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in (22, 4):  # with 4, most texts take the way of very long ones
        monkeypatch.setattr(rules, "PLACE_BITS", bits)
        for r in rules.count_words(df, "text").collect():
            assert (r["_n_words"], r["_word_chars"], r["_n_symbols"], r["_n_dup_lines"], r["_n_repeat_words"]) == counts(r["text"]), r["text"]


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, bad if i % 10 else good, "junk") for i in range(40)] + [(200, good, None), (201, None, "fine"), (202, good, "new"), (202, good, "new")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, verdict string")
    out = rules.judge(df)
    assert out.count() == len(rows) and out.select("row.*").columns == df.columns
    kept = [r["row"]["doc_id"] for r in out.where("verdict.kept").collect()]
    assert sorted(kept) == [*range(40), 200, 202, 202]
    assert rules.judge(df.limit(0)).count() == 0


def test_hosts_are_judged_against_the_prior(spark):
    """Of twenty hosts one fails four times as often as the others: it goes, though far from MAX_HOST_RATE; chance alone takes none."""
    shares = {f"h{i}": 4 + i % 3 for i in range(20)}
    for worst, gone in ((20, {"h7"}), (7, set())):
        rows = [(host, i < n) for host, k in shares.items() for n in [worst if host == "h7" else k] for i in range(100)]
        found = rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()
        rates = {h: sum(f for g, f in rows if g == h) / 100 for h in shares}
        mean = sum(rates.values()) / 20
        size = mean * (1 - mean) / (sum(r * r for r in rates.values()) / 20 - mean * mean) - 1
        for r in found:
            assert abs(r["rate"] - (100 * rates[r["host"]] + size * mean) / (100 + size)) < 1e-6
        assert {r["host"] for r in found if r["host_failed"]} == gone
    few = spark.createDataFrame([("one", True)] + [(f"h{i}", i % 20 == 0) for i in range(400)], "host string, failed boolean")
    assert rules.host_verdicts(few).where("host_failed").count() <= 21


def test_domains(spark):
    urls = ["https://WWW.Example.com:80/a", "http://u:p@b.org?q", "ftp://c", "nothing", None]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(rules.domain_of(F.col("u"))).collect()
    assert [r[0] for r in found] == ["example.com", "b.org", "c", None, None]
