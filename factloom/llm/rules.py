"""Operator 7: quality rules and host verdicts, with DataFrame expressions alone.

Each document gets counts of its whole text and fails the base rules where it has under MIN_WORDS words or more than
MAX_REPEATED percent of its words stand in 3-word windows that occur twice. Failures are added up by host (for
`documents` the source), a host's rate is shrunk by a beta prior fitted to all hosts by moments, and a host takes its
documents with it when its shrunk rate is above MAX_HOST_RATE, or stands out from the moments of all other hosts:
OUTLIER_SDS standard deviations above their mean, and OUTLIER_TIMES the mean, which keeps hosts that differ by chance.

Counts by document are written once and used twice. Adding up by host is partial before the shuffle, so a host with a
third of all rows sends a few rows from each task; the join back leaves it to Spark to broadcast host verdicts where
they are small, and to split a hot host where they aren't.

Defined results: a null text has no words and fails; documents with a null host get no host verdict; repeated rows count
and return as often as they come; an empty table gives no row; extra columns, of any name, are kept by `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, table

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_HOST_RATE = 0.5
OUTLIER_SDS, OUTLIER_TIMES = 3.0, 2.0
#: White space that separates words, as characters and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: Bits of a packed value that hold a window's place; longer texts are counted by another, slower expression.
PLACE_BITS = 22


def domain_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and a leading www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def _covered(places: str) -> Column:
    """Words in the 3-word windows that start at these ascending places."""
    p = F.col(places)
    return F.aggregate(
        F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1))).cast("long")),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )


def count_words(df: DataFrame, text: str) -> DataFrame:
    """Add _n_words, _word_chars, _n_symbols, _n_dup_lines and _n_repeat_words, counted over whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(SPACES))
    solid = t
    for space in SPACES:
        solid = F.replace(solid, F.lit(space), F.lit(""))
    df = df.withColumns(
        {
            "_words": F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_PATTERN, -1)),
            "_word_chars": F.length(solid).cast("long"),
            "_n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
            "_lines": F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        }
    )
    words = F.col("_words")
    df = df.withColumns(
        {
            "_n_words": F.size(words).cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(
                F.size(words) > 2,
                F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    windows = F.col("_windows")
    place = (1 << PLACE_BITS) - 1
    df = df.withColumn(
        "_sorted",
        F.when(
            (F.size(F.array_distinct(windows)) < F.size(windows)) & (F.size(windows) <= place),
            F.sort_array(F.transform(windows, lambda x, i: F.shiftleft(F.shiftright(x, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long")))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    packed = F.col("_sorted")

    def same(v: Column, other: Column) -> Column:
        """Both windows share the packed part of their hash, and then the whole."""
        near = F.shiftright(v, PLACE_BITS) == F.shiftright(other, PLACE_BITS)
        at = lambda x: F.get(windows, x.bitwiseAND(F.lit(place)).cast("int"))
        return F.coalesce(near & (at(v) == at(other)), F.lit(False))

    repeated = F.filter(packed, lambda v, j: same(v, F.get(packed, j - 1)) | same(v, F.get(packed, j + 1)))
    df = df.withColumn("_repeated", repeated)
    df = df.withColumn("_places", F.sort_array(F.transform("_repeated", lambda v: v.bitwiseAND(F.lit(place)))))
    df = df.withColumn(
        "_long_sorted",
        F.when(F.size(windows) > place, F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:bigint>>")
        ),
    )
    long = F.col("_long_sorted")
    twice = F.filter(long, lambda v, j: F.coalesce(v["h"] == F.get(long, j - 1)["h"], F.lit(False)) | F.coalesce(v["h"] == F.get(long, j + 1)["h"], F.lit(False)))
    df = df.withColumn("_long_twice", twice)
    df = df.withColumn("_long_places", F.sort_array(F.transform("_long_twice", lambda v: v["i"])))
    df = df.withColumn("_n_repeat_words", _covered("_places") + _covered("_long_places"))
    return df.drop("_words", "_lines", "_windows", "_sorted", "_repeated", "_places", "_long_sorted", "_long_twice", "_long_places")


def base_failed() -> Column:
    return (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEATED * F.col("_n_words"))


def host_verdicts(counts: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """A row for each host: host, documents, failures, shrunk rate, host_failed.

    The prior Beta(a, b) has the overall rate m as its mean; its size a + b makes the variance of host rates, weighted
    by documents, what it is: m (1 - m) / variance - 1, between 1 and 1e6.
    """
    hosts = counts.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col(failed).cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("documents")
    one = hosts.agg(
        F.sum("documents").alias("n"), F.sum("failures").alias("f"), F.sum(rate * rate * F.col("documents")).alias("squares")
    ).first()
    n = one["n"] or 1
    mean = (one["f"] or 0) / n
    variance = max((one["squares"] or 0.0) / n - mean * mean, 0.0)
    size = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e6) if variance > 1e-12 else 1e6
    shrunk = (F.col("failures") + F.lit(size * mean)) / (F.col("documents") + F.lit(size))
    # the others' moments are the sums without the host's own part
    rest = F.nullif(F.lit(one["n"] or 0) - F.col("documents"), F.lit(0))
    others = (F.lit(one["f"] or 0) - F.col("failures")) / rest
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.lit(one["squares"] or 0.0) - rate * rate * F.col("documents")) / rest - others * others))
    bar = F.least(F.lit(MAX_HOST_RATE), F.greatest(others + OUTLIER_SDS * spread, OUTLIER_TIMES * others))
    return hosts.withColumn("rate", F.round(shrunk, 9)).withColumn("host_failed", F.col("rate") > F.round(bar, 9))


def judge(docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of docs (columns in `carry`, all by default) with a struct `verdict` of counts and decisions beside them."""
    carried = F.struct(*[docs[f"`{c}`"].alias(c) for c in (docs.columns if carry is None else carry)])
    rows = docs.select(carried.alias("row"), docs[f"`{host}`"].cast("string").alias("host"), docs[f"`{text}`"].alias("_t"))
    counts = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words")
    counted = cut(count_words(rows, "_t").select("row", "host", *counts, base_failed().alias("failed")), "rules")
    # written, so that both sides of the join are dealt out by it alone and Spark can split a host with very many rows
    hosts = cut(host_verdicts(counted).select("host", "rate", "host_failed"), "hosts")
    joined = counted.join(hosts, "host", "left")
    kept = ~F.col("failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))
    verdict = F.struct(*[F.col(c).alias(c[1:]) for c in counts], F.col("failed").alias("base_failed"), kept.alias("kept"), F.round("rate", 6).alias("host_rate"))
    return joined.select("row", verdict.alias("verdict"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every row of `documents`, with its host's shrunk rate of failures."""
    return judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("row.doc_id", "verdict.*")


ORACLES = {
    "op7_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
b AS (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(x) / sum(n) AS mean, greatest(sum(x / n * x / n * n) / sum(n) - (sum(x) / sum(n)) * (sum(x) / sum(n)), 0) AS v FROM h),
p AS (SELECT mean, CASE WHEN v > 1e-12 THEN least(greatest(mean * (1 - mean) / v - 1, 1), 1e6) ELSE 1e6 END AS size FROM m),
t AS (SELECT sum(n) AS n, sum(x) AS x, sum(x / n * x / n * n) AS s FROM h),
o AS (SELECT h.source, h.n, h.x, (t.x - h.x) / nullif(t.n - h.n, 0) AS mean, (t.s - h.x / h.n * h.x / h.n * h.n) / nullif(t.n - h.n, 0) AS s FROM h, t),
j AS (
  SELECT o.source, round((x + size * p.mean) / (n + size), 9) AS rate,
    round((x + size * p.mean) / (n + size), 9) > round(least(0.5, greatest(o.mean + 3 * sqrt(greatest(0, o.s - o.mean * o.mean)), 2 * o.mean)), 9) AS host_failed
  FROM o, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(host_failed, false) AS kept, round(rate, 6) AS host_rate
FROM f LEFT JOIN j USING (source)"""
}
QUERIES = {"op7_quality_rules": quality_rules}
