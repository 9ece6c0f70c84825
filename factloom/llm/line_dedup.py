"""Operator 9: line deduplication by a segment-partition edit join.

Two lines link when they are within as many edits (insertions, deletions, substitutions of characters) of each other as
the shorter one's length allows: one for each CHARS_PER_EDIT characters, and at most EDITS. So shorter lines than that
are equal or not. Linked lines are one class, and of each class only the first line (least doc_id, then line number)
stays in the documents. By the pigeonhole principle, of a line cut into one more segment than it may have edits at least
one stands unchanged in any longer line that links to it, near its own place. So each line writes its segments, and the
substrings of itself that could be segments of no longer lines (multi-match-aware positions), as hashes that hold length
and segment number. Keys that lines share give a star of candidates; inside their components (see clusters) lines are
joined again and verified by a banded bit-parallel edit distance.

Blank lines are left alone. Copies are told by a 128-bit digest; a task writes the keys of a line once. Components and
classes are named by 64 bits of it, so among a billion different lines two share a name with a chance of 3 in a hundred.

Defined results: null texts stay null and have no lines; a document is a doc_id and its text (by a 64-bit hash), so rows
that repeat both are one document and lose the same lines, and texts that share an id are documents of their own, in
the order of their hashes; those without an id come last; a document that had lines and lost them all is `emptied`;
extra columns, of any name, are kept by `dedup_lines`.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.clusters import Sets, components, draw, hot_keys, linked, place, weak_edges, with_totals
from factloom.llm.common import broadcast_if_small, cut, prepare, release, table
from factloom.llm.ngram_join import _name, _Seen

#: Edits that a long line may have, and characters that allow one each.
EDITS, CHARS_PER_EDIT = 2, 12
SPACES = " \t\n\x0b\x0c\r"


def allowed(length: int, edits: int = EDITS, per: int = CHARS_PER_EDIT) -> int:
    """Edits that a line of this length may have, always fewer than its characters; it never falls with the length."""
    return min(edits, length // per, max(length - 1, 0))


@lru_cache(maxsize=100_000)
def segments(length: int, edits: int) -> tuple[tuple[int, int], ...]:
    """Start and size of the edits + 1 segments of a line, the longer ones last."""
    parts = edits + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return tuple(out)


@lru_cache(maxsize=100_000)
def probes(length: int, edits: int = EDITS, per: int = CHARS_PER_EDIT) -> tuple[tuple[int, int, int, int], ...]:
    """(indexed length, segment, start, size) of substrings that may be a segment of a line no longer than this one.

    Segment i of a line shorter by d can stand moved by at most i places to either side, as at most i edits come before
    it, and by at most its edits - i places seen from the end. The line's own segments aren't among them.
    """
    out = []
    for shorter in range(edits + 1):
        other = length - shorter
        most = allowed(other, edits, per)
        if not most or shorter > most:
            continue
        for i, (start, size) in enumerate(segments(other, most)):
            low = max(start - i, start + shorter - (most - i), 0)
            high = min(start + i, start + shorter + (most - i), length - size)
            out += [(other, i, p, size) for p in range(low, high + 1) if shorter or p != start]
    return tuple(out)


def line_keys(line: str, edits: int = EDITS, per: int = CHARS_PER_EDIT) -> tuple[list[int], list[int]]:
    """Hashes of the line's segments, and of its probes; none where it may have no edits."""
    digest, n = xxhash.xxh3_64_intdigest, len(line)
    most = allowed(n, edits, per)
    own = [digest(line[a : a + size], n * 8 + i) - (1 << 63) for i, (a, size) in enumerate(segments(n, most))] if most else []
    seek = [digest(line[p : p + size], other * 8 + i) - (1 << 63) for other, i, p, size in probes(n, edits, per)]
    return own, list(dict.fromkeys(seek))


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most `edits`.

    What the lines share at both ends goes first. The rest is a bit-parallel computation of the band of 2 * edits + 1
    diagonals: the vectors of vertical differences move down by one row with each column, and the distance is followed
    along the band's lowest diagonal, then along the last row.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not b or len(a) <= edits:
        return len(a) <= edits
    width = 2 * edits + 2
    mask = (1 << width) - 1
    top, row = 1 << width - 1, 1 << width - 2
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << i + width
    up, down = mask & ~((1 << width - edits - 1) - 1), 0
    distance, most = edits, 2 * edits + len(b) - len(a)
    first = edits + 1  # of the window in `places`, which leave `width` empty bits below
    for j, c in enumerate(b):
        match = places[c] >> first & mask if c in places else 0
        zero = ((match & up) + up & mask ^ up) | match | down
        right_up = (down | ~(zero | up)) & mask
        right_down = zero & up
        if j < len(a) - edits:
            distance += not zero & top
        else:
            distance += bool(right_up & row) - bool(right_down & row)
            row >>= 1
        if distance > most:
            return False
        up = (right_down | ~(zero >> 1 | right_up)) & mask
        down = zero >> 1 & right_up
        first += 1
    return distance <= edits


def edit_clusters(payloads: list[bytes], labels: list[int], edits: int = EDITS, per: int = CHARS_PER_EDIT) -> list[int]:
    """Exact clusters of lines in UTF-8; equal labels are linked already."""
    lines = [p.decode() for p in payloads]

    def link(a: str, b: str) -> bool:
        return within(a, b, allowed(min(len(a), len(b)), edits, per))

    groups = Sets(labels)
    first: dict[str, int] = {}
    for i, x in enumerate(lines):
        groups.union(i, first.setdefault(x, i))
    order = sorted(first.values(), key=lambda i: (len(lines[i]), i))
    keys = {i: line_keys(lines[i], edits, per) for i in order}
    index: dict[int, list[int]] = defaultdict(list)
    # first against leaders only, so that a group of near copies costs one test each
    for i in order:
        own, seek = keys[i]
        tried = set()
        for j in (j for t in (*own, *seek) for j in index.get(t, ())):
            if j not in tried and groups.find(i) != groups.find(j):
                tried.add(j)
                if link(lines[i], lines[j]):
                    groups.union(i, j)
                    break
        else:
            for t in own:
                index[t].append(i)
    # then whatever still shares keys across clusters
    if len({groups.find(i) for i in order}) > 1:
        index.clear()
        for i in order:
            for t in keys[i][0]:
                index[t].append(i)
        roots = {t: {groups.find(i) for i in members} for t, members in index.items()}
        for i in order:
            tried = set()
            for t in (*keys[i][0], *keys[i][1]):
                if roots.get(t, set()) - {groups.find(i)}:
                    for j in index[t]:
                        if j not in tried and groups.find(i) != groups.find(j):
                            tried.add(j)
                            if link(lines[i], lines[j]):
                                groups.union(i, j)
    return groups.labels()


def sketch(docs: DataFrame, edits: int, per: int) -> DataFrame:
    """(doc_id, th, items, numbers, sizes, keys, owners, indexed): the lines with words, and keys of those that a task meets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for text in batch.column(2).to_pylist():
                items, numbers, sizes, keys, owners, indexed = [], [], [], [], [], []
                for i, line in enumerate((text or "").split("\n")):
                    if line.strip(SPACES):
                        digest = hashlib.md5(line.encode()).digest()
                        name = _name(digest)
                        items.append(name)
                        numbers.append(i)
                        sizes.append(len(line))
                        if len(line) >= per and seen.first(digest):
                            own, seek = line_keys(line, edits, per)
                            keys += own
                            keys += seek
                            owners += [name] * (len(own) + len(seek))
                            indexed += [True] * len(own) + [False] * len(seek)
                for column, value in zip(columns, (items, numbers, sizes, keys, owners, indexed), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "th", "items", "numbers", "sizes", "keys", "owners", "indexed"],
            )
        release(seen.held)

    schema = "doc_id long, th long, items array<long>, numbers array<int>, sizes array<int>, keys array<long>, owners array<long>, indexed array<boolean>"
    return docs.mapInArrow(run, schema)


def line_classes(docs: DataFrame, sketches: DataFrame, edits: int, per: int) -> DataFrame:
    """(item, leader) of lines that link to others."""
    keyed = sketches.select(F.explode(F.arrays_zip("keys", "owners", "indexed")).alias("x")).select(
        F.col("x.keys").alias("key"), F.col("x.owners").alias("item"), F.col("x.indexed").alias("indexed")
    )
    hot = hot_keys(draw(sketches, "doc_id", "th").select(F.explode("keys").alias("key")), "key")
    weak = cut(components(weak_edges(keyed, hot, may_lead="indexed")), "weak")
    lines = sketches.select("doc_id", "th", F.explode(F.arrays_zip("items", "numbers", "sizes")).alias("x")).select(
        F.struct("doc_id", "th", "x.numbers").alias("at"), F.col("x.items").alias("item"), F.col("x.sizes").alias("chars")
    )
    # added up partially, so that a line with very many places sends a row from each task
    found = lines.join(broadcast_if_small(weak, weak.count(), 32), F.col("item") == F.col("node"))
    chosen = found.groupBy("item", "component").agg(F.min("at").alias("at"), (12 * F.max("chars") + 600).cast("long").alias("size"))  # text, keys and index
    placed = place(cut(chosen, "chosen"))
    wanted = placed.groupBy(F.col("at.doc_id").alias("k"), F.col("at.th").alias("h")).agg(F.collect_list(F.struct(F.col("at.numbers").alias("number"), "component", "block", "blocks", "item", "size")).alias("lines"))
    wanted = cut(wanted, "wanted")
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("lines")).alias("m")).first()
    wanted = broadcast_if_small(wanted, 48 * size["n"] + 48 * (size["m"] or 0), 1)
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["k"]) & (docs["th"] == wanted["h"])).select("lines", "t")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for wanted_lines, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split = text.split("\n")
                found += [(x["component"], x["block"], x["blocks"], x["item"], x["size"], split[x["number"]].encode()) for x in wanted_lines]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            kinds = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    schema = "component long, block long, blocks long, item long, size long, payload binary"
    payloads = texts.mapInArrow(take, schema).dropDuplicates(["item"])
    return linked(payloads, lambda p, labels: edit_clusters(p, labels, edits, per))


def dedup_lines(docs: DataFrame, edits: int = EDITS, per: int = CHARS_PER_EDIT, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, text, n_lines, n_dropped, emptied) for each row: `row` holds its columns (those of `carry`), `text` what stays."""
    prepare(docs.sparkSession)
    t = docs[f"`{text}`"].cast("string")
    bare = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))
    sketches = cut(sketch(bare, edits, per), "lines")
    leaders = cut(line_classes(bare, sketches, edits, per).where("item <> leader").withColumnRenamed("item", "of"), "leaders")
    # places in the order of documents, those without an id last
    at = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th", F.col("x.numbers").alias("number"))
    lines = sketches.select("doc_id", "th", F.explode(F.arrays_zip("items", "numbers")).alias("x")).select(at.alias("at"), F.col("x.items").alias("item"))
    joined = lines.join(broadcast_if_small(leaders, leaders.count(), 32), F.col("item") == F.col("of"), "left")
    classed = joined.select("at", F.coalesce("leader", "item").alias("class"))
    hot = hot_keys(draw(classed, "at"), "class")
    later = with_totals(classed, "class", {"first": F.min("at")}, hot).where("at <> first")
    dropped = cut(later.groupBy(F.col("at.doc_id").alias("k"), F.col("at.th").alias("h")).agg(F.collect_set("at.number").alias("dropped")), "dropped")
    size = dropped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("dropped")).alias("m")).first()
    dropped = broadcast_if_small(dropped, 48 * size["n"] + 4 * (size["m"] or 0), 1)

    carried = F.struct(*[docs[f"`{c}`"].alias(c) for c in (docs.columns if carry is None else carry)])
    rows = docs.select(carried.alias("row"), docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))
    split = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h")), "left").withColumn("lines", F.split(F.coalesce("t", F.lit("")), "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    worded = lambda x: F.btrim(x, F.lit(SPACES)) != ""
    n_lines, n_dropped = F.size(F.filter("lines", worded)).cast("long"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    kept = F.when(F.col("dropped").isNull(), F.col("t")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    counted = split.select("row", kept.alias("text"), n_lines.alias("n_lines"), F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(n_dropped).cast("long").alias("n_dropped"))
    return counted.withColumn("emptied", (F.col("n_dropped") > 0) & (F.col("n_lines") == F.col("n_dropped")))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every row of `documents` keeps of its lines."""
    kept = dedup_lines(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return kept.select(
        "row.doc_id", "n_lines", "n_dropped", "emptied", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


ORACLES: dict[str, str] = {}
QUERIES = {"op9_line_dedup": line_dedup}
