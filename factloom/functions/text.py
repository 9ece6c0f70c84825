"""Text functions over columns: sentences, candidate parts, routing, typing, salience and the text folds.

Patterns spell out Unicode word boundaries, as Java's own are ASCII by default.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_CHAR = r"[\p{L}\p{N}_]"
BEFORE, AFTER = rf"(?<!{WORD_CHAR})", rf"(?!{WORD_CHAR})"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
EDGE_PUNCTUATION = ".,!?;:'\""
EDGE_CLASS = r"[.,!?;:'\"]"

#: Relation verbs in order; the first that matches names the relation.
VERBS = (
    ("works_at", r"(?:works?|working)\s+(?:at|for)", True),
    ("lives_in", r"(?:lives?|living|based)\s+in", True),
    ("located_in", r"(?:located|situated)\s+in", True),
    ("dislikes", r"(?:dislikes?|hates?)", True),
    ("likes", r"(?:likes?|loves?|enjoys?|prefers?)", True),
    ("is_a", r"(?:is|am|are)\s+(?:an?\s+)?", False),
    ("uses", r"(?:uses?|using)", True),
    ("has", r"(?:owns?|has|have)", True),
    ("knows", r"(?:knows?)", True),
)
#: Relations that a first-person sentence states beyond doubt.
EXPLICIT = ("works_at", "lives_in", "likes", "dislikes", "uses")
#: Predicates whose slot holds many values at once.
MULTIVALUED = ("likes", "dislikes", "uses", "knows", "has", "owns", "speaks", "plays", "member_of", "interested_in", "skilled_in")
#: Predicates that need no typing.
KNOWN_PREDICATES = (
    "works_at", "lives_in", "located_in", "likes", "dislikes", "is_a", "has", "uses", "knows", "owns", "member_of", "drives", "speaks",
    "plays", "skilled_in", "interested_in", "works_in", "commutes_by", "asserts", "supersedes", "extends",
)
#: Endpoints that don't stand by themselves.
PRONOUNS = (
    "he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs", "it", "its", "this", "that", "these", "those",
    "the former", "the latter", "the same",
)
#: Words that hint at an inference, for the router and for the typer.
ROUTER_CUES = r"so|therefore|thus|hence|because|since|must|probably|likely|presumably|implies|imply|implied|means|suggests?|consequently|as\s+a\s+result"
TYPER_CUES = "so|therefore|thus|hence|because|since|must|probably|likely|means|consequently|implies|suggests"
#: Words that add a value to a slot rather than replace it.
ADDITIVE_CUES = r"also|too|as\s+well|in\s+addition|additionally|and|plus|another|besides|moreover|on\s+the\s+side"
#: Starts of a clause whose subject is left out.
ELLIPSIS_LEADS = "and|but|then|also|plus|so"
VERB_LEADS = "works?|lives?|moved|joined|left|likes?|loves?|hates?|uses?|has|had|is|are|was|were"
FIRST_PERSON = "I|I'm|my|me|mine"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

#: The verbs of the older extractor, in its order, and its first person.
RULE_VERBS = (
    ("works_at", r"(?:works?|working)\s+(?:at|for)"),
    ("lives_in", r"(?:lives?|living|based)\s+in"),
    ("likes", r"(?:likes?|loves?|enjoys?|prefers?)"),
    ("dislikes", r"(?:dislikes?|hates?)"),
    ("is_a", r"(?:is|am|are)\s+(?:a|an)"),
    ("has", r"(?:has|have|owns?)"),
    ("uses", r"(?:uses?|using)"),
)
RULE_FIRST_PERSON = "I|I'm|I am|my|me|mine"

CAP_RUN = rf"{BEFORE}[A-Z][\p{{L}}\p{{N}}_.&-]*(?:{SPACE}+[A-Z][\p{{L}}\p{{N}}_.&-]*)*"


def _spaces(pattern: str) -> str:
    return pattern.replace(r"\s", SPACE)


def has_word(text: Column, words: str) -> Column:
    """Whether one of the words, a pattern, stands in the text between word boundaries, in any case."""
    return text.rlike(rf"(?iu){BEFORE}(?:{_spaces(words)}){AFTER}")


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def sentences(text: Column) -> Column:
    """Split after . ! or ? and white space; blank parts go."""
    return F.filter(F.split(strip_spaces(text), rf"(?<=[.!?]){SPACE}+", -1), lambda s: strip_spaces(s) != "")


def _verb(pattern: str, bounded: bool) -> str:
    return rf"{BEFORE}{_spaces(pattern)}{AFTER if bounded else ''}"


def relation(sentence: Column) -> Column:
    """The relation of the first verb pattern that matches; null without one."""
    out = F.lit(None).cast("string")
    for name, pattern, bounded in reversed(VERBS):
        out = F.when(sentence.rlike(rf"(?iu){_verb(pattern, bounded)}"), F.lit(name)).otherwise(out)
    return out


def verb_end(sentence: Column, relation_name: Column) -> Column:
    """Characters up to the end of the relation's first match."""
    out = F.lit(0)
    for name, pattern, bounded in VERBS:
        found = F.length(F.regexp_extract(sentence, rf"(?isu)^.*?{_verb(pattern, bounded)}", 0))
        out = F.when(relation_name == name, found).otherwise(out)
    return out


def first_person(sentence: Column) -> Column:
    return has_word(sentence, FIRST_PERSON)


def subject(sentence: Column, is_first_person: Column, default: str = "user") -> Column:
    """(name, end, grounded): the speaker, else the first run of capitalised words, else the first word."""
    run = F.regexp_extract(sentence, CAP_RUN, 0)
    before = F.regexp_extract(sentence, rf"(?s)^(.*?){CAP_RUN}", 1)
    lead = F.regexp_replace(F.get(F.split(strip_spaces(sentence), rf"{SPACE}+", 2), F.lit(0)), rf"^{EDGE_CLASS}+|{EDGE_CLASS}+$", "")
    return F.when(is_first_person, F.struct(F.lit(default).alias("name"), F.lit(0).alias("end"), F.lit(False).alias("grounded"))).when(
        run != "", F.struct(run.alias("name"), (F.length(before) + F.length(run)).alias("end"), F.lit(True).alias("grounded"))
    ).otherwise(F.struct(F.coalesce(F.nullif(lead, F.lit("")), F.lit(default)).alias("name"), F.lit(0).alias("end"), F.lit(False).alias("grounded")))


def object_after(sentence: Column, after: Column) -> Column:
    """The first capitalised run that starts at or behind a place, without marks at its end; else the last word; else null.

    Runs are found from the sentence's start, so one that straddles the place is passed over whole: each is marked, and
    places are added up over the marked pieces.
    """
    marked = F.split(F.regexp_replace(sentence, CAP_RUN, "\u0001$0\u0002"), "\u0001", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        run = F.when(F.instr(piece, "\u0002") > 0, F.substring_index(piece, "\u0002", 1)).otherwise(F.lit(""))
        hit = acc["found"].isNull() & (run != "") & (acc["at"] >= after)
        length = F.length(F.replace(piece, F.lit("\u0002"), F.lit("")))
        return F.struct((acc["at"] + length).alias("at"), F.when(hit, run).otherwise(acc["found"]).alias("found"))

    run = F.regexp_replace(F.aggregate(marked, start, step)["found"], rf"{EDGE_CLASS}+$", "")
    tokens = F.filter(
        F.transform(F.split(sentence, rf"{SPACE}+", -1), lambda t: F.regexp_replace(t, rf"^{EDGE_CLASS}+|{EDGE_CLASS}+$", "")), lambda t: t != ""
    )
    return F.coalesce(run, F.try_element_at(tokens, F.lit(-1)))


def confidence(is_first_person: Column, relation_name: Column) -> Column:
    return F.when(is_first_person & relation_name.isin(*EXPLICIT), F.lit(0.9)).otherwise(F.lit(0.4))


def loose_key(name: Column) -> Column:
    """Lower case, trimmed, white space collapsed: the router's fold of names."""
    return F.regexp_replace(F.lower(strip_spaces(name)), rf"{SPACE}+", " ")


def router_reasons(
    text: Column, subject_name: Column, object_name: Column, predicate: Column, conf: Column, grounded: Column, pre_flagged: Column | None = None,
    threshold: float = 0.4, self_name: str = "user",
) -> Column:
    """Why a candidate needs typing, in order; an empty array: it doesn't."""
    pronoun = loose_key(subject_name).isin(*PRONOUNS) | loose_key(object_name).isin(*PRONOUNS)
    leads = text.rlike(rf"(?iu)^{SPACE}*(?:{ELLIPSIS_LEADS}|{VERB_LEADS}){AFTER}")
    coref = F.coalesce(pronoun, F.lit(False)) | (~(grounded | (loose_key(subject_name) == self_name)) & leads)
    derives = F.coalesce(~predicate.isin(*KNOWN_PREDICATES), F.lit(True)) | has_word(text, ROUTER_CUES)
    return F.array_compact(
        F.array(
            F.when(F.lit(False) if pre_flagged is None else pre_flagged, F.lit("pre_flagged")),
            F.when(conf < threshold, F.lit("low_confidence")),
            F.when(coref, F.lit("coreference")),
            F.when(derives, F.lit("derives")),
        )
    )


def typed_relation(text: Column) -> Column:
    return F.when(has_word(text, TYPER_CUES), F.lit("derives")).otherwise(F.lit("asserts"))


def additive(text: Column, predicate: Column) -> Column:
    return has_word(F.coalesce(text, F.lit("")), ADDITIVE_CUES) | F.coalesce(predicate.isin(*MULTIVALUED), F.lit(False))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def salience(text: Column, is_user: Column, is_inference: Column) -> Column:
    """0 to 10: what a statement is worth, by dates, numbers, names, length and where it comes from."""

    def score(t: Column) -> Column:
        date = t.rlike(
            rf"(?iu){BEFORE}(?:\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}|\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{1,2}}(?:[/-]\p{{Nd}}{{2,4}})?|\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}"
            rf"|(?:{MONTHS})[a-z]*\.?{SPACE}+\p{{Nd}}{{1,2}}){AFTER}"
        )
        digits = t.rlike(r"\p{Nd}")  # dates and numbers hold one; most texts need no further look
        number = t.rlike(rf"{BEFORE}\p{{Nd}}+(?:[.,]\p{{Nd}}+)?{AFTER}")
        rest = F.regexp_replace(t, rf"(?s)^[^\p{{L}}\p{{N}}_]*{WORD_CHAR}+{SPACE}*", "")
        proper = rest.rlike(rf"(?s)(?<!^){BEFORE}[A-Z][a-zA-Z]+{AFTER}")
        length = _bound(F.size(F.split(t, rf"{SPACE}+", -1)), lambda n: F.when(n <= 3, F.lit(-2.5)).otherwise(F.least(F.lit(1.8), (n - 3) * 0.18)))
        total = (
            F.lit(4.0)
            + F.when(digits & date, 1.6).otherwise(0.0)
            + F.when(digits & number, 0.9).otherwise(0.0)
            + F.when(proper, 1.2).otherwise(0.0)
            + length
            - F.when(is_inference, 2.0).otherwise(0.0)
            - F.when(is_user, 0.0).otherwise(1.0)
        )
        return F.when(t == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), total)))

    return _bound(strip_spaces(F.coalesce(text, F.lit(""))), score)


@F.arrow_udf(T.StringType())
def normalize_text(texts: pa.Array) -> pa.Array:
    """NFC, full case folding, white space collapsed: Spark has no function for the first two."""
    return pa.array([None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()) for t in texts.to_pylist()], pa.string())


entity_key = normalize_text
_EDGES = string.punctuation + string.whitespace


@F.arrow_udf(T.StringType())
def restatement_key(texts: pa.Array) -> pa.Array:
    """White space collapsed, case folded, punctuation at both ends gone; an empty key never equals another."""
    return pa.array([None if t is None else " ".join(t.split()).casefold().strip(_EDGES) for t in texts.to_pylist()], pa.string())


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and their base letters, by Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def search_tokens(text: Column) -> Column:
    """Terms of the text index: lower case, without diacritics, runs of letters and digits."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def plain_term(token: Column) -> Column:
    """A lower-case token without diacritics; only tokens that have any are rewritten."""
    return F.when(token.rlike(r"[^\x00-\x7f]"), F.translate(token, ACCENTED, PLAIN)).otherwise(token)


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order."""
    table = str.maketrans(ACCENTED, PLAIN)
    folded = query.lower().translate(table)
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in folded).split()))


def normalize_predicate(predicate: Column) -> Column:
    bare = F.regexp_replace(F.lower(strip_spaces(predicate)), rf"^[\"'.,!?;:]+|[\"'.,!?;:]+$", "")
    joined = F.regexp_replace(strip_spaces(bare), rf"{SPACE}+", "_")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("_untyped"))


def relation_from_str(value: Column, default: str = "asserts") -> Column:
    folded = F.lower(strip_spaces(value))
    return F.when(folded.isin("asserts", "supersedes", "extends", "derives"), folded).otherwise(F.lit(default))


def predicate_or_default(predicate: Column) -> Column:
    """An empty predicate of a candidate is `about`."""
    return F.coalesce(F.nullif(predicate, F.lit("")), F.lit("about"))


def is_llm_only(relation: Column) -> Column:
    """Only a model may infer: no deterministic pass gives `derives` without review."""
    return F.coalesce(~relation.isin("asserts", "supersedes", "extends"), F.lit(True))


def triggers_versioning(relation: Column) -> Column:
    """Only `supersedes` retires what a slot holds."""
    return F.coalesce(relation == "supersedes", F.lit(False))


def safe_namespace(namespace: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(namespace, "[^A-Za-z0-9_.-]", "_"), F.lit("")), F.lit("default"))
