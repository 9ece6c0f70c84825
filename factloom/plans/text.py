"""Queries over sentences and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import extract
from factloom.plans.inputs import SENTENCES, T0, episodes, table

BEFORE, AFTER = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def _word(words: str, column: str = "sentence") -> str:
    return rf"regexp_matches({column}, '(?i){BEFORE}(?:{words.replace(chr(39), chr(39) * 2)}){AFTER}')"


_RELATION = "CASE " + " ".join(
    rf"WHEN regexp_matches(sentence, '(?i){BEFORE}{p}{AFTER if bounded else ''}') THEN '{n}'" for n, p, bounded in X.VERBS
) + " END"


def _turn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.split_sentences(episodes(spark, sf_dir))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_sentences(spark, sf_dir).select("namespace", "seq", F.col("pos").cast("long").alias("pos"), "sentence")


def relation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turn_sentences(spark, sf_dir).withColumn("predicate", X.relation(F.col("sentence")))
    return rows.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.first_person(F.col("sentence"))).alias("n_first_person"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.candidates(episodes(spark, sf_dir)).select("namespace", "seq", "pos", "subject_name", "predicate", "object_literal", "confidence", "grounded", "t_ref")


def router_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.router_stats(extract.route(extract.candidates(episodes(spark, sf_dir))), ["namespace"])


def escalation_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts a turn and the median length of facts."""
    found = extract.candidates(episodes(spark, sf_dir))
    turns = table(spark, sf_dir, "conversations").agg(F.count(F.lit(1)).alias("turns"))
    facts = found.agg(F.count(F.lit(1)).alias("facts"), F.percentile(F.length("sentence"), 0.5).cast("int").alias("median_chars"))
    return facts.join(F.broadcast(turns)).withColumn("facts_per_turn", F.round(F.col("facts") / F.col("turns"), 6))  # two single rows


def episode_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode with the number of facts it gave; facts are counted before the join."""
    turns = episodes(spark, sf_dir).select("namespace", "seq", "source", "t_ref")
    counts = extract.candidates(episodes(spark, sf_dir)).groupBy("namespace", "seq").agg(F.count(F.lit(1)).alias("n"))
    return turns.join(counts, ["namespace", "seq"], "left").withColumn("facts", F.coalesce("n", F.lit(0))).drop("n")


def router_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentence")
    return _turn_sentences(spark, sf_dir).select(
        "namespace", "seq", F.col("pos").cast("long").alias("pos"),
        X.has_word(s, X.ROUTER_CUES).alias("router_cue"), (X.typed_relation(s) == "derives").alias("derives"), X.has_word(s, X.ADDITIVE_CUES).alias("additive"),
        s.rlike(rf"(?iu)^{X.SPACE}*(?:{X.ELLIPSIS_LEADS}|{X.VERB_LEADS}){X.AFTER}").alias("leads"),
    )


def typer_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turn_sentences(spark, sf_dir).withColumn("relation", X.typed_relation(F.col("sentence")))
    return rows.groupBy("namespace", "relation").agg(F.count(F.lit(1)).alias("n"))


def salience_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.round(X.salience(F.col("text"), F.col("lang") == "en", F.col("source") == "src1"), 6).alias("salience"))
    return rows


def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions: each document's first word, in the namespace of its source."""
    mentions = table(spark, sf_dir, "documents").select(
        F.col("source").alias("namespace"), F.get(F.split(F.col("text"), "[ \n\t]", -1), F.lit(0)).alias("subject_name"), F.col("doc_id").alias("seq")
    )
    return extract.resolve_entities(mentions).select("namespace", "name_key", "name", "first_seq")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalize_text("text"), 256).alias("norm_sha256"))


def restatement_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.restatement_key("text"), 256).alias("key_sha256"))


def predicate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.initcap("p_type").alias("p_type"), "p_brand")
    return rows.select(
        "p_partkey", X.normalize_predicate(F.concat(F.lit(" '"), "p_type", F.lit("!' "))).alias("predicate"), X.safe_namespace(F.col("p_brand")).alias("namespace"),
        X.relation_from_str(F.when(F.col("p_partkey") % 3 == 0, " Derives ").otherwise(F.col("p_type"))).alias("relation"),
    )


def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.operators.evaluate import transcript

    rows = episodes(spark, sf_dir)
    return transcript(rows, "namespace", "seq", "source", "raw", "t_ref").select("namespace", F.sha2("transcript", 256).alias("transcript_sha256"))


_DATE = (
    r"\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?|\d{1,2}:\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}"
)
#: normalize_text and restatement_key in SQL; characters of these tables fold like lower case but for the sharp s.
NORMAL = r"trim(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '\s+', ' ', 'g'))"
#: Punctuation and white space, as a class in SQL.
_EDGES = "[" + "".join("''" if c == "'" else "\\" + c for c in '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~') + r" \t\n\r\x0b\x0c]+"
RESTATED = rf"regexp_replace(regexp_replace(trim(regexp_replace(replace(lower({{0}}), 'ß', 'ss'), '\s+', ' ', 'g')), '^{_EDGES.replace('{', '{{').replace('}', '}}')}', ''), '{_EDGES.replace('{', '{{').replace('}', '}}')}$', '')"
WORD = _word


_W = r"[^\p{L}\p{N}_]"


def _end(pattern: str, bounded: bool) -> str:
    return rf"length(regexp_extract(sentence, '(?is)^(.*?(?:^|{_W}){pattern}){'(?:' + _W + '|$)' if bounded else ''}', 1))"


_ENDS = "CASE predicate " + " ".join(f"WHEN '{n}' THEN {_end(p, b)}" for n, p, b in X.VERBS) + " END"
_STRIP = "trim({0}, '.,!?;:''\"')"
_LEAD = _STRIP.format(r"string_split_regex(trim(sentence), '\s+')[1]")
#: Candidates in SQL: capitalised runs are marked, and their places added up over the pieces.
CANDIDATES = rf"""{SENTENCES},
re AS (SELECT *, {_RELATION} AS predicate, {_word(X.FIRST_PERSON)} AS first_person FROM sp),
mk AS (
  SELECT *, {_ENDS} AS verb_end,
    string_split(regexp_replace(sentence, '(^|{_W})([A-Z][\p{{L}}\p{{N}}_.&-]*(?:\s+[A-Z][\p{{L}}\p{{N}}_.&-]*)*)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) AS ps,
    list_filter(list_transform(string_split_regex(sentence, '\s+'), lambda t: {_STRIP.format("t")}), lambda t: t <> '') AS tokens
  FROM re WHERE predicate IS NOT NULL),
ru AS (
  SELECT *, list_transform(range(2, len(ps) + 1), lambda i: {{'at': coalesce(list_sum(list_transform(ps[1:i - 1], lambda p: length(replace(p, chr(2), '')))), 0), 'run': string_split(ps[i], chr(2))[1]}}) AS runs
  FROM mk),
su AS (SELECT *, NOT first_person AND len(runs) > 0 AS grounded, CASE WHEN first_person OR len(runs) = 0 THEN 0 ELSE runs[1].at + length(runs[1].run) END AS subject_end FROM ru),
ob AS (SELECT *, list_filter(runs, lambda r: r.at >= greatest(subject_end, verb_end))[1].run AS run FROM su),
ca AS (
  SELECT namespace, seq, pos, sentence, t_ref, predicate, grounded,
    CASE WHEN first_person THEN 'user' WHEN grounded THEN runs[1].run ELSE coalesce(nullif({_LEAD}, ''), 'user') END AS subject_name,
    coalesce(regexp_replace(run, '[.,!?;:''"]+$', ''), tokens[-1]) AS object_literal,
    CASE WHEN first_person AND predicate IN ({", ".join(f"'{e}'" for e in X.EXPLICIT)}) THEN 0.9 ELSE 0.4 END::DOUBLE AS confidence
  FROM ob WHERE run IS NOT NULL OR len(tokens) > 0)"""
_LOOSE = "regexp_replace(lower(trim({0})), '\\s+', ' ', 'g')"
_PRONOUNS = ", ".join(f"'{x}'" for x in X.PRONOUNS)
#: The router's reasons in SQL; predicates of the patterns are all known.
ROUTED = f"""{CANDIDATES},
ro AS (
  SELECT *, {_LOOSE.format("subject_name")} IN ({_PRONOUNS}) OR {_LOOSE.format("object_literal")} IN ({_PRONOUNS})
      OR (NOT grounded AND {_LOOSE.format("subject_name")} <> 'user' AND regexp_matches(sentence, '(?i)^\\s*(?:{X.ELLIPSIS_LEADS}|{X.VERB_LEADS}){AFTER}')) AS coref,
    {_word(X.ROUTER_CUES)} AS derives
  FROM ca)"""
QUERIES = {
    f.__name__: f
    for f in (
        sentences, relation_match, candidates, router_stats, escalation_probe, episode_facts, router_cues, typer_relation, salience_score, entity_resolve, normalize_text,
        restatement_key, predicate_forms, transcript_render,
    )
}
ORACLES = {
    "sentences": f"WITH {SENTENCES} SELECT namespace, seq, pos, sentence FROM sp",
    "relation_match": f"WITH {SENTENCES} SELECT {_RELATION} AS predicate, count(*) AS n, count_if({_word(X.FIRST_PERSON)})::BIGINT AS n_first_person FROM sp GROUP BY 1",
    "candidates": f"WITH {CANDIDATES} SELECT namespace, seq, pos::INT AS pos, subject_name, predicate, object_literal, confidence, grounded, t_ref FROM ca",
    "router_stats": f"""WITH {ROUTED}
SELECT namespace, count(*) AS seen, count_if(coref OR derives)::BIGINT AS escalated, 0::BIGINT AS n_pre_flagged, 0::BIGINT AS n_low_confidence, count_if(coref)::BIGINT AS n_coreference,
  count_if(derives)::BIGINT AS n_derives, count_if(coref OR derives) / count(*) AS rate FROM ro GROUP BY namespace""",
    "escalation_probe": f"""WITH {CANDIDATES}
SELECT count(*) AS facts, floor(quantile_cont(length(sentence), 0.5))::INT AS median_chars, (SELECT count(*) FROM conversations) AS turns, round(count(*) / (SELECT count(*) FROM conversations), 6) AS facts_per_turn FROM ca""",
    "episode_facts": f"WITH {CANDIDATES} SELECT namespace, seq, ep.source, ep.t_ref, count(ca.pos) AS facts FROM ep LEFT JOIN ca USING (namespace, seq) GROUP BY ALL",
    "router_cues": f"""WITH {SENTENCES} SELECT namespace, seq, pos, {_word(X.ROUTER_CUES)} AS router_cue, {_word(X.TYPER_CUES)} AS derives, {_word(X.ADDITIVE_CUES)} AS additive,
  regexp_matches(sentence, '(?i)^\\s*(?:{X.ELLIPSIS_LEADS}|{X.VERB_LEADS}){AFTER}') AS leads FROM sp""",
    "typer_relation": f"WITH {SENTENCES} SELECT namespace, CASE WHEN {_word(X.TYPER_CUES)} THEN 'derives' ELSE 'asserts' END AS relation, count(*) AS n FROM sp GROUP BY ALL",
    "salience_score": rf"""
WITH d AS (SELECT doc_id, lang, source, trim(text, E' \n\t\r') AS t FROM documents),
s AS (
  SELECT doc_id, t, 4.0
    + CASE WHEN regexp_matches(t, '(?i){BEFORE}(?:{_DATE}){AFTER}') THEN 1.6 ELSE 0 END
    + CASE WHEN regexp_matches(t, '{BEFORE}\d+(?:[.,]\d+)?{AFTER}') THEN 0.9 ELSE 0 END
    + CASE WHEN regexp_matches(regexp_replace(t, '(?s)^[^\p{{L}}\p{{N}}_]*[\p{{L}}\p{{N}}_]+\s*', ''), '(?s).{BEFORE.replace("^|", "")}[A-Z][a-zA-Z]+{AFTER}')
             OR regexp_matches(regexp_replace(t, '(?s)^[^\p{{L}}\p{{N}}_]*[\p{{L}}\p{{N}}_]+\s*', ''), '(?s)^[^\p{{L}}\p{{N}}_][A-Z][a-zA-Z]+{AFTER}') THEN 1.2 ELSE 0 END
    + CASE WHEN len(string_split_regex(t, '\s+')) <= 3 THEN -2.5 ELSE least(1.8, (len(string_split_regex(t, '\s+')) - 3) * 0.18) END
    - CASE WHEN source = 'src1' THEN 2.0 ELSE 0 END - CASE WHEN lang = 'en' THEN 0 ELSE 1.0 END AS v
  FROM d)
SELECT doc_id, round(CASE WHEN t = '' THEN 0 ELSE greatest(0, least(10, v)) END, 6)::DOUBLE AS salience FROM s""",
    "entity_resolve": f"""
WITH m AS (SELECT source AS namespace, string_split_regex(text, '[ \\n\\t]')[1] AS name, doc_id FROM documents),
k AS (SELECT namespace, {NORMAL.format("name")} AS name_key, name, doc_id FROM m)
SELECT namespace, name_key, arg_min(name, doc_id) AS name, min(doc_id) AS first_seq FROM k GROUP BY ALL""",
    "normalize_text": f"SELECT doc_id, sha256({NORMAL.format('text')}) AS norm_sha256 FROM documents",
    "restatement_key": f"SELECT doc_id, sha256({RESTATED.format('text')}) AS key_sha256 FROM documents",
    "predicate_forms": """
SELECT p_partkey, replace(lower(p_type), ' ', '_') AS predicate, regexp_replace(p_brand, '[^A-Za-z0-9_.-]', '_', 'g') AS namespace,
  CASE WHEN p_partkey % 3 = 0 THEN 'derives' ELSE 'asserts' END AS relation FROM part""",
    "transcript_render": f"""
SELECT conv_id AS namespace, sha256(string_agg('[' || strftime(make_timestamp(({T0} + turn * 1000) * 1000), '%Y-%m-%d') || '] ' ||
  CASE WHEN starts_with(coalesce(text, ''), role || ':') THEN text ELSE role || ': ' || coalesce(text, '') END, chr(10) ORDER BY turn)) AS transcript_sha256
FROM conversations GROUP BY conv_id""",
}
