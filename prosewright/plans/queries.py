"""The registered queries over whole tables, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import changelog as C
from ..operators import evaluate as E
from ..operators import protection as P
from ..operators import rewrite as R
from ..operators import segments as G
from ..operators import stylometry as S
from ..operators import verify as V
from ..operators.claims import claims as claim_rows
from ..sources import files
from ..sources.providers import Stub
from . import oracle as O
from .drafts import DRAFTS, REWRITES, rewrites

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DRAFTS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(rewrites("{drafts}"), drafts=drafts(spark, sf_dir))


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def big(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


def six(*cols: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)


# stylometry


@query(f"WITH {O.sentences('documents', 'doc_id')} SELECT doc_id, sent_idx, s AS sentence FROM sents")
def sentence_split(spark, sf_dir):
    rows = T.each(docs_of(spark, sf_dir), ["doc_id"], T.sentences(F.coalesce("text", F.lit(""))), "sent_idx", "sentence")
    return longs(rows, "sent_idx")


LENGTHS = ("n_sentences", "n_words", "min_length", "max_length")


@query(f"WITH {O.per_document('documents')} SELECT doc_id, {big(*LENGTHS)}, {six('mean_length', 'length_variance')} FROM nom")
def sentence_length_stats(spark, sf_dir):
    df = S.base(docs_of(spark, sf_dir)).withColumns(S.length_stats())
    return rounded(longs(df, *LENGTHS), "mean_length", "length_variance").select("doc_id", *LENGTHS, "mean_length", "length_variance")


COUNTS = ("n_connectives", "n_hedges", "n_moreover", "n_diction")


@query(f"WITH {O.DRAFT_CTE} SELECT doc_id, " + ", ".join(f"CAST({O.count_phrases('text', e)} AS BIGINT) AS {n}" for n, e in zip(COUNTS, (L.CONNECTIVES, L.HEDGES, L.MOREOVER_FAMILY, L.DICTION), strict=True)) + " FROM drafts")
def lexicon_density(spark, sf_dir):
    return longs(drafts(spark, sf_dir).withColumns(S.lexicon_counts(F.col("text"))), *COUNTS).select("doc_id", *COUNTS)


@query(f"WITH {O.DRAFT_CTE} SELECT doc_id, CAST({O.count_plain('text', L.HOLLOW)} AS BIGINT) AS n_hollow FROM drafts")
def hollow_phrase_count(spark, sf_dir):
    return drafts(spark, sf_dir).select("doc_id", S.hollow(F.col("text")).cast("long").alias("n_hollow"))


@query(f"WITH {O.per_document('documents')} SELECT doc_id, {big('n_passive')}, round(CASE WHEN n_sentences = 0 THEN 0 ELSE n_passive / n_sentences END, 6) AS passive_ratio, round(CASE WHEN n_passive > 0 THEN (n_sentences - n_passive) / n_passive END, 6) AS active_to_passive FROM nom")
def passive_ratio(spark, sf_dir):
    df = S.features(docs_of(spark, sf_dir))
    return rounded(longs(df, "n_passive"), "passive_ratio", "active_to_passive").select("doc_id", "n_passive", "passive_ratio", "active_to_passive")


@query(f"WITH {O.per_document('documents')} SELECT doc_id, {big('n_nominal')}, round(CASE WHEN n_words = 0 THEN 0 ELSE 100.0 * n_nominal / n_words END, 6) AS nominalisation_rate FROM nom")
def nominalisation_rate(spark, sf_dir):
    df = S.base(docs_of(spark, sf_dir)).withColumn("n_nominal", S.nominalisations())
    df = df.withColumn("nominalisation_rate", T.ratio(F.col("n_nominal") * 100.0, F.size("_words")))
    return rounded(longs(df, "n_nominal"), "nominalisation_rate").select("doc_id", "n_nominal", "nominalisation_rate")


@query(f"WITH {O.per_document('documents')} SELECT doc_id, {six('clause_depth')} FROM nom")
def clause_depth(spark, sf_dir):
    return rounded(S.base(docs_of(spark, sf_dir)).withColumn("clause_depth", S.clause_depth()), "clause_depth").select("doc_id", "clause_depth")


@query(f"""WITH {O.sentences('documents', 'doc_id')},
f AS (SELECT doc_id, lower({O.words('s')}[1]) AS w, sent_idx FROM sents), c AS (SELECT doc_id, w, count(*) AS n, min(sent_idx) AS i FROM f WHERE w IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT doc_id, sum(n) AS uniform_openings, arg_max(w, n * 100000 - i) AS top_opening, max(n) AS top_opening_count FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(uniform_openings, 0) AS BIGINT) AS uniform_openings, top_opening, CAST(coalesce(top_opening_count, 0) AS BIGINT) AS top_opening_count FROM documents d LEFT JOIN t USING (doc_id)""")
def opening_repetition(spark, sf_dir):
    df = S.opening_columns(S.base(docs_of(spark, sf_dir)))
    return longs(df, "uniform_openings", "top_opening_count").select("doc_id", "uniform_openings", "top_opening", "top_opening_count")


TELLS = ("n_diction", "n_hollow", "n_moreover", "n_tricolons", "n_dashes")


@query(f"""WITH {O.DRAFT_CTE} SELECT doc_id, CAST({O.count_phrases('text', L.DICTION)} AS BIGINT) AS n_diction, CAST({O.count_plain('text', L.HOLLOW)} AS BIGINT) AS n_hollow,
CAST({O.count_phrases('text', L.MOREOVER_FAMILY)} AS BIGINT) AS n_moreover, CAST(len(regexp_extract_all(lower(text), {O.quote(O.TRICOLON)})) AS BIGINT) AS n_tricolons, CAST(len(regexp_extract_all(text, '[—–]')) AS BIGINT) AS n_dashes FROM drafts""")
def tells(spark, sf_dir):
    return longs(S.features(drafts(spark, sf_dir)), *TELLS).select("doc_id", *TELLS)


REPORT = ("mean_length", "passive_ratio", "hedging_density", "nominalisation_rate", "clause_depth")
REPORT_SQL = f"""{O.per_document('documents')},
report AS (SELECT doc_id, {big('n_words', 'n_sentences')}, {six('mean_length')}, round_even(round(length_variance, 6), 2) AS length_variance, round(CASE WHEN n_sentences = 0 THEN 0 ELSE n_passive / n_sentences END, 6) AS passive_ratio,
 round(CASE WHEN n_words = 0 THEN 0 ELSE 100.0 * ({O.count_words("coalesce(text, '')", L.HEDGES)}) / n_words END, 6) AS hedging_density, round(CASE WHEN n_words = 0 THEN 0 ELSE 100.0 * n_nominal / n_words END, 6) AS nominalisation_rate,
 {six('clause_depth')}, round(CAST(n_sentences AS DOUBLE), 6) AS paragraph_mean, CASE WHEN n_words = 0 THEN 'none' WHEN n_words < 80 THEN 'low' ELSE 'ok' END AS confidence FROM nom)"""


@query(f"WITH {REPORT_SQL} SELECT * FROM report")
def style_report(spark, sf_dir):
    return rounded(longs(S.style_report(docs_of(spark, sf_dir)).drop("text"), "n_words", "n_sentences"), *REPORT, "paragraph_mean")


@query(f"""WITH {REPORT_SQL} SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n_docs, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(n_sentences) AS BIGINT) AS n_sentences, round(avg(passive_ratio), 6) AS passive_ratio
FROM report JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def style_by_lang_rollup(spark, sf_dir):
    df = rounded(S.features(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), "passive_ratio")
    out = df.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_words").cast("long").alias("n_words"), F.sum("n_sentences").cast("long").alias("n_sentences"), F.round(F.avg("passive_ratio"), 6).alias("passive_ratio"))
    return out.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("lang", "source")})


# segmentation


@query(f"WITH {O.DRAFT_CTE}, {O.segments()} SELECT * FROM segs")
def segment_blocks(spark, sf_dir):
    return longs(G.segments(drafts(spark, sf_dir)), "seg_idx")


@query(f"WITH {O.DRAFT_CTE}, {O.segments()} SELECT doc_id, count(*) AS segments, count(*) FILTER (heading) AS headings, count(*) FILTER (frozen) AS frozen, bool_or(heading) AS section_aware, CASE WHEN NOT bool_or(heading) THEN {O.quote(L.NO_HEADINGS)} END AS message FROM segs GROUP BY doc_id")
def segment_report(spark, sf_dir):
    return G.segment_report(G.segments(drafts(spark, sf_dir)))


@query(f"WITH {O.DRAFT_CTE}, {O.segments()} SELECT doc_id, seg_idx, section, CASE WHEN section IN ('methods', 'results') THEN 'conservative' ELSE 'enhanced' END AS intensity FROM segs WHERE NOT frozen")
def intensity_plan(spark, sf_dir):
    rows = G.segments(drafts(spark, sf_dir)).filter("not frozen")
    return longs(rows.withColumn("intensity", G.intensity(F.col("section"), "enhanced")), "seg_idx").select("doc_id", "seg_idx", "section", "intensity")


# protection

NATIVE = ["url", "cite_num", "p_value"]
URL = "https?://[^\\s)\\]]+"
P_VALUE = "(?i)\\bp\\s*[<>=≤≥]\\s*\\.?\\d+(\\.\\d+)?"


@query(f"""WITH {O.DRAFT_CTE} SELECT doc_id, CAST(len(regexp_extract_all(text, 'https?://[^\\s)\\]]+')) AS BIGINT) AS url, CAST(len(regexp_extract_all(text, '\\[\\s*\\d+(\\s*[-–,]\\s*\\d+)*\\s*\\]')) AS BIGINT) AS cite_num,
CAST(len(regexp_extract_all(text, '(?i)\\bp\\s*[<>=≤≥]\\s*\\.?\\d+(\\.\\d+)?')) AS BIGINT) AS p_value FROM drafts""")
def protected_span_counts(spark, sf_dir):
    return longs(drafts(spark, sf_dir).withColumns(P.span_counts(F.col("text"), NATIVE)), *NATIVE).select("doc_id", *NATIVE)


@query(f"""WITH {O.DRAFT_CTE}, every AS (SELECT 'document' AS origin, doc_id, text FROM documents UNION ALL SELECT 'draft', doc_id, text FROM drafts)
SELECT origin, doc_id, md5(text) AS restored_md5, true AS ok, len(regexp_extract_all(text, '{URL}'))::BIGINT AS url, len(regexp_extract_all(text, '{P_VALUE}'))::BIGINT AS p_value, contains(text, 'http') AND regexp_matches(text, '{URL}') AS changed FROM every""")
def mask_round_trip(spark, sf_dir):
    every = docs_of(spark, sf_dir).select(F.lit("document").alias("origin"), "doc_id", "text").unionByName(drafts(spark, sf_dir).withColumn("origin", F.lit("draft")))
    df = every.withColumn("p", P.protect(F.col("text")))
    check = P.integrity(F.col("p.masked"), P.top_tokens(F.col("p.spans")))
    of = lambda kind: F.size(F.filter("p.spans", lambda x: x["kind"] == kind)).cast("long").alias(kind)
    # masked: no address is left where the text had one
    gone = F.contains("text", F.lit("http")) & (F.regexp_count("text", F.lit(URL)) > 0) & ~F.contains("p.masked", F.lit("http"))
    return df.select("origin", "doc_id", F.md5(P.restore(F.col("p.masked"), F.col("p.spans"))).alias("restored_md5"), check["ok"].alias("ok"), of("url"), of("p_value"), gone.alias("changed"))


MASKED_SQL = f"""{O.DRAFT_CTE}, m AS (SELECT doc_id, ['⟦PA⟧', '⟦PB⟧', '⟦PC⟧'] AS tokens, unnest(['keep', 'drop', 'repeat', 'invent']) AS fate FROM drafts),
o AS (SELECT doc_id, fate, tokens, CASE fate WHEN 'keep' THEN '⟦PA⟧ x ⟦PB⟧ y ⟦PC⟧' WHEN 'drop' THEN '⟦PA⟧ x y ⟦PC⟧' WHEN 'repeat' THEN '⟦PA⟧ ⟦PB⟧ ⟦PB⟧ ⟦PC⟧' ELSE '⟦PC⟧ ⟦PB⟧ ⟦PA⟧ ⟦PZ⟧' END AS output FROM m),
f AS (SELECT *, regexp_extract_all(output, '⟦P[A-Z]+⟧') AS found FROM o)"""


@query(f"""WITH {MASKED_SQL}, g AS (SELECT doc_id, fate, array_to_string(list_filter(tokens, lambda t: len(list_filter(found, lambda x: x = t)) = 0), ' ') AS missing,
array_to_string(list_filter(tokens, lambda t: len(list_filter(found, lambda x: x = t)) > 1), ' ') AS duplicated, array_to_string(list_sort(list_distinct(list_filter(found, lambda x: NOT list_contains(tokens, x)))), ' ') AS unexpected FROM f)
SELECT doc_id, fate, missing, duplicated, unexpected, missing = '' AND duplicated = '' AND unexpected = '' AS ok FROM g""")
def placeholder_integrity(spark, sf_dir):
    fates = {"keep": "⟦PA⟧ x ⟦PB⟧ y ⟦PC⟧", "drop": "⟦PA⟧ x y ⟦PC⟧", "repeat": "⟦PA⟧ ⟦PB⟧ ⟦PB⟧ ⟦PC⟧", "invent": "⟦PC⟧ ⟦PB⟧ ⟦PA⟧ ⟦PZ⟧"}
    rows = drafts(spark, sf_dir).select("doc_id", F.explode(F.create_map(*[F.lit(x) for kv in fates.items() for x in kv])).alias("fate", "output"))
    rows = rows.withColumn("v", P.integrity(F.col("output"), F.array(*map(F.lit, ("⟦PA⟧", "⟦PB⟧", "⟦PC⟧")))))
    return rows.select("doc_id", "fate", *[F.array_join(f"v.{c}", " ").alias(c) for c in ("missing", "duplicated", "unexpected")], "v.ok")


LOST = "len(list_filter(list_distinct(regexp_extract_all({o}, '" + P_VALUE + "')), lambda x: (length({r}) - length(replace({r}, x, ''))) < length(x) * len(list_filter(regexp_extract_all({o}, '" + P_VALUE + "'), lambda y: y = x))))"


@query(f"""WITH {O.PAIR_CTE}, p AS (SELECT doc_id, model_id, rewritten, regexp_extract_all(original, '{P_VALUE}') AS every FROM pairs), one AS (SELECT *, unnest(list_distinct(every)) AS span FROM p),
n AS (SELECT doc_id, model_id, span, CAST(len(list_filter(every, lambda x: x = span)) AS INT) AS expected, CAST((length(rewritten) - length(replace(rewritten, span, ''))) / length(span) AS INT) AS present FROM one)
SELECT * FROM n WHERE present < expected""")
def missing_spans(spark, sf_dir):
    return P.missing_spans(pairs(spark, sf_dir).drop("input_pos"))


# claims

CLAIM = ("subject", "relation", "object", "sentence")


@query(f"WITH {O.DRAFT_CTE}, {O.claims('drafts', 'doc_id', 'text')} SELECT doc_id, sent_idx, subject, relation, object, CAST(hedge AS BIGINT) AS hedge, sentence FROM claims")
def claims(spark, sf_dir):
    return longs(claim_rows(drafts(spark, sf_dir)), "sent_idx", "hedge")


@query(f"WITH {O.PAIR_CTE}, {O.claims('pairs', 'model_id, doc_id', 'rewritten')} SELECT model_id, CAST(hedge AS BIGINT) AS hedge, count(*) AS n FROM claims GROUP BY ALL")
def hedge_histogram(spark, sf_dir):
    rows = claim_rows(pairs(spark, sf_dir).select("model_id", "doc_id", F.col("rewritten").alias("text")))
    return longs(rows.groupBy("model_id", "hedge").agg(F.count("*").alias("n")), "hedge")


# verification


def sides(spark, sf_dir, provider: str) -> tuple[DataFrame, DataFrame]:
    """Segments of the drafts, and of what one provider makes of them."""
    segs = G.segments(drafts(spark, sf_dir))
    how = F.expr(REWRITES[provider].format(t="text"))
    return segs, segs.withColumn("text", F.when(F.col("frozen"), F.col("text")).otherwise(how))


def drift_sql(provider: str) -> str:
    """CTEs that end in ``drift``: claims of a segment and its rewrite, sentence by sentence, as these providers keep sentences in place."""
    return f"""{O.DRAFT_CTE}, {O.segments()}, prose AS (SELECT *, {REWRITES[provider].format(t='text')} AS rewritten FROM segs WHERE NOT frozen),
{O.claims('prose', 'doc_id, seg_idx', 'text', 'ca')}, {O.claims('prose', 'doc_id, seg_idx', 'rewritten', 'cb')},
side AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.seg_idx, b.seg_idx) AS seg_idx, coalesce(a.sent_idx, b.sent_idx) AS sent_idx, a.sentence AS before, b.sentence AS after, CAST(a.hedge AS BIGINT) AS before_hedge, CAST(b.hedge AS BIGINT) AS after_hedge
  FROM ca a FULL JOIN cb b ON a.doc_id = b.doc_id AND a.seg_idx = b.seg_idx AND a.sent_idx = b.sent_idx),
drift AS (SELECT *, CASE WHEN after IS NULL THEN 'dropped' WHEN before IS NULL THEN 'added' WHEN after_hedge > before_hedge THEN 'strengthened' WHEN after_hedge < before_hedge THEN 'weakened' END AS kind FROM side)"""


@query(f"""WITH {drift_sql('strengthen')} SELECT doc_id, seg_idx, row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY kind = 'added', sent_idx) - 1 AS flag_idx, kind,
CASE WHEN kind <> 'added' THEN before END AS before, CASE WHEN kind <> 'dropped' THEN after END AS after, before_hedge, after_hedge FROM drift WHERE kind IS NOT NULL""")
def claim_drift(spark, sf_dir):
    return longs(V.claim_flags(V.pair_segments(*sides(spark, sf_dir, "strengthen"))), "seg_idx", "flag_idx", "before_hedge", "after_hedge")


@query(f"""WITH {O.DRAFT_CTE}, {O.segments()}, cut AS (SELECT *, regexp_replace(text, '^[^.]*\\.\\s+', '') AS shorter FROM segs WHERE NOT frozen),
{O.sentences('cut', 'doc_id, seg_idx', 'text', 'so')}, {O.sentences('cut', 'doc_id, seg_idx', 'shorter', 'sr')},
n AS (SELECT doc_id, seg_idx, section, (SELECT count(*) FROM so WHERE so.doc_id = cut.doc_id AND so.seg_idx = cut.seg_idx) AS before, (SELECT count(*) FROM sr WHERE sr.doc_id = cut.doc_id AND sr.seg_idx = cut.seg_idx) AS after FROM cut),
t AS (SELECT *, CASE WHEN section IN ('methods', 'results') THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS tolerance FROM n)
SELECT * FROM t WHERE before > 0 AND abs(after - before) > tolerance * before""")
def sentence_flags(spark, sf_dir):
    segs = G.segments(drafts(spark, sf_dir))
    shorter = segs.withColumn("text", F.when(F.col("frozen"), F.col("text")).otherwise(F.regexp_replace("text", r"^[^.]*\.\s+", "")))
    return longs(V.sentence_flags(V.pair_segments(segs, shorter)), "seg_idx", "before", "after")


@query(f"""WITH {drift_sql('broken')},
fl AS (SELECT doc_id, sum({LOST.format(o='text', r='rewritten')}) AS n FROM prose GROUP BY doc_id),
cf AS (SELECT doc_id, count(*) AS n FROM drift WHERE kind IS NOT NULL GROUP BY doc_id),
sa AS (SELECT doc_id, seg_idx, count(*) AS n FROM ca_s GROUP BY ALL), sb AS (SELECT doc_id, seg_idx, count(*) AS n FROM cb_s GROUP BY ALL),
sf AS (SELECT doc_id, count(*) AS n FROM prose JOIN sa USING (doc_id, seg_idx) LEFT JOIN sb USING (doc_id, seg_idx)
  WHERE abs(coalesce(sb.n, 0) - sa.n) > (CASE WHEN section IN ('methods', 'results') THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END) * sa.n GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(fl.n, 0) AS BIGINT) AS fidelity_failures, coalesce(cf.n, 0) AS claim_flags, coalesce(sf.n, 0) AS sentence_flags, coalesce(fl.n, 0) = 0 AS passed
FROM drafts d LEFT JOIN fl USING (doc_id) LEFT JOIN cf USING (doc_id) LEFT JOIN sf USING (doc_id)""")
def verify_report(spark, sf_dir):
    return V.verify(*sides(spark, sf_dir, "broken"))


# evaluation

TOP = "(SELECT model_id, doc_id, count(*) AS n, max(hedge) AS top FROM {t} GROUP BY ALL)"
FIDELITY_SQL = f"""{O.PAIR_CTE}, {O.claims('pairs', 'model_id, doc_id', 'original', 'ca')}, {O.claims('pairs', 'model_id, doc_id', 'rewritten', 'cb')},
na AS (SELECT model_id, doc_id, count(*) AS n FROM ca_s GROUP BY ALL), nb AS (SELECT model_id, doc_id, count(*) AS n FROM cb_s GROUP BY ALL),
fid AS (SELECT p.*, NOT contains(rewritten, '⟦P') AS placeholders_ok, coalesce(a.n, 0) AS claims_before, coalesce(b.n, 0) AS claims_after, coalesce(b.top > a.top, false) AS claim_strengthened, coalesce(b.top < a.top, false) AS claim_weakened,
 coalesce(nb.n, 0) - coalesce(na.n, 0) AS sentence_delta, coalesce(na.n, 0) > 0 AND abs(coalesce(nb.n, 0) - coalesce(na.n, 0)) > 0.5 * coalesce(na.n, 0) AS sentence_flag
 FROM pairs p LEFT JOIN {TOP.format(t='ca')} a USING (model_id, doc_id) LEFT JOIN {TOP.format(t='cb')} b USING (model_id, doc_id) LEFT JOIN na USING (model_id, doc_id) LEFT JOIN nb USING (model_id, doc_id))"""
FIDELITY = ("claims_before", "claims_after", "sentence_delta")


@query(f"WITH {FIDELITY_SQL} SELECT doc_id, model_id, placeholders_ok, {big(*FIDELITY)}, claim_strengthened, claim_weakened, sentence_flag, placeholders_ok AND NOT claim_strengthened AS passed FROM fid")
def fidelity_gate(spark, sf_dir):
    df = E.fidelity(pairs(spark, sf_dir))
    return longs(df, *FIDELITY).select("doc_id", "model_id", "placeholders_ok", *FIDELITY, "claim_strengthened", "claim_weakened", "sentence_flag", "passed")


def tell_sql(t: str) -> dict[str, str]:
    return {"diction": O.count_phrases(t, L.DICTION), "hollow": O.count_plain(t, L.HOLLOW), "moreover": O.count_phrases(t, L.MOREOVER_FAMILY), "tricolons": f"len(regexp_extract_all(lower({t}), {O.quote(O.TRICOLON)}))", "dashes": f"len(regexp_extract_all({t}, '[—–]'))"}


QUALITY_SQL = f"""{O.PAIR_CTE}, {O.sentences('pairs', 'model_id, doc_id', 'rewritten', 'sr')},
lv AS (SELECT model_id, doc_id, count(*) AS n_sentences, coalesce(var_pop(len({O.words('s')})) FILTER (len({O.words('s')}) > 0), 0) AS v FROM sr GROUP BY ALL),
tl AS (SELECT *, {', '.join(f'{q} AS a_{k}' for k, q in tell_sql('rewritten').items())}, {' + '.join(tell_sql('original').values())} AS tells_before FROM pairs),
qu AS (SELECT *, a_diction + a_hollow + a_moreover + a_tricolons + a_dashes AS tells_after,
  a_diction * 2 + a_hollow * 2 + a_dashes * 3 + a_moreover + a_tricolons + CASE WHEN n_sentences > 1 AND v < 4.0 THEN 2 ELSE 0 END AS penalty FROM tl JOIN lv USING (model_id, doc_id))"""


@query(f"WITH {QUALITY_SQL} SELECT doc_id, model_id, {big('tells_before', 'tells_after', 'penalty')}, round(1.0::DOUBLE / (1 + penalty), 6) AS quality FROM qu")
def quality_score(spark, sf_dir):
    df = rounded(longs(E.scorecards(pairs(spark, sf_dir)), "tells_before", "tells_after", "penalty"), "quality")
    return df.select("doc_id", "model_id", "tells_before", "tells_after", "penalty", "quality")


def voice_of(spark, sf_dir) -> DataFrame:
    """The profile of document 3, as an author's sample."""
    return S.features(docs_of(spark, sf_dir).filter("doc_id = 3"))


@query(f"""WITH {O.DRAFT_CTE}, one AS (SELECT * FROM documents WHERE doc_id = 3), both_ AS (SELECT doc_id, text FROM drafts UNION ALL SELECT -1, text FROM one), {O.per_document('both_')},
fx AS (SELECT doc_id, mean_length AS m, n_passive / n_sentences AS p, 100.0::DOUBLE * ({O.count_words('text', L.HEDGES)}) / n_words AS h, 100.0::DOUBLE * n_nominal / n_words AS o FROM nom),
dist AS (SELECT a.doc_id, abs(a.m - t.m) / (abs(t.m) + 1.0) + abs(a.p - t.p) + abs(a.h - t.h) / (abs(t.h) + 1.0) + abs(a.o - t.o) / (abs(t.o) + 1.0) AS d FROM fx a, fx t WHERE t.doc_id = -1 AND a.doc_id <> -1)
SELECT doc_id, round(d, 6) AS voice_distance, round(1.0 / (1.0 + d), 6) AS voice_score FROM dist""")
def voice_match(spark, sf_dir):
    df = E.match_voice(drafts(spark, sf_dir).withColumnRenamed("text", "rewritten"), voice_of(spark, sf_dir))
    return rounded(df, "voice_distance", "voice_score").select("doc_id", "voice_distance", "voice_score")


RANKED_SQL = (
    f"WITH {FIDELITY_SQL}, {QUALITY_SQL.removeprefix(O.PAIR_CTE + ', ')}, "
    "ca_nd AS (SELECT f.doc_id, f.model_id, f.input_pos, CASE WHEN f.placeholders_ok AND NOT f.claim_strengthened THEN 0 ELSE 1 END AS tier, 1.0::DOUBLE / (1 + penalty) AS quality_rank FROM fid f JOIN qu USING (model_id, doc_id)), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, quality_rank DESC, input_pos) AS rank FROM ca_nd) "
    "SELECT doc_id, model_id, CAST(tier AS BIGINT) AS tier, CAST(rank AS BIGINT) AS rank, round(quality_rank, 6) AS quality_rank FROM rk"
)


def candidates(spark, sf_dir) -> DataFrame:
    """The pairs of each draft, with what its equal texts have in common made once."""
    each = [F.struct(F.lit(i).alias("input_pos"), F.lit(name).alias("model_id"), F.expr(how.format(t="text")).alias("rewritten")) for i, (name, how) in enumerate(REWRITES.items())]
    # a small file of keys is one task's share, but the texts made of it aren't; a given number isn't merged again, and does for the ranking, too
    customer = table(spark, sf_dir, "customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    return E.candidates(spark.sql(DRAFTS.replace("FROM customer", "FROM {customer}"), customer=customer), each)


def ranked(spark, sf_dir) -> DataFrame:
    df = E.rank(E.scorecards(candidates(spark, sf_dir)).withColumn("ok", F.lit(True)))
    return rounded(longs(df, "tier", "rank"), "quality_rank").select("doc_id", "model_id", "tier", "rank", "quality_rank")


@query(RANKED_SQL)
def model_ranking(spark, sf_dir):
    return ranked(spark, sf_dir)


@query(f"SELECT doc_id, model_id, quality_rank FROM ({RANKED_SQL}) WHERE rank = 1 AND tier = 0")
def best_candidate(spark, sf_dir):
    return E.best(ranked(spark, sf_dir)).select("doc_id", "model_id", "quality_rank")


# changelog


@query()
def changelog(spark, sf_dir):
    return longs(C.changelog(V.pair_segments(*sides(spark, sf_dir, "clean")).drop("section")), "seg_idx", "entry_idx")


@query(f"WITH {O.DRAFT_CTE}, {O.segments()}, prose AS (SELECT * FROM segs WHERE NOT frozen), {O.sentences('prose', 'doc_id, seg_idx')}, e AS (SELECT doc_id FROM sents UNION ALL SELECT doc_id FROM segs WHERE frozen) SELECT doc_id, 'unchanged' AS reason, count(*) AS n FROM e GROUP BY doc_id")
def change_summary_echo(spark, sf_dir):
    return C.summary(C.changelog(V.pair_segments(*sides(spark, sf_dir, "echo")).drop("section")), "doc_id")


@query()
def change_ratio(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", "model_id", F.round(C.change_ratio(F.col("original"), F.col("rewritten")), 6).alias("change_ratio"))


# rewriting


@query(f"""WITH {O.DRAFT_CTE}, {O.segments()} SELECT doc_id, count(*) AS segments, count(*) FILTER (NOT frozen) AS rewritten, count(*) FILTER (frozen) AS frozen, 0::BIGINT AS failed, 0::BIGINT AS retries FROM segs GROUP BY doc_id""")
def rewrite_report(spark, sf_dir):
    rows = R.rewrite(G.segments(drafts(spark, sf_dir)), Stub)
    return R.rewrite_report(rows).select("doc_id", "segments", "rewritten", "frozen", "failed", F.col("retries").cast("long").alias("retries"))


#: What is masked as one word in the drafts, though it has blanks.
WIDE_SPANS = [P_VALUE, "\\[\\s*\\d+(\\s*[-–,]\\s*\\d+)*\\s*\\]", "(Section|Fig\\.|Table)\\s+\\d+", "\\d+\\s+mL"]
MASKED_TEXT = "text"
for _span in WIDE_SPANS:
    MASKED_TEXT = f"regexp_replace({MASKED_TEXT}, {O.quote(_span)}, 'X', 'g')"


@query(f"""WITH {O.DRAFT_CTE}, {O.segments()}, n AS (SELECT doc_id, CASE WHEN frozen THEN 0 ELSE len(regexp_extract_all({MASKED_TEXT}, '\\S+')) END AS n FROM segs)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS prompt_tokens, CAST(sum(n) AS BIGINT) AS completion_tokens FROM n GROUP BY doc_id""")
def token_usage(spark, sf_dir):
    rows = R.rewrite(G.segments(drafts(spark, sf_dir)), Stub)
    return R.rewrite_report(rows).select("doc_id", "prompt_tokens", "completion_tokens")


def selective():
    return Stub(lambda p: "" if "Sample" in p else p)


@query(f"""WITH {O.DRAFT_CTE}, {O.segments()}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (frozen) AS fr, count(*) FILTER (NOT frozen AND contains(text, 'Sample')) AS bad FROM segs GROUP BY doc_id)
SELECT doc_id, unnest([1, 2, 3])::BIGINT AS stage_idx, unnest(['segment', 'rewrite', 'verify']) AS stage, unnest([true, bad = 0, true]) AS ok, unnest([n, n - fr - bad, 0])::BIGINT AS items FROM s""")
def audit_trail(spark, sf_dir):
    from .runs import run_pipeline

    return run_pipeline(drafts(spark, sf_dir), selective)["audit"].select("doc_id", F.col("stage_idx").cast("long").alias("stage_idx"), "stage", "ok", F.col("items").cast("long").alias("items"))


# catalog, prompts, judge

KINDS = "CASE n_nationkey % 3 WHEN 0 THEN 'openai_compat' WHEN 1 THEN 'ollama' ELSE 'stub' END"


@query(f"SELECT 'm-' || n_nationkey AS id, {KINDS} AS provider, n_nationkey % 3 <> 0 OR n_nationkey % 2 = 0 AS available FROM nation WHERE n_nationkey % 5 <> 4")
def catalog_available(spark, sf_dir):
    """A catalog with a model of each nation: every fifth is off, one provider needs one of two keys."""
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS n", "n_name", f"{KINDS} AS kind").orderBy("n").collect()  # 25 rows
    entry = '[[model]]\nid = "m-{n}"\ndisplay_name = "{name}"\nprovider = "{kind}"\nmodel = "m"\nenabled = {on}\napi_key_env = "{key}"\n'
    text = "".join(entry.format(n=r["n"], name=r["n_name"], kind=r["kind"], on=str(r["n"] % 5 != 4).lower(), key=f"KEY_{r['n'] % 2}" if r["n"] % 3 == 0 else "") for r in rows)
    models = spark.createDataFrame(files.model_rows(text), files.MODEL_SCHEMA)
    usable = files.available(models, ["KEY_0"]).select("id", F.lit(True).alias("available"))
    return models.filter("enabled").join(usable, "id", "left").select("id", "provider", F.coalesce("available", F.lit(False)).alias("available"))


@query("SELECT 'prompt/' || p_type AS id, CAST(max(p_size) AS INT) AS version, count(*) AS versions FROM (SELECT DISTINCT p_type, p_size FROM part) GROUP BY p_type")
def prompt_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_type", "p_size").distinct()
    made = rows.select(F.concat(F.lit("/prompts/prompt/"), "p_type", F.lit(".v"), F.col("p_size").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Rewrite "), "p_type").alias("text"))
    prompts = files.prompt_table(made, "prompts")
    return files.latest(prompts).join(prompts.groupBy("id").agg(F.count("*").alias("versions")), "id").select("id", "version", "versions")


REPLY = """CASE event_id % 4 WHEN 0 THEN '{"best": "m1", "ranking": ["m1", "m2", "zz"]}' WHEN 1 THEN 'I think: {"best": "zz", "ranking": ["m2", "m1"]} so.' WHEN 2 THEN 'no json here' ELSE '{broken' END"""


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END AS best_label, CASE event_id % 4 WHEN 0 THEN 'm1,m2' WHEN 1 THEN 'm2,m1' END AS ranking FROM events""")
def judge_parse(spark, sf_dir):
    replies = table(spark, sf_dir, "events").select("event_id", F.expr(REPLY).alias("reply"), F.array(F.lit("m1"), F.lit("m2")).alias("labels"))
    return E.verdicts(replies).select("event_id", "best_label", F.array_join("ranking", ",").alias("ranking"))
