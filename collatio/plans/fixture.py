"""The benchmark's tables, derived from the driver's `benchmark` table, and the same in DuckDB SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ref_label
from ..operators.scoring import KEY
from ..operators.synthetic import synthetic_responses

EDITIONS = (("ed_a", 0), ("ed_b", 1), ("ed_c", 2))
STRATA = ("extremely_famous", "well_known", "random", "translation_sensitive", "short_verse", "long_verse")


@dataclass(frozen=True)
class Dataset:
    editions: DataFrame
    references: DataFrame
    cases: DataFrame
    responses: DataFrame


def editions(spark: SparkSession) -> DataFrame:
    rows = [(i, f"Edition {i[-1].upper()}", i, f"{2000 + p}", "public_domain", "https://example.org/l", "https://example.org/s", True, p) for i, p in EDITIONS]
    return spark.createDataFrame(rows, "id string, name string, abbreviation string, edition string, license_kind string, license_url string, source_url string, redistribute_reference_text boolean, pos int")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three editions of every item, with an apostrophe or a second line in some."""
    item = F.col("item_id")
    base = F.trim(F.regexp_replace("text", r"\s+", " "))
    base = F.concat(base, F.when(item % 7 == 3, " don't stop").when(item % 7 == 5, "\namen").otherwise(""))
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", base.alias("base"))
    three = rows.withColumn("e", F.explode(F.array(*(F.struct(F.lit(i).alias("translation"), F.lit(p).alias("pos")) for i, p in EDITIONS))))
    text = F.when(F.col("e.pos") == 1, F.replace(F.col("base"), F.lit(" the "), F.lit(" that "))).when(F.col("e.pos") == 2, F.replace(F.col("base"), F.lit(", "), F.lit(" "))).otherwise(F.col("base"))
    return three.select(
        "item_id", "e.translation", "e.pos", F.concat(F.lit("Book "), F.floor(item / 20).cast("string")).alias("book"), (F.floor(item / 10) % 2 + 1).cast("int").alias("chapter"),
        (item % 10 + 1).cast("int").alias("verse_start"), F.lit(None).cast("int").alias("verse_end"), text.alias("text"),
    )


def cases(refs: DataFrame) -> DataFrame:
    label = ref_label(*(F.col(k) for k in KEY))
    own = refs.withColumn("ref_label", label)
    identity = F.concat_ws("|", F.lit("fixture"), F.lit("dev"), "translation", "ref_label")
    case_id = F.upper(F.concat(F.lit("BQ-dev-"), F.substring(F.sha2(identity, 256), 1, 16)))
    stratum = F.get(F.array(*map(F.lit, STRATA)), (F.col("item_id") % 6).cast("int"))
    order = F.row_number().over(Window.orderBy("ref_label", "pos")) - 1  # a benchmark is some hundred cases
    return own.select(case_id.alias("case_id"), "translation", *KEY, "ref_label", stratum.alias("stratum"), F.lit("canonical").alias("prompt_variant"), order.cast("long").alias("ord"), "pos", "text")


def injected(responses: DataFrame) -> DataFrame:
    """Some responses in another form of the same text (decomposed letters, CRLF, curly apostrophes), some cut off or typed as refusals."""
    n = F.col("ord")
    out = F.when(n % 3 == 0, F.replace("output", F.lit("'"), F.lit("’"))).otherwise(F.col("output"))
    out = F.when(n % 5 == 1, F.replace(F.replace(out, F.lit("é"), F.lit("e\u0301")), F.lit("\n"), F.lit("\r\n"))).otherwise(out)
    ok = F.col("error").isNull()
    return responses.withColumns({"output": out, "truncated": ok & (n % 13 == 4), "typed_refusal": ok & (n % 17 == 6)})


def set_up(responses: DataFrame) -> DataFrame:
    """Responses with the settings of their runs."""
    return responses.withColumns({"temperature": F.lit(0.0).cast("float"), "reasoning_effort": F.lit("none"), "seed": F.lit(None).cast("decimal(20,0)"), "system_fingerprint": F.concat(F.lit("fp-"), F.col("model"))})


def configs(responses: DataFrame) -> DataFrame:
    """The settings of each run."""
    rows = responses.select("provider", "model", "run_id").distinct()
    return rows.withColumns({"temperature": F.lit(0.0).cast("float"), "reasoning_effort": F.lit("none"), "max_output_tokens": F.lit(1024), "endpoint": F.lit("https://example.org/v1")})


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    refs = references(spark, sf_dir)
    own = cases(refs)
    return Dataset(editions(spark), refs, own, injected(synthetic_responses(own)))


#: The tables above, then scores, as common table expressions. al: aligned pairs by carrying counts forward;
#: levenshtein() is by byte there, so letters outside ASCII become control characters first.
SQL = r"""
WITH editions AS (SELECT * FROM (VALUES ('ed_a', 0, '2000'), ('ed_b', 1, '2001'), ('ed_c', 2, '2002')) AS t(id, pos, edition)),
base AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) || CASE WHEN item_id % 7 = 3 THEN ' don''t stop' WHEN item_id % 7 = 5 THEN chr(10) || 'amen' ELSE '' END AS base FROM benchmark),
refs AS (SELECT item_id, id AS translation, pos, 'Book ' || (item_id // 20)::VARCHAR AS book, ((item_id // 10) % 2 + 1)::INT AS chapter, (item_id % 10 + 1)::INT AS verse_start, NULL::INT AS verse_end,
  CASE pos WHEN 1 THEN replace(base, ' the ', ' that ') WHEN 2 THEN replace(base, ', ', ' ') ELSE base END AS text FROM base CROSS JOIN editions),
lab AS (SELECT *, book || ' ' || chapter || ':' || verse_start AS ref_label FROM refs),
cases AS (SELECT upper('BQ-dev-' || substr(sha256('fixture|dev|' || translation || '|' || ref_label), 1, 16)) AS case_id, translation, book, chapter, verse_start, verse_end, ref_label,
  ['extremely_famous', 'well_known', 'random', 'translation_sensitive', 'short_verse', 'long_verse'][(item_id % 6)::INT + 1] AS stratum, 'canonical' AS prompt_variant,
  row_number() OVER (ORDER BY ref_label, pos) - 1 AS ord, pos, text FROM lab),
alts AS (SELECT c.case_id, arg_min(o.text, o.pos) AS o_text FROM cases c LEFT JOIN cases o ON o.ref_label = c.ref_label AND o.text <> c.text GROUP BY 1),
rows_ AS (SELECT c.*, coalesce(o_text, text) AS alt, m, r, (ord + r + 3 * m) % 11 AS category FROM cases c JOIN alts USING (case_id) CROSS JOIN (VALUES (0), (1)) t(m) CROSS JOIN (VALUES (0), (1), (2)) u(r)),
toks AS (SELECT *, string_split_regex(text, '\s+') AS tt, string_split_regex(alt, '\s+') AS ta FROM rows_),
syn AS (SELECT case_id, CASE m WHEN 0 THEN 'a' ELSE 'b' END || '-' || r AS run_id, 'synthetic' AS provider, 'synthetic-' || CASE m WHEN 0 THEN 'a' ELSE 'b' END AS model,
  CASE WHEN category < 4 THEN text WHEN category = 4 THEN regexp_replace(text, '[,.;:!?]', '', 'g') WHEN category = 5 THEN alt
    WHEN category = 6 THEN array_to_string(tt[1:len(tt) // 2], ' ') || ' ' || array_to_string(ta[len(ta) // 2 + 1:], ' ')
    WHEN category = 7 THEN 'I cannot provide that passage.' WHEN category = 8 THEN 'Here is the passage: ' || text ELSE '' END AS output,
  CASE WHEN category = 10 THEN 'synthetic provider failure' END AS error, category::INT AS category, ord FROM toks),
i1 AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN replace(output, '''', '’') ELSE output END AS output) FROM syn),
responses AS (SELECT * REPLACE (CASE WHEN ord % 5 = 1 THEN replace(replace(output, 'é', 'e' || chr(769)), chr(10), chr(13) || chr(10)) ELSE output END AS output),
  model AS resolved_model, error IS NULL AND ord % 13 = 4 AS truncated, error IS NULL AND ord % 17 = 6 AS typed_refusal FROM i1),
nrefs AS (SELECT *, nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS norm FROM cases),
wrefs AS (SELECT *, list_transform(regexp_extract_all(norm, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*'), lambda w: replace(w, '’', '''')) AS expected FROM nrefs),
nresp AS (SELECT *, nfc_normalize(replace(replace(output, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS outn FROM responses),
wresp AS (SELECT *, list_transform(regexp_extract_all(outn, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*'), lambda w: replace(w, '’', '''')) AS got FROM nresp),
pairs AS (SELECT w.case_id, w.run_id, w.model, w.got, x.translation, x.norm, x.expected, x.translation = c.translation AS own, w.outn
  FROM wresp w JOIN cases c USING (case_id) JOIN wrefs x ON x.ref_label = c.ref_label),
ucomb AS (SELECT DISTINCT expected, got FROM pairs),
al AS (SELECT expected, got, list_reduce(
    list_prepend({{'w': '', 'row': list_transform(range(0, len(got) + 1), lambda j: {{'c': j, 'i': j, 'd': 0::BIGINT, 's': 0::BIGINT, 'm': repeat('0', j::BIGINT)}})}},
      list_transform(expected, lambda e: {{'w': e, 'row': []::STRUCT(c BIGINT, i BIGINT, d BIGINT, s BIGINT, m VARCHAR)[]}})),
    lambda up, nx: {{'w': nx.w, 'row': list_reduce(
        list_prepend([{{'c': up.row[1].c + 1, 'i': 0::BIGINT, 'd': up.row[1].d + 1, 's': 0::BIGINT, 'm': ''}}], list_transform(range(1, len(got) + 1), lambda j: [{{'c': j, 'i': 0::BIGINT, 'd': 0::BIGINT, 's': 0::BIGINT, 'm': ''}}])),
        lambda acc, q: list_append(acc, CASE
          WHEN got[q[1].c] = nx.w THEN {{'c': up.row[q[1].c].c, 'i': up.row[q[1].c].i, 'd': up.row[q[1].c].d, 's': up.row[q[1].c].s, 'm': up.row[q[1].c].m || '1'}}
          WHEN up.row[q[1].c].c <= least(up.row[q[1].c + 1].c, acc[-1].c) THEN {{'c': up.row[q[1].c].c + 1, 'i': up.row[q[1].c].i, 'd': up.row[q[1].c].d, 's': up.row[q[1].c].s + 1, 'm': up.row[q[1].c].m || '0'}}
          WHEN up.row[q[1].c + 1].c <= acc[-1].c THEN {{'c': up.row[q[1].c + 1].c + 1, 'i': up.row[q[1].c + 1].i, 'd': up.row[q[1].c + 1].d + 1, 's': up.row[q[1].c + 1].s, 'm': up.row[q[1].c + 1].m}}
          ELSE {{'c': acc[-1].c + 1, 'i': acc[-1].i + 1, 'd': acc[-1].d, 's': acc[-1].s, 'm': acc[-1].m || '0'}} END))}}).row[-1] AS a FROM ucomb),
ap AS (SELECT p.*, al.a FROM pairs p JOIN al ON al.expected = p.expected AND al.got = p.got),
mine AS (SELECT * FROM ap WHERE own),
theirs AS (SELECT case_id, run_id, list({{'t': translation, 'd': a.c, 'm': a.m, 'n': norm}} ORDER BY translation) AS others FROM ap WHERE NOT own GROUP BY 1, 2),
s1 AS (SELECT r.*, c.translation AS requested_translation, c.book, c.chapter, c.verse_start, c.ref_label, c.stratum, m.norm, m.expected, m.a, o.others,
  r.error IS NULL AND NOT truncated AND NOT typed_refusal AS allowed
  FROM wresp r JOIN cases c USING (case_id) JOIN mine m ON m.case_id = r.case_id AND m.run_id = r.run_id JOIN theirs o ON o.case_id = r.case_id AND o.run_id = r.run_id),
s2 AS (SELECT *, allowed AND outn = norm AS exact_text, allowed AND got = expected AS exact_words,
  typed_refusal OR regexp_matches(lower(outn), 'can''t provide|cannot provide|unable to provide|can''t quote|cannot quote|copyright') AS refusal,
  a.c AS word_errors, a.i AS insertions, a.d AS deletions, a.s AS substitutions,
  CASE WHEN len(expected) = 0 THEN (a.c > 0)::INT::DOUBLE ELSE a.c / len(expected) END AS word_error_rate,
  levenshtein(translate(norm, '{foreign}', '{plain}'), translate(outn, '{foreign}', '{plain}')) / length(norm) AS character_error_rate,
  list_sort(list_distinct(list_transform(list_filter(others, lambda o: o.n = outn), lambda o: o.t))) AS exact_other_translations,
  len(list_filter(range(1, len(got) + 1), lambda j: a.m[j] = '0')) AS unmatched,
  len(list_filter(range(1, len(got) + 1), lambda j: a.m[j] = '0' AND len(list_filter(others, lambda o: o.m[j] = '1')) > 0)) AS explained,
  list_min(list_transform(others, lambda o: o.d)) AS nearest FROM s1),
s3 AS (SELECT *, greatest(0.0, 1 - word_error_rate) AS word_accuracy, CASE WHEN unmatched > 0 THEN explained / unmatched END AS alternative_edition_token_overlap,
  NOT exact_text AND (contains(outn, norm) OR (len(expected) > 0 AND len(got) > len(expected) AND contains(chr(31) || array_to_string(got, chr(31)) || chr(31), chr(31) || array_to_string(expected, chr(31)) || chr(31)))) AS extraneous_text,
  CASE WHEN len(got) = 0 OR refusal OR error IS NOT NULL OR truncated OR nearest >= word_errors THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(list_filter(others, lambda o: o.d = nearest), lambda o: o.t))) END AS closest_translations FROM s2),
scores AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'provider_error' WHEN truncated THEN 'truncated' WHEN refusal THEN 'refusal' WHEN outn = '' THEN 'empty' WHEN exact_text THEN 'exact_requested'
  WHEN len(exact_other_translations) > 0 THEN 'translation_confusion' WHEN extraneous_text THEN 'extraneous_text' ELSE 'partial' END AS classification,
  provider || ' / ' || model || ' / ' || resolved_model AS model_key FROM s3),
matrix AS (SELECT *, CASE WHEN classification IN ('provider_error', 'truncated', 'empty', 'refusal') THEN '_' || classification WHEN classification = 'exact_requested' THEN requested_translation
  WHEN len(exact_other_translations) > 1 THEN '_ambiguous_exact' WHEN len(exact_other_translations) = 1 THEN exact_other_translations[1]
  WHEN len(closest_translations) > 1 THEN '_ambiguous_closest' WHEN len(closest_translations) = 1 THEN closest_translations[1] ELSE '_unclassified' END AS resembles FROM scores)
"""
_FOREIGN = "éèêçàñóíáúüöäßëïîôâûùœÉÈÊÇÀÑÓÍÁÚÜÖÄ’"
SQL = SQL.replace("{{", "{").replace("}}", "}").replace("{foreign}", _FOREIGN).replace("{plain}", "".join(chr(k + 1) if k < 8 else chr(k + 6) if k < 26 else "[]^_`{|}~<>#@$%*"[k - 26] for k in range(len(_FOREIGN))))
