"""Queries: column functions over code and metadata, pairing and side expansion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.functions.dictionaries import ALIASES, SINKS, STDLIB
from patchloom.operators import datasets as D
from patchloom.operators import pairs as P
from patchloom.operators import textfeat
from patchloom.plans.base import PAIRS, has_code_sql, pairs, query, read, strip_sql, unchanged_sql
from patchloom.sources import tables

L = f"lower({strip_sql('language')})"
RESOLVED = f"CASE {L} " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in ALIASES.items()) + " END"


@query(f"SELECT row_index, {L} AS language FROM ({PAIRS})")
def normalize_language(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", T.normalize_language(F.col("language")).alias("language"))


@query(f"SELECT row_index, {RESOLVED} AS language FROM ({PAIRS})")
def resolve_language_alias(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", T.resolve_language(F.col("language")).alias("language"))


@query(f"SELECT row_index, language FROM ({PAIRS}) WHERE {RESOLVED} IS NOT NULL")
def filter_supported_language(spark, sf_dir):
    return P.supported(pairs(spark, sf_dir)).select("row_index", "language")


@query(f"SELECT row_index, CASE WHEN {RESOLVED} IS NULL THEN 'unsupported_language' ELSE 'no_code' END AS reason FROM ({PAIRS}) WHERE {RESOLVED} IS NULL OR NOT {has_code_sql('vulnerable_code')}")
def pairs_rejects(spark, sf_dir):
    return P.rejects(pairs(spark, sf_dir)).select("row_index", "reason")


@query(f"SELECT row_index FROM ({PAIRS}) WHERE {has_code_sql('vulnerable_code')}")
def filter_no_code(spark, sf_dir):
    return pairs(spark, sf_dir).where(T.has_code(F.col("vulnerable_code"))).select("row_index")


@query(f"SELECT row_index, {unchanged_sql()} AS unchanged FROM ({PAIRS})")
def classify_row_origin(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", T.unchanged(F.col("vulnerable_code"), F.col("fixed_code")).alias("unchanged"))


@query(f"SELECT row_index, coalesce(cve_id, '') AS cve_id, coalesce(vulnerability_type, '') AS vulnerability_type FROM ({PAIRS})")
def metadata_defaults(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", *[T.or_empty(F.col(c)).alias(c) for c in ("cve_id", "vulnerability_type")])


SIDES = f"""SELECT * FROM (SELECT *, unnest(CASE WHEN {unchanged_sql()} THEN ['unchanged'] WHEN NOT {has_code_sql('vulnerable_code')} THEN [] WHEN {has_code_sql('fixed_code')} THEN ['vulnerable', 'fixed'] ELSE ['vulnerable'] END) AS side FROM ({PAIRS}))"""


@query(f"SELECT row_index, side, CASE WHEN side = 'fixed' THEN fixed_code ELSE vulnerable_code END AS code FROM ({SIDES})")
def origin_explode(spark, sf_dir):
    return D.sides(pairs(spark, sf_dir)).select("row_index", "side", "code")


@query(f"""SELECT row_index || ':' || side AS method_id, coalesce(repo, '') || '|' || coalesce(file, '') || '|' || coalesce(method, '') AS group_id,
  CASE WHEN side = 'vulnerable' THEN 1 ELSE 0 END AS label FROM ({SIDES})""")
def raw_methods(spark, sf_dir):
    return D.raw_methods(pairs(spark, sf_dir)).select("method_id", "group_id", "label")


@query(f"SELECT row_index, side, CASE WHEN side = 'vulnerable' THEN coalesce(vulnerability_type, '') ELSE 'none' END AS vulnerability_type FROM ({SIDES})")
def force_safe_type(spark, sf_dir):
    return P.safe_type(D.sides(pairs(spark, sf_dir)), "side").select("row_index", "side", "vulnerability_type")


@query(f"SELECT row_index, substr(coalesce(vulnerable_code, ''), 1, 300) AS text_preview FROM ({PAIRS})")
def text_preview(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", T.preview(F.col("vulnerable_code")).alias("text_preview"))


@query(f"SELECT row_index, language FROM ({PAIRS})")
def leak_safe_projection(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", *D.feature_columns(["cve_id", "repo", "language", "label", "vulnerability_type"]))


_MIXED = "CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' false ' WHEN 2 THEN 'junk' WHEN 3 THEN '' WHEN 4 THEN '2.5' ELSE CAST(o_custkey AS VARCHAR(20)) END"


@query(f"SELECT o_orderkey, coalesce(try_cast({_MIXED} AS DOUBLE), CASE lower(trim({_MIXED})) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END, 0.0) AS value FROM orders")
def coerce_numeric(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.to_number(F.expr(_MIXED)).alias("value"))


PIECES = "list_filter(list_transform(string_split_regex(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '\\n\\s*\\n+'), lambda p: " + strip_sql("p") + "), lambda p: p <> '')"


@query(f"SELECT row_index, CAST(i - 1 AS INTEGER) AS pos, l[i] AS snippet FROM (SELECT row_index, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT row_index, {PIECES.format(x='vulnerable_code')} AS l FROM ({PAIRS})))")
def split_blank_lines(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", F.posexplode(T.split_blank_lines(F.col("vulnerable_code"))).alias("pos", "snippet"))


_VF = f"SELECT row_index, {PIECES.format(x="coalesce(vulnerable_code, '')")} AS v, {PIECES.format(x="coalesce(fixed_code, '')")} AS f FROM ({PAIRS})"
_STATUS = "CASE WHEN len(v) = 0 THEN 'no_vulnerable_code' WHEN len(v) <> len(f) THEN 'mismatch' ELSE 'success' END"


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda c: T.split_blank_lines(F.coalesce(F.col(c), F.lit("")))
    return pairs(spark, sf_dir).select("row_index", side("vulnerable_code").alias("v"), side("fixed_code").alias("f"))


@query(f"SELECT row_index, {_STATUS} AS status, CAST(CASE WHEN {_STATUS} = 'success' THEN len(v) ELSE 0 END AS INTEGER) AS n_pairs, CASE WHEN {_STATUS} = 'success' THEN v[1] || ' => ' || f[1] END AS first FROM ({_VF})")
def pair_strict(spark, sf_dir):
    status, made = T.pair_strict(F.col("v"), F.col("f"))
    rows = _snippets(spark, sf_dir).select("row_index", status.alias("status"), made.alias("p"))
    first = F.when(F.size("p") > 0, F.concat(F.col("p")[0]["vulnerable_code"], F.lit(" => "), F.col("p")[0]["fixed_code"]))
    return rows.select("row_index", "status", F.size("p").alias("n_pairs"), first.alias("first"))


@query(f"""SELECT count(*) AS total_in, CAST(coalesce(sum(CASE WHEN s = 'success' THEN n ELSE 0 END), 0) AS BIGINT) AS total_out, count_if(s = 'no_vulnerable_code') AS skipped_no_code, count_if(s = 'mismatch') AS skipped_mismatch
  FROM (SELECT {_STATUS} AS s, len(v) AS n FROM ({_VF}))""")
def pairs_stats(spark, sf_dir):
    status, made = T.pair_strict(F.col("v"), F.col("f"))
    return P.stats(_snippets(spark, sf_dir).select(status.alias("status"), F.size(made).cast("long").alias("n_pairs")))


@query(f"""SELECT count(*) AS n_rows, count_if(side = 'vulnerable') AS n_vulnerable, count_if(side = 'fixed') AS n_fixed, count_if(side = 'unchanged') AS n_unchanged, count_if(side = 'vulnerable' AND row_index % 3 = 0) AS n_positive FROM ({SIDES})""")
def features_stats(spark, sf_dir):
    rows = D.sides(pairs(spark, sf_dir)).withColumn("label", ((F.col("side") == "vulnerable") & (F.col("row_index") % 3 == 0)).cast("int"))
    return P.feature_stats(rows, "side")


@query(f"SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_ws(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_ws(F.col("text"))).alias("digest"))


@query("SELECT 'r' || o_custkey || ':f:m:' || o_orderkey || ':vulnerable:1-2#' || (o_orderkey % 3 + 1) AS statement_id FROM orders")
def compose_ids(spark, sf_dir):
    prefix = F.concat_ws(":", F.concat(F.lit("r"), F.col("o_custkey")), F.lit("f"), F.lit("m"), F.col("o_orderkey").cast("string"), F.lit("vulnerable"))
    return read(spark, sf_dir, "orders").select(T.statement_id(prefix, F.lit(1), F.lit(2), F.col("o_orderkey") % 3 + 1).alias("statement_id"))


_ID = "CASE WHEN o_orderkey % 5 = 0 THEN 'no index' ELSE 'a:7:fixed:b:' || o_orderkey || ':vulnerable:1-2#1' END"


@query(f"SELECT o_orderkey, CAST(list_extract(regexp_extract_all({_ID}, ':(\\d+):(vulnerable|fixed|unchanged):', 1), -1) AS BIGINT) AS row_index FROM orders")
def parse_row_index(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.row_index_of(F.expr(_ID)).alias("row_index"))


_TOKENS = f"regexp_extract_all(coalesce({{x}}, ''), '{T.TOKEN}')"


@query(f"SELECT page_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT page_id, {_TOKENS.format(x='html')} AS t FROM pages)")
def code_tokens(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.code_tokens(F.col("html")).alias("t")).select("page_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT row_index, CAST(length(vulnerable_code) AS INTEGER) AS char_length, CAST(len({_TOKENS.format(x='vulnerable_code')}) AS INTEGER) AS token_count FROM ({PAIRS})")
def lexical_counts(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", F.char_length("vulnerable_code").alias("char_length"), F.size(T.code_tokens(F.col("vulnerable_code"))).alias("token_count"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS line_start, CAST(l_linenumber + l_quantity AS INTEGER) AS line_end, CAST(l_quantity AS INTEGER) AS num_source_lines FROM lineitem")
def line_span(spark, sf_dir):
    start, end = F.col("l_linenumber") + 1, (F.col("l_linenumber") + F.col("l_quantity")).cast("int")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("line_start"), end.alias("line_end"), T.line_span(start, end).alias("num_source_lines"))


#: Call names by part: some of each language's sinks, and others.
def _names(language: str) -> list[str]:
    known = [n for exact, suffix, within in SINKS[language].values() for n in (*exact, *(f"x{s}" for s in suffix), *(f"{w}y" for w in within))]
    return [*dict.fromkeys(known), "helper", f"{(STDLIB[language] or ('lib',))[0]}.thing", "vendor.thing", ""]


def _name_sql(language: str) -> str:
    names = _names(language)
    return f"CASE p_partkey % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _sinks_sql(language: str) -> str:
    def test(exact, suffix, within) -> str:
        parts = [f"name IN ({', '.join(repr(e) for e in exact)})"] if exact else []
        parts += [f"ends_with(name, '{s}')" for s in suffix] + [f"contains(name, '{w}')" for w in within]
        return " OR ".join(parts) or "false"

    return f"SELECT p_partkey, name, {', '.join(f'({test(*rule)}) AS {flag}' for flag, rule in SINKS[language].items())} FROM (SELECT p_partkey, {_name_sql(language)} AS name FROM part)"


for _language in SINKS:

    def _sinks(spark, sf_dir, language=_language):
        named = read(spark, sf_dir, "part").select("p_partkey", F.expr(_name_sql(language)).alias("name"))
        return named.withColumns(T.sink_flags(F.array("name"), language))

    query(_sinks_sql(_language), f"sink_flags_{_language}")(_sinks)


_FIRST = "string_split_regex(name, '->|::|\\.')[1]"


@query(f"""SELECT p_partkey, name, CASE WHEN name = '' THEN 'none' WHEN {_FIRST} = name THEN 'user_defined' WHEN {_FIRST} IN ({', '.join(repr(x) for x in STDLIB['python'])}) THEN 'stdlib' ELSE 'third_party' END AS kind
  FROM (SELECT p_partkey, {_name_sql('python')} AS name FROM part)""")
def call_target_kind(spark, sf_dir):
    named = read(spark, sf_dir, "part").select("p_partkey", F.expr(_name_sql("python")).alias("name"))
    return named.withColumn("kind", T.call_target_kind(F.col("name"), "python"))


_CALLS = "regexp_extract_all({x}, '([A-Za-z_][A-Za-z0-9_.]*)\\s*\\(', 1)"


@query(f"SELECT page_id, CAST(len(c) AS INTEGER) AS n_calls, array_to_string(c, ',') AS calls FROM (SELECT page_id, {_CALLS.format(x='html')} AS c FROM pages)")
def call_names_regex(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.call_names(F.col("html")).alias("c")).select("page_id", F.size("c").alias("n_calls"), F.array_join("c", ",").alias("calls"))


@query("SELECT page_id, page_id % 3 = 0 OR (page_id % 2 = 0 AND contains(html, '<p')) AS is_output_render FROM (SELECT page_id, html FROM pages)")
def output_render_text(spark, sf_dir):
    kind, language = F.when(F.col("page_id") % 3 == 0, "echo").otherwise("call_expr"), F.when(F.col("page_id") % 2 == 0, "javascript").otherwise("php")
    raw = F.replace("html", F.lit("<p"), F.lit("el.innerHTML"))
    return read(spark, sf_dir, "pages").select("page_id", T.output_text(raw, kind, language).alias("is_output_render"))


@query(f"SELECT row_index, contains(coalesce(vulnerable_code, ''), '<?php') AS has_tag FROM ({PAIRS})")
def php_tag_detect(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", T.has_php_tag(F.col("vulnerable_code")).alias("has_tag"))


@query(f"""SELECT row_index, CASE WHEN regexp_matches(ltrim(vulnerable_code), '^(private|public|protected|readonly|static) ') THEN 'class _ {{' || chr(10) || vulnerable_code || chr(10) || '}}' ELSE vulnerable_code END AS code FROM ({PAIRS})""")
def wrap_isolated_method(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_index", T.wrap_method(F.col("vulnerable_code")).alias("code"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_size / 100.0 WHEN p_size >= 1 THEN p_size / 100.0 ELSE p_size END AS test_size FROM part")
def parse_test_size(spark, sf_dir):
    """20, 20% and 0.2 alike."""
    size = F.col("p_size").cast("string")
    given = F.when(F.col("p_partkey") % 3 == 0, size).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), size, F.lit("% "))).otherwise((F.col("p_size") / 100).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", T.share(given).alias("test_size"))


_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'assign' WHEN 1 THEN 'call_expr' WHEN 2 THEN 'break' WHEN 3 THEN 'echo' WHEN 4 THEN 'import' ELSE 'goto' END"


@query(f"SELECT p_partkey, p_size % 3 = 0 AND (p_size % 2 > 0 OR k = 'assign') AND k NOT IN ('pass', 'break', 'continue', 'fallthrough', 'goto', 'label', 'import', 'global', 'nonlocal') AS uses_only_literals FROM (SELECT *, {_KIND} AS k FROM part)")
def only_literals(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.only_literals(F.col("p_size") % 3, F.col("p_size") % 2, F.expr(_KIND)).alias("uses_only_literals"))


@query("""WITH t AS (SELECT o_custkey AS conv_id, o_orderkey % 3 AS turn, o_orderstatus || chr(10) || '  ' || o_orderpriority AS text FROM orders),
  l AS (SELECT conv_id, turn, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS line FROM t)
  SELECT DISTINCT a.conv_id, a.line FROM l a WHERE a.turn = 0 AND a.line <> '' AND EXISTS (SELECT 1 FROM l b WHERE b.conv_id = a.conv_id AND b.turn > 0 AND b.line = a.line)""")
def moved_lines(spark, sf_dir):
    text = F.concat("o_orderstatus", F.lit("\n  "), "o_orderpriority")
    return P.moved_lines(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("conv_id"), (F.col("o_orderkey") % 3).alias("turn"), text.alias("text")))


@query("""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_partkey % 50 AS INTEGER) AS a, CAST(l_partkey % 50 + l_quantity AS INTEGER) AS b FROM lineitem),
  o AS (SELECT * FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.id = x.id AND y.line <> x.line AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b)))
  SELECT id, min(a) AS a FROM o GROUP BY 1""")
def outermost_interval(spark, sf_dir):
    span = F.col("l_partkey") % 50
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), span.cast("int").alias("a"), (span + F.col("l_quantity")).cast("int").alias("b"))
    return P.outermost(calls).groupBy("id").agg(F.min("a").alias("a"))


@query("SELECT row_index, cve_id, language, vulnerable_code FROM (" + PAIRS + ")")
def scan_csv_roundtrip(spark, sf_dir):
    """Quotes and line ends in fields survive being written and read."""
    path = f"{tables.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(pairs(spark, sf_dir).select("row_index", "cve_id", "language", "vulnerable_code"), path)
    schema = "row_index long, cve_id string, language string, vulnerable_code string"
    from pyspark.sql import types

    return tables.read_csv(spark, path, types.StructType.fromDDL(schema))


@query("SELECT doc_id, quality, toxic FROM labels")
def csv_sink_roundtrip(spark, sf_dir):
    path = f"{tables.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), path)
    from pyspark.sql import types

    return tables.read_csv(spark, path, types.StructType.fromDDL("doc_id long, quality int, toxic int"))


N = f"""n AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM (SELECT item_id, {_TOKENS.format(x='text')} AS t FROM benchmark)) GROUP BY ALL)"""


def _ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ngrams(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text")


@query(f"WITH {N} SELECT * FROM n")
def ngram_counts(spark, sf_dir):
    return _ngrams(spark, sf_dir)


@query(f"WITH {N} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM n GROUP BY 1")
def tfidf_vocab(spark, sf_dir):
    return D.vocabulary(_ngrams(spark, sf_dir), "item_id")


@query(f"WITH {N} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM n GROUP BY 1 ORDER BY 2 DESC, term LIMIT 500")
def tfidf_top_terms(spark, sf_dir):
    return D.vocabulary(_ngrams(spark, sf_dir), "item_id", 500)


@query(f"""WITH {N}, v AS (SELECT term, sum(tf) AS t, count(*) AS df FROM n GROUP BY 1 ORDER BY 2 DESC, term LIMIT 500), m AS (SELECT count(*) AS d FROM benchmark),
  w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1.0 + d) / (1 + df)) + 1) AS w FROM n JOIN v USING (term), m)
  SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w""")
def tfidf_weights(spark, sf_dir):
    return textfeat.fit_transform(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text", 500).withColumn("weight", F.round("weight", 6))
