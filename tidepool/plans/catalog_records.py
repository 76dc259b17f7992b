"""Checked queries: enrichment records (J3) and the enrichment loop (J2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.operators import enrich as EN
from tidepool.operators import index as I
from tidepool.operators import records as R
from tidepool.plans import fixtures as fx
from tidepool.plans import sqlfn as S
from tidepool.plans.catalog import register
from tidepool.plans.oracle_views import with_views
from tidepool.session import cut_lineage, scratch_path

VOCAB = fx.VOCABULARY
_VOCAB_SQL = "[" + ", ".join(f"'{t}'" for t in VOCAB) + "]"


def _typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate records as VARIANT (the general, dynamically typed path)."""
    r = fx.v_rec(spark, sf_dir)
    rec = F.struct("enriched", "summary", "topics", "entities", "key_takeaways")
    return r.select("doc_id", "path", "attempt", R.typed_to_variant(rec).alias("v"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate records in the typed shape (fast path)."""
    r = fx.v_rec(spark, sf_dir)
    rec = F.struct("enriched", "summary", "topics", "entities", "key_takeaways")
    return r.select("doc_id", "path", "attempt", rec.alias("record"))


def _errors_sql() -> str:
    q = "''"
    msgs = [
        f"CASE WHEN entities_missing THEN 'Missing required field: {q}entities{q}' END",
        f"CASE WHEN NOT enriched THEN 'Field {q}enriched{q} must equal True, got False' END",
        f"CASE WHEN length(summary) < 200 THEN 'Field {q}summary{q} is too short: minimum 200 characters, got ' "
        f"|| CAST(length(summary) AS VARCHAR) END",
        f"CASE WHEN length(summary) > 20000 THEN 'Field {q}summary{q} is too long: maximum 20000 characters, got ' "
        f"|| CAST(length(summary) AS VARCHAR) END",
        f"CASE WHEN len(key_takeaways) > 7 THEN 'Field {q}key_takeaways{q} exceeds max_items=7: got ' "
        f"|| CAST(len(key_takeaways) AS VARCHAR) || ' items' END",
    ]
    vocab = (f"list_transform(list_filter(primary_topics, lambda x: NOT list_contains({_VOCAB_SQL}, x)), "
             f"lambda x: 'topics.primary item {q}' || x || '{q} not in vocab')")
    return f"list_sort(list_filter([{', '.join(msgs)}] || {vocab}, lambda m: m IS NOT NULL))"


_CHECKED_SQL = f"SELECT *, {_errors_sql()} AS errors FROM v_rec"


# Expected results for the YAML answers: the same candidate records, plus the
# three injected variants (no mapping, an extra key, a non-string topic).
_RAW_CHECKED_SQL = f"""
SELECT *, k % 19 = 0 AS nomap,
       CASE WHEN k % 19 = 0 THEN ['{C.MSG_NO_YAML}']
            WHEN k % 29 = 0 THEN list_sort(errors || ['topics.primary item {{''AI'': ''alignment''}} is not a string'])
            ELSE errors END AS raw_errors
FROM checked"""


@register("validate_record", with_views("""
SELECT path, CAST(attempt AS BIGINT) AS attempt, len(errors) = 0 AS ok, array_to_string(errors, '|') AS errors
FROM checked""", "v_rec", extra={"checked": _CHECKED_SQL}))
def q_validate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema + vocabulary check of every candidate record (all errors collected)."""
    v = R.validate_typed(_records(spark, sf_dir), VOCAB)
    return v.select("path", F.col("attempt").cast("long").alias("attempt"), "ok",
                    F.array_join("errors", "|").alias("errors"))


@register("vocab_offlist", with_views(f"""
SELECT path, CAST(attempt AS BIGINT) AS attempt,
       array_to_string(list_filter(primary_topics, lambda x: NOT list_contains({_VOCAB_SQL}, x)), '|') AS offlist
FROM v_rec""", "v_rec"))
def q_vocab_offlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.v_rec(spark, sf_dir)
    return r.select("path", F.col("attempt").cast("long").alias("attempt"),
                    F.array_join(R.vocab_offlist(F.col("topics.primary"), VOCAB), "|").alias("offlist"))


_FIRST_SQL = """
SELECT path, win IS NOT NULL AS ok, CAST(coalesce(win, n) AS BIGINT) AS attempts,
       CASE WHEN win IS NOT NULL THEN '' ELSE array_to_string(flatten(list(errors ORDER BY attempt)), '|') END AS errors
FROM (SELECT path, errors, attempt,
             min(CASE WHEN len(errors) = 0 THEN attempt END) OVER (PARTITION BY path) AS win,
             max(attempt) OVER (PARTITION BY path) AS n FROM checked)
GROUP BY path, win, n"""


@register("first_valid_attempt", with_views(_FIRST_SQL, "v_rec", extra={"checked": _CHECKED_SQL}))
def q_first_valid_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three candidates per document: the first valid wins; else all errors in order."""
    v = R.validate_typed(_records(spark, sf_dir), VOCAB).select("path", "attempt", "ok", "errors")
    f = R.first_valid_attempt(v)
    return f.select("path", "ok", "attempts", F.array_join("errors", "|").alias("errors"))


@register("sanitize_record", with_views("""
SELECT path, CAST(attempt AS BIGINT) AS attempt, enriched, CASE WHEN length(summary) <= 20000 THEN summary END AS summary,
       array_to_string(primary_topics, '|') AS primary_topics,
       CAST(CASE WHEN entities_missing THEN NULL ELSE len(organizations) END AS BIGINT) AS n_organizations,
       CAST(least(len(key_takeaways), 7) AS BIGINT) AS n_takeaways
FROM v_rec""", "v_rec"))
def q_sanitize_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-listed, type-checked, size-bounded record (takeaways cut to 7)."""
    t = _typed_records(spark, sf_dir).withColumn("c", R.sanitize(F.col("v")))
    return t.select("path", F.col("attempt").cast("long").alias("attempt"), F.col("c.enriched").alias("enriched"),
                    F.col("c.summary").alias("summary"),
                    F.array_join("c.topics.primary", "|").alias("primary_topics"),
                    F.size("c.entities.organizations").cast("long").alias("n_organizations"),
                    F.size("c.key_takeaways").cast("long").alias("n_takeaways"))


# --------------------------------------------------------------------------- entities
def _aliases_sql() -> str:
    rows = ", ".join(f"({i}, '{a}', '{c}')" for i, (a, c) in enumerate(fx.ALIASES))
    return f"SELECT * FROM (VALUES {rows}) t(alias_ord, alias, canonical)"


_ALIAS_RED_SQL = f"""
SELECT fold, canonical FROM (
  SELECT {S.casefold('alias')} AS fold, canonical,
         row_number() OVER (PARTITION BY {S.casefold('alias')} ORDER BY alias_ord DESC) AS r FROM aliases) WHERE r = 1"""


@register("alias_join", with_views(f"""
SELECT e.doc_id, CAST(e.pos AS BIGINT) AS pos, coalesce(a.canonical, e.token) AS canonical
FROM v_entities e LEFT JOIN alias_red a ON a.fold = {S.casefold('e.token')}""", "v_entities",
    extra={"aliases": _aliases_sql(), "alias_red": _ALIAS_RED_SQL}))
def q_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded token → canonical form (duplicate alias keys: the last wins), else the token."""
    e = R.alias_join(fx.v_entities(spark, sf_dir), fx.v_aliases(spark))
    return e.select("doc_id", F.col("pos").cast("long").alias("pos"), "canonical")


@register("normalize_entities", with_views(f"""
SELECT doc_id, array_to_string(list_sort(list(canon)), '|') AS entities FROM (
  SELECT doc_id, arg_min(canon, pos) AS canon FROM (
    SELECT e.doc_id, e.pos, coalesce(a.canonical, e.token) AS canon
    FROM v_entities e LEFT JOIN alias_red a ON a.fold = {S.casefold('e.token')})
  GROUP BY doc_id, {S.casefold('canon')})
GROUP BY doc_id""", "v_entities", extra={"aliases": _aliases_sql(), "alias_red": _ALIAS_RED_SQL}))
def q_normalize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias → dedupe by folded canonical (first casing wins) → code-point sort."""
    n = R.normalize_entities_table(fx.v_entities(spark, sf_dir, by_doc=True), fx.v_aliases(spark))
    return n.select("doc_id", F.array_join("entities", "|").alias("entities"))


def _group_norm_sql(col: str) -> str:
    return f"""
SELECT r.path, r.attempt, coalesce(array_to_string(list_sort(x.vals), '|'), '') AS {col} FROM v_rec r
LEFT JOIN (
  SELECT path, attempt, list(canon) AS vals FROM (
    SELECT path, attempt, arg_min(canon, i) AS canon FROM (
      SELECT u.path, u.attempt, u.i, coalesce(a.canonical, u.x) AS canon
      FROM (SELECT path, attempt, unnest({col}) AS x, generate_subscripts({col}, 1) AS i FROM v_rec) u
      LEFT JOIN alias_red a ON a.fold = {S.casefold('u.x')})
    GROUP BY path, attempt, {S.casefold('canon')})
  GROUP BY path, attempt) x ON x.path = r.path AND x.attempt = r.attempt
WHERE NOT r.entities_missing"""


@register("normalize_entity_groups", with_views(f"""
SELECT o.path, CAST(o.attempt AS BIGINT) AS attempt, o.organizations, p.people
FROM ({_group_norm_sql('organizations')}) o JOIN ({_group_norm_sql('people')}) p
  ON o.path = p.path AND o.attempt = p.attempt""", "v_rec",
    extra={"aliases": _aliases_sql(), "alias_red": _ALIAS_RED_SQL}))
def q_normalize_entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """organizations / people of every candidate record, normalised with the alias table."""
    t = _typed_records(spark, sf_dir)
    # generated, not filtered: a filter would be pushed below and normalise every record a second time
    groups = F.filter(F.array(R.normalize_entity_groups(F.col("v"), R.alias_map(fx.ALIASES))), lambda x: x.isNotNull())
    g = t.select("path", "attempt", F.explode(groups).alias("g"))
    return g.select("path", F.col("attempt").cast("long").alias("attempt"),
                    F.array_join("g.organizations", "|").alias("organizations"),
                    F.array_join("g.people", "|").alias("people"))


# --------------------------------------------------------------------------- merge and report
@register("upsert_metadata", with_views(f"""
WITH res AS ({_FIRST_SQL.replace("SELECT path, win IS NOT NULL AS ok", "SELECT path, win, win IS NOT NULL AS ok")}),
win AS (SELECT r.path, c.enriched, c.summary, c.primary_topics, c.key_takeaways
        FROM res r JOIN checked c ON c.path = r.path AND c.attempt = r.win WHERE r.ok)
SELECT d.path, d.title, w.enriched, w.summary, array_to_string(w.primary_topics, '|') AS primary_topics,
       CAST(CASE WHEN w.key_takeaways IS NULL THEN NULL ELSE least(len(w.key_takeaways), 7) END AS BIGINT)
         AS n_takeaways
FROM v_docs d LEFT JOIN win w ON w.path = d.path""", "v_rec", extra={"checked": _CHECKED_SQL}))
def q_upsert_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful records put into the document table (bodies included); failed ones untouched."""
    from tidepool.sources import doctable as DT

    t = R.validate_typed(_records(spark, sf_dir), VOCAB)
    t = t.withColumn("clean", F.when(F.col("ok"), R.sanitize_typed(F.col("record"), R.alias_map(fx.ALIASES))))
    res = cut_lineage(R.first_valid_attempt(t.select("path", "attempt", "ok", "errors", "clean")))
    docs = fx.v_docs(spark, sf_dir).select("path", "title", "source", "published", F.col("content").alias("body"))
    folder = scratch_path(spark, "documents")
    m = DT.upsert_documents(spark, DT.store_documents(docs, folder.rsplit("/", 1)[-1].replace("-", "_"), folder), res)
    return m.select("path", "title", "enriched", "summary", F.array_join("topics.primary", "|").alias("primary_topics"),
                    F.size("key_takeaways").cast("long").alias("n_takeaways"))


@register("batch_report", with_views("""
SELECT CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed
FROM firsts""", "v_rec", extra={"checked": _CHECKED_SQL, "firsts": _FIRST_SQL}))
def q_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Succeeded / failed documents after all attempts."""
    v = R.validate_typed(_records(spark, sf_dir), VOCAB)
    return R.batch_report(R.first_valid_attempt(v.select("path", "attempt", "ok", "errors")))


@register("batch_failures", with_views("""
SELECT path, array_to_string(flatten(list(errors ORDER BY attempt)), '|') AS errors
FROM (SELECT * FROM checked WHERE attempt <= 2) GROUP BY path HAVING bool_and(len(errors) > 0)""", "v_rec", extra={"checked": _CHECKED_SQL}))
def q_batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that failed with one retry, each with its own errors."""
    v = R.validate_typed(_records(spark, sf_dir), VOCAB).select("path", "attempt", "ok", "errors")
    return R.batch_failures(R.first_valid_attempt(v, retries=1)).select("path", F.array_join("errors", "|").alias("errors"))


# --------------------------------------------------------------------------- raw responses (rows-only)
@register("extract_block", with_views("""
SELECT path, CAST(attempt AS BIGINT) AS attempt, NOT nomap AS has_mapping FROM raw_checked""", "v_rec",
    extra={"checked": _CHECKED_SQL, "raw_checked": _RAW_CHECKED_SQL}))
def q_extract_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced YAML block → mapping (VARIANT); answers without one yield no mapping."""
    r = fx.v_raw(spark, sf_dir)
    return r.select("path", F.col("attempt").cast("long").alias("attempt"),
                    R.parse_record(F.col("raw")).isNotNull().alias("has_mapping"))


_RAW_FIRST_SQL = """
SELECT path, win, win IS NOT NULL AS ok, CAST(coalesce(win, n) AS BIGINT) AS attempts,
       CASE WHEN win IS NOT NULL THEN '' ELSE array_to_string(flatten(list(raw_errors ORDER BY attempt)), '|') END
         AS errors
FROM (SELECT path, raw_errors, attempt,
             min(CASE WHEN len(raw_errors) = 0 THEN attempt END) OVER (PARTITION BY path) AS win,
             max(attempt) OVER (PARTITION BY path) AS n FROM raw_checked)
GROUP BY path, win, n"""


@register("writeback", with_views(f"""
SELECT f.path, f.ok, f.attempts, f.errors, r.summary, o.organizations
FROM raw_first f
LEFT JOIN v_rec r ON r.path = f.path AND r.attempt = f.win
LEFT JOIN ({_group_norm_sql('organizations')}) o ON o.path = f.path AND o.attempt = f.win""", "v_rec",
    extra={"checked": _CHECKED_SQL, "raw_checked": _RAW_CHECKED_SQL, "raw_first": _RAW_FIRST_SQL,
           "aliases": _aliases_sql(), "alias_red": _ALIAS_RED_SQL}))
def q_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract → check → first valid attempt → normalise → sanitise, per document."""
    w = R.writeback(fx.v_raw(spark, sf_dir), VOCAB, fx.ALIASES)
    return w.select("path", "ok", "attempts", F.array_join("errors", "|").alias("errors"),
                    F.col("clean.summary").alias("summary"),
                    F.array_join("clean.entities.organizations", "|").alias("organizations"))


@register("missing_required", with_views("""
SELECT path, CAST(attempt AS BIGINT) AS attempt,
       CASE WHEN nomap THEN 'enriched|summary|topics|entities' WHEN k % 11 = 0 THEN 'entities' ELSE '' END AS missing,
       CASE WHEN NOT nomap AND k % 23 = 0 THEN 'injected' ELSE '' END AS dropped
FROM raw_checked""", "v_rec", extra={"checked": _CHECKED_SQL, "raw_checked": _RAW_CHECKED_SQL}))
def q_missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.sources.scans import yaml_to_json
    r = fx.v_raw(spark, sf_dir).withColumn("j", yaml_to_json(R.extract_block(F.col("raw"))))
    keys = F.when(F.col("j").startswith("{"), R.object_keys(F.col("j")))
    return r.select("path", F.col("attempt").cast("long").alias("attempt"),
                    F.array_join(R.missing_required(keys), "|").alias("missing"),
                    F.array_join(R.dropped_keys(keys), "|").alias("dropped"))


@register("dropped_keys", with_views("""
SELECT path, CAST(attempt AS BIGINT) AS attempt, 'injected' AS dropped FROM raw_checked
WHERE NOT nomap AND k % 23 = 0""", "v_rec", extra={"checked": _CHECKED_SQL, "raw_checked": _RAW_CHECKED_SQL}))
def q_dropped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.sources.scans import yaml_to_json
    r = fx.v_raw(spark, sf_dir).withColumn("j", yaml_to_json(R.extract_block(F.col("raw"))))
    keys = F.when(F.col("j").startswith("{"), R.object_keys(F.col("j")))
    return r.where(F.size(R.dropped_keys(keys)) > 0).select(
        "path", F.col("attempt").cast("long").alias("attempt"), F.array_join(R.dropped_keys(keys), "|").alias("dropped"))


@register("ensure_list", with_views("""
SELECT path, CAST(attempt AS BIGINT) AS attempt,
       CASE WHEN nomap THEN '' WHEN k % 29 = 0 THEN '{"AI":"alignment"}|' || array_to_string(primary_topics, '|')
            ELSE array_to_string(primary_topics, '|') END AS primary_topics
FROM raw_checked""", "v_rec", extra={"checked": _CHECKED_SQL, "raw_checked": _RAW_CHECKED_SQL}))
def q_ensure_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topics.primary of every parsed answer coerced to a list (str → [str], other → [])."""
    from tidepool.sources.scans import ensure_list
    r = fx.v_raw(spark, sf_dir).withColumn("v", R.parse_record(F.col("raw")))
    prim = F.try_variant_get(F.col("v"), "$.topics.primary", "variant")
    return r.select("path", F.col("attempt").cast("long").alias("attempt"),
                    F.array_join(ensure_list(prim), "|").alias("primary_topics"))


@register("sink_failed_queue", with_views("""
SELECT path, errors FROM raw_first WHERE NOT ok""",
    "v_rec", extra={"checked": _CHECKED_SQL, "raw_checked": _RAW_CHECKED_SQL, "raw_first": _RAW_FIRST_SQL}))
def q_sink_failed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed writebacks appended to the re-run queue (JSON lines) and read back."""
    from tidepool.sources.sinks import sink_failed_queue
    w = R.writeback(fx.v_raw(spark, sf_dir), VOCAB, fx.ALIASES)
    path = sink_failed_queue(w.where(~F.col("ok")), scratch_path(spark, "failed-queue"))
    back = spark.read.schema("path string, errors array<string>").json(path)
    return back.select("path", F.array_join("errors", "|").alias("errors"))


# --------------------------------------------------------------------------- enrichment loop (J2)
def _backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.filter_backlog(fx.v_docs(spark, sf_dir))


def _sq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql(content: str) -> str:
    head = EN.system_text(VOCAB) + "\n\n" + EN.ARTICLE_OPEN
    return f"({_sq(head)} || substr(coalesce({content}, ''), 1, 50000) || {_sq(EN.ARTICLE_CLOSE)})"


_BACKLOG_SQL = "SELECT * FROM v_docs WHERE NOT coalesce(enriched, false)"


@register("render_prompt", with_views(f"""
SELECT path, CAST(length(p) AS BIGINT) AS prompt_chars, sha256(p) AS prompt_sha256
FROM (SELECT path, {_prompt_sql('content')} AS p FROM backlog)""", "v_docs", extra={"backlog": _BACKLOG_SQL}))
def q_render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _backlog(spark, sf_dir)
    p = EN.render_prompt(F.col("content"), VOCAB)
    return b.select("path", F.char_length(p).cast("long").alias("prompt_chars"), F.sha2(p, 256).alias("prompt_sha256"))


@register("build_packet", with_views(f"""
SELECT path, coalesce(nullif(title, ''), regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')) AS title,
       CAST(length(coalesce(content, '')) AS BIGINT) AS article_chars, CAST(length(p) AS BIGINT) AS prompt_chars,
       sha256(p) AS prompt_sha256, {_sq(EN.C.OUTPUT_CONTRACT)} AS output_contract
FROM (SELECT *, {_prompt_sql('content')} AS p FROM backlog)""", "v_docs", extra={"backlog": _BACKLOG_SQL}))
def q_build_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work packets for the backlog (prompt hash, sizes, output contract)."""
    pk = EN.build_packets(_backlog(spark, sf_dir), VOCAB)
    return pk.drop("prompt")


@register("sink_packets", with_views(f"""
SELECT path, sha256(p) AS prompt_sha256, CAST(length(p) AS BIGINT) AS prompt_chars
FROM (SELECT path, {_prompt_sql('content')} AS p FROM backlog)""", "v_docs", extra={"backlog": _BACKLOG_SQL}))
def q_sink_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written as JSON lines and read back."""
    from tidepool.sources.sinks import sink_packets
    path = sink_packets(EN.build_packets(_backlog(spark, sf_dir), VOCAB), scratch_path(spark, "packets"))
    back = spark.read.schema("path string, prompt_sha256 string, prompt_chars long").json(path)
    return back


@register("udf_enricher", with_views(f"""
SELECT path, substr(trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')), 1, 20000) AS summary,
       array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(content, ''), '\\p{{Lu}}\\p{{Ll}}+'))), '|') AS organizations,
       array_to_string(list_filter({_VOCAB_SQL}, lambda t: contains(lower(coalesce(content, '')), t)), '|')
         AS primary_topics
FROM v_docs WHERE NOT coalesce(enriched, false)""", "v_docs"))
def q_udf_enricher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default (native) enricher over the backlog."""
    e = EN.native_enrich(_backlog(spark, sf_dir), VOCAB)
    return e.select("path", F.col("record.summary").alias("summary"),
                    F.array_join(F.array_sort("record.entities.organizations"), "|").alias("organizations"),
                    F.array_join("record.topics.primary", "|").alias("primary_topics"))


@register("enrich_batch", with_views("""
SELECT path, true AS ok, '' AS errors, 'de' AS primary_topics,
       rpad(s, CAST(greatest(length(s), 200) AS INTEGER), '.') AS summary
FROM (SELECT path, substr(trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')), 1, 20000) AS s FROM backlog)""", "v_docs", extra={"backlog": _BACKLOG_SQL}))
def q_enrich_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable enricher run with mapInPandas over the whole backlog, then written back."""
    resp = EN.enrich_with(_backlog(spark, sf_dir), EN.lead_text_enricher(VOCAB), "stand-in")
    w = R.writeback(resp.withColumn("attempt", F.lit(1)), VOCAB, fx.ALIASES)
    return w.select("path", "ok", F.array_join("errors", "|").alias("errors"), F.array_join("clean.topics.primary", "|").alias("primary_topics"),
                    F.col("clean.summary").alias("summary"))


@register("packet_response_join", with_views(f"""
SELECT b.path, CAST(r.attempt AS BIGINT) AS attempt, CAST(length(p) AS BIGINT) AS prompt_chars, NOT r.nomap AS has_mapping
FROM (SELECT path, {_prompt_sql('content')} AS p FROM backlog) b JOIN raw_checked r ON r.path = b.path""",
    "v_rec", extra={"backlog": _BACKLOG_SQL, "checked": _CHECKED_SQL, "raw_checked": _RAW_CHECKED_SQL}))
def q_packet_response_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers paired with their packet by path (inner equi-join)."""
    pk = EN.build_packets(_backlog(spark, sf_dir), VOCAB).select("path", "prompt_chars")
    raw = fx.v_raw(spark, sf_dir).select("path", "attempt", "raw")
    return pk.join(raw, "path").select("path", F.col("attempt").cast("long").alias("attempt"), "prompt_chars",
                                       R.parse_record(F.col("raw")).isNotNull().alias("has_mapping"))
