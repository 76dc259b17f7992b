"""Enrichment records (J3): extract → validate → first valid attempt → normalise
entities → sanitise → upsert.

Model output is dynamically typed, so records are validated as VARIANT.
Every check is a Column expression generated once on the driver from
:data:`tidepool.contracts.ENRICHMENT_SCHEMA`; a record's errors are an
``array<string>`` (sorted — the order of checks over a set of fields is not
meaningful) and ``ok`` is ``size(errors) = 0``.  Nothing raises per row: a
bad record yields errors, never a failed task.

Type names follow Python's (``bool`` is not ``int``); VARIANT distinguishes a
missing key (SQL NULL) from a JSON null (type VOID).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.functions.text import casefold, casefold_array, let
from tidepool.session import cut_lineage, shuffle_partitions
from tidepool.sources.scans import yaml_to_json

SPEC = C.ENRICHMENT_SCHEMA
FENCE_OPEN_RE = r"(?i)```ya?ml\s*\n"
FENCE = "```"


# ---------------------------------------------------------------------------
# Extraction
# ---------------------------------------------------------------------------

def extract_block(raw: Column) -> Column:
    """The first fenced yaml/yml block (case-insensitive), else the whole text.

    The text is cut at its first opening fence and, if there is one, at the next fence: two
    plain searches.  Without a closing fence there is no later opening one either.
    """
    def block(parts: Column) -> Column:
        rest = F.get(parts, F.lit(1))
        return F.when(F.contains(rest, F.lit(FENCE)), F.substring_index(rest, FENCE, 1)).otherwise(raw)
    return let(F.split(raw, FENCE_OPEN_RE, 2), block)


def parse_record(raw: Column) -> Column:
    """Raw model output → VARIANT of the YAML mapping, null when it is not one."""
    v = F.try_parse_json(yaml_to_json(extract_block(F.coalesce(raw, F.lit("")))))
    return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), v)


def typed_to_variant(rec: Column) -> Column:
    """A typed record struct → VARIANT; null fields become absent keys."""
    return F.parse_json(F.to_json(rec))


# ---------------------------------------------------------------------------
# Python-style type names and reprs of VARIANT values
# ---------------------------------------------------------------------------

def py_type(x: Column) -> Column:
    t = F.schema_of_variant(x)
    return (F.when(t == "BOOLEAN", "bool").when(t == "STRING", "str").when(t.startswith("ARRAY"), "list")
             .when(t.startswith("OBJECT"), "dict").when(t == "VOID", "NoneType")
             .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
             .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float")
             .when(t == "DATE", "date").when(t.startswith("TIMESTAMP"), "datetime")
             .otherwise(F.lower(t)))


def py_repr(x: Column) -> Column:
    """``repr`` for the scalar/flat cases that occur in records (strings quoted,
    booleans True/False, null None, mappings and lists in Python punctuation)."""
    t = py_type(x)
    j = F.to_json(x)
    pyish = F.replace(F.replace(F.replace(j, F.lit('"'), F.lit("'")), F.lit("':"), F.lit("': ")),
                      F.lit(",'"), F.lit(", '"))
    return (F.when(t == "str", F.concat(F.lit("'"), F.try_variant_get(x, "$", "string"), F.lit("'")))
             .when(t == "bool", F.when(F.try_variant_get(x, "$", "boolean"), "True").otherwise("False"))
             .when(t == "NoneType", "None").when(t.isin("dict", "list"), pyish).otherwise(j))


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _fmt(template: str, **parts) -> Column:
    """Fill a message template with literal strings and Column values."""
    pieces, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces.append(F.lit(pre))
        v = parts[name]
        pieces.append(v if isinstance(v, Column) else F.lit(str(v)))
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


# ---------------------------------------------------------------------------
# Validation
# ---------------------------------------------------------------------------

def _field_names():
    return SPEC["required_fields"] + SPEC["optional_fields"]


def field_view(v: Column) -> Column:
    """Per-field VARIANT values and their Python type names, computed once per
    record (the checks below only read this struct)."""
    parts = []
    for f in _field_names():
        x = _get(v, f)
        parts += [x.alias(f"x_{f}"), py_type(x).alias(f"t_{f}")]
        for sk in SPEC["field_specs"].get(f, {}).get("subkeys", {}):
            y = _get(x, sk)
            parts += [y.alias(f"x_{f}_{sk}"), py_type(y).alias(f"t_{f}_{sk}")]
    return F.struct(*parts)


def _vocab_array(vocabulary) -> Column:
    return F.array(*[F.lit(t) for t in sorted(vocabulary)]) if vocabulary else F.array().cast("array<string>")


def _view_errors(fv: Column, vocabulary) -> Column:
    msgs: list[Column] = []
    for f in SPEC["required_fields"]:
        msgs.append(F.when(fv[f"x_{f}"].isNull(), F.lit(C.MSG_MISSING.format(field=f))))
    for f in _field_names():
        spec = SPEC["field_specs"].get(f, {})
        x, t = fv[f"x_{f}"], fv[f"t_{f}"]
        present = x.isNotNull()
        ty = spec.get("type")
        ok_type = present & (t == ty) if ty else present
        if ty:
            msgs.append(F.when(present & (t != ty), _fmt(C.MSG_WRONG_TYPE, field=f, expected=ty, got=t)))
        if "const" in spec:
            const = spec["const"]
            cur = F.try_variant_get(x, "$", "boolean") if isinstance(const, bool) else F.to_json(x)
            msgs.append(F.when(ok_type & (cur != F.lit(const)),
                               _fmt(C.MSG_CONST, field=f, const=repr(const), value=py_repr(x))))
        if "min_len" in spec or "max_len" in spec:
            n = F.char_length(F.try_variant_get(x, "$", "string"))
            is_str = ok_type & (t == "str")
            if "min_len" in spec:
                msgs.append(F.when(is_str & (n < spec["min_len"]),
                                   _fmt(C.MSG_TOO_SHORT, field=f, min_len=spec["min_len"], n=n.cast("string"))))
            if "max_len" in spec:
                msgs.append(F.when(is_str & (n > spec["max_len"]),
                                   _fmt(C.MSG_TOO_LONG, field=f, max_len=spec["max_len"], n=n.cast("string"))))
        if "max_items" in spec:
            n = F.size(F.try_variant_get(x, "$", "array<variant>"))
            msgs.append(F.when(ok_type & (t == "list") & (n > spec["max_items"]),
                               _fmt(C.MSG_MAX_ITEMS, field=f, max_items=spec["max_items"], n=n.cast("string"))))
        for sk, st in spec.get("subkeys", {}).items():
            sub, subt = fv[f"x_{f}_{sk}"], fv[f"t_{f}_{sk}"]
            is_dict = ok_type & (t == "dict")
            msgs.append(F.when(is_dict & sub.isNull(), F.lit(C.MSG_MISSING_SUBKEY.format(field=f, subkey=sk))))
            msgs.append(F.when(is_dict & sub.isNotNull() & (subt != st),
                               F.lit(C.MSG_SUBKEY_TYPE.format(field=f, subkey=sk, expected=st))))
    vocab = _vocab_array(vocabulary)
    items = F.when((fv["t_topics"] == "dict") & (fv["t_topics_primary"] == "list"),
                   F.try_variant_get(fv["x_topics_primary"], "$", "array<variant>"))

    def item_msg(e):
        et = py_type(e)
        s = F.try_variant_get(e, "$", "string")
        return F.when(et != "str", _fmt(C.MSG_NOT_STRING, item=py_repr(e))) \
            .when(~F.array_contains(vocab, s), _fmt(C.MSG_OFF_VOCAB, item=s))
    item_msgs = F.transform(F.coalesce(items, F.array().cast("array<variant>")), item_msg)
    return F.array_sort(F.filter(F.concat(F.array(*msgs), item_msgs), lambda m: m.isNotNull()))


def validation_errors(v: Column, vocabulary) -> Column:
    """Sorted error messages of one record (``v`` an OBJECT VARIANT); [] when valid."""
    return _view_errors(field_view(v), vocabulary)


def validate(df: DataFrame, vocabulary, v_col: str = "v") -> DataFrame:
    """Adds ``errors`` and ``ok``.  A null ``v`` (no mapping extracted) gets the
    single extraction error.  Field values/types are projected once, then checked."""
    v = F.col(v_col)
    staged = df.withColumn("_fv", field_view(v))
    errs = F.when(v.isNull(), F.array(F.lit(C.MSG_NO_YAML))).otherwise(_view_errors(F.col("_fv"), vocabulary))
    return staged.withColumn("errors", errs).withColumn("ok", F.size("errors") == 0).drop("_fv")


def validate_typed(df: DataFrame, vocabulary, rec_col: str = "record") -> DataFrame:
    """The same checks for records already in the typed shape
    (:data:`tidepool.contracts.RECORD_SCHEMA`): types hold by construction, a
    null field or subkey counts as missing.  No VARIANT round trip."""
    r = F.col(rec_col)
    specs = SPEC["field_specs"]
    msgs: list[Column] = []
    for f in SPEC["required_fields"]:
        msgs.append(F.when(r[f].isNull(), F.lit(C.MSG_MISSING.format(field=f))))
    msgs.append(F.when(r["enriched"] != F.lit(specs["enriched"]["const"]),
                       F.lit(C.MSG_CONST.format(field="enriched", const=repr(specs["enriched"]["const"]),
                                                value=repr(not specs["enriched"]["const"])))))
    n = F.char_length(r["summary"])
    msgs.append(F.when(n < specs["summary"]["min_len"], _fmt(C.MSG_TOO_SHORT, field="summary",
                                                             min_len=specs["summary"]["min_len"], n=n.cast("string"))))
    msgs.append(F.when(n > specs["summary"]["max_len"], _fmt(C.MSG_TOO_LONG, field="summary",
                                                             max_len=specs["summary"]["max_len"], n=n.cast("string"))))
    k = F.size(r["key_takeaways"])
    msgs.append(F.when(r["key_takeaways"].isNotNull() & (k > specs["key_takeaways"]["max_items"]),
                       _fmt(C.MSG_MAX_ITEMS, field="key_takeaways", max_items=specs["key_takeaways"]["max_items"],
                            n=k.cast("string"))))
    for f in ("topics", "entities"):
        for sk in specs[f]["subkeys"]:
            msgs.append(F.when(r[f].isNotNull() & r[f][sk].isNull(),
                               F.lit(C.MSG_MISSING_SUBKEY.format(field=f, subkey=sk))))
    vocab = _vocab_array(vocabulary)
    item_msgs = F.transform(F.filter(F.coalesce(r["topics"]["primary"], F.array().cast("array<string>")),
                                     lambda x: ~F.array_contains(vocab, x)),
                            lambda x: _fmt(C.MSG_OFF_VOCAB, item=x))
    errs = F.array_sort(F.filter(F.concat(F.array(*msgs), item_msgs), lambda m: m.isNotNull()))
    return df.withColumn("errors", errs).withColumn("ok", F.size("errors") == 0)


def vocab_offlist(primary: Column, vocabulary) -> Column:
    """Primary topics not in the vocabulary (repeats reported each time)."""
    vocab = F.array(*[F.lit(t) for t in sorted(vocabulary)])
    return F.filter(primary, lambda x: ~F.array_contains(vocab, x))


def object_keys(json_text: Column) -> Column:
    return F.json_object_keys(json_text)


def missing_required(keys: Column) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in SPEC["required_fields"]]), F.coalesce(keys, F.array().cast("array<string>")))


def dropped_keys(keys: Column) -> Column:
    return F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in C.ALLOWED_KEYS]))


# ---------------------------------------------------------------------------
# Entity normalisation
# ---------------------------------------------------------------------------

def alias_map(aliases) -> Column:
    """(variant, canonical) pairs → map of folded variant → canonical; on a
    repeated folded key the later pair wins."""
    d: dict[str, str] = {}
    for variant, canonical in aliases:
        d[_fold_py(variant)] = canonical
    if not d:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])


def _fold_py(s: str) -> str:
    return s.casefold()


def normalize_list(arr: Column, amap: Column) -> Column:
    """Strings only → alias → dedupe by folded canonical form (first casing wins) → sorted.

    The (fold, place, spelling) triples are sorted once; of equal folds, which then lie
    side by side, the first is kept.  Repeats of one spelling go before that.
    """
    strings = F.array_distinct(F.coalesce(arr, F.array().cast("array<string>")))
    canon = F.zip_with(strings, casefold_array(strings), lambda x, fold: F.coalesce(F.try_element_at(amap, fold), x))
    pair = F.struct(canon.alias("canon"), casefold_array(canon).alias("folds"))
    triples = let(pair, lambda p: F.sort_array(F.transform(p["canon"], lambda x, i: F.struct(F.get(p["folds"], i).alias("fold"), i.alias("at"), x.alias("canon")))))
    firsts = let(triples, _first_of_each_fold)
    return F.when(arr.isNull(), F.lit(None).cast("array<string>")).otherwise(F.array_sort(F.transform(firsts, lambda x: x["canon"])))


def variant_strings(x: Column) -> Column:
    """List VARIANT → its string elements (non-strings skipped); null otherwise."""
    arr = F.try_variant_get(x, "$", "array<variant>")  # null for anything but a list
    return F.transform(F.filter(arr, lambda e: F.schema_of_variant(e) == "STRING"), lambda e: F.try_variant_get(e, "$", "string"))


def normalize_entity_groups(v: Column, amap: Column) -> Column:
    """entities → struct(organizations, people): only list-valued known groups, normalised."""
    ents = _get(v, "entities")
    is_dict = F.try_variant_get(ents, "$", "map<string,variant>").isNotNull()  # null for anything but a mapping
    groups = [normalize_list(variant_strings(_get(ents, g)), amap).alias(g) for g in C.ENTITY_GROUPS]
    return F.when(is_dict, F.struct(*groups))


def alias_join(ents: DataFrame, aliases: DataFrame, value_col: str = "token") -> DataFrame:
    """``ents`` with ``canonical``: the value's alias (compared folded, the last of repeated aliases), else the value.

    A join with the alias table, of any size: Spark broadcasts it where its bytes
    allow and shuffles both sides by the folded value otherwise, splitting skewed values at run time.
    """
    return _alias_join(ents, aliases, value_col).drop("_fold", "_canonical", "_canonical_fold")


def _alias_join(ents: DataFrame, aliases: DataFrame, value_col: str) -> DataFrame:
    last = (aliases.withColumn("_fold", casefold(F.col("alias"))).groupBy("_fold")
            .agg(F.max_by("canonical", "alias_ord").alias("_canonical"))
            .withColumn("_canonical_fold", casefold(F.col("_canonical"))))
    j = ents.withColumn("_fold", casefold(F.col(value_col))).join(last, "_fold", "left")
    return j.withColumn("canonical", F.coalesce("_canonical", value_col))


def normalize_entities_table(ents: DataFrame, aliases: DataFrame, id_col: str = "doc_id",
                             pos_col: str = "pos", value_col: str = "token") -> DataFrame:
    """Exploded entities (id, pos, value) → (id, entities sorted).

    Rows are dealt by id once, before anything is grouped: Spark leaves that out where they
    lie so already, and no later step deals them anew.  The parts are as many as the session
    has for shuffles and are not put together again, as a task's distinct values should fit
    its memory.  A value's repeats within an id are then reduced to their first; an id's
    distinct values, which its record bounds, are put in order of (fold, place), where the
    first of each fold is kept.
    """
    once = ents.repartition(shuffle_partitions(ents.sparkSession), F.col(id_col)).groupBy(id_col, value_col).agg(F.min(pos_col).alias("_pos"))
    j = _alias_join(once, aliases, value_col)
    value = F.struct(F.coalesce("_canonical_fold", "_fold").alias("fold"), F.col("_pos").alias("at"), F.col("canonical").alias("canon"))
    listed = j.groupBy(id_col).agg(F.sort_array(F.collect_list(F.when(F.col("canonical").isNotNull() & F.col("_pos").isNotNull(), value))).alias("_all"))
    return listed.select(id_col, F.array_sort(F.transform(_first_of_each_fold(F.col("_all")), lambda x: x["canon"])).alias("entities"))


def _first_of_each_fold(triples: Column) -> Column:
    return F.filter(triples, lambda x, i: (i == 0) | (x["fold"] != F.get(triples, i - 1)["fold"]))


# ---------------------------------------------------------------------------
# Sanitising and merging
# ---------------------------------------------------------------------------

def sanitize(v: Column, amap: Column | None = None) -> Column:
    """Allow-listed keys only, wrong types dropped, over-long summary dropped,
    lists reduced to strings and cut to ``max_items``; never fails.  With
    ``amap`` the entity groups are normalised first (the writeback order)."""
    specs = SPEC["field_specs"]
    enriched = _get(v, "enriched")
    summary = _get(v, "summary")
    s_text = F.try_variant_get(summary, "$", "string")
    max_len = specs["summary"].get("max_len", 20000)
    topics = _get(v, "topics")
    tk = _get(v, "key_takeaways")

    def sub_list(parent, name):
        x = _get(parent, name)
        return F.when(py_type(x) == "list", variant_strings(x))

    ents = _get(v, "entities")
    if amap is not None:
        ent_struct = normalize_entity_groups(v, amap)
    else:
        ent_struct = F.when(py_type(ents) == "dict", F.struct(*[sub_list(ents, g).alias(g) for g in C.ENTITY_GROUPS]))
    return F.struct(
        F.when(py_type(enriched) == "bool", F.try_variant_get(enriched, "$", "boolean")).alias("enriched"),
        F.when((py_type(summary) == "str") & (F.char_length(s_text) <= max_len), s_text).alias("summary"),
        F.when(py_type(topics) == "dict", F.struct(sub_list(topics, "primary").alias("primary"),
                                                   sub_list(topics, "secondary").alias("secondary"))).alias("topics"),
        ent_struct.alias("entities"),
        F.when(py_type(tk) == "list", F.slice(variant_strings(tk), 1, specs["key_takeaways"]["max_items"]))
         .alias("key_takeaways"))


def sanitize_typed(rec: Column, amap: Column | None = None) -> Column:
    """:func:`sanitize` for records already in the typed shape: over-long summary
    dropped, takeaways cut to ``max_items``, entity groups normalised."""
    specs = SPEC["field_specs"]
    ents = rec["entities"]
    groups = [(normalize_list(ents[g], amap) if amap is not None else ents[g]).alias(g) for g in C.ENTITY_GROUPS]
    return F.struct(
        rec["enriched"].alias("enriched"),
        F.when(F.char_length(rec["summary"]) <= specs["summary"]["max_len"], rec["summary"]).alias("summary"),
        rec["topics"].alias("topics"),
        F.when(ents.isNotNull(), F.struct(*groups)).alias("entities"),
        F.slice(rec["key_takeaways"], 1, specs["key_takeaways"]["max_items"]).alias("key_takeaways"))


def first_valid_attempt(attempts: DataFrame, key: str = "path", n_col: str = "attempt", retries: int | None = None) -> DataFrame:
    """Per key: the first attempt that validated (its record, errors cleared), or
    — when none did — all attempts' errors in attempt order.

    With ``retries`` only attempts 1 … 1 + retries count, so the error lists
    gathered per key are bounded by it.
    """
    if retries is not None:
        attempts = attempts.where(F.col(n_col) <= 1 + retries)
    rec_cols = [c for c in attempts.columns if c not in (key, n_col, "ok", "errors")]
    g = attempts.groupBy(key).agg(
        F.min(F.when(F.col("ok"), F.col(n_col))).alias("_win"),
        F.max(n_col).alias("_n"),
        F.sort_array(F.collect_list(F.struct(F.col(n_col).alias("n"), F.col("errors").alias("e")))).alias("_all"),
        *[F.min_by(F.col(c), F.when(F.col("ok"), F.col(n_col))).alias(c) for c in rec_cols])
    ok = F.col("_win").isNotNull()
    return g.select(key, ok.alias("ok"), F.coalesce(F.col("_win"), F.col("_n")).cast("long").alias("attempts"),
                    F.when(ok, F.array().cast("array<string>"))
                     .otherwise(F.flatten(F.transform("_all", lambda x: x["e"]))).alias("errors"),
                    *[F.when(ok, F.col(c)).alias(c) for c in rec_cols])


META_FIELDS = ("enriched", "summary", "topics", "entities", "key_takeaways")


def upsert_metadata(docs: DataFrame, results: DataFrame, key: str = "path") -> DataFrame:
    """Sanitised keys of successful results overwrite a document's fields; keys the
    result does not carry, other frontmatter and failed documents stay as they are.

    ``docs`` has ``key`` plus any frontmatter columns (those named in
    :data:`META_FIELDS` are optional); ``results`` has ``key``, ``ok``, ``clean``.
    """
    new = results.where(F.col("ok")).select(key, F.col("clean").alias("_new"))
    j = docs.join(new, key, "left")
    out = j
    for f in META_FIELDS:
        newv = F.col("_new")[f]
        out = out.withColumn(f, F.coalesce(newv, F.col(f)) if f in docs.columns else newv)
    return out.drop("_new")


def writeback(raw: DataFrame, vocabulary, aliases, key: str = "path", n_col: str = "attempt",
              raw_col: str = "raw", retries: int | None = None) -> DataFrame:
    """extract → check → (first valid attempt) → normalise → sanitise, per row isolated.
    Attempts beyond 1 + ``retries`` are not read.

    Returns one row per key: ok, attempts, errors, clean (typed record or null).
    """
    amap = alias_map(aliases)
    if retries is not None:
        raw = raw.where(F.col(n_col) <= 1 + retries)
    # Spread the Python YAML step over all tasks; the attempt is part of the key,
    # so rows that share a path (or have none) do not land in one task.
    # The parsed answers are checkpointed: the YAML step runs once, and the many
    # checks below read a stored VARIANT instead of parsing the JSON again.
    parsed = raw.repartition(F.col(key), F.col(n_col), F.xxhash64(raw_col)).select(key, n_col, parse_record(F.col(raw_col)).alias("v"))
    parsed = cut_lineage(parsed)
    checked = validate(parsed, vocabulary)
    with_clean = checked.withColumn("clean", F.when(F.col("ok"), sanitize(F.col("v"), amap)))
    return first_valid_attempt(with_clean.select(key, n_col, "ok", "errors", "clean"), key, n_col)


def batch_failures(results: DataFrame, key: str = "path") -> DataFrame:
    """The failed paths of a batch, each with its own errors."""
    return results.where(~F.col("ok")).select(key, "errors")


def batch_report(results: DataFrame) -> DataFrame:
    """Succeeded count and failed count of one batch; :func:`batch_failures` lists the failures."""
    return results.agg(F.count_if(F.col("ok")).cast("long").alias("succeeded"),
                       F.count_if(~F.col("ok")).cast("long").alias("failed"))
