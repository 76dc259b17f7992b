"""Enrichment (J2): prompts and work packets for the backlog, and the enricher seam.

The default enricher is native Spark columns (deterministic, checkable); a
user-supplied enricher — e.g. a client of a hosted model — plugs in through
``mapInPandas`` over the capped backlog and returns raw text + token usage,
which then goes through :func:`tidepool.operators.records.writeback`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.functions.text import collapse_ws

# Our own instructions for the metadata record (the stable prompt prefix).
SPEC_TEXT = (
    "Read the article below and describe it as a YAML mapping with these keys:\n"
    "- enriched: true\n"
    "- summary: a plain-prose summary between 200 and 20000 characters\n"
    "- topics: primary (a list drawn only from the vocabulary below) and secondary (a free list)\n"
    "- entities: organizations (a list) and people (a list)\n"
    "- key_takeaways: optional, at most 7 short strings\n"
    "Answer with the YAML block only."
)
VOCAB_LABEL = "Primary topic vocabulary: "
NO_VOCAB = "(empty)"
ARTICLE_OPEN = "=== ARTICLE ===\n"
ARTICLE_CLOSE = "\n=== END OF ARTICLE ===\n"


def system_text(vocabulary) -> str:
    """Stable prefix: instructions + sorted vocabulary (a driver-side constant)."""
    vocab = ", ".join(sorted(vocabulary)) if vocabulary else NO_VOCAB
    return f"{SPEC_TEXT}\n\n{VOCAB_LABEL}{vocab}"


def render_prompt(content: Column, vocabulary, max_chars: int = C.PROMPT_MAX_CHARS) -> Column:
    """Prefix + the article body cut to ``max_chars`` characters, delimited."""
    body = F.substring(F.coalesce(content, F.lit("")), 1, max_chars)
    return F.concat(F.lit(system_text(vocabulary) + "\n\n" + ARTICLE_OPEN), body, F.lit(ARTICLE_CLOSE))


def build_packets(backlog: DataFrame, vocabulary, max_chars: int = C.PROMPT_MAX_CHARS) -> DataFrame:
    """One work packet per backlog document: path, title (stem fallback),
    article_chars, prompt_chars, prompt_sha256, output_contract, prompt."""
    from tidepool.operators.index import path_stem
    prompt = render_prompt(F.col("content"), vocabulary, max_chars)
    return backlog.select(
        "path",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), path_stem(F.col("path"))).alias("title"),
        F.char_length(F.coalesce(F.col("content"), F.lit(""))).cast("long").alias("article_chars"),
        F.char_length(prompt).cast("long").alias("prompt_chars"),
        F.sha2(prompt, 256).alias("prompt_sha256"),
        F.lit(C.OUTPUT_CONTRACT).alias("output_contract"),
        prompt.alias("prompt"))


# Default enricher (native): deterministic fields derived from the text.
ENTITY_RE = r"(\p{Lu}\p{Ll}+)"


def native_enrich(backlog: DataFrame, vocabulary) -> DataFrame:
    """Typed record per document: summary = the text as far as the record schema
    lets a summary go, primary = vocabulary terms occurring in the text
    (case-insensitive), organizations = the distinct capitalised words, no
    people, no takeaways."""
    longest = C.ENRICHMENT_SCHEMA["field_specs"]["summary"]["max_len"]
    low = F.lower(F.coalesce(F.col("content"), F.lit("")))
    vocab = F.array(*[F.lit(t) for t in sorted(vocabulary)])
    orgs = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("content"), F.lit("")), F.lit(ENTITY_RE), 1))
    rec = F.struct(
        F.lit(True).alias("enriched"),
        F.substring(collapse_ws(F.coalesce(F.col("content"), F.lit(""))), 1, longest).alias("summary"),
        F.struct(F.filter(vocab, lambda t: F.contains(low, t)).alias("primary"),
                 F.array().cast("array<string>").alias("secondary")).alias("topics"),
        F.struct(orgs.alias("organizations"), F.array().cast("array<string>").alias("people")).alias("entities"),
        F.lit(None).cast("array<string>").alias("key_takeaways"))
    return backlog.select("path", rec.alias("record"))


RESPONSE_SCHEMA = ("path string, raw string, model string, input_tokens long, cache_read long, "
                   "cache_creation long, output_tokens long")


def enrich_with(backlog: DataFrame, enrich_fn: Callable[[str], tuple[str, dict]], model: str) -> DataFrame:
    """Run a user enricher over the backlog in Arrow batches (``mapInPandas``).

    ``enrich_fn(content) -> (raw_text, usage)``; a failing call yields a null
    response for that row (it goes to the failed queue), never a failed task.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    raw, usage = enrich_fn(content or "")
                except Exception:  # noqa: BLE001 — isolate one bad call
                    raw, usage = None, {}
                out.append((path, raw, model, usage.get("input_tokens"), usage.get("cache_read_input_tokens"),
                            usage.get("cache_creation_input_tokens"), usage.get("output_tokens")))
            yield pd.DataFrame(out, columns=["path", "raw", "model", "input_tokens", "cache_read",
                                             "cache_creation", "output_tokens"])
    return backlog.select("path", "content").mapInPandas(run, RESPONSE_SCHEMA)


def lead_text_enricher(vocabulary) -> Callable[[str], tuple[str, dict]]:
    """A deterministic stand-in for a model client: the record's summary is the
    article's text within the schema's length bounds, its primary topic the
    first vocabulary term; returned as fenced YAML like a model answer."""
    import json
    topic = sorted(vocabulary)[0] if vocabulary else "general"
    min_len, max_len = (C.ENRICHMENT_SCHEMA["field_specs"]["summary"][k] for k in ("min_len", "max_len"))

    def enrich(content: str) -> tuple[str, dict]:
        summary = " ".join(content.split())[:max_len].ljust(min_len, ".")
        raw = ("```yaml\nenriched: true\nsummary: " + json.dumps(summary, ensure_ascii=False) +
               "\ntopics:\n  primary: [" + json.dumps(topic) + "]\n  secondary: []\n"
               "entities:\n  organizations: []\n  people: []\n```")
        return raw, {"input_tokens": len(content), "output_tokens": len(raw) // 4}
    return enrich
