"""The registered queries of the subpackage, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, read_table

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", "text")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")).drop("matches", "longest_match", "items")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge, learn

    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = learn(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import perplexities

    return perplexities(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import ranked

    return ranked(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hyperminhash import near_duplicate_sets

    return near_duplicate_sets(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_warc, op2_token_counts, op3_simhash, op4_line_dedup, op5_personal_data, op6_packing, op7_decontamination, op8_quality_rules, op9_perplexity, op10_language,
    op11_collocations, op12_ranked_search, op13_hyperminhash)}

_WORDS7 = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS12 = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

ORACLE: dict[str, str] = {
    "op11_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
     n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
     g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
           FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
     f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
     c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
     cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y
             FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
     s AS (SELECT lang, cuts.phrase AS phrase, cuts.a AS a, n, cut, fx.f AS l, fy.f AS r, (1000::HUGEINT * a * n) // (fx.f::HUGEINT * fy.f) AS score
           FROM cuts JOIN f fx USING (lang) JOIN f fy USING (lang) JOIN n USING (lang) WHERE fx.phrase = x AND fy.phrase = y),
     m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
     i AS (SELECT DISTINCT lang, phrase, a FROM (SELECT lang, a, array_to_string(w[pos:pos + size - 1], ' ') AS phrase
           FROM (SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS pos FROM (SELECT *, unnest(range(2, k)) AS size FROM c)))),
     o AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = m.lang AND i.phrase = m.phrase AND i.a >= m.a)),
     t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM t WHERE rank <= 2000""",
    "op12_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS12} AS w FROM documents),
     b AS (SELECT row_number() OVER () AS item, item_id, {_TERMS12} AS w FROM benchmark),
     s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
     q AS (SELECT item, item_id, term, count(*) AS c FROM (SELECT item, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
     tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
     wt AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
     m AS (SELECT row, doc_id, 75 + (25 * len(w) * docs) // terms AS m FROM d, s WHERE len(w) > 0),
     x AS (SELECT item, item_id, row, doc_id, sum(c * wt.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 20""",
    "op13_hyperminhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingle FROM d),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
     link AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
     edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
     reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.r)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
     q AS (SELECT page_id, strlen(h) AS payload_bytes, max(page_id) OVER (PARTITION BY x) AS keeper,
                  list_transform([1, 11, 21, 31], lambda k: CAST('0x' || substr(x, k, 10) AS BIGINT)) AS parts FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((parts[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM q""",
    "op4_line_dedup": """
WITH l AS (SELECT doc_id, p AS pos, line, length(line) AS ns,
                  CASE WHEN regexp_full_match(line, '[ \\t\\r\\x0b\\x0c]*') THEN repeat('f', 33) ELSE md5(line) END AS h
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p
                 FROM documents WHERE length(text) > 0)),
     a AS (SELECT *, lead(h) OVER (PARTITION BY doc_id ORDER BY pos) AS nh FROM l),
     u AS (SELECT doc_id, pos, 2 AS size, h || nh AS run FROM a WHERE nh IS NOT NULL AND least(h, nh) <> repeat('f', 33)
           UNION ALL SELECT doc_id, pos, 1, h FROM a WHERE ns >= 40 AND h <> repeat('f', 33)),
     e AS (SELECT *, min((doc_id, pos)) OVER (PARTITION BY run) AS first FROM u),
     g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM e WHERE (doc_id, pos) <> first),
     r AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text
           FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
       CASE WHEN n_lines IS NULL THEN d.text ELSE coalesce(r.text, '') END AS text
FROM documents d LEFT JOIN r USING (doc_id)""",
    "op7_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS7}, []) AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS7} AS w FROM benchmark),
     bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
     dw AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
            FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
     hit AS (SELECT rid, item, dw.k, p FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
     n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hit) GROUP BY rid),
     i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)""",
}
