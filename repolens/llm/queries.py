"""Registered queries of the ``llm`` operators: thin wrappers that apply an
operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, write_table
from . import bpe, chat, collocations, exact, fingerprint, jaccard, language, lexical, mixture, neighbours, pii, substrings, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir.rstrip("/"))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]

_OP1_SQL = """
WITH r(r_host, r_path, r_verdict) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS rid, page_id,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (SELECT rid, r_host || r_path AS rule, r_verdict,
        row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
      FROM h JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM h LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)
""".format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))


@register("op1_url_filter", _OP1_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block every page by URL rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_table(spark, sf_dir, "pages", "page_id", "url"), rules)


_OP4_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
-- The sources that reach their cap first are those with the smallest cap for
-- their weight; the rate is the one under which just these are capped.
o AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
        sum(weight) OVER (ORDER BY 2 * source_size / weight DESC, source DESC NULLS FIRST) AS free FROM s),
c AS (SELECT arg_min((1.5::DOUBLE * total - 2 * used) / free, 2 * source_size / weight) FILTER (WHERE (1.5::DOUBLE * total - 2 * used) / free * weight < 2 * source_size) AS rate FROM o),
t AS (SELECT source, source_size, CASE WHEN rate IS NULL OR weight * rate >= 2 * source_size THEN 2.0 * source_size ELSE weight * rate END::DOUBLE AS target FROM s, c),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base,
        CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS need FROM t),
k AS (SELECT source, hash, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS after, sum(size) AS words FROM d GROUP BY source, hash)
SELECT d.doc_id, d.size, b.source_size, b.target,
  (d.size * (base + CASE WHEN need > 0 AND (after <= need OR (after - words <= need AND after - need < need - (after - words))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.hash = k.hash
"""


@register("op4_mix_sources", _OP4_SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    thin, sources = mixture.plan_mixture(_table(spark, sf_dir, "documents", "doc_id", "text", "source"), mixture.cyclic_weights)
    return mixture.take(thin, sources).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    """The public byte-level vocabulary of op8; other files are an argument
    of ``bpe.Tokenizer``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.token_digests(bpe.encode_table(docs, bpe.Tokenizer(spark, tokenizer_path())))


@register("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    terms = write_table(pii.revealing_terms(docs), "pii-terms")
    spans = pii.find_spans(docs, terms)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = pii.span_string(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS)))
    return spans.select("doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(base, 256).alias("base_sha256"),
                        pii.span_string(F.col("spans")).alias("spans"))


_OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, replace(replace(role, '%', '%25'), chr(10), '%0A') AS head,
        regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g') AS body FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || head || ':' || chr(10) || body || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@register("op2_chat_format", _OP2_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and -7 of conflicting texts, formatted and read back."""
    odd = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


@register("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, declared language and source."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    model = language.fit(docs)
    if model is None:
        return spark.createDataFrame([], "doc_id long, language string, confidence double, text_language string, keep boolean")
    scored = write_table(docs.select("doc_id", "lang", "source", language.score_column(spark, model, F.col("text")).alias("scores")), "language-scores")
    return (language.identify(scored, model, F.col("lang"), F.col("source"), scored=F.col("scores"))
            .select("doc_id", "language", "confidence", "text_language", "keep"))


@register("language_id_pages")
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its visible text, markup, address suffix
    and host, with the model fitted on documents."""
    model = language.fit(_table(spark, sf_dir, "documents", "text", "lang"))
    if model is None:
        return spark.createDataFrame([], "page_id long, language string, confidence double, text_language string, keep boolean")
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    host = F.regexp_replace(url_rules.url_parts(F.col("url"))[0], "^.*@|:[0-9]*$", "")
    shown = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    parts = pages.select("page_id", F.when(host != "", host).alias("host"), shown.alias("text"),
                         F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1).alias("declared"))
    scored = write_table(parts.select("page_id", "host", "declared", language.score_column(spark, model, F.col("text")).alias("scores")), "page-scores")
    return (language.identify(scored, model, F.col("declared"), F.col("host"), language.address_suffix(F.col("host")), scored=F.col("scores"))
            .select("page_id", "language", "confidence", "text_language", "keep"))


@register("op9_nearest")
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return neighbours.search(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0)


@register("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that stand in a smaller one."""
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by shingle similarity."""
    return jaccard.similar_components(_table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op6_jaccard_links")
def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op6_jaccard_join, with each document's number of links."""
    return jaccard.similar_components(_table(spark, sf_dir, "documents", "doc_id", "text"), links=True)


_OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm)::BIGINT AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
"""


@register("op12_exact_dedup", _OP12_SQL)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the equal one that stays."""
    return exact.find_copies(_table(spark, sf_dir, "documents", "doc_id", "text"))


_OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT rid, doc_id, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM d),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (
        SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(ts) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT i, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))))::BIGINT AS score
      FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, rid)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


@register("op13_lexical_search", _OP13_SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


_OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
        SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
x AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
c AS (SELECT x.lang, x.phrase, a, x.k, fl.f AS l, fr.f AS r, (2000000 * a) // (fl.f + fr.f) AS score
      FROM (SELECT *, unnest(range(1, m)) AS k FROM x) x
      JOIN f fl ON fl.lang = x.lang AND fl.phrase = array_to_string(ws[1:x.k], ' ')
      JOIN f fr ON fr.lang = x.lang AND fr.phrase = array_to_string(ws[x.k + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase AS sub, max(a) AS longer FROM (
        SELECT lang, a, array_to_string(ws[s:s + j - 1], ' ') AS phrase FROM (
          SELECT *, unnest(range(1, m - j + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS j FROM x))) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)::BIGINT AS rank, b.phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.sub = b.phrase
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""


@register("op11_collocations", _OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two to four words of every language."""
    return collocations.mine(_table(spark, sf_dir, "documents", "lang", "text"))
