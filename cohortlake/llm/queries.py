"""The registered query of every operator, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import (
    bpe,
    collocations,
    decontaminate,
    fingerprints,
    html_text,
    mixing,
    quality,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
    whitening,
)
from cohortlake.llm.common import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


@query("op10_simhash_near_copies")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, at most 4 differing bits, all of ``documents``."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents`` by a field trained on the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    crf = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, crf)
    return scored.select(
        F.col("id").alias("doc_id"),
        toxicity.held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        F.transform("spans", lambda s: s["start"]).alias("span_starts"),
    )


@query("op9_document_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of 128 five-word shingle hashes of all ``documents`` and their edited texts."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"), k=128, shingle=5)


# Of these pages: the lines of the article element, cut at its block elements.
ARTICLE_SQL = r"""
WITH body AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS body FROM pages
), pieces AS (
  SELECT page_id, url, list_transform(
    regexp_split_to_array(regexp_replace(body, '<br[^>]*>', ' ', 'g'), '</?(?:p|h1)(?: [^>]*)?>'),
    lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS pieces FROM body
), decoded AS (
  SELECT page_id, url, list_transform(pieces, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(x, '&amp;|&amp', chr(1), 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), chr(1), '&'), '\s+', ' ', 'g'))) AS lines FROM pieces
), joined AS (
  SELECT page_id, url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) AS text FROM decoded
)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM joined
"""


@query("op5_html_text", ARTICLE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Where no host rule fits: listings, session pages and logins are no documents.
PATTERN_RULES = (
    ("listing page", "block", r"[?&]page=[0-9]+(?:[&#]|$)", ["page"]),
    ("session", "block", r"(?i)[?&;](?:jsessionid|phpsessid)=", []),
    ("login", "block", r"(?i)/login(?:[/?#]|$)", ["login"]),
)

URL_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), places AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), judged AS (
  SELECT *,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN regexp_matches(url, '[?&]page=[0-9]+([&#]|$)') THEN 'listing page'
         WHEN regexp_matches(url, '(?i)[?&;](jsessionid|phpsessid)=') THEN 'session'
         WHEN regexp_matches(url, '(?i)/login([/?#]|$)') THEN 'login' END AS other
  FROM places
)
SELECT page_id, url, host, path, rule, CASE WHEN rule IS NULL THEN other END AS pattern_rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN other IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op4_url_filter", URL_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` against four host rules and three pattern rules."""
    rules = url_filter.host_rules(spark, HOST_RULES).unionByName(url_filter.pattern_rules(spark, PATTERN_RULES))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def _seed_sql(source: str, key: str) -> str:
    """Places of the masks in the word lists of a table, with the words they take."""
    parts = []
    for mask in decontaminate.MASKS:
        taken = " || ' ' || ".join(f"w[pos + {i + 1}]" for i, bit in enumerate(mask) if bit == "1")
        parts.append(
            f"SELECT {key}, pos, '{mask} ' || {taken} AS seed FROM"
            f" (SELECT {key}, w, unnest(range(len(w) - {len(mask)} + 1)) AS pos FROM {source} WHERE len(w) >= {len(mask)})"
        )
    return " UNION ALL ".join(parts)


LEAK_SQL = rf"""
WITH d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
    FROM benchmark) GROUP BY w
), hits AS (
  SELECT DISTINCT s.doc_id, t.item_id, s.pos - t.pos AS shift
  FROM ({_seed_sql("d", "doc_id")}) s JOIN ({_seed_sql("b", "item_id")}) t USING (seed)
), laid AS (
  SELECT doc_id, item_id, shift, least(13, len(b.w)) AS n, d.w AS dw, b.w AS iw,
    greatest(0, -shift) AS first, least(len(b.w), len(d.w) - shift) AS past
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), windows AS (
  SELECT doc_id, item_id, shift, n, s AS item_start, s + shift AS doc_start,
    len(list_filter(range(s, s + n), lambda j: iw[j + 1] = dw[j + shift + 1])) AS n_equal
  FROM (SELECT *, unnest(range(first, past - n + 1)) AS s FROM laid)
)
SELECT doc_id, item_id, CAST(doc_start AS INTEGER) AS doc_start, CAST(item_start AS INTEGER) AS item_start,
  CAST(n AS INTEGER) AS n_window, CAST(n_equal AS INTEGER) AS n_equal, n_equal / n AS similarity
FROM windows WHERE n_equal >= ceil(0.8 * n - 1e-9)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, doc_start, item_start) = 1
"""


@query("op2_benchmark_leaks", LEAK_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.benchmark_leaks(docs, benchmark, short=True).drop("key")


REPEAT_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), suffixes AS (
  SELECT doc_id, pos, substr(x, 2 * pos + 1, 100) AS s FROM (SELECT doc_id, x, n, unnest(range(n - 49)) AS pos FROM d WHERE n >= 50)
), firsts AS (
  SELECT s, min(doc_id) AS owner FROM suffixes GROUP BY s
), repeated AS (
  SELECT DISTINCT doc_id, pos FROM suffixes JOIN firsts USING (s) WHERE owner < doc_id
), bytes AS (
  SELECT doc_id, pos, substr(x, 2 * pos + 1, 2) AS b FROM (SELECT doc_id, x, unnest(range(n)) AS pos FROM d)
), covered AS (
  SELECT b.doc_id, b.pos, b.b,
    coalesce(b.pos - max(r.pos) OVER (PARTITION BY b.doc_id ORDER BY b.pos) < 50, false) AS gone
  FROM bytes b LEFT JOIN repeated r ON r.doc_id = b.doc_id AND r.pos = b.pos
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM covered
), kept AS (
  SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (opens) AS BIGINT) AS n_spans,
    coalesce(string_agg(b, '' ORDER BY pos) FILTER (NOT gone), '') AS x
  FROM edges GROUP BY doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op6_suffix_dedup", REPEAT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that repeat across all of ``documents``."""
    return suffix_dedup.repeated_text(table(spark, sf_dir, "documents"), least=50)


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all ``documents`` under a public vocabulary of 32,000 scored pieces."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``; no labels are read."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs))


def mix_levels() -> list[mixing.Level]:
    """Domains are groups of sources; every level's weights are among siblings.

    The last two digits of a source's first number decide, so it may have any length; a source
    without a number is in the domain ``(none)``."""
    domain = F.right(F.regexp_extract("source", "([0-9]+)", 1), F.lit(2)).try_cast("int") % 4
    lang = F.col("lang")
    return [
        mixing.Level("domain", F.concat(F.lit("domain"), domain.cast("string")), F.when(domain == 0, 4000).otherwise(2000)),
        mixing.Level("lang", lang, F.when(lang == "en", 4000).when(lang == "de", 3000).otherwise(1500)),
        mixing.Level("source", F.col("source"), F.lit(1)),
    ]


def half_of_all():
    return F.floor(F.col("total") * 0.5)


def _level_sql(depth: int, name: str, path: list[str], parent: list[str], weight: str) -> str:
    """The children of one level and how their parent's budget is split."""
    keys, above = ", ".join(path), ", ".join(parent)
    by = f"PARTITION BY {above}" if parent else ""
    source = f"JOIN g{depth - 1} USING ({above})" if parent else ", g_top"
    return f"""
n{depth} AS (SELECT {keys}, CAST(sum(tokens) * 2 AS HUGEINT) AS cap, CAST(max({weight}) AS HUGEINT) AS w FROM leaves GROUP BY {keys}),
r{depth} AS (
  SELECT n.*, b, coalesce(sum(cap) OVER prior, 0) AS cap_before,
    sum(w) OVER ({by}) - coalesce(sum(w) OVER prior, 0) AS w_left
  FROM n{depth} n {source}
  WINDOW prior AS ({by} ORDER BY cap::DOUBLE / w::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f{depth} AS (SELECT *, cap * w_left <= (b - cap_before) * w AS is_full FROM r{depth}
), s{depth} AS (
  SELECT *, b - coalesce(sum(cap) FILTER (is_full) OVER ({by}), 0) AS rest_b, sum(w) FILTER (NOT is_full) OVER ({by}) AS rest_w FROM f{depth}
), p{depth} AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE (rest_b * w)::HUGEINT // rest_w::HUGEINT END AS part,
    CASE WHEN is_full THEN 0 ELSE (rest_b * w)::HUGEINT % rest_w::HUGEINT END AS frac FROM s{depth}
), g{depth} AS (
  SELECT {keys}, part + CASE WHEN row_number() OVER ({by} ORDER BY is_full, frac DESC, {name}) <= b - sum(part) OVER ({by}) THEN 1 ELSE 0 END AS b
  FROM p{depth}
)"""


MIX_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n,
    'domain' || (CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 4) AS domain, lang, source
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n) AS tokens,
    CASE WHEN domain = 'domain0' THEN 4000 ELSE 2000 END AS w_domain,
    CASE lang WHEN 'en' THEN 4000 WHEN 'de' THEN 3000 ELSE 1500 END AS w_lang, 1 AS w_source
  FROM d WHERE n > 0 GROUP BY ALL
), g_top AS (SELECT CAST(floor(sum(tokens) * 0.5) AS HUGEINT) AS b FROM leaves),"""
    + _level_sql(0, "domain", ["domain"], [], "w_domain")
    + ","
    + _level_sql(1, "lang", ["domain", "lang"], ["domain"], "w_lang")
    + ","
    + _level_sql(2, "source", ["domain", "lang", "source"], ["domain", "lang"], "w_source")
    + r"""
, plan AS (
  SELECT domain, lang, source, CAST(b // tokens::HUGEINT AS BIGINT) AS whole, CAST(b % tokens::HUGEINT AS BIGINT) AS rest
  FROM g2 JOIN leaves USING (domain, lang, source) WHERE b > 0
), placed AS (
  SELECT d.*, whole, rest,
    CAST('0x' || substr(md5('7|' || (whole + 1) || '|' || doc_id || '|' || digest), 1, 15) AS BIGINT) AS h
  FROM d JOIN plan USING (domain, lang, source) WHERE n > 0
), run AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed
)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(n AS BIGINT) AS n_tokens, CAST(taken AS BIGINT) AS taken
FROM (
  SELECT *, unnest(range(1, whole + 1)) AS epoch, n AS taken FROM run
  UNION ALL
  SELECT *, whole + 1 AS epoch, greatest(0, least(n, rest - before)) AS taken FROM run
) WHERE taken > 0
"""
)


@query("op1_source_mix", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the tokens of all ``documents``, by domain, language and source, two epochs at most."""
    return mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), half_of_all(), seed=7, max_epochs=2)


WORD_VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@query("op11_bpe_round_trip")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded and decoded with a public vocabulary of byte pairs."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` projected on the 16 leading components of the distinct ones."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, wanted=16))


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), spans AS (
  SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM starts
), f AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS n FROM spans GROUP BY ALL HAVING count(*) >= 100
), total AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), cuts AS (
  SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.n AS l, r.n AS r, t.n AS n,
    (1000 * c.a::HUGEINT * t.n::HUGEINT) // (l.n::HUGEINT * r.n::HUGEINT) AS score
  FROM cuts c JOIN total t USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1 :], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), sub AS (
  SELECT lang, n, string_split(phrase, ' ') AS w, k, unnest(range(1, k + 1)) AS i FROM f WHERE k > 2
), inside AS (
  SELECT lang, array_to_string(w[i : j], ' ') AS phrase, max(n) AS around
  FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM sub) WHERE j - i + 1 < k GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""


@query("op13_phrases", PHRASE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 5 words in all ``documents``, 100 times or more in a language, the 2000 best of each."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)
