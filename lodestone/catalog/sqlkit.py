"""Fragments shared by the DuckDB statements."""

from __future__ import annotations

from lodestone.rules import fixed as R


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(xs) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


def values(rows) -> str:
    """VALUES rows from tuples of str / numbers / None / bool."""
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        return lit(v) if isinstance(v, str) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def squeeze(e: str) -> str:
    return strip(rf"regexp_replace({e}, '\s+', ' ', 'g')")


CONTROL = r"[\x00-\x1f\x7f-\x{9f}]"


def sanitize_query(e: str, cap: int | None = 500) -> str:
    a = strip(e) if cap is None else f"substring({strip(e)}, 1, {cap})"
    a = rf"regexp_replace(regexp_replace({a}, '{CONTROL}', '', 'g'), '\s+', ' ', 'g')"
    return rf"regexp_replace({a}, '[<>{{}}|\[\]\\^`]', '', 'g')"


def normalize_query(e: str) -> str:
    return squeeze(rf"regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g')")


def raw_tokens(e: str) -> str:
    return rf"regexp_split_to_array(regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+')"


def token_list(e: str, stop=R.MATCH_STOPWORDS) -> str:
    return f"list_filter({raw_tokens(e)}, lambda t: length(t) > 2 AND t NOT IN {in_list(stop)})"


def token_set(e: str, stop=R.MATCH_STOPWORDS) -> str:
    """Sorted distinct tokens."""
    return f"list_sort(list_distinct({token_list(e, stop)}))"


def words(e: str) -> str:
    return (rf"list_filter(regexp_split_to_array(regexp_replace(lower({e}), "
            rf"'[^\p{{L}}\p{{N}}_\s''-]', ' ', 'g'), '\s+'), lambda t: t <> '')")


def sentences(e: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({e}, '[.\\n]+'), lambda s: {strip('s')}), "
            f"lambda s: s <> '')")


# query_id, session_id, query: one row per sentence of each user turn
QLOG = f"""qlog AS (
  SELECT conv_id || '-' || turn || '-' || pos AS query_id, conv_id AS session_id, {sanitize_query('s', None)} AS query
  FROM (SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos
        FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.\\n]+') AS l
              FROM conversations WHERE role = 'user'))
  WHERE {sanitize_query('s', None)} <> '')"""

# query_id, pos, word
QWORDS = f"""{QLOG}, qwords AS (
  SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT query_id, {words('query')} AS w FROM qlog))"""

LAB = "lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)"

_NAMES = (r"list_filter(regexp_extract_all(text, '\p{Lu}\p{L}+'), lambda x, i: "
          r"list_position(regexp_extract_all(text, '\p{Lu}\p{L}+'), x) = i)")

DOCS = f"""{LAB}, docs0 AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS document_uuid, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
    {sentences('d.text')} AS key_facts, regexp_extract_all(d.text, '\\p{{Lu}}\\p{{L}}+') AS names_all,
    d.lang AS document_data_type, d.source AS document_schema, d.source AS document_category,
    d.n_chars AS word_count, least(d.n_chars / 100.0::DOUBLE, 100.0) AS content_depth_score,
    CAST(coalesce(l.quality * 100, 50) AS DOUBLE) AS authority_rank_score
  FROM documents d LEFT JOIN lab l ON d.doc_id = l.doc_id),
docs1 AS (
  SELECT *, coalesce(key_facts[1], '') AS document_title, text AS document_summary,
    list_filter(names_all, lambda x, i: list_position(names_all, x) = i) AS entity_names
  FROM docs0),
docs AS (
  SELECT *, {token_set('document_title')} AS primary_keywords, [lang, source] AS semantic_keywords,
    [source] AS topic_tags, coalesce(entity_names[1], '') AS primary_subject_name,
    entity_names[2:4] AS secondary_subjects,
    CASE WHEN quality = 1 THEN 'HIGH' WHEN quality = 0 THEN 'LOW' ELSE 'MEDIUM' END AS primary_subject_confidence,
    CASE lang WHEN 'en' THEN 'PERSON' WHEN 'fr' THEN 'PLACE' WHEN 'de' THEN 'EVENT' ELSE 'WORK' END AS primary_subject_type
  FROM docs1)"""

EVENTS = """ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS event_date,
    user_id || '-' || strftime(ts, '%Y%m%d') AS session_id
  FROM events)"""

SEARCHES = f"""{EVENTS}, searches AS (
  SELECT *, k AS results_count, value AS search_time_ms, CASE WHEN k % 2 = 0 THEN 'n' ELSE 'y' END AS mode,
    'query ' || (k % 25) AS query
  FROM ev WHERE event_type = 'view')"""

CLICKS = """clicks AS (
  SELECT *, k AS clicked_position, CAST(trunc(value * 100) AS BIGINT) AS time_to_click_ms, k % 20 AS doc_key,
    'https://site.example/' || (k % 20) AS clicked_url, 'query ' || (k % 25) AS query
  FROM ev WHERE event_type = 'click')"""

PLACES = """places AS (
  SELECT c_custkey AS place_user, n_name AS location_city, r_name AS location_country
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

VOCTOK = f"""voctok AS (
  SELECT term, lang, count(*) AS n
  FROM (SELECT lang, unnest({token_list('text')}) AS term FROM documents) GROUP BY term, lang)"""

VOCAB = f"""{VOCTOK}, vocab AS (
  SELECT term, CAST(sum(n) AS BIGINT) AS rank, arg_min(lang, (-n, lang)) AS category, 'noun' AS pos
  FROM voctok GROUP BY term)"""


def ngrams(n: int, name: str, least: int = 1) -> str:
    return f"""{name} AS (
  SELECT term, CAST(sum(n) AS BIGINT) AS rank, arg_min(lang, (-n, lang)) AS category, 'noun' AS pos
  FROM (SELECT term, lang, count(*) AS n
        FROM (SELECT lang, array_to_string(tk[i:i+{n - 1}], ' ') AS term
              FROM (SELECT lang, tk, unnest(range(1, len(tk) - {n - 2})) AS i
                    FROM (SELECT lang, {token_list('text')} AS tk FROM documents) WHERE len(tk) >= {n}))
        GROUP BY term, lang)
  GROUP BY term HAVING sum(n) >= {least})"""


PRODUCTS = """products AS (
  SELECT p_partkey, p_name AS product_name, p_brand AS product_brand, p_type AS product_category,
    p_size AS product_size, split_part(p_name, ' ', 1) AS product_color, p_retailprice AS product_price,
    coalesce(n, 0) AS product_review_count, round(q / n / 10, 4) AS product_rating,
    p_partkey % 3 = 0 AS black_owned, p_partkey % 7 <> 0 AS in_stock
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
    ON p_partkey = l_partkey)"""

EATERIES = """eateries AS (
  SELECT s_suppkey, s_name AS document_title, n_name AS location_city, r_name AS location_state,
    round(((s_acctbal % 5.0) + 5.0) % 5.0, 2) AS service_rating, coalesce(n, 0) AS service_review_count,
    'type' || (s_suppkey % 4) AS service_type, repeat('$', CAST(s_suppkey % 4 + 1 AS INTEGER)) AS price_symbol,
    s_suppkey % 2 = 0 AS delivery, s_suppkey % 5 = 0 AS reservations, s_suppkey % 3 = 0 AS black_owned,
    s_acctbal AS authority_score
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)"""

TRIPS = """trips AS (
  SELECT o_orderkey, o_orderstatus AS event_type, CAST(o_orderdate AS DATE) AS event_date_start,
    n_name AS location_country, r_name AS location_region, o_orderpriority AS topic,
    o_totalprice < 50000 AS is_free, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

QUESTIONS = f"""questions AS (
  SELECT item_id, CAST(item_id AS VARCHAR) AS document_uuid, text AS question, label, embedding,
    {token_set('text')} AS tokens,
    CASE label % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'FACTUAL' ELSE 'TEMPORAL' END AS question_type
  FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)"""

PAGES = r"""pg AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
    regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^\s+|\s+$', '', 'g') AS title,
    regexp_extract_all(html, 'href="([^"]*)"', 1) AS image_url,
    regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang
  FROM pages)"""


def _by_lang(c: str, out: dict) -> str:
    return "CASE " + c + "".join(f" WHEN {lit(k)} THEN {lit(v)}" for k, v in out.items()) + " END"


POS_LANG = {"en": "noun", "fr": "verb", "de": "adjective", "es": "adverb"}
CAT_LANG = {"en": "Education", "fr": "US City", "de": "Person", "es": "US State"}


def named(src: str, name: str) -> str:
    return (f"{name} AS (SELECT term, {_by_lang('category', CAT_LANG)} AS category, rank, "
            f"{_by_lang('category', POS_LANG)} AS pos FROM {src})")


NVOCAB = f"{VOCAB}, {named('vocab', 'nv')}"


def asked(forms) -> str:
    cases = []
    for i, f in enumerate(forms):
        parts = f.split("{q}")
        e = lit(parts[0]) + "".join(f" || query || {lit(p)}" for p in parts[1:])
        cases.append(f"WHEN {i} THEN {e}")
    expr = f"CASE (length(query) + session_id) % {len(forms)} {' '.join(cases)} END"
    return f"""{QLOG}, asked AS (SELECT query_id, session_id, {sanitize_query('q', None)} AS query
  FROM (SELECT query_id, session_id, {expr} AS q FROM qlog)),
awords AS (SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT query_id, {words('query')} AS w FROM asked))"""


PREFIXES = f"""{QWORDS}, prefixes AS (
  SELECT DISTINCT prefix FROM (SELECT word AS prefix FROM qwords UNION ALL SELECT substring(word, 1, 4) FROM qwords))"""


def deletes(src: str, col: str, name: str) -> str:
    """src(col) -> name(col, key): leading ten characters with up to two removed."""
    return f"""{name}0 AS (SELECT DISTINCT {col}, substring({col}, 1, 10) AS key FROM {src}),
{name}1 AS (SELECT DISTINCT {col}, substring(key, 1, i - 1) || substring(key, i + 1) AS key
  FROM (SELECT {col}, key, unnest(range(1, length(key) + 1)) AS i FROM {name}0)),
{name}2 AS (SELECT DISTINCT {col}, substring(key, 1, i - 1) || substring(key, i + 1) AS key
  FROM (SELECT {col}, key, unnest(range(1, length(key) + 1)) AS i FROM {name}1)),
{name} AS (SELECT * FROM {name}0 UNION SELECT * FROM {name}1 UNION SELECT * FROM {name}2)"""


def lev(a: str, b: str) -> str:
    """Plain distance by characters (the built-in counts bytes)."""
    def one(e):
        return f"translate({e}, 'ßäöüàâáçéèêëíñóúùûôîï', 'ABCDEFGHIJKLMNOPQRSTU')"
    return f"levenshtein({one(a)}, {one(b)})"


def near(words: str, wcol: str, terms: str) -> str:
    """near(word, term, lev, distance): pairs within two edits, swaps counted as one."""
    return f"""{deletes(words, wcol, 'wd')}, {deletes(terms, 'term', 'td')},
pairs AS (SELECT DISTINCT {wcol} AS word, term FROM wd JOIN td USING (key)
  WHERE abs(length({wcol}) - length(term)) <= 2 AND {lev(wcol, 'term')} <= 2),
near AS (SELECT word, term, {lev('word', 'term')} AS lev, CASE WHEN {lev('word', 'term')} = 2 AND length(word) = length(term)
   AND len(list_filter(range(1, length(word)), lambda i: substring(word, 1, i - 1) || substring(word, i + 1, 1) || substring(word, i, 1)
     || substring(word, i + 2) = term)) > 0 THEN 1 ELSE {lev('word', 'term')} END AS distance FROM pairs)"""


FIELDS = {"primary_subject_name": 100, "document_title": 10, "entity_names": 8, "primary_keywords": 6, "secondary_subjects": 5,
          "key_facts": 4, "semantic_keywords": 3}
_LISTS = {"entity_names", "primary_keywords", "secondary_subjects", "key_facts", "semantic_keywords", "topic_tags"}


def field_text(f: str) -> str:
    return f"array_to_string({f}, ' ')" if f in _LISTS else f


def posting_sql(fields: dict, name: str = "post") -> str:
    parts = " UNION ALL ".join(f"SELECT document_uuid, unnest({token_set(field_text(f))}) AS token, {w} AS w FROM docs" for f, w in fields.items())
    return f"{name} AS (SELECT token, document_uuid, CAST(sum(w) AS BIGINT) AS weight FROM ({parts}) GROUP BY 1, 2)"


POST = posting_sql(FIELDS)
QT = f"""qt AS (SELECT query_id, {token_set('query')} AS ts FROM qlog), qtok AS (SELECT query_id, len(ts) AS need, unnest(ts) AS token FROM qt)"""
HITS = """hits AS (SELECT query_id, document_uuid, CAST(sum(weight) AS BIGINT) AS text_match FROM qtok JOIN post USING (token) GROUP BY 1, 2, need HAVING count(*) = need)"""
STAR = """star AS (SELECT query_id, document_uuid, 0 AS text_match FROM qt, (SELECT document_uuid FROM docs ORDER BY authority_rank_score DESC, document_uuid LIMIT 100) WHERE len(ts) = 0)"""
CAND = f"""{QLOG}, {DOCS}, {POST}, {QT}, {HITS}, {STAR}, cand AS (
  SELECT query_id, c.document_uuid, text_match, row_number() OVER w AS candidate_rank FROM (SELECT * FROM hits UNION ALL SELECT * FROM star) c JOIN docs USING (document_uuid)
  WINDOW w AS (PARTITION BY query_id ORDER BY text_match DESC, authority_rank_score DESC, c.document_uuid))"""


def dist(a: str, b: str) -> str:
    return f"round(1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 9)"
