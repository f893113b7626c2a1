"""Query signals, profiles and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.catalog.section_c2 import _NG, _NGC, _greedy, _validated
from lodestone.operators import profile as P
from lodestone.operators import signals as O
from lodestone.operators import understand as U
from lodestone.operators import vocab as V
from lodestone.rules import lexicon as L
from lodestone.sources import mapping as M

c = F.col
IN = S.in_list


def _dom(word: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {word} IN {IN(ws)} THEN '{n}' END" for n, ws in L.DOMAINS.items()) + "], lambda z: z IS NOT NULL)"


def _overlap(ctx: str) -> str:
    return "[" + ", ".join(f"len(list_filter({ctx}, lambda z: z IN {IN(ws)}))" for ws in L.DOMAINS.values()) + "]"


_NAMES = "[" + ", ".join(f"'{n}'" for n in L.DOMAINS) + "]"
_ACTION = "CASE " + " ".join(f"WHEN word IN {IN(ws)} THEN '{a}'" for a, ws in L.ACTIONS.items()) + " END"
_ANY = "coalesce(bool_or({}), false)"


def _any(cond, name):
    return f"{_ANY.format(cond)} AS {name}"


def _last(cond, name, val="word"):
    return f"arg_max({val}, pos) FILTER ({cond}) AS {name}"


def _first(cond, name, val="word"):
    return f"arg_min({val}, pos) FILTER ({cond}) AS {name}"


_NOUN = "pos_tag IN ('noun', 'proper_noun')"
_PLURAL = f"({_NOUN} AND word LIKE '%s' AND length(word) > 3)"
_PLACE = "category IN ('US City', 'US State')"
_OWNED = " OR ".join(f"contains(lower(query), '{p}')" for p in L.OWNED_PHRASES)
SIG = f"""{S.asked(M.ASK_FORMS)}, {_validated('awords')},
nb AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS nw, lag(word) OVER w AS p1, lag(word, 2) OVER w AS p2, lead(word) OVER w AS n1, lead(word, 2) OVER w AS n2
  FROM vw WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
cx AS (SELECT *, list_distinct(list_filter([p2, p1, n1, n2], lambda z: z IS NOT NULL AND z <> word)) AS ctx FROM nb),
ov AS (SELECT *, CASE WHEN word IN {IN(L.AMBIGUOUS)} THEN {_overlap('ctx')} END AS sc FROM cx),
dm AS (SELECT *, CASE WHEN word IN {IN(L.AMBIGUOUS)} THEN CASE WHEN list_max(sc) > 0 THEN [{_NAMES}[list_position(sc, list_max(sc))]] ELSE [] END
  WHEN category = 'stopword' THEN [] ELSE {_dom('word')} END AS domains, {_ACTION} AS act,
  CASE WHEN word IN {IN(L.PRICE_CHEAP)} THEN 'cheap' WHEN word IN {IN(L.PRICE_EXPENSIVE)} THEN 'expensive' END AS price FROM ov),
s0 AS (SELECT query_id, count(*) AS word_count, {_any(f'word IN {IN(L.QUESTION_WORDS)}', 'has_question_word')}, {_last(f'word IN {IN(L.QUESTION_WORDS)}', 'question_word')},
  {_last(f'word IN {IN(L.QUESTION_WORDS)}', 'question_position', "CASE WHEN pos = 1 THEN 'start' WHEN pos = nw THEN 'end' ELSE 'middle' END")},
  {_any(f'pos = 1 AND word IN {IN(L.QUESTION_STARTERS)}', 'has_question_starter')},
  {_any(f'word IN {IN(L.TEMPORAL_OLDEST + L.TEMPORAL_NEWEST)}', 'has_temporal')},
  {_last(f'word IN {IN(L.TEMPORAL_OLDEST + L.TEMPORAL_NEWEST)}', 'temporal_direction', f"CASE WHEN word IN {IN(L.TEMPORAL_OLDEST)} THEN 'oldest' ELSE 'newest' END")},
  {_any(f'word IN {IN(L.PROXIMITY)}', 'has_proximity')}, {_first(f'word IN {IN(L.PROXIMITY)} AND pos < nw', 'pf')}, {_last(f'word IN {IN(L.PROXIMITY)}', 'pl')},
  {_any(f'word IN {IN(L.LOCATION_PREPOSITIONS)}', 'has_location_preposition')},
  {_any(f"word IN {IN(L.ME_WORDS)} OR (word = 'my' AND n1 IN {IN(L.MY_PLACES)})", 'has_me_reference')},
  {_any(f'word IN {IN(L.SUPERLATIVE)}', 'has_superlative')}, {_last(f'word IN {IN(L.SUPERLATIVE)}', 'superlative_word')},
  {_any(f'word IN {IN(L.QUANTITY)}', 'has_quantity_word')}, {_any('act IS NOT NULL', 'has_action_word')}, {_first('act IS NOT NULL', 'action_type', 'act')},
  {_any(f'word IN {IN(L.SERVICE)}', 'has_service_word')}, {_any(f'word IN {IN(L.PRODUCT)}', 'has_product_word')},
  {_any(f'word IN {IN(L.ROLE)}', 'has_role_word')}, {_first(f'word IN {IN(L.ROLE)}', 'role_word')}, {_any(f'word IN {IN(L.RATING)}', 'has_rating_signal')},
  {_any(f'word IN {IN(L.COMPARISON)}', 'cmp')},
  {_any(f"pos = 1 AND ((word = 'what' AND n1 IN ('is', 'are', 'was', 'were')) OR (word = 'who' AND n1 IN ('is', 'was')) OR (word IN {IN(L.DEFINITION)} AND n1 IS NOT NULL))", 'is_definition_query')},
  coalesce(flatten(list(list_filter([p1, n1], lambda z: z IS NOT NULL) ORDER BY pos) FILTER (word IN {IN(L.COMPARISON_MARKERS)})), []) AS items,
  {_any(f'word IN {IN(L.NEGATION)}', 'has_negation')},
  coalesce(list_filter(list(array_to_string(list_filter([n1, n2], lambda z: z IS NOT NULL AND z NOT IN {IN(L.NEGATION_SKIP)}), ' ') ORDER BY pos)
    FILTER (word IN {IN(L.NEGATION)}), lambda z: z <> ''), []) AS negated,
  {_any('price IS NOT NULL', 'has_price_signal')}, {_first('price IS NOT NULL', 'price_direction', 'price')}, {_any("word = 'black' AND n1 = 'owned'", 'owned2')},
  {_any(_PLACE, 'has_location')}, {_any(_PLURAL, 'has_plural_noun')}, {_any(f'{_NOUN} AND pos = 1', 'starts_with_noun')}, {_any(f'{_NOUN} AND pos = nw', 'ends_with_noun')},
  {_any("pos_tag = 'adjective'", 'has_adjective')}, {_any("pos_tag IN ('verb', 'be', 'auxiliary', 'modal')", 'has_verb')},
  count(*) FILTER ({_NOUN}) AS nn, count(*) FILTER (category <> 'stopword') AS nc, count(*) FILTER (status = 'unknown') AS unknown_term_count,
  {_any("category = 'Person'", 'has_person')}, false AS has_organization,
  [{', '.join(f"count(*) FILTER (list_contains(domains, '{n}'))" for n in L.DOMAINS)}] AS dsc
  FROM dm GROUP BY query_id),
s1 AS (SELECT s0.*, a.query, coalesce(pf, pl) AS proximity_word, cmp OR len(items) >= 2 AS is_comparison_query, CASE WHEN len(items) >= 2 THEN items ELSE [] END AS comparison_items,
  {_OWNED} OR owned2 AS has_black_owned, nc > 0 AND nn = nc AS all_nouns, unknown_term_count > 0 AS has_unknown_terms,
  CASE WHEN list_max(dsc) > 0 THEN {_NAMES}[list_position(dsc, list_max(dsc))] END AS primary_domain,
  list_transform(list_sort(list_filter(list_transform(dsc, lambda n, i: [-n, i]), lambda z: z[1] < 0)), lambda z: {_NAMES}[z[2]]) AS domains_detected,
  has_service_word AND (has_location OR has_proximity OR has_me_reference) AS is_local_search,
  CAST(has_service_word AS INT) + CAST(has_location AS INT) + CAST(has_proximity AS INT) + CAST(has_me_reference AS INT) AS four
  FROM s0 JOIN asked a ON s0.query_id = a.query_id),
sig AS (SELECT *, CASE WHEN NOT is_local_search THEN 'none' WHEN four >= 3 THEN 'strong' ELSE 'weak' END AS local_search_strength,
  {' + '.join(f'CAST({x} AS BIGINT)' for x in L.COUNTED_SIGNALS)} AS signal_count,
  CASE WHEN is_comparison_query THEN 'compare' WHEN has_product_word AND (coalesce(action_type = 'buy', false) OR has_price_signal) THEN 'shop' WHEN is_local_search THEN 'local'
    WHEN question_word IN ('who', 'when', 'where') THEN 'answer' WHEN question_word = 'what' AND is_definition_query THEN 'answer'
    WHEN question_word IN ('what', 'how', 'why') AND (has_person OR has_organization OR has_role_word
      OR NOT (has_plural_noun OR has_superlative OR has_quantity_word OR has_service_word)) THEN 'answer'
    WHEN has_temporal AND has_role_word THEN 'answer' WHEN has_service_word OR has_plural_noun OR has_quantity_word OR has_superlative THEN 'browse' ELSE 'explore' END AS query_mode FROM s1)"""


def _words(t):
    return V.validate_words(M.query_words(M.asked_queries(t)), M.named_vocabulary(t))


def _sig(t, flags=None):
    return O.signals(_words(t), M.asked_queries(t))


def _join(x):
    return F.array_join(x, "|").alias(x)


def signal_query(name, cols, lists=()):
    names = [*cols, *lists]
    sql = ", ".join([*cols, *[f"array_to_string({x}, '|') AS {x}" for x in lists]])

    @query(name, f"WITH {SIG} SELECT query_id, {sql} FROM sig")
    def run(t):
        s = _sig(t).select("query_id", *cols, *[_join(x) for x in lists])
        return s.select("query_id", *[c(x).cast("bigint") if dict(s.dtypes)[x] in ("int",) else c(x) for x in names])
    return run


signal_query("c34_lexicon_signals", ["word_count", "has_question_word", "question_word", "question_position", "has_question_starter", "has_temporal",
                                     "temporal_direction", "has_superlative", "superlative_word", "has_quantity_word", "has_action_word", "action_type",
                                     "has_service_word", "has_product_word", "has_role_word", "role_word", "has_rating_signal", "has_location_preposition"])
signal_query("c36_pattern_signals", ["is_definition_query", "has_me_reference", "has_proximity", "proximity_word"])
signal_query("c37_comparison_items", ["is_comparison_query"], ["comparison_items"])
signal_query("c39_price_signal", ["has_price_signal", "price_direction"])
signal_query("c40_ownership_signal", ["has_black_owned"])
signal_query("c42_domain_scores", ["primary_domain"], ["domains_detected"])
signal_query("c43_pos_structure", ["all_nouns", "starts_with_noun", "ends_with_noun", "has_adjective", "has_verb", "has_plural_noun"])
signal_query("c45_local_signal", ["is_local_search", "local_search_strength"])
signal_query("c46_signal_count", ["signal_count"])
signal_query("c47_query_mode", ["query_mode"])


@query("c38_negated_terms", f"WITH {SIG} SELECT query_id, has_negation, array_to_string(negated, '|') AS negated_terms FROM sig")
def c38(t):
    return _sig(t).select("query_id", "has_negation", _join("negated_terms"))


# flags stand in for the word gate: the category and length of a word raise them
@query("c35_flag_signals", f"""
WITH {S.asked(M.ASK_FORMS)}, {_validated('awords')}
SELECT query_id, coalesce(bool_or(category = 'US City'), false) AS has_food_word, coalesce(bool_or(category = 'Person'), false) AS has_beauty_word,
  coalesce(bool_or(length(word) > 12), false) AS has_size_modifier,
  coalesce(bool_or(category IN ('US City', 'Person') OR word IN {IN(L.SERVICE)}), false) AS has_service_word FROM vw GROUP BY 1""")
def c35(t):
    flags = F.array_compact(F.array(F.when(c("category") == "US City", "known_food"), F.when(c("category") == "Person", "known_beauty"),
                                    F.when(F.length("word") > 12, "known_size")))
    s = O.signals(_words(t).withColumn("flags", flags), M.asked_queries(t), flags="flags")
    return s.select("query_id", "has_food_word", "has_beauty_word", "has_size_modifier", "has_service_word")


@query("c41_resolve_domain", f"""
WITH {SIG} SELECT query_id, pos, word, domains[1] AS domain FROM dm WHERE word IN {IN(L.AMBIGUOUS)}""")
def c41(t):
    d = O.domain_of_words(O._word_columns(_words(t), None)).where(c("word").isin(L.AMBIGUOUS))
    return d.select("query_id", c("pos").cast("bigint").alias("pos"), "word", F.get("domains", F.lit(0)).alias("domain"))


@query("c44_entities", f"""
WITH RECURSIVE {S.asked(M.ASK_FORMS)}, {_NG.replace('bi AS', 'bi AS', 1)}, voctok AS (SELECT term, lang, count(*) AS n FROM (SELECT lang, unnest({S.token_list('text')}) AS term FROM documents) GROUP BY term, lang),
vocab AS (SELECT term, CAST(sum(n) AS BIGINT) AS rank, arg_min(lang, (-n, lang)) AS category FROM voctok GROUP BY term),
{_greedy('awords', {2: 'bi', 3: 'tri'}, 'ng')}, {_NGC},
e AS (SELECT query_id, term AS text, rank FROM awords JOIN vocab ON word = term WHERE category = 'fr' AND rank > 100
  UNION ALL SELECT query_id, gram, rank FROM ngc)
SELECT query_id, string_agg(text, '|' ORDER BY rank DESC, text) AS entities FROM e GROUP BY 1""")
def c44(t):
    w = _words(t).withColumn("pos_tag", F.when(c("category") == "US City", "proper_noun").otherwise(c("pos_tag")))
    ng = U.detect_ngrams(w, [M.named_ngrams(t, 2), M.named_ngrams(t, 3)])
    s = O.signals(w, M.asked_queries(t), ng).where(F.size("detected_entities") > 0)
    return s.select("query_id", F.array_join("detected_entities", "|").alias("entities"))


@query("c48_result_wish", f"""
WITH {SIG} SELECT query_id, query_mode = 'answer' OR is_definition_query OR (has_temporal AND has_role_word)
  OR (coalesce(question_word IN ('who', 'what', 'when', 'where'), false) AND (has_temporal OR has_role_word)) AS wants_single_result,
  query_mode IN ('browse', 'local', 'shop') OR has_plural_noun OR has_quantity_word OR has_service_word OR has_product_word OR has_superlative
  OR (all_nouns AND NOT has_question_word) AS wants_multiple_results FROM sig""")
def c48(t):
    return _sig(t).select("query_id", "wants_single_result", "wants_multiple_results")


@query("c49_infer_domain", f"""
WITH {SIG} SELECT query_id, coalesce(primary_domain, CASE WHEN has_service_word AND is_local_search THEN 'business' END) AS primary_domain FROM sig""")
def c49(t):
    return O.infer_domain(_sig(t)).select("query_id", "primary_domain")


@query("c50_simple_intent", f"""
WITH {S.asked(M.ASK_FORMS)}
SELECT query_id, CASE WHEN {' OR '.join(f"contains(lower(query), '{w}')" for w in L.INTENT_LOCATION)} THEN 'location'
  WHEN {' OR '.join(f"contains(lower(query), '{w}')" for w in L.INTENT_PERSON)} THEN 'person' ELSE 'general' END AS intent FROM asked""")
def c50(t):
    return M.asked_queries(t).select("query_id", O.simple_intent(c("query")).alias("intent"))


_PROF = f"""{SIG}, pt AS (SELECT v.query_id, pos, word, category, score, pos_tag IN ('noun', 'proper_noun') AS noun, query_mode, coalesce(question_word = 'where', false) AND query_mode = 'answer' AS subj
  FROM vw v JOIN sig s ON v.query_id = s.query_id WHERE category <> 'stopword'),
pr AS (SELECT s.query_id, any_value(s.query_mode) AS query_mode, CAST(coalesce(sum(score) FILTER (category = 'Person'), 0) AS BIGINT) AS person_score,
  CAST(coalesce(sum(score) FILTER ({_PLACE}), 0) AS BIGINT) AS location_score, max(score) FILTER (category = 'Person') AS person_best,
  coalesce(list_sort(list_distinct(list(word) FILTER (category = 'Person'))), []) AS persons,
  coalesce(list_sort(list_distinct(list(upper(word[1]) || word[2:]) FILTER (category = 'US City' AND NOT subj))), []) AS cities,
  coalesce(list_sort(list_distinct(list(upper(word[1]) || word[2:]) FILTER (category = 'US State' AND NOT subj))), []) AS states,
  coalesce(list_sort(list_distinct(list(word) FILTER (noun AND NOT ({_PLACE} AND NOT subj)))), []) AS search_terms
  FROM sig s LEFT JOIN pt ON s.query_id = pt.query_id GROUP BY 1)"""


def _no_ngrams(t):
    return t.spark.createDataFrame([], "query_id string, n int, pos int, gram string, category string, rank bigint")


def _profile(t, ngrams=None):
    w = _words(t)
    s = O.signals(w, M.asked_queries(t))
    return P.build_profile(w, _no_ngrams(t) if ngrams is None else ngrams, s), s, w


@query("c51_build_profile", f"""
WITH {_PROF}
SELECT query_id, person_score, location_score, array_to_string(persons, '|') AS persons, array_to_string(cities, '|') AS cities, array_to_string(states, '|') AS states,
  array_to_string(search_terms, '|') AS search_terms,
  CASE WHEN greatest(person_score, location_score) = 0 THEN 'general' WHEN person_score >= location_score THEN 'person' ELSE 'location' END AS primary_intent FROM pr""")
def c51(t):
    p, _, _ = _profile(t)
    return p.select("query_id", "person_score", "location_score", *[F.array_join(F.array_sort(x), "|").alias(x) for x in
                                                                    ("persons", "cities", "states", "search_terms")], "primary_intent")


_MODE_W = {f: "CASE pr.query_mode " + " ".join(f"WHEN '{m}' THEN {ws[f]}" for m, ws in L.MODE_BOOSTS.items() if f in ws) + f" ELSE {b} END"
           if any(f in ws for ws in L.MODE_BOOSTS.values()) else str(b) for f, b in L.BASE_BOOSTS.items()}


def _boost_sql(f):
    hp = "array_length(persons) > 0"
    add = {"entity_names": f"CASE WHEN {hp} THEN 10 + least(person_best // 100, 5) ELSE 0 END", "document_title": f"CASE WHEN {hp} THEN 5 ELSE 0 END"}.get(f, "0")
    single = {k: str(v) for k, v in L.ANSWER_SINGLE_BOOSTS.items()}.get(f, "NULL")
    return (f"SELECT pr.query_id, '{f}' AS field, CAST(CASE WHEN pr.query_mode = 'answer' THEN {single} ELSE {_MODE_W[f]} END + {add} "
            f"+ CASE WHEN has_unknown_terms THEN CASE WHEN {hp} THEN 3 ELSE 8 END ELSE 0 END AS BIGINT) AS weight FROM pr JOIN sig ON pr.query_id = sig.query_id")


@query("c52_field_boosts", f"""
WITH {_PROF} SELECT * FROM ({' UNION ALL '.join(_boost_sql(f) for f in L.BASE_BOOSTS)}) WHERE weight IS NOT NULL""")
def c52(t):
    p, s, _ = _profile(t)
    return P.field_boosts(p, s)


_FLAGS = """fl AS (SELECT query_id, coalesce(bool_or(category = 'Person'), false) AS has_person, coalesce(bool_or(category IN ('US City', 'US State')), false) AS has_location,
  coalesce(bool_or(category = 'Education'), false) AS has_topic FROM vw WHERE category <> 'stopword' AND status <> 'unknown' GROUP BY 1),
fa AS (SELECT a.query_id, coalesce(has_person, false) AS p, coalesce(has_location, false) AS l, coalesce(has_topic, false) AS tp FROM asked a LEFT JOIN fl ON a.query_id = fl.query_id)"""


@query("c53_dynamic_weights", f"""
WITH {S.asked(M.ASK_FORMS)}, {_validated('awords')}, {_FLAGS}
SELECT query_id, 'entity_names' AS field, CASE WHEN p THEN 14 ELSE 8 END AS weight FROM fa
UNION ALL SELECT query_id, 'key_facts', CASE WHEN p THEN 6 ELSE 4 END FROM fa
UNION ALL SELECT query_id, 'document_title', 3 FROM fa
UNION ALL SELECT query_id, 'primary_keywords', CASE WHEN p THEN 10 WHEN tp THEN 12 WHEN l THEN 8 ELSE 10 END FROM fa
UNION ALL SELECT query_id, 'semantic_keywords', CASE WHEN tp THEN 10 ELSE 6 END FROM fa
UNION ALL SELECT query_id, 'location_city', 12 FROM fa WHERE l UNION ALL SELECT query_id, 'location_state', 12 FROM fa WHERE l""")
def c53(t):
    return P.dynamic_weights(U.category_summary(_words(t), _no_ngrams(t), M.asked_queries(t)))


@query("c54_boosted_query", f"""
WITH RECURSIVE {S.asked(M.ASK_FORMS)}, {_validated('awords')}, {_NG}, {_greedy('awords', {2: 'bi', 3: 'tri'}, 'ng')},
x AS (SELECT query_id, 0 AS part, -n AS size, pos, gram AS t FROM ng UNION ALL SELECT query_id, 1, 0, pos, word FROM vw v WHERE category <> 'stopword'
  AND NOT EXISTS (SELECT 1 FROM ng g WHERE g.query_id = v.query_id AND v.pos BETWEEN g.pos AND g.pos + g.n - 1))
SELECT query_id, string_agg(t, ' ' ORDER BY part, size, pos) AS boosted FROM x GROUP BY 1""")
def c54(t):
    w = _words(t)
    ng = U.detect_ngrams(w, [M.named_ngrams(t, 2), M.named_ngrams(t, 3)])
    return P.boosted_query(w, ng).select("query_id", "boosted")


@query("c55_search_params", f"""
WITH {_PROF}
SELECT pr.query_id, CASE WHEN sig.query_mode IN ('answer', 'compare') THEN 0 ELSE 1 END AS num_typos,
  CASE WHEN sig.query_mode IN ('answer', 'compare') THEN 0 WHEN sig.query_mode = 'explore' THEN CASE WHEN len(search_terms) <= 2 THEN 0 ELSE 1 END
    WHEN sig.query_mode = 'browse' THEN CASE WHEN len(search_terms) <= 3 THEN 1 ELSE 2 END ELSE 1 END AS drop_tokens,
  coalesce(temporal_direction, price_direction, CASE WHEN sig.query_mode = 'local' OR (sig.query_mode = 'browse' AND has_superlative) OR has_rating_signal THEN 'rating' END, 'text') AS sort_key,
  CASE sig.query_mode WHEN 'local' THEN 'business' WHEN 'shop' THEN 'product' END AS required_type FROM pr JOIN sig ON pr.query_id = sig.query_id""")
def c55(t):
    p, s, _ = _profile(t)
    return P.search_params(p, s).select("query_id", c("num_typos").cast("bigint").alias("num_typos"), c("drop_tokens").cast("bigint").alias("drop_tokens"),
                                        "sort_key", "required_type")


