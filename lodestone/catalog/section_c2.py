"""Query understanding: grammar, correction, n-grams, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.operators import understand as O
from lodestone.operators import vocab as V
from lodestone.rules import language as R
from lodestone.sources import mapping as M

c = F.col
STOP = S.in_list(R.STOPWORDS)
_SP = f"sp(word, pos) AS ({S.values([(w, p) for p, ws in R.POS_WORDS.items() for w in ws])})"


def _validated(words: str) -> str:
    """vw: words with status, part of speech, score and category."""
    return f"""{S.NVOCAB}, {_SP}, vw AS (
  SELECT query_id, q.pos, q.word, CASE WHEN nv.term IS NOT NULL OR q.word IN {STOP} THEN 'valid' ELSE 'unknown' END AS status,
    CASE WHEN nv.term IS NOT NULL THEN nv.pos WHEN q.word IN {STOP} THEN coalesce(sp.pos, 'unknown') ELSE 'unknown' END AS pos_tag,
    coalesce(nv.rank, 0) AS score,
    CASE WHEN nv.term IS NOT NULL THEN nv.category WHEN q.word IN {STOP} THEN 'stopword' ELSE '' END AS category
  FROM {words} q LEFT JOIN nv ON q.word = nv.term LEFT JOIN sp ON q.word = sp.word)"""


_RULES = f"rules(l, r, p, conf) AS ({S.values([(a, b, p, f) for (a, b), (p, f) in R.CONTEXT_RULES.items()])})"
_PREDICT = f"""{_RULES}, nb AS (
  SELECT *, lag(CASE WHEN status = 'valid' THEN pos_tag END) OVER w AS l,
    CASE WHEN lead(word) OVER w IS NULL THEN 'end' ELSE lead(CASE WHEN status = 'valid' THEN pos_tag END) OVER w END AS r
  FROM vw WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
pp AS (SELECT nb.* EXCLUDE (l, r), CASE WHEN status = 'unknown' THEN coalesce(a.p, b.p, d.p, 'noun') END AS predicted_pos,
    CASE WHEN status = 'unknown' THEN CAST(coalesce(a.conf, b.conf, d.conf, 0.5) AS DOUBLE) END AS pos_confidence
  FROM nb LEFT JOIN rules a ON nb.l = a.l AND nb.r = a.r LEFT JOIN rules b ON nb.l = b.l AND b.r IS NULL
    LEFT JOIN rules d ON d.l IS NULL AND nb.r = d.r AND nb.r <> 'end')"""


def _log(t):
    q = M.query_log(t)
    return q, M.query_words(q)


def _valid(t, words=None):
    return V.validate_words(_log(t)[1] if words is None else words, M.named_vocabulary(t))


def _pos_long(df):
    return df.withColumn("pos", c("pos").cast("bigint"))


def _greedy(words: str, grams: dict[int, str], out: str) -> str:
    """Recursive statement: for each size (largest first) walk the positions left to right."""
    sql, blocked = [], []
    for n, g in sorted(grams.items(), reverse=True):
        lead = " || ' ' || ".join(["word", *[f"lead(word, {i}) OVER w" for i in range(1, n)]])
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM t{m} x WHERE x.acc AND x.query_id = g.query_id AND x.pos <= g.pos + {n - 1} AND x.pos + {m - 1} >= g.pos)"
                       for m in blocked)
        sql.append(f"""g{n} AS (SELECT query_id, pos, gram FROM (SELECT query_id, pos, {lead} AS gram FROM {words} WINDOW w AS (PARTITION BY query_id ORDER BY pos)) WHERE gram IN (SELECT term FROM {g})),
f{n} AS (SELECT g.* FROM g{n} g WHERE true{free}),
t{n} AS (SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS gram, false AS acc, CAST(0 AS BIGINT) AS free FROM (SELECT DISTINCT query_id FROM f{n})
  UNION ALL SELECT * FROM (SELECT DISTINCT ON (t.query_id) t.query_id, CAST(f.pos AS BIGINT), f.gram, true, CAST(f.pos + {n} AS BIGINT) FROM t{n} t JOIN f{n} f
    ON t.query_id = f.query_id AND f.pos >= t.free ORDER BY t.query_id, f.pos))""")
        blocked.append(n)
    union = " UNION ALL ".join(f"SELECT query_id, {n} AS n, pos, gram FROM t{n} WHERE acc" for n in grams)
    return ", ".join(sql) + f", {out} AS ({union})"


@query("c04_classify_queries", f"""
WITH RECURSIVE {S.QWORDS}, {S.NVOCAB}, {S.ngrams(2, 'bi', 2)}, {S.ngrams(3, 'tri', 2)}, {S.ngrams(4, 'quad', 2)}, {_greedy('qwords', {2: 'bi', 3: 'tri', 4: 'quad'}, 'ng')},
al AS (SELECT * FROM bi UNION ALL SELECT * FROM tri UNION ALL SELECT * FROM quad),
nn AS (SELECT query_id, ng.pos, gram AS term, {S._by_lang('category', S.CAT_LANG)} AS category, CASE n WHEN 2 THEN 'bigram' WHEN 3 THEN 'trigram' ELSE 'quadgram' END AS kind
  FROM ng JOIN al ON gram = al.term),
w1 AS (SELECT q.query_id, q.pos, q.word AS term, coalesce(nv.category, '') AS category,
    CASE WHEN nv.term IS NOT NULL THEN 'term' WHEN q.word IN {STOP} THEN 'stopword' ELSE 'unknown' END AS kind
  FROM qwords q LEFT JOIN nv ON q.word = nv.term
  WHERE NOT EXISTS (SELECT 1 FROM ng x WHERE x.query_id = q.query_id AND q.pos BETWEEN x.pos AND x.pos + x.n - 1)),
b AS (SELECT * FROM nn UNION ALL SELECT * FROM w1)
SELECT query_id, pos, term, kind FROM b UNION ALL SELECT query_id, pos, term, 'location' FROM b WHERE category IN ('US City', 'US State')
UNION ALL SELECT query_id, pos, term, 'stopword' FROM b WHERE kind = 'term' AND term IN {STOP}""")
def c04(t):
    grams = [M.named_ngrams(t, n) for n in (2, 3, 4)]
    return _pos_long(O.classify_queries(_log(t)[1], M.named_vocabulary(t), grams))


@query("c06_predict_pos", f"""
WITH {S.QWORDS}, {_validated('qwords')}, {_PREDICT}
SELECT query_id, pos, word, status, predicted_pos, pos_confidence FROM pp""")
def c06(t):
    return _pos_long(O.predict_pos(_valid(t)).select("query_id", "pos", "word", "status", "predicted_pos", "pos_confidence"))


_GROUPS = [(k, v) for k, vs in R.POS_GROUPS.items() for v in vs]


# every word scored as if it stood where its successor stands
@query("c10_pos_score", f"""
WITH {S.QWORDS}, {_validated('qwords')}, {_PREDICT}, grp(a, b) AS ({S.values(_GROUPS)}),
x AS (SELECT query_id, pos, pos_tag AS cand, lead(predicted_pos) OVER w AS pred, lead(pos_confidence) OVER w AS conf
  FROM pp WINDOW w AS (PARTITION BY query_id ORDER BY pos))
SELECT query_id, pos, cand, pred, round(CASE WHEN cand = pred THEN conf * 80 WHEN EXISTS (SELECT 1 FROM grp WHERE a = pred AND b = cand) THEN conf * 0.8 * 50
  WHEN EXISTS (SELECT 1 FROM grp WHERE a = cand AND b = pred) THEN conf * 0.7 * 50 ELSE -10 END, 6) AS pos_score FROM x WHERE pred IS NOT NULL""")
def c10(t):
    p = O.predict_pos(_valid(t))
    x = p.select("query_id", "pos", c("pos_tag").alias("cand"), F.lead("predicted_pos").over(O.by_pos()).alias("pred"),
                 F.lead("pos_confidence").over(O.by_pos()).alias("conf")).where(c("pred").isNotNull())
    return _pos_long(x.select("query_id", "pos", "cand", "pred", F.round(O.pos_score(c("cand"), c("pred"), c("conf")), 6).alias("pos_score")))


@query("c11_context_bonus", f"""
WITH {S.QWORDS}, {S.ngrams(2, 'bi')}, {S.ngrams(3, 'tri')},
x AS (SELECT query_id, pos, word, lag(word) OVER w AS l, lead(word) OVER w AS r FROM qwords WINDOW w AS (PARTITION BY query_id ORDER BY pos))
SELECT query_id, pos, word, 120 * (CAST(l IS NOT NULL AND l || ' ' || word IN (SELECT term FROM bi) AS BIGINT)
  + CAST(r IS NOT NULL AND word || ' ' || r IN (SELECT term FROM bi) AS BIGINT)) AS bigram_bonus,
  150 * CAST(l IS NOT NULL AND r IS NOT NULL AND l || ' ' || word || ' ' || r IN (SELECT term FROM tri) AS BIGINT) AS trigram_bonus FROM x""")
def c11(t):
    w = V.with_neighbours(_log(t)[1])
    b = O.context_bonus(w, [M.ngrams(t, 2), M.ngrams(t, 3)], "prev_word1", "word", "next_word1")
    return b.select("query_id", c("pos").cast("bigint").alias("pos"), "word", c("bigram_bonus").cast("bigint").alias("bigram_bonus"),
                    c("trigram_bonus").cast("bigint").alias("trigram_bonus"))


def _understood(t):
    q, w = _log(t)
    fixed, ng = O.understand(q, w, M.named_vocabulary(t), M.named_ngrams(t, 2), M.named_ngrams(t, 3))
    return q, fixed, ng


@query("c12_correct_words")
def c12(t):
    return _understood(t)[1].select("query_id", "pos", "word", "status", "corrected", "corrected_pos", "distance",
                                    F.round("final_score", 6).alias("final_score"))


@query("c13_correct_pairs")
def c13(t):
    return O.correct_pairs(_valid(t), M.named_ngrams(t, 2))


_UNK = f"unk AS (SELECT DISTINCT word FROM qwords WHERE word NOT IN {STOP} AND word NOT IN (SELECT term FROM vocab))"


@query("c14_split_words", f"""
WITH {S.QWORDS}, {S.VOCAB}, {_UNK}, x AS (
  SELECT word, substring(word, 1, i) AS part1, substring(word, i + 1) AS part2 FROM (SELECT word, unnest(range(2, length(word) - 1)) AS i FROM unk WHERE length(word) >= 4))
SELECT word, part1, part2, a.rank + b.rank AS score FROM x JOIN vocab a ON part1 = a.term JOIN vocab b ON part2 = b.term
QUALIFY row_number() OVER (PARTITION BY word ORDER BY a.rank + b.rank DESC, length(part1)) = 1""")
def c14(t):
    v = M.vocabulary(t)
    unk = V.validate_words(_log(t)[1], v).where(c("status") == "unknown")
    return O.split_words(unk, v)


@query("c15_merge_words", f"""
WITH {S.QWORDS}, {_validated('qwords')},
h AS (SELECT query_id, pos, word || w2 AS merged FROM (SELECT *, lead(word) OVER w AS w2, lead(status) OVER w AS s2 FROM vw WINDOW w AS (PARTITION BY query_id ORDER BY pos))
  WHERE w2 IS NOT NULL AND (status = 'unknown' OR s2 = 'unknown') AND word || w2 IN (SELECT term FROM nv)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY query_id ORDER BY pos) AS g FROM h),
ok AS (SELECT query_id, pos, merged FROM (SELECT *, (pos - min(pos) OVER (PARTITION BY query_id, g)) % 2 AS odd FROM isl) WHERE odd = 0)
SELECT vw.query_id, row_number() OVER (PARTITION BY vw.query_id ORDER BY vw.pos) AS new_pos, coalesce(merged, word) AS word,
  CASE WHEN merged IS NOT NULL THEN 'merged' ELSE status END AS status
FROM vw LEFT JOIN ok ON vw.query_id = ok.query_id AND vw.pos = ok.pos
WHERE NOT EXISTS (SELECT 1 FROM ok k WHERE k.query_id = vw.query_id AND k.pos + 1 = vw.pos)""")
def c15(t):
    m = O.merge_words(_valid(t), M.named_vocabulary(t))
    return m.withColumn("new_pos", c("new_pos").cast("bigint"))


_NG = f"{S.ngrams(2, 'bi', 2)}, {S.ngrams(3, 'tri', 2)}, al AS (SELECT * FROM bi UNION ALL SELECT * FROM tri)"
_NGC = f"""ngc AS (SELECT query_id, n, ng.pos, gram, {S._by_lang('category', S.CAT_LANG)} AS category, rank FROM ng JOIN al ON gram = al.term)"""


def _grams(t):
    return [M.named_ngrams(t, 2), M.named_ngrams(t, 3)]


@query("c16_detect_ngrams", f"""
WITH RECURSIVE {S.QWORDS}, {_NG}, {_greedy('qwords', {2: 'bi', 3: 'tri'}, 'ng')}, {_NGC}
SELECT query_id, n, pos, gram, category, rank FROM ngc""")
def c16(t):
    n = O.detect_ngrams(_log(t)[1], _grams(t))
    return _pos_long(n.withColumn("n", c("n").cast("bigint")))


_REST = """rest AS (SELECT v.* FROM vw v WHERE status <> 'unknown' AND category <> 'stopword'
  AND NOT EXISTS (SELECT 1 FROM ng x WHERE x.query_id = v.query_id AND v.pos BETWEEN x.pos AND x.pos + x.n - 1))"""


def _title(e: str) -> str:
    return f"array_to_string(list_transform(string_split({e}, ' '), lambda z: upper(z[1]) || z[2:]), ' ')"


@query("c17_extract_filters", f"""
WITH RECURSIVE {S.QWORDS}, {_validated('qwords')}, {_NG}, {_greedy('qwords', {2: 'bi', 3: 'tri'}, 'ng')}, {_NGC}, {_REST},
x AS (SELECT query_id, pos, gram AS term, category, true AS is_ng FROM ngc UNION ALL SELECT query_id, pos, word, category, false FROM rest)
SELECT query_id, pos, CASE WHEN category IN ('US City', 'US State') THEN 'location' ELSE 'filter' END AS kind,
  CASE category WHEN 'US City' THEN 'location_city' WHEN 'US State' THEN 'location_state' WHEN 'Education' THEN 'primary_keywords'
    ELSE CASE WHEN is_ng THEN 'primary_keywords' ELSE 'entity_names' END END AS field,
  CASE WHEN category IN ('US City', 'US State') THEN {_title('term')} ELSE term END AS value, term FROM x""")
def c17(t):
    w = O.predict_pos(_valid(t))
    return _pos_long(O.extract_filters(w, O.detect_ngrams(_log(t)[1], _grams(t))))


@query("c18_category_summary", f"""
WITH RECURSIVE {S.QWORDS}, {_validated('qwords')}, {_NG}, {_greedy('qwords', {2: 'bi', 3: 'tri'}, 'ng')}, {_NGC}, {_REST},
x AS (SELECT query_id, category FROM ngc UNION ALL SELECT query_id, category FROM rest)
SELECT q.query_id, coalesce(bool_or(category = 'Person'), false) AS has_person, coalesce(bool_or(category IN ('US City', 'US State')), false) AS has_location,
  coalesce(bool_or(category = 'Education'), false) AS has_topic, false AS has_song_title, false AS has_media, false AS has_food, false AS has_business,
  false AS has_culture, coalesce(bool_or(category = 'Person'), false) AS has_entity
FROM qlog q LEFT JOIN x ON q.query_id = x.query_id GROUP BY 1""")
def c18(t):
    q, w = _log(t)
    return O.category_summary(_valid(t, w), O.detect_ngrams(w, _grams(t)), q)


@query("c19_discover")
def c19(t):
    q, fixed, _ = _understood(t)
    d = O.discover(q, fixed)
    return d.select("query_id", "query", "corrected_query", "valid_count", "unknown_count", F.size("corrections").alias("n_corrections"),
                    "total_score", "average_score", "max_score")


# the uncorrected part of the profile: a log whose words are all taken as typed
@query("c19_discover_valid", f"""
WITH {S.QWORDS}, {_validated('qwords')}
SELECT q.query_id, string_agg(word, ' ' ORDER BY pos) AS corrected_query, count(*) FILTER (status = 'valid') AS valid_count,
  count(*) FILTER (status = 'unknown') AS unknown_count, CAST(coalesce(sum(score) FILTER (status = 'valid'), 0) AS BIGINT) AS total_score,
  coalesce(max(score) FILTER (status = 'valid'), 0) AS max_score
FROM qlog q JOIN vw ON q.query_id = vw.query_id GROUP BY 1""")
def c19_valid(t):
    q, w = _log(t)
    none = F.lit(None)
    v = O.predict_pos(_valid(t, w)).withColumns({
        "corrected": none.cast("string"), "corrected_pos": none.cast("string"), "corrected_score": none.cast("bigint"),
        "distance": none.cast("int")})
    d = O.discover(q, v).where(c("corrected_query").isNotNull())
    return d.select("query_id", "corrected_query", "valid_count", "unknown_count", "total_score", "max_score")


# a corrected text with the first word replaced and the last one dropped
@query("c20_correction_diff", rf"""
WITH {S.QLOG}, w AS (SELECT query_id, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '') AS o FROM qlog),
x AS (SELECT query_id, o, CASE WHEN len(o) > 1 THEN list_concat(['fixed'], o[2:len(o) - 1]) ELSE ['fixed'] END AS k FROM w),
y AS (SELECT query_id, unnest(o) AS original, generate_subscripts(o, 1) AS position, k FROM x)
SELECT query_id, position, original, coalesce(k[position], original) AS corrected, original <> coalesce(k[position], original) AS was_changed FROM y""")
def c20(t):
    o = F.filter(F.split(F.lower("query"), r"\s+"), lambda x: x != "")
    k = F.array_join(F.concat(F.array(F.lit("fixed")), F.slice(o, 2, F.greatest(F.size(o) - 2, F.lit(0)))), " ")
    d = O.correction_diff(M.query_log(t).withColumn("corrected_query", k))
    return d.withColumn("position", c("position").cast("bigint"))


# the first word of each query corrected to itself with a category by its length
@query("c21_safe_query", f"""
WITH {S.QWORDS}, {S.NVOCAB}, f AS (SELECT query_id, nv.category, nv.pos AS cp FROM qwords LEFT JOIN nv ON word = term WHERE qwords.pos = 1)
SELECT q.query_id, coalesce(cp <> 'noun' OR category IN ('US City', 'US State', 'Person'), true) AS has_unsafe,
  CASE WHEN coalesce(cp <> 'noun' OR category IN ('US City', 'US State', 'Person'), true) THEN query ELSE 'fixed ' || query END AS safe_query
FROM qlog q JOIN f ON q.query_id = f.query_id""")
def c21(t):
    q, w = _log(t)
    first = w.where(c("pos") == 1).join(M.named_vocabulary(t).select(c("term").alias("word"), "category", c("pos").alias("cp")), "word", "left")
    d = q.join(first, "query_id").select(
        "query_id", "query", F.concat(F.lit("fixed "), "query").alias("corrected_query"),
        F.array(F.struct(F.coalesce(c("cp") == "noun", F.lit(False)).alias("pos_match"), F.coalesce("category", F.lit("")).alias("category"))).alias("corrections"))
    return O.safe_query(d).select("query_id", "has_unsafe", "safe_query")
