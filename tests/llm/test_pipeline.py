import corpus_pipeline as C
from llm import test_line_dedup, test_packing, test_pii, test_simhash
from lodestone.llm import pii


def redact(t):
    out, at = "", 0
    for s, k, e in pii.spans(t):
        if s >= at:
            out += t[at:s] + f"[{k.upper()}]"
        at = max(at, e)
    return out + t[at:]


def brute(rows):
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    rows = [(i, t) for i, _, _, t in test_line_dedup.brute(rows)]
    comp = test_simhash.brute_wide_components(dict(rows))
    return [(i, redact(t)) for i, t in rows if comp[i] == i]


def test_against_brute_force(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(120)
    extra = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "123 456 !!", "en", "s", 10), (9003, "mail me at a@b.co, +1 555 010 9999", None, None, 3), (9004, "mail me at a@b.co, +1 555 010 9999", None, None, 3)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    test_packing.check_law(C.run(spark, str(tmp_path)).collect(), brute(rows))


def test_columns_stay_and_clean_documents_too(spark, data):
    docs = before = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = C.stored(stage(spark, docs, data), name)
        assert docs.dtypes == before.dtypes
    kept = {r.doc_id: r for r in docs.collect()}
    assert len(kept) > 0.7 * before.count() and all(r.n_chars == len(r.text) and not test_pii.brute(r.text) for r in kept.values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
