"""The pipeline against plain versions of its stages, and its contract."""

import corpus_pipeline
from swaymeter.llm import decontaminate, quality, secrets
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def expected(docs, bench, kept_by_rules):
    docs = [d for d in docs if d["doc_id"] in kept_by_rules]
    prints = [plain.simhash(d["text"]) for d in docs]
    root, least = plain.component_roots(prints), {}
    for d, p in zip(docs, prints, strict=True):
        least[root[p]] = min(d["doc_id"], least.get(root[p], d["doc_id"]))
    clean = []
    for d in docs:
        if d["doc_id"] not in least.values():
            continue
        hit, _ = plain.overlap(d["text"], bench)
        if sum(hit) and 20 * sum(hit) >= len(hit):
            continue
        text = decontaminate.cut_out(d["text"], bytearray(hit)) if sum(hit) else d["text"]
        clean.append({**d, "text": secrets.redact(text, secrets.find_secrets(text))})
    copies = plain.mix([(d["doc_id"], d["source"], len(plain.words(d["text"]))) for d in clean])
    return sorted((d["doc_id"], d["text"], len(d["text"]), c + 1) for d, (*_, n) in zip(clean, copies, strict=True) for c in range(n))


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = quality.judge(docs).select("doc_id", "text", "verdict.*").collect()
    assert all(r.base_failed == plain.quality(r.text)[-1] for r in judged)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "copy"]
    rows = sorted((r.doc_id, r.text, r.n_chars, r["copy"]) for r in got.collect())
    assert rows == expected([r.asDict() for r in docs.collect()], bench, {r.doc_id for r in judged if r.kept})


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_run_on_odd_rows(spark, tmp_path):
    """Null ids, sources and texts, repeated rows, an empty text, a text of more than a megabyte, and clashing column names, through the whole
    chain."""
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect()
    rows = [(r.doc_id, r.text, r.source, r.n_chars, 1, 2, "x") for r in given]
    long = " ".join(f"the word{i} and of it" for i in range(60_000))
    rows += [rows[0], rows[0], (None, rows[1][1] + " tail of it", None, 5, 1, 2, "x"), (None, None, None, None, None, None, None), (900, "", "s", 0, 1, 2, "x"), (901, long, "s", len(long), 1, 2, "x")]
    schema = "doc_id long, text string, source string, n_chars long, fp int, `copy` int, `odd.name` string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[:-1] == ["doc_id", "text", "source", "n_chars", "fp", "copy", "odd.name"] and got.columns[-1] not in got.columns[:-1]
    out = got.toDF(*(f"c{i}" for i in range(8))).collect()
    assert all(len(r.c1) == r.c3 for r in out if r.c0 is None or r.c0 == 901) and all(r.c1 for r in out)
    numbers = {}
    for r in out:
        numbers.setdefault((r.c0, r.c1), []).append(r.c7)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())
