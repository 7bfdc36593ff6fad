"""Each stage of the pipeline against what its operator says, on whole small tables."""

import re

import corpus_pipeline
from postmill.llm import decontamination, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_hand(rows, least):
    """The ids that stay where texts of similarity ``least`` are linked."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (len(a & sets[j]) / len(a | sets[j]) if a or sets[j] else 1.0) >= least:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return {min(g, key=lambda x: (x is None, x)) for g in groups.values()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6, "kept words then token = abcdef0123456789abcdef0123 and more", "en", "src0", 60)], docs.schema))
    columns = docs.columns
    model = toxicity.train_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    calm = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert calm.columns == columns
    assert ids(calm) == sorted(r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < 0.7)

    single = corpus_pipeline.keep_one_of_near_copies(spark, calm, SF)
    assert single.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in calm.collect()]
    assert kept_by_hand(rows, 0.45) <= set(ids(single)) <= kept_by_hand(rows, 0.85) and len(set(ids(single)) - kept_by_hand(rows, 0.8)) <= 1

    clean = corpus_pipeline.drop_contaminated(spark, single, SF)
    found = decontamination.find_contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert clean.columns == columns and ids(clean) == ids(found.where("NOT contaminated"))

    masked = corpus_pipeline.mask_secrets(spark, clean, SF)
    assert masked.columns == columns and ids(masked) == ids(clean)
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    left = masked.select("doc_id", "text", "n_chars", secrets.all_spans(masked["text"]).alias("spans")).collect()
    assert all(not r["spans"] and r["n_chars"] == len(r["text"]) for r in left)
    assert any(r["text"] != before[r["doc_id"]] for r in left)

    mixed = corpus_pipeline.mix(spark, masked, SF)
    assert ids(mixed) == ids(masked)
    assert ids(corpus_pipeline.run(spark, SF)) == [i for i in ids(mixed) if i < 10**6]


def test_stages_over_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF)
            n = docs.count()
            assert n <= before.count()
    single = corpus_pipeline.keep_one_of_near_copies(spark, odd_docs, SF)
    assert sorted((r["doc_id"] or -1) for r in single.collect()) == [-1, 1, 2, 5, 7, 8, 9]


def test_unrelated_texts_under_one_id_all_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(3, text(0)), (7, text(0)), (7, text(1)), (8, text(2)), (8, text(3)), (8, text(3)), (9, text(3)), (10, text(4)), (None, text(4)), (None, text(0))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == sorted([(3, text(0)), (7, text(1)), (8, text(2)), (8, text(3)), (10, text(4))])
