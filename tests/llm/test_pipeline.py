import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from lamina.llm import secrets
from lamina.llm.bpe import Bpe


def fixture():
    """(rows of documents, items, ids that must come out): every stage has rows to decide on."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "ng", "")]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, items = [], [say(30) for _ in range(4)]
    for i in range(60):
        t = say(rng.randint(60, 300))
        if i % 6 == 1:
            t[5:5] = [w if rng.random() > 0.1 else "edited" for w in items[i % 4]]
        if i % 6 == 2:
            t[9:9] = ["token=" + "".join(rng.choice("abcdef0123456789") for _ in range(24))]
        docs.append([i, " ".join(t), i % 6 != 1])
        if i % 6 == 3:
            u = list(t)
            u[len(u) // 2] = "changed"
            docs += [[1000 + i, " ".join(u), False], [2000 + i, " ".join(t), False]]
    docs += [[300, "too short", False], [301, None, False], [302, "", False], [303, "the same eight words come here again now " * 30, False], [None, " ".join(say(80)), True]]
    return [(d, t, "en", "s", len(t or "")) for d, t, _ in docs], [(i, " ".join(x)) for i, x in enumerate(items)], [(d, t) for d, t, keep in docs if keep]


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, items, want = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Bpe.load().ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id or -1, r.ids) for r in got)) == sorted((d or -1, exact.encode_ordinary(secrets.redact_text(t))) for d, t in want)
    assert sum("[SECRET]" in secrets.redact_text(t) for _, t in want) == 10


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "byte_bpe"]
