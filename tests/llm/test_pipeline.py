"""The pipeline on planted documents: each stage takes what it should and leaves the rest."""

import random

import pytest

import corpus_pipeline


def test_stages_take_planted_rows_and_leave_the_rest(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, base = say(30), say(120)
    docs = [(i, say(60)) for i in range(60)]
    docs += [(100, base), (101, base), (102, base.replace(base.split()[60], "other", 1)), (103, base + " and more")]  # one group
    docs += [(200, f"{say(20)} {passage} {say(20)}"), (300, "write to sam@corp.example now"), (400, None), (401, ""), (None, "no id here")]
    rows = [(i, t, "en", "x", len(t) if t else 0) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in docs} - {101, 102, 103, 200}
    clean = {i: t or "" for i, t in docs} | {300: "write to [EMAIL] now"}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    assert all(list(r.ids) == sp.encode(clean[i], add_eos=True) and r.decoded == sp.decode(list(r.ids)) for i, r in got.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontamination", "pii", "sentencepiece"]
