"""The stages in turn, and what each has done to a small corpus."""

import os

import pytest

import corpus_pipeline
from quirelake.llm import simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == columns
    good, distinct, clean, mixed = seen[1:]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    assert trusted <= {r.doc_id for r in good.collect()} and good.count() < docs.count()
    kept = {r.doc_id: r.text for r in distinct.collect()}
    assert set(kept) <= {r.doc_id for r in good.collect()}
    for r in good.collect():
        if r.doc_id not in kept:  # each document that went has a like one with a smaller id
            assert any(k < r.doc_id and simhash._similar(r.text, good_text, 5) >= 0.8 for k, good_text in ((g.doc_id, g.text) for g in good.collect()))
    assert clean.count() == distinct.count()
    assert not any("@" in r.text and ".example" in r.text and "[EMAIL]" not in r.text for r in clean.collect())
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(clean)) < 0.05 * words(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    rows = packed.collect()
    assert all(len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0 for r in rows)
    assert sum(r.length for r in rows if r.start == 0) <= sum(r.length for r in rows)


def plain_quality(rows, labels):
    """Kept ids, by the query's SQL."""
    import duckdb
    import pandas as pd

    from quirelake.llm import quality

    documents, labels = pd.DataFrame(rows, columns=["doc_id", "text", "lang"]), labels  # noqa: F841  read by name
    return {k for k, keep in duckdb.sql(f"SELECT doc_id, keep FROM ({quality.oracle()})").fetchall() if keep}


def plain_distinct(texts):
    """{id: text} without all but the smallest id of each group that equal texts and pairs at Jaccard 0.8 join."""
    sets = {k: simhash._shingles(t, 5) for k, t in texts.items()}
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            one, two = sets[a], sets[b]
            both = len(one & two)
            if texts[a] == texts[b] or (one or two) and both >= 0.8 * (len(one) + len(two) - both) and both:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: texts[k] for k in ids if top(k) == k}


def plain_redacted(texts):
    """Texts without personal data, from the spans of the query's SQL."""
    import duckdb
    import pandas as pd

    from quirelake.llm import pii

    documents = pd.DataFrame(list(texts.items()), columns=["doc_id", "text"])  # noqa: F841  read by name
    out = {}
    for k, spans in duckdb.sql(f"SELECT doc_id, spans FROM ({pii.oracle()})").fetchall():
        parts, at = [], 0
        for span in spans.split(",") if spans else []:
            kind, a, b = span.split(":")
            if int(a) >= at:
                parts += [texts[k][at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        out[k] = "".join(parts) + texts[k][at:]
    return out


def test_stages_against_plain_versions(spark):
    """Each stage on what the stage before it kept, against SQL, all pairs, or the tokenizer on whole texts."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from quirelake.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = {name: function for name, function in corpus_pipeline.STAGES}
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = stage["quality classifier"](spark, docs, SF).cache()
    kept = {r.doc_id: r.text for r in good.collect()}
    assert set(kept) == plain_quality([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels)
    distinct = stage["simhash near-dedup"](spark, good, SF).cache()
    assert {r.doc_id: r.text for r in distinct.collect()} == plain_distinct(kept)
    clean = stage["personal data"](spark, distinct, SF).cache()
    assert {r.doc_id: r.text for r in clean.collect()} == plain_redacted({r.doc_id: r.text for r in distinct.collect()})
    mixed = stage["mixing to target weights"](spark, clean, SF).cache()
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixing.mix_documents(clean).collect() if r.taken}
    packed = stage["packing"](spark, mixed, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in mixed.collect())
    made, rows = [], sorted(packed, key=lambda r: r.sequence_id)
    for r in rows:
        if r.start == 0:
            made.append((r.doc_id, b""))
        assert made[-1][0] == r.doc_id and len(made[-1][1]) == 4 * r.start
        made[-1] = r.doc_id, made[-1][1] + bytes(r.ids)
    assert sorted(made) == want


def test_run_and_empty(spark, tmp_path):
    run = corpus_pipeline.run(spark, SF)
    assert run.count() > 0
    odd = [(2**53 + 1, None, None, None, None, 1), (None, "", "", "", 0, 2), (None, "tiny", "en", "s", 4, 3), (5, "word " * 300_000, "en", "s", 1_500_000, 4), (5, "word " * 300_000, "en", "s", 1_500_000, 4)]
    rows = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, keep int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, SF).cache()
        assert rows.columns == before.columns and rows.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
