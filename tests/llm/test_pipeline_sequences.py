"""The pipeline's training sequences hold the redacted texts, and its stages take awkward tables."""

from collections import Counter

from tarnlake.llm._shared import cut
from tarnlake.llm.queries import tokenizer_path


def test_sequences_decode_to_the_kept_texts(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    made = corpus_pipeline.sequences(spark, sf).collect()
    kept = corpus_pipeline._through(spark, sf, corpus_pipeline.STAGES[:-1]).select("doc_id", "text").collect()
    pieces = {}
    for s in made:
        assert len(s.ids) == sum(s.lengths) <= 4096
        at = 0
        for doc, n in zip(s.doc_ids, s.lengths):
            pieces.setdefault(doc, []).append(list(s.ids[at : at + n]))
            at += n
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in kept}
    assert pieces.keys() == want.keys()
    for doc, ids in want.items():
        cuts = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        assert Counter(map(tuple, pieces[doc])) == Counter(map(tuple, cuts))


def test_stages_take_awkward_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = docs.orderBy("doc_id").first()["text"]
    rows = [(i, t, None, None, None, 7, "x") for i, t in ((None, None), (None, ""), (1, None), (1, " \n "), (2, long), (2, long), (3, long * 30), (None, "한국어 " * 40))]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_hash long, line string")
    for empty in (False, True):
        table = cut(odd.limit(0) if empty else odd)
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, table, sf))
            if name == "packing":
                assert (out.count() == 0) == empty
            else:
                assert out.columns == odd.columns and out.count() <= table.count()
                table = out


def test_near_fingerprints_are_compared_first(spark, monkeypatch):
    """Operator 3's links alone, with no group from the prefix join, take out near copies; texts that share a fingerprint but few runs stay."""
    import corpus_pipeline
    from tarnlake.llm import lines, simhash

    common = " ".join(f"w{i}" for i in range(11))
    a, b = (" ".join([common] * 60 + [x]) for x in ("one two three four five six", "seven eight nine ten eleven twelve"))
    long = [f"v{i}" for i in range(3000)]
    texts = [a, b, " ".join(long), " ".join([*long, "end"]), " ".join(f"u{i}" for i in range(300)), None, ""]
    prints = [simhash.fingerprint(t) for t in texts]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4
    assert near(0, 1) and near(2, 3) and not near(3, 4)
    links = simhash.links(spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(prints)], "id long, fingerprint long"))
    assert sorted(map(tuple, links.collect())) == [(0, 1), (2, 3), (5, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == [0, 1, 2, 4, 5]
    whole = lines.candidates
    monkeypatch.setattr(lines, "candidates", lambda *args: whole(*args).where("component IS NULL"))
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == [0, 1, 2, 4, 5]
