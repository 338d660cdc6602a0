import zlib

import numpy as np
import public_tokenizers
from test_lines import brute as brute_lines
from test_simhash import least_reachable, plain
from tokenizers import Tokenizer

import corpus_pipeline
from loam.llm import quality
from loam.llm.common import table
from loam.llm.packing import first_fit

SF = "/root/testdata/sf0.001"


def near(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def distances(item, texts):
    """The least edit distance of ``item`` to a substring of each text, by Sellers' columns over all texts at once."""
    gap = 40
    codes = np.array([ord(c) for t in texts for c in t + "\x00" * gap])
    row, at = np.zeros(len(codes) + 1, np.int64), np.arange(len(codes) + 1)
    for k, c in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(np.concatenate(([k], new)) - at) + at
    ends = np.cumsum([len(t) + gap for t in texts])
    return [int(row[e - len(t) - gap : e - gap + 1].min()) for e, t in zip(ends.tolist(), texts)]


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            break
        assert out.columns == columns
        docs = out.checkpoint()
        kept = {r.doc_id: r for r in docs.collect()}
        ids = sorted(before)
        texts = [before[i].text for i in ids]
        if name == "quality":  # scores are held against loops in test_quality
            scored = quality.classify(spark.createDataFrame(list(before.values()), docs.schema), table(spark, SF, "labels")).collect()
            assert {r.doc_id for r in scored if r._bad is not None and r._bad < 0.6 and r._toxic < 0.25} == set(kept)
            assert all(kept[i] == before[i] for i in kept) and 100 < len(kept) < len(ids)
        elif name == "lines":
            want = dict(brute_lines(list(zip(ids, texts)), least=1, per=8))
            assert {i: r.text for i, r in kept.items()} == {i: t for i, t in want.items() if t == before[i].text or t.strip()}
            assert all(r.n_chars == len(r.text) for r in kept.values())
        elif name == "near_duplicates":
            fps = [plain(t, 5) for t in texts]
            class_of = least_reachable(ids, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or near(texts[a], texts[b]))
            assert {i: before[i] for i in set(class_of)} == kept
        elif name == "benchmark":
            flat = [" ".join(t.lower().split()) for t in texts]
            gone = set()
            for r in table(spark, SF, "benchmark").collect():
                item = " ".join(r.text.lower().split())
                gone |= {i for i, d in zip(ids, distances(item, flat)) if d <= int(len(item) * 0.08)}
            assert set(ids) - set(kept) == gone and gone
        before = kept
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    rows = out.collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(before)
    for i, own in pieces.items():
        ids, at = [*tokenizer.encode(before[i].text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part), len(ids))
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert sequences.setdefault(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 2048
    # one group at this size: as many sequences as first fit needs
    assert len(sequences) == len({b for b, _ in first_fit(sorted((r.length for r in rows), reverse=True), 2048)})


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and repeated rows, and empty tables pass every stage."""
    sf = SF
    good = "It was a fine day and we went out to see the sea. We came home late in the evening, tired but happy about all of it."
    schema = "doc_id long, text string, lang string, source string, n_chars long, component string"
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, good), (None, good), (4, good), (5, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], schema)
    got = sorted((r.doc_id for r in corpus_pipeline.fresh_lines(spark, docs, sf).collect()), key=str)
    assert got == sorted([1, 1, 2, 3, None, None, 5], key=str)
    got = sorted((r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, sf).collect()), key=str)
    assert got == sorted([1, 2, None, None], key=str)
    assert corpus_pipeline.clean_of_benchmarks(spark, docs, sf).count() == len(rows)
    assert corpus_pipeline.packed(spark, docs, sf).count() == len(rows)
    assert not any(r.text in (None, "") for r in corpus_pipeline.good_quality(spark, docs, sf).collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
