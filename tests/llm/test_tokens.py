import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from loam.llm import packing, tokens

ODD = ["<|endoftext|> it's don't we'll I'M they've", "Ünïcode É́ áb ΣΟΦΟΣ İstanbul", "tab\tand\x0bother\x0cspace\xa0nbsp　wide", "x²y 12,5% a_b!!! ??? %%%", "ªº ß ÿ Ā ĭ ŉ", "日本語 テキスト 한국어", "a" * 3000, "😀👍🏽", "a'b c', d's. 's'", "\x1c\x85 z", "\r\n\r\n  ", "word,!! WORD.( (word) [x]", "é" * 60 + ",", ""]


def reference():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def documents(spark, sf_dir="/root/testdata/sf0.01"):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_ids_equal_the_whole_tokenizer(spark):
    texts = ODD + documents(spark)
    encode, whole = tokens.Encoder(most=5000), reference()
    for text in texts:
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids), text


def test_random_strings():
    r = random.Random(3)
    letters = "abzAZéÉßñ'’.,!?%$# \n\t-_0129²ªİΣσςŉ<|>"
    encode, whole = tokens.Encoder(most=200), reference()
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(40)))
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids), text


SCHEMA = "doc_id long, text string, length long, grp long"


def test_histogram_answers_every_limit(spark):
    texts = documents(spark)[:200] + [None, "", ""]
    lengths = [len(reference().encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    df = spark.createDataFrame([(k, t, 1, 1) for k, t in enumerate(texts)], SCHEMA)
    rows = {r.length: r for r in tokens.histogram(df, block=64).collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_at_least == sum(x >= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.total_tokens == sum(lengths)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert abs(r.rank - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    assert tokens.histogram(df.limit(0)).collect() == []


def test_packing(spark):
    texts = documents(spark)[:300] + ODD + [None, None]
    df = spark.createDataFrame([(k // 2 if k > 290 else k, t, 1, 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = packing.pack(df, limit=256, group_rows=100).collect()
    whole, want, got = reference(), [], {}
    for k, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want += [(k // 2 if k > 290 else k, a, min(256, len(ids) - a), zlib.crc32(raw[4 * a : 4 * a + 1024]), len(ids)) for a in range(0, len(ids), 256)]
    assert sorted(want) == sorted((r.id, r.start, r.length, r.crc, r.tokens) for r in rows)
    for r in rows:
        got.setdefault(r.sequence, []).append((r.offset, r.length))
    filled = 0
    for parts in got.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        filled += at
    assert filled / (256 * len(got)) > 0.97
    assert packing.pack(df.limit(0)).collect() == []


def test_first_fit_equals_a_plain_scan():
    r = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        items = sorted((r.randrange(1, 101) for _ in range(n)), reverse=True)
        room, want = [], []
        for x in items:
            k = next((k for k, free in enumerate(room) if free >= x), len(room))
            if k == len(room):
                room.append(100)
            want.append((k, 100 - room[k]))
            room[k] -= x
        assert packing.first_fit(items, 100) == want
