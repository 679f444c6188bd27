"""Token counts and ids against the library on whole texts; packing against its contract."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from logloom.llm import packing as p
from logloom.llm import token_counts as t
from logloom.llm.common import table

TEXTS = [
    "", " ", "  \n\n ", "a", "Hello  world\n\n  don't 're 'S it''s x'll", "<|endoftext|>", "a <|endoftext|>b  <|endoftext|>", "<|endof text|>",
    "tab\tend \t", "é è́ Å H̱ ß ﬁ   x  y　z ​", "日本語 テキスト 123４５６ ²³", "\x1c a \x85 b", "😀👍🏽 ok!!! ... ???",
    "Erndly | ndinger.%%% edanst*** (x) [y] {z} 'quoted' \"q\" it's they'RE don't. x'", "<|startoftext|> Foo <|ENDOFTEXT|> <|endoftext|>.",
    "ΑΣ Σ ΣΑΣ. ΟΔΟΣ", "word." * 40, "'" * 5 + " 's 't", "µ ª º Ĳ ŉ", "á̧.", "x\r\ny\x0bz\x0c",
]


def odd_texts(rng, n):
    pool = list("ab Z9'.,!|<>\n\t  é") + ["<|endoftext|>", "the ", " of", "  ", "\n\n", "'s", "don't", "日本"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def corpus(spark):
    return [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]


def test_counts_equal_the_library(spark):
    path = t.tokenizer_path("byte_bpe_50k.json")
    texts = TEXTS + odd_texts(random.Random(2), 200) + corpus(spark)
    whole = t.load(path)
    for text in texts:
        want = len(whole.encode(text, add_special_tokens=False).ids)
        assert t.count_text(text, path) == want, text[:80]
        for chunk, overlap in ((40, 8), (200, 16)):
            assert t.count_text(text, path, chunk, overlap) == want, (text[:80], chunk)


def test_overlap_is_widened_up_to_the_whole_text():
    path = t.tokenizer_path("byte_bpe_50k.json")
    whole = t.load(path)
    for text in ("x" * 5000, "ab" * 900 + " c " + "1" * 3000, " " * 2000 + "y", "<|endoftext|>" * 300):
        encoded = []

        def encode(part):
            encoded.append(len(part))
            return whole.encode(part, add_special_tokens=False)

        assert t.spliced_count(text, encode, 13, 100, 16) == len(whole.encode(text, add_special_tokens=False).ids)
    assert max(encoded) <= 5000


def test_remembered_segments_are_bounded():
    counter = t.SegmentCounter(t.tokenizer_path("byte_bpe_50k.json"), bound=50)
    words = [f" w{i}x" for i in range(500)]
    want = len(t.load(t.tokenizer_path("byte_bpe_50k.json")).encode("".join(words), add_special_tokens=False).ids)
    assert counter.count("".join(words)) == want
    for i in range(0, 500, 20):
        counter.count("".join(words[i : i + 20]))
        assert len(counter.known) <= 500


def test_count_tokens_rows(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (2, "é " * 600, "y"), (3, "", "z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    long = len(t.load(t.tokenizer_path("byte_bpe_50k.json")).encode("é " * 600, add_special_tokens=False).ids)
    got = sorted(map(str, (tuple(r) for r in t.count_tokens(frame).collect())))
    assert got == sorted(map(str, [(1, 11, 2, False), (1, 11, 2, False), (None, 0, 0, False), (2, 1800, long, True), (3, 0, 0, False)]))
    assert t.count_tokens(frame.limit(0)).count() == 0
    pieces = t.count_tokens(frame, tokenizer="piece_bpe_32k.model").where("doc_id = 1").first()
    assert pieces.n_tokens == 2


def test_ids_equal_the_library(spark):
    path = t.tokenizer_path("word_bpe_49k.json")
    whole = t.load(path)
    for text in TEXTS + odd_texts(random.Random(3), 200) + corpus(spark):
        want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert p.token_ids(text, path) == want, text[:80]


def test_fullest_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.randint(1, 40)
        counts = {n: rng.randint(1, 4) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(6, capacity)))}
        pattern = p.fullest(counts, capacity)
        total = sum(n * m for n, m in pattern.items())
        assert all(m <= counts[n] for n, m in pattern.items()) and max(counts) in pattern and total <= capacity
        sums = {max(counts)}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(c + 1 - (n == max(counts)))}
        assert total == max(s for s in sums if s <= capacity)


def check_packing(rows, texts, capacity=p.CAPACITY):
    path = t.tokenizer_path("word_bpe_49k.json")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = p.token_ids(texts[doc] or "", path) + (1).to_bytes(4, "little")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows), len(by_sequence)


def test_packing_keeps_the_contract(spark):
    docs = {i: text for i, text in enumerate(corpus(spark) + TEXTS + [None, "x " * 50_000])}
    frame = spark.createDataFrame([(i, s, 7) for i, s in docs.items()], "doc_id bigint, text string, length int")
    used, sequences = check_packing(p.pack(frame).collect(), docs)
    assert sequences * p.CAPACITY < 1.05 * used + p.CAPACITY


def test_packing_odd_rows_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(p, "BUCKET_ROWS", 3)
    rows = [(1, "same text"), (1, "same text"), (None, None), (None, "same text")] + [(i, "same text") for i in range(2, 60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = p.pack(frame, capacity=16).collect()
    assert len(got) == len(rows)
    places = [(r.sequence_id, r.offset) for r in got]
    assert len(set(places)) == len(places)
    check = defaultdict(list)
    for r in got:
        check[r.sequence_id].append((r.offset, r.length))
    for pieces in check.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert p.pack(frame.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [{}, {5: 1}, {16: 7}, {1: 1000, 15: 3, 9: 40, 7: 39}])
def test_plan_uses_every_piece_once(counts):
    lines = p.plan_windows(counts, 16)
    taken = defaultdict(list)
    for length, low, high, *_ in lines:
        taken[length].append((low, high))
    for length, c in counts.items():
        at = 0
        for low, high in sorted(taken[length]):
            assert low == at and high > low
            at = high
        assert at == c


def test_words_forgotten_and_met_again_keep_their_ids():
    path = t.tokenizer_path("word_bpe_49k.json")
    reader = p.WordIds(path, bound=12)
    texts = [f"The Über-straße, word{i % 7} naïve{i % 5}! IT'S <s> {i * 37} ok..." for i in range(40)] + ["", " \n", "the the THE"]
    for text in texts:
        whole = p.load(path).encode(text, add_special_tokens=False).ids
        assert reader.ids(text.encode()) == p._packed(whole)
        assert len(reader.words) <= 12 + len(set(text.split()))
