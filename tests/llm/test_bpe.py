import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tandem.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.open(PATH)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


BITS = ["the", " quick", "  ", "\n", "\t\n ", "don't", "'ll", "'S", "é", "ß", "日本語", "😀", "　", "\x85", "\x1c", "​", "１２", "½", "Ⅻ", "1234", "___", "<|endoftext|>", "<|endof", "՘", "౜", "\U00016ff4", "\x00", "a" * 30, "!?", " '", "�", "ſ"]


def drawn(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25)))


def test_against_the_library_on_drawn_texts(vocabulary, library):
    rng, encoder, decoder = random.Random(5), bpe.Encoder(vocabulary), bpe.Decoder(vocabulary, False)
    without = bpe.Decoder(vocabulary, True)
    texts = [drawn(rng) for _ in range(1500)] + ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x20000)])) for _ in range(40)) for _ in range(500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode([text])[0]
        assert got.tolist() == want, text
        assert decoder.decode(got) == library.decode(want, skip_special_tokens=False)
        assert without.decode(got) == library.decode(want, skip_special_tokens=True)


def test_every_code_point_splits_as_in_the_library(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 3000):
        text = "".join(f"a{chr(c)}1{chr(c)}!" for c in points[lo : lo + 3000])
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert [w for block in bpe.words(text) for w in block] == want, lo


def test_decoding_of_any_ids(vocabulary, library):
    rng, decoder = random.Random(6), bpe.Decoder(vocabulary, False)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 30))] + [rng.randrange(90, 256) for _ in range(5)]
        assert decoder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    assert decoder.decode(np.array([-1, 60_000, 1 << 40])) == ""


def merged_by_definition(vocabulary, word):
    parts = [bytes([b]) for b in word]
    while True:
        ranks = [vocabulary.ranks.get(p, bpe.NONE) for p in zip(parts, parts[1:])]
        if not ranks or min(ranks) == bpe.NONE:
            return parts
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_both_ways_of_merging_give_the_same_parts(vocabulary):
    rng, words = random.Random(7), []
    for n in [0, 1, 2, 3, *range(5, 400, 13)]:
        for letters in ("ab", "etaoin ", "aaaa", "".join(map(chr, range(33, 127)))):
            word = "".join(rng.choice(letters) for _ in range(n)).encode()
            words.append(word)
    flat, counts = vocabulary.merge(words)
    for word, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1])):
        want, cuts = merged_by_definition(vocabulary, word), vocabulary.cuts_of_long(word)
        assert [vocabulary.tokens[i] for i in ids.tolist()] == want and [word[a:b] for a, b in zip(cuts, cuts[1:])] == want


def test_long_words_and_texts(vocabulary, library, monkeypatch):
    import time

    encoder = bpe.Encoder(vocabulary)
    for text in ("ab" * 150_000, "x" * 300_000, " " * 300_000, "é!" * 100_000, "A man 12 \n\n a plan " * 20_000):
        began = time.time()
        got = encoder.encode([text])[0]
        assert time.time() - began < 20
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    rng = random.Random(8)
    monkeypatch.setattr(bpe, "BLOCK", 7)  # every text in many blocks
    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "TOKENS", 3)
    monkeypatch.setattr(bpe, "ROWS", 4)
    monkeypatch.setattr(bpe, "SHORT", 6)
    decoder, encoder = bpe.Decoder(vocabulary, False), bpe.Encoder(vocabulary)
    for text, got in zip(texts := [drawn(rng) for _ in range(300)], encoder.encode(texts)):
        assert len(encoder.memo) < 100
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
        assert decoder.decode(got) == text


def test_rows_nulls_clashes_and_empty_tables(spark, vocabulary, library):
    rows = [(1, None, "own", 5), (2, "", "own", None), (3, "two  words\n", None, 1), (3, "two  words\n", None, 1), (None, "<|endoftext|>", "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    assert got.columns == ["doc_id", "text", "ids_0", "decoded_0", "ids", "decoded"]
    for r in got.collect():
        assert r.ids == (library.encode(r.text, add_special_tokens=False).ids if r.text else []) and r.decoded == (r.text or "")
    assert got.where("ids_0 = 'own'").count() == 2 and bpe.encode(df.limit(0), vocabulary).count() == 0
    some = spark.createDataFrame([(1, None), (2, [464, None, 99_999])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(some, vocabulary).orderBy("k").collect()] == [None, "The"]


def test_refuses_other_kinds_of_files(vocabulary):
    for name in ("word_bpe_49k.json",):
        with pytest.raises(ValueError):
            bpe.Vocabulary.open(public_tokenizers.path(name))


def test_query_against_the_library(spark, library):
    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    got = bpe.op13_rank_array_bpe(spark, at).collect()
    assert len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
