r"""Byte-pair encoding and decoding with a given vocabulary.

A vocabulary is a file of the tokenizers library: a byte-level BPE model with the usual split into words (contractions, letters, numbers, other
signs, each with at most one space before it, and white space), no normaliser, and added tokens, which are taken out of a text first, the longest
where several begin. Files of other kinds are refused. The driver reads the file and broadcasts it, so its size bounds what is sent.

A word of at most SHORT bytes is an array of its parts, one between every two boundaries, beside an array of the ranks of adjacent parts. The lowest rank, the first of equal
ones, is found by scanning; the boundary within that pair is deleted, and the ranks of the joined part and its two neighbours are looked up anew, until no adjacent parts
have a rank. The new words of many texts are rows of such arrays, of which numpy takes a step at once. Scanning a longer word so would be quadratic; there the ranks stand
in a heap and the parts in a linked list, which merges in the same order. Encodings of short words are remembered until there are MEMO of them, then all are forgotten;
nothing else outlives a run of texts.

Characters that the vocabulary's Unicode version (16) does not assign are signs, neither letters nor numbers. Null and empty texts have no tokens. Very long texts are split
in blocks, at white space after other characters, where a word begins in any case; a single word is held whole. Rows are encoded each for itself, so
repeated rows are encoded alike. Extra columns pass through, renamed if they clash; an empty table gives an empty one. Decoding skips ids that the vocabulary
does not have and null ids, decodes null to null, and writes U+FFFD for bytes that are not UTF-8, as the library does.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, unclash

#: Bytes of a word that is merged by scanning; words that a task remembers; words that are merged at once.
SHORT, MEMO, ROWS = 128, 1 << 18, 2048
#: Characters that are split into words at once, and tokens that are decoded at once.
BLOCK, TOKENS = 1 << 20, 1 << 20
NONE = 1 << 30

#: Code points to which later versions of Unicode than 16 give a letter or a number, so that the vocabulary takes them for signs.
LATER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1"
    r"\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF"
    r"\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
#: Fixed value: the split into words, for letters, numbers and the white space of a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{O}]+|[{S}]+(?![^{S}])|[{S}]+"
SPACES = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORDS_ASCII = re.compile(SPLIT.format(L="[A-Za-z]", N="[0-9]", S=r"\x09-\x0D\x20", O="A-Za-z0-9"))
WORDS_ANY = regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", S=SPACES, O=r"\p{L}\p{N}"))
WORDS_LATER = regex.compile("(?V1)" + SPLIT.format(L=rf"[\p{{L}}--[{LATER}]]", N=rf"[\p{{N}}--[{LATER}]]", S=SPACES, O=rf"[\p{{L}}--[{LATER}]][\p{{N}}--[{LATER}]]"))
IS_LATER, MAY_BE_LATER = re.compile(f"[{LATER}]"), re.compile(r"[\u0558-\U0010FFFF]")
#: White space after another character: a word begins there, whatever stands around.
CUT = re.compile(rf"[^{SPACES}](?=[{SPACES}])")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary: printable ones for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


def words(text: str):
    """Lists of the words of a text, by blocks."""
    find = (WORDS_ASCII if text.isascii() else WORDS_LATER if MAY_BE_LATER.search(text) and IS_LATER.search(text) else WORDS_ANY).findall
    at = 0
    while len(text) - at > BLOCK and (cut := CUT.search(text, at + BLOCK)):
        yield find(text[at : cut.end()])
        at = cut.end()
    yield find(text[at:] if at else text)


class Vocabulary:
    """ids: bytes of a token to its id; ranks: bytes of two parts to the rank of their merge; tokens: bytes by id; added: content of an added token to its id."""

    def __init__(self, config: dict):
        model, pre, decoder = config["model"], config["pre_tokenizer"] or {}, config["decoder"] or {}
        kept = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"}
        if model["type"] != "BPE" or any(model.get(k) for k in kept) or config["normalizer"] or config["post_processor"] or decoder.get("type") != "ByteLevel":
            raise ValueError("no plain byte-level BPE vocabulary")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("no vocabulary of the usual split into words")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in config["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours are not supported")
        signs = byte_signs()
        raw = lambda token: bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special = {t["id"] for t in config["added_tokens"] if t["special"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: raw(t) for t, i in self.added.items()}
        self.taken_out = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # the same by numbers: pairs of ids in order with their ranks, the id that each rank makes, ids of bytes, ranks of pairs of bytes
        coded = sorted((self.ids[raw(a)] << 32 | self.ids[raw(b)], r) for r, (a, b) in enumerate(pairs))
        self.pairs, self.pair_ranks = (np.array([x[i] for x in coded], np.int64) for i in (0, 1))
        self.made = np.array([self.ids[raw(a) + raw(b)] for a, b in pairs], np.int64)
        self.bytes = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        self.byte_ranks = np.array([[self.ranks.get((bytes([i]), bytes([j])), NONE) for j in range(256)] for i in range(256)], np.int64)

    @classmethod
    def open(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where they have none or an id is -1."""
        if not len(self.pairs):
            return np.full(a.shape, NONE, np.int32)
        code = a.astype(np.int64) << 32 | b  # negative where an id is
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.pair_ranks[at], NONE).astype(np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short words one after the other, and how many each has: rows of parts (-1 behind the last) and of ranks, where rank j is that of parts j and j + 1."""
        counts, ended = np.zeros(len(words), np.int64), []
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for lo in range(0, len(order), ROWS):
            rows = np.array(order[lo : lo + ROWS])
            sizes = np.array([len(words[i]) for i in rows])
            width = max(1, int(sizes.max()))
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
            column = np.arange(width)
            parts = np.where(column < sizes[:, None], self.bytes[raw], -1).astype(np.int32)
            ranks = np.where(column[1:] < sizes[:, None], self.byte_ranks[raw[:, :-1], raw[:, 1:]], NONE).astype(np.int32)
            while len(rows):
                row, n = np.arange(len(rows)), parts.shape[1]
                at = ranks.argmin(axis=1) if n > 1 else row
                low = ranks[row, at] if n > 1 else np.full(len(rows), NONE)
                if (done := low == NONE).any():
                    ended.append((rows[done], parts[done]))
                    counts[rows[done]] = (parts[done] >= 0).sum(axis=1)
                    rows, parts, ranks, at, low = (x[~done] for x in (rows, parts, ranks, at, low))
                    row = np.arange(len(rows))
                    if not len(rows):
                        break
                parts[row, at] = self.made[low]
                # every row loses one boundary, so the arrays stay rectangular
                kept = np.ones(parts.shape, bool)
                kept[row, at + 1] = False
                parts, ranks = parts[kept].reshape(len(rows), n - 1), ranks[kept[:, 1:]].reshape(len(rows), n - 2)
                for some, first in ((np.flatnonzero(at < n - 2), at), (np.flatnonzero(at > 0), at - 1)):
                    ranks[some, first[some]] = self.rank_of(parts[some, first[some]], parts[some, first[some] + 1])
        flat, first = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for rows, parts in ended:
            column = np.arange(parts.shape[1])
            inside = column < counts[rows][:, None]
            flat[(first[rows][:, None] + column)[inside]] = parts[inside]
        return flat, counts

    def cuts_of_long(self, word: bytes) -> list[int]:
        """Boundaries of the parts of a long word: ranks in a heap, parts in a list linked both ways. An entry counts only while its two parts are those that it was made for."""
        rank, n = self.ranks.get, len(word)
        after, before, there = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if not there[a] or after[a] != b or b >= n or after[b] != end:
                continue
            there[b], after[a] = 0, end
            if end < n:
                before[end] = a
                if (r := rank((word[a:end], word[end : after[end]]))) is not None:
                    heapq.heappush(heap, (r, a, end, after[end]))
            if a:
                p = before[a]
                if (r := rank((word[p:a], word[a:end]))) is not None:
                    heapq.heappush(heap, (r, p, a, end))
        return [*(i for i in range(n) if there[i]), n]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of any length."""
        short = [w if len(w) <= SHORT else b"" for w in words]
        flat, counts = self.merge(short)
        if all(short):
            return flat, counts
        ends, pieces, at = np.cumsum(counts), [], 0
        for i, w in enumerate(words):
            if len(w) > SHORT:
                cut = self.cuts_of_long(w)
                pieces += [flat[at : ends[i]], np.array([self.ids[w[a:b]] for a, b in zip(cut, cut[1:])], np.int32)]
                counts[i], at = len(cut) - 1, ends[i]
        return np.concatenate([*pieces, flat[at:]]), counts


class Encoder:
    """Encodes texts. memo has the number of a word that is remembered; sizes, first and flat say by these numbers what its ids are."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.sizes, self.first, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: set[str]) -> None:
        """Puts words that are new to the memo, long ones too; see settle()."""
        new = list(words.difference(self.memo))
        flat, sizes = self.vocabulary.encode_words([w.encode() for w in new])
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])

    def settle(self, waiting: list, out: list[list[np.ndarray]]) -> None:
        """Ids of the waiting blocks (text, list of words or an id) into the lists of their texts."""
        self.learn(set().union(*(block for _, block in waiting if block.__class__ is list)))
        for i, block in waiting:
            if block.__class__ is not list:
                out[i].append(np.array([block], np.int32))
                continue
            word = np.fromiter(map(self.memo.__getitem__, block), np.int64, len(block))
            sizes = self.sizes[word]
            ends = np.cumsum(sizes)
            # the ids of each word stand together, from its first place on
            out[i].append(self.flat[np.arange(ends[-1]) + np.repeat(self.first[word] - ends + sizes, sizes)])
        waiting.clear()
        # a long word takes as much memory as its text, so it is not kept beyond it
        if len(self.memo) > MEMO or len(self.flat) > 4 * MEMO:
            self.forget()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts are taken together until they have BLOCK characters, longer ones a block at a time."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        added, taken_out, waiting, size = self.vocabulary.added, self.vocabulary.taken_out, [], 0
        for i, text in enumerate(texts):
            for k, piece in enumerate(taken_out.split(text) if taken_out else [text]):
                if k % 2:
                    waiting.append((i, added[piece]))
                elif piece:
                    for block in words(piece):
                        waiting.append((i, block))
                        size += min(len(piece), BLOCK)
                        if size >= BLOCK:
                            self.settle(waiting, out)
                            size = 0
        self.settle(waiting, out)
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in out]


class Decoder:
    """Bytes of the tokens by id, as one array from which Arrow takes them."""

    def __init__(self, vocabulary: Vocabulary, skip_special: bool):
        self.size = max(vocabulary.tokens, default=-1) + 1
        skipped = vocabulary.special if skip_special else ()
        # the last place stands for ids that there are not
        self.table = pa.array([b"" if i in skipped else vocabulary.tokens.get(i, b"") for i in range(self.size + 1)], pa.large_binary())

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for at in range(0, len(ids), TOKENS):
            some = ids[at : at + TOKENS].astype(np.int64)
            some[(some < 0) | (some >= self.size)] = self.size
            found = pc.take(self.table, pa.array(some))
            offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
            out.append(b"" if found.buffers()[2] is None else found.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]])
        return b"".join(out).decode("utf-8", "replace")


def encode(documents: DataFrame, vocabulary: Vocabulary, column: str = "text", added: str = "ids") -> DataFrame:
    """documents with the ids of a text column as an array of int in the column `added`; null texts have none."""
    documents = unclash(documents, [added]) if column != added else documents
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*documents.schema.fields, T.StructField(added, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            found = encoder.encode([t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()])
            for lo, hi in blocks([len(f) for f in found]):
                ends = np.cumsum([0, *[len(f) for f in found[lo:hi]]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found[lo:hi], np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, ids], names=schema.names)

    return documents.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, column: str = "ids", added: str = "decoded", skip_special: bool = False) -> DataFrame:
    """rows with the text of an array of ids in the column `added`; null for null."""
    rows = unclash(rows, [added]) if column != added else rows
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*rows.schema.fields, T.StructField(added, T.StringType())])

    def run(batches):
        decoder = Decoder(shared.value, skip_special)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            for lo, hi in blocks(sizes):
                out = []
                for ids in lists.slice(lo, hi - lo):
                    out.append(decoder.decode(pc.fill_null(ids.values, -1).to_numpy(zero_copy_only=False)) if ids.is_valid else None)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def blocks(sizes: list[int]):
    """(first row, end row) of runs of rows with some TOKENS tokens together; an empty batch has one empty run."""
    lo = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= TOKENS:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes) or not sizes:
        yield lo, len(sizes)


def op13_rank_array_bpe(spark, sf_dir):
    import public_tokenizers

    vocabulary = Vocabulary.open(public_tokenizers.path("byte_bpe_50k.json"))
    found = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
