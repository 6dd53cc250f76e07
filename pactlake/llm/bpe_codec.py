"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The vocabulary comes from a tokenizer file: NFC, white space dropped, lower case, words cut by the file's pattern, bytes
written as characters, and a mark at the end of each word. A word's merges are led by a segment tree whose leaves are the
ranks of its adjacent pairs, with their places below them: the root is the leftmost pair of the lowest rank. A merge
changes three leaves, each on a path to the root, until the root holds no pair; a word of n bytes takes O(n log n) steps
however long it is. Words come back often, so a worker keeps the pieces of up to `kept` short words from task to task.

Texts whose code points all lie below U+0530 are normalised and cut here; there Unicode's tables are the same in every
version. Other texts go through the tokenizer file's own normaliser and pattern, whose tables are newer than Python's.

A null text counts as empty: no pieces. The strings of special tokens in a text are those tokens, and stay in what is
decoded. Repeated rows are encoded each on its own. An empty table gives an empty result; encode_texts and decode_ids
keep the other columns, token_digests leaves them out.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

NONE = 1 << 62
_BEYOND = re.compile("[^\x00-ԯ]")


class PairTree:
    """The pairs of a sequence of symbols by rank: first() is the leftmost of the lowest rank, or None."""

    def __init__(self, ranks: list[int]):
        """ranks: of the pair that begins at each place, NONE where there is none."""
        self.n = max(1, len(ranks))
        self.size = 1 << (self.n - 1).bit_length()
        leaves = [r if r == NONE else r * self.n + i for i, r in enumerate(ranks)]
        self.tree = [NONE] * self.size + leaves + [NONE] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def first(self) -> int | None:
        top = self.tree[1]
        return None if top == NONE else top % self.n

    def set(self, at: int, rank: int) -> None:
        tree, i = self.tree, at + self.size
        key = rank if rank == NONE else rank * self.n + at
        if tree[i] == key:
            return
        tree[i] = key
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least


class BpeCodec:
    """The tokenizer of a file with byte-level pieces and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        steps = [s["type"] for s in (told["normalizer"] or {}).get("normalizers", [])], [s["type"] for s in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or told["decoder"] or model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a byte-level vocabulary with word ends")
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        # Of each byte that occurs in UTF-8, the number of its character, inside and at the end of a word.
        letters = _byte_letters()
        self.inside = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.word = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.apart = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self._letter = {c: b for b, c in enumerate(letters)}
        self._held: dict[bytes, tuple[tuple[int, ...], str, str]] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The pieces of one word."""
        symbols = [self.inside[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n, merges, none = len(symbols), self.merges, (NONE, 0)
        tree = PairTree([merges.get((symbols[i], symbols[i + 1]), none)[0] for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (at := tree.first()) is not None:
            gone = after[at]
            symbols[at] = merges[symbols[at], symbols[gone]][1]
            symbols[gone] = -1
            after[at] = far = after[gone]
            if gone < n - 1:
                tree.set(gone, NONE)
            if far < n:
                before[far] = at
                tree.set(at, merges.get((symbols[at], symbols[far]), none)[0])
            else:
                tree.set(at, NONE)
            if (left := before[at]) >= 0:
                tree.set(left, merges.get((symbols[left], symbols[at]), none)[0])
        return [s for s in symbols if s >= 0]

    def words(self, text: str) -> list[bytes]:
        """The words of a text without special tokens."""
        if _BEYOND.search(text) is None:
            text = unicodedata.normalize("NFC", text)
            # Letter by letter where a sigma's lower case depends on its place.
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            return [w.encode() for w in self.word.findall(text)]
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self._letter[c] for c in w) for w, _ in pieces]

    def pieces(self, word: bytes, kept: int, longest: int = 64) -> tuple[tuple[int, ...], str, str]:
        """The ids of a word, the same as text, and what they decode to. Up to `kept` short words are held; when there
        are more, all are let go."""
        found = self._held.get(word)
        if found is None:
            ids = self.merged(word)
            found = tuple(ids), " ".join(map(str, ids)), self.decode(ids)
            if len(word) <= longest:
                if len(self._held) >= kept:
                    self._held.clear()
                self._held[word] = found
        return found

    def encode(self, text: str, kept: int = 1 << 19) -> list[tuple[tuple[int, ...], str, str]]:
        """pieces() of the words of a text and of its special tokens."""
        out, get = [], self._held.get
        for i, part in enumerate(self.apart.split(text) if self.apart else [text]):
            if i % 2:
                out.append(((self.special[part],), str(self.special[part]), part))
            elif part:
                out.extend(get(w) or self.pieces(w, kept) for w in self.words(part))
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


@lru_cache(2)
def codec(path: str) -> BpeCodec:
    """Read once for a worker."""
    return BpeCodec(path)


def word_pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(df: DataFrame, path: str, text_col: str = "text", to: str = "ids", kept: int = 1 << 19) -> DataFrame:
    """df with `to`: the ids of each text's pieces."""
    return _with_column(df, text_col, to, "array<int>", pa.list_(pa.int32()), lambda c: lambda text: [i for ids, _, _ in c.encode(text or "", kept) for i in ids], path)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with `to`: the pieces of the ids, a space between; null ids are an empty text."""
    return _with_column(df, ids_col, to, "string", pa.string(), lambda c: lambda ids: c.decode(ids or []), path)


def _with_column(df: DataFrame, of: str, to: str, kind: str, arrow: pa.DataType, make: Callable, path: str) -> DataFrame:
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make(codec(path))
        for part in column:
            yield pa.array([one(x.as_py()) for x in part], arrow)

    return df.withColumn(to, F.arrow_udf(run, kind)(F.col(of)))


def token_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kept: int = 1 << 19) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), one row for each input row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)

        digest = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                found = c.encode(text.as_py() or "", kept)
                each, numbers, pieces = zip(*found, strict=True) if found else ((), (), ())
                n.append(sum(map(len, each)))
                ids.append(digest(numbers))
                decoded.append(digest(pieces))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_pieces_path())
