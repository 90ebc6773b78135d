"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up every
adjacent pair by binary search over the sorted pair keys, takes each word's
lowest rank, and merges there. All places of that pair are merged in one round
where no pair with the new symbol has a lower rank; otherwise the leftmost
only, which is the order in which a queue of merges would work.

The tokenizer file (public JSON form, with a word end suffix) is read on the
driver and broadcast; it holds about 2 MB whatever the input.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import held, small_batches, table

#: Words and white-space free chunks that a worker remembers; when there are more, it starts anew.
MEMORY = 150_000
_NEVER = np.int64(1 << 40)
#: White space of Unicode; str.split() would also split at the four separators 28 to 31.
_SPACES = regex.compile(r"\p{White_Space}+")
_POINTS = tuple(".,!?;:")
_ODD = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """A tokenizer of words with an end suffix, from its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.spec, self.library = text, None
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[alphabet[b] + suffix] for b in range(256)], np.int64)
        self.size = len(self.tokens)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in map(self._pair, model["merges"])), strict=True))
        ranks = np.arange(len(made))
        first = np.full(self.size, _NEVER)
        np.minimum.at(first, left, ranks)
        np.minimum.at(first, right, ranks)
        keys = left * self.size + right
        by = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[by], ranks[by]
        self.made, self.whole = made, first[made] > ranks
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def _pair(merge) -> tuple[str, str]:
        return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), lengths)
        sym[ends - 1] = self.last[raw[ends - 1]]
        out: list[bytes] = [b""] * len(words)
        while len(sym):
            start = np.concatenate(([True], word[1:] != word[:-1]))
            starts = np.flatnonzero(start)
            key = np.full(len(sym), -1, np.int64)
            key[:-1] = np.where(start[1:], -1, sym[:-1] * self.size + sym[1:])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], _NEVER)
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            done = least == _NEVER
            if done.any():
                stay = np.repeat(~done, sizes)
                ready, cuts = sym[~stay].astype("<u4").tobytes(), np.cumsum(sizes[done]) * 4
                lo = 0
                for w, hi in zip(word[starts[done]].tolist(), cuts.tolist(), strict=True):
                    out[w] = ready[lo:hi]
                    lo = hi
                sym, word, rank, sizes, least = sym[stay], word[stay], rank[stay], sizes[~done], least[~done]
                if not len(sym):
                    break
            each = np.repeat(least, sizes)
            pick = rank == each
            run = pick & ~np.concatenate(([False], pick[:-1]))
            index = np.arange(len(sym))
            parity = (index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0
            once = np.zeros(len(sym), bool)
            places = np.flatnonzero(pick)
            once[places[np.concatenate(([True], word[places][1:] != word[places][:-1]))]] = True
            pick &= np.where(self.whole[each], parity, once)
            places = np.flatnonzero(pick)
            sym[places] = self.made[rank[places]]
            stay = np.ones(len(sym), bool)
            stay[places + 1] = False
            sym, word = sym[stay], word[stay]
        return out

    def _pieces(self, chunk: str) -> list:
        """Words of a chunk, and ids of special tokens as integers."""
        if "<|" in chunk:
            parts = self.special_pattern.split(chunk)
            return [p for k, part in enumerate(parts) for p in ([self.special[part]] if k % 2 else self._words(part))]
        return self._words(chunk)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        elif any(unicodedata.category(c) == "Cn" for c in text):
            return self._words_of_library(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if text.isalpha():
            return [text]
        if text[-1:] in _POINTS and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def _words_of_library(self, text: str) -> list[str]:
        """Words by the library's own normaliser and pattern, whose Unicode tables may be newer than ours."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            cut = next(p for p in json.loads(self.spec)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
            self.library = Tokenizer.from_str(self.spec).normalizer, pre_tokenizers.Split(Regex(cut["pattern"]["Regex"]), cut["behavior"].lower(), cut["invert"])
        normalizer, splitter = self.library
        return [w for w, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]

    def split(self, text: str) -> list[str]:
        return [c for c in _SPACES.split(text) if c] if _ODD.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        if len(self.chunks) > MEMORY:
            self.chunks = {}
        if len(self.words) > MEMORY:
            self.words = {}
        new = set().union(*parts).difference(self.chunks)
        new = list(new)
        pieces = list(map(self._pieces, new))
        unseen = [w for w in set().union(*pieces).difference(self.words) if isinstance(w, str)]
        for lo in range(0, len(unseen), 20_000):
            some = unseen[lo : lo + 20_000]
            self.words.update(zip(some, self.merge([w.encode("utf-8") for w in some]), strict=True))
        known = self.words
        self.chunks.update((c, known[p[0]] if len(p) == 1 and p[0].__class__ is str else b"".join([known[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in p])) for c, p in zip(new, pieces, strict=True))
        return [b"".join(map(self.chunks.__getitem__, p)) for p in parts]

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def _tokenizer(shared) -> WordBpe:
    return held(("words", hash(shared.value)), lambda: WordBpe(shared.value))


def text_groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about size bytes of a text column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="left")) + 1
        yield lo, min(hi, len(ends))
        lo = hi


def encode(df: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with the token ids of its text column, without special tokens of its own.

    The ids are binary, little-endian unsigned 32-bit integers; `as_array` makes
    array<int> of them. Null and empty texts have no ids. Strings of special
    tokens in a text get their special ids. Rows, ties and all other columns
    stay as they are; a column named as the ids is replaced.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    base = df.drop(ids)
    place = base.columns.index(text)

    def run(batches):
        t = _tokenizer(shared)
        for b in batches:
            column = b.column(place)
            for lo, hi in text_groups(column):
                found = t.encode([x or "" for x in column.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(found, pa.binary())], names=[*b.schema.names, ids])

    return base.mapInArrow(run, StructType([*base.schema.fields]).add(ids, "binary"))


def decode(df: DataFrame, tokenizer_json: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ids (binary, as encode gives them); null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    base = df.drop(text)
    place = base.columns.index(ids)

    def run(batches):
        t = _tokenizer(shared)
        for b in batches:
            column = b.column(place)
            for lo, hi in text_groups(column):
                made = pa.array([t.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in column.slice(lo, hi - lo).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, made], names=[*b.schema.names, text])

    return base.mapInArrow(run, StructType([*base.schema.fields]).add(text, "string"))


def as_array(df: DataFrame, ids: str = "token_ids") -> DataFrame:
    """df with its binary ids as array<int>."""
    base = df.drop(ids)

    def run(batches):
        for b in batches:
            column = b.column(b.num_columns - 1)
            for lo, hi in text_groups(column):
                made = pa.array([np.frombuffer(x or b"", "<i4") for x in column.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], made], names=b.schema.names)

    return df.select(*base.columns, ids).mapInArrow(run, StructType([*base.schema.fields]).add(ids, ArrayType(IntegerType())))


def word_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; null texts are empty, repeated rows alike."""
    spec = word_tokenizer()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = decode(encode(docs, spec).drop("text"), spec)
    return both.select("doc_id", F.expr("bigint(octet_length(token_ids) div 4)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
