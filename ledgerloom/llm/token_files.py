"""Token ids as Parquet list columns, for selective reads.

The documents are dealt by ranges of doc_id and sorted within each, encoded
where they lie, and written by Spark's Parquet writer: ids as a list column in
a dictionary (delta encoded where a dictionary would be no smaller), metadata
as columns of their own, row groups and pages of set sizes. The writer adds
column and offset indexes, so a reader that filters on doc_id skips pages, and
one that reads metadata alone never touches the ids.
"""

from __future__ import annotations

import os
import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet, text_groups
from .common import held, scratch, table

END_ID = 2
#: Parts of texts that a worker remembers with their ids; when there are more, they become the older ones, and those before are forgotten.
MEMORY = 400_000
#: Text that is encoded at a time. Its distinct parts are looked up once each, so larger groups need fewer lookups, and more memory.
GROUP_BYTES = 4 << 20
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES, PAGE_ROWS = 64 << 20, 256 << 10, 1 << 20, 2_000
#: Letters (or wide characters still to be looked at), points of ASCII, and line feeds between them. An apostrophe may begin
#: a word of the pattern, "<" a special token: parts with these are left to the library.
_LETTERS, _MARKS = r"[A-Za-z\x80-\U0010ffff]", r"[!-&(-/:;=-@\[-`{-~]"
_SIMPLE = re.compile(f" ?(?:{_LETTERS}|{_MARKS})(?:\n?(?:{_LETTERS}|{_MARKS}))*")
_RUNS = re.compile(f" ?{_LETTERS}+| ?{_MARKS}+|\n")
_POINTS = "".join(c for c in map(chr, range(128)) if re.match(_MARKS, c))
#: Points of ASCII that part_bounds cuts at: none of them is in a special token or begins a word of the pattern.
_SAFE = '.,;:!?()"'


def _tables() -> tuple[np.ndarray, ...]:
    """What part_bounds asks of a byte, and of two bytes in a row.

    Of a byte: whether it is a blank, a line feed or a safe point. Of two: whether
    a letter ends with them; a letter begins there; something other than white
    space ends with them, white space of three bytes apart; something other than
    white space begins there for sure; and white space of three bytes may end with
    them. Letters are those of ASCII, of U+00C0 to U+027F but for its two signs,
    and of U+0400 to U+047F.
    """
    of_note = np.zeros(256, bool)
    of_note[[32, 10, *map(ord, _SAFE)]] = True
    first, second = np.divmod(np.arange(1 << 16), 256)
    latin = np.isin(first, [*range(0xC3, 0xCA), 0xD0, 0xD1]) & ~np.isin(np.arange(1 << 16), [0xC397, 0xC3B7])
    letter = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
    white = np.array([chr(c).isspace() and c < 128 for c in range(256)])
    whole = ~white[second] & ~np.isin(np.arange(1 << 16), [0xC285, 0xC2A0])
    starts = ~white[first] & ~np.isin(first, [0xC2, 0xE1, 0xE2, 0xE3])
    doubt = np.isin(np.arange(1 << 16), _WIDE & 0xFFFF)
    return of_note, letter[second] | latin, letter[first] | latin, whole, starts, doubt


#: White space of three bytes.
_WIDE = np.array([int.from_bytes(chr(c).encode(), "big") for c in range(0x800, 0xD800) if chr(c).isspace()])
_OF_NOTE, _LETTER_ENDS, _LETTER_BEGINS, _SOLID_ENDS, _SOLID_BEGINS, _DOUBT = _tables()


def part_bounds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the parts of texts that lie between bounds in data (UTF-8 bytes), the first one's start before them.

    Parts end before a blank or line feed behind other characters, behind such
    a line feed that stands alone, and between letters and safe points.
    """
    ends = np.zeros(len(data) + 1, bool)
    ends[bounds] = True
    at = np.flatnonzero(_OF_NOTE[data])
    if len(at):
        # What lies beyond a text's ends decides only about cuts that are there anyway, or are right in any case.
        here, last = data[at], len(data) - 1
        before = data[at - 1] | (data[np.maximum(at - 2, 0)].astype(np.uint16) << 8)
        behind = data[np.minimum(at + 2, last)] | (data[np.minimum(at + 1, last)].astype(np.uint16) << 8)
        solid = _SOLID_ENDS[before]
        doubt = np.flatnonzero(_DOUBT[before])
        solid[doubt] &= ~np.isin(before[doubt] | (data[at[doubt] - 3].astype(np.int64) << 16), _WIDE)
        feed = here == 10
        point = ~feed & (here != 32)
        ends[at[np.where(point, _LETTER_ENDS[before], solid)]] = True
        ends[at[feed & solid & _SOLID_BEGINS[behind] | point & _LETTER_BEGINS[behind]] + 1] = True
    return np.flatnonzero(ends)


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls empty, and the bounds of its texts in them."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class Pieces(dict):
    """Ids of texts by the tokenizers library, part by part.

    A text is cut by part_bounds where the byte-level pattern ends a token in
    any case and what follows has no say in the token before, so the parts' ids
    in a row are the text's ids, and a part that is remembered is not encoded again.
    The pattern also ends a token between letters, points and a lone line feed:
    parts made of these alone are cut there, and each run, one word of the
    pattern, goes to the library's model. All others take the library's whole way.
    The parts of many texts are coded by an Arrow dictionary, so that Python
    meets each distinct part of a group once, and new ones all together.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.alphabet = {b: c for b, c in byte_alphabet().items() if b}
        self.older: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        """Remembers the ids of parts that are not known yet, each there once."""
        words, cut = [], {}
        for p in parts:
            if (p[1:] if p[0] == " " else p).isalpha():
                words.append(p)
                continue
            word = p.rstrip(_POINTS)
            if (word[1:] if word[:1] == " " else word).isalpha():
                cut[p] = [word, p[len(word) :]]
                continue
            runs = _RUNS.findall(p) if _SIMPLE.fullmatch(p) else []
            if runs and (p.isascii() or all(r.isascii() or r.lstrip(" ").isalpha() for r in runs)):
                cut[p] = runs
            else:
                self[p] = array("I", self.library.encode(p, add_special_tokens=False).ids).tobytes()
        new = words + list(set().union(*cut.values()).difference(words, self))
        tokenize = self.model.tokenize
        # No run holds the character 0, which stays as it is.
        mapped = "\0".join(new).encode("utf-8").decode("latin-1").translate(self.alphabet).split("\0") if new else []
        self.update((w, array("I", [t.id for t in tokenize(m)]).tobytes()) for w, m in zip(new, mapped, strict=True))
        self.update((p, b"".join([self[r] for r in runs])) for p, runs in cut.items())

    def _found(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts."""
        found = list(map(self.get, parts))
        missing = [p for p, ids in zip(parts, found, strict=True) if ids is None]
        if not missing:
            return found
        older = list(map(self.older.get, missing))
        self.update((p, ids) for p, ids in zip(missing, older, strict=True) if ids is not None)
        self._learn([p for p, ids in zip(missing, older, strict=True) if ids is None])
        return [self[p] if ids is None else ids for p, ids in zip(parts, found, strict=True)]

    def lists(self, texts: list[str] | pa.Array, end: bytes = b"") -> pa.ListArray:
        """The ids of each text (null: empty) as a list of int32, with those of end (little-endian unsigned 32-bit integers) after them."""
        if len(self) > MEMORY:
            self.older = dict(self)
            self.clear()
        data, bounds = _utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        ends = part_bounds(data, bounds)
        parts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        ids = [*self._found(coded.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()), end]
        at = np.searchsorted(ends, bounds)
        codes = np.insert(coded.indices.to_numpy(), at[1:], len(ids) - 1)
        known = _lists(np.cumsum([0, *map(len, ids)]) // 4, b"".join(ids)).take(pa.array(codes))
        return pa.ListArray.from_arrays(known.offsets.take(pa.array(at + np.arange(len(at)))), known.values)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = self.lists(texts)
        at, ids = (4 * found.offsets.to_numpy().astype(np.int64)).tolist(), found.values.to_numpy().tobytes()
        return [ids[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]


def _lists(offsets: np.ndarray, ids: bytes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)]))


def _pieces(shared) -> Pieces:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("bytes", hash(shared.value)), lambda: Pieces(shared.value))


def token_rows(docs: DataFrame, tokenizer_json: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids, place) in ascending doc_id order, which is that of place: part by part, and within each."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    names = ["doc_id", "n_tokens", "ids"]

    def run(batches):
        pieces = _pieces(shared)
        for b in batches:
            texts = b.column(1)
            for lo, hi in text_groups(texts, GROUP_BYTES):
                found = pieces.lists(texts.slice(lo, hi - lo), end)
                sizes = pa.array(np.diff(found.offsets.to_numpy()).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), sizes, found], names=names)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = F.col("doc_id").asc_nulls_first()
    by = base.repartitionByRange(first, F.length("text")).sortWithinPartitions(first, F.length("text"), "text")
    return by.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>").withColumn("place", F.monotonically_increasing_id())


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = END_ID) -> None:
    """Writes token_rows as Parquet files at path.

    Null and empty texts are written as their end id alone. Rows that repeat a
    doc_id lie side by side, by the length of their text and the text; rows without doc_id come
    first. Other columns are ignored.
    """
    options = {
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.dictionary.page.size": DICTIONARY_BYTES,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#place": "false",
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
    }
    token_rows(docs, tokenizer_json, end_id).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


PART = "shiftright(place, 33)"


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the ids before each written part, from the metadata columns only; a row per part."""
    parts = spark.read.parquet(path).groupBy(F.expr(PART).alias("part")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _crcs(batches):
    names = ["doc_id", "place", "ids_crc32", "found"]
    for b in batches:
        ids = b.column(2)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
        at, raw = 4 * ids.offsets.to_numpy()[:-1].astype(np.int64), ids.values.to_numpy().astype("<u4", copy=False).view(np.uint8)
        crc = [crc32(raw[lo:hi]) for lo, hi in zip(at.tolist(), (at + 4 * sizes).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64()), pa.array(sizes)], names=names)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files at path; n_tokens is the length of the ids that were read."""
    rows = spark.read.parquet(path).select("doc_id", "place", "ids").mapInArrow(_crcs, "doc_id long, place long, ids_crc32 long, found long")
    rows = rows.withColumn("part", F.expr(PART))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("found").over(within), F.lit(0)))
    return placed.join(part_starts(spark, path), "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), F.col("found").alias("n_tokens"), "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; null texts are their end id alone."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, spec)
    return read_tokens(spark, path)
