"""Packing by power-of-two decomposition: each document is cut into pieces of binary length, each its own sequence.

A document of n tokens gives n // 4096 pieces of 4096 and then one piece for each binary digit of the rest,
longest first. Every piece fills a sequence of exactly its length, so nothing is padded, no sequence crosses
documents, and equal lengths share a bucket. The work is row-wise: no shuffle, no limit on a document.

Edge cases. A null text counts as empty and gives one piece, the end token alone. Repeated rows give their
pieces each. Extra columns are not read. A null key stays null.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import arrow_map, tidy

MAX_LENGTH = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Distinct stretches between white space whose ids a worker remembers; beyond it those met least recently go.
CACHE_SIZE = 400_000
#: Bytes of text that are cut at once.
PART_BYTES = 4 << 20
#: The vocabulary's pre-token expression, over Latin-1 (letters, digits, the rest); letters need no rule.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
LATIN_PARTS = rf"('s|'t|'re|'ve|'m|'ll|'d|[{LATIN_NUMBERS}]|[^ {LATIN_LETTERS}{LATIN_NUMBERS}]+)"
#: Stretches that go to the tokenizer one by one: long ones, those beyond Latin-1 or with its control characters and spaces.
LONGEST_PLAIN = 400
NOT_PLAIN = r"[^\x{21}-\x{7e}\x{a1}-\x{ff}]"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Merges:
    """The vocabulary's merges over symbols: ranks of symbol strings, and the vocabulary's id of each rank."""

    ranks: dict[bytes, int]
    ids: np.ndarray


@lru_cache(maxsize=1)
def plain_merges(path: str) -> Merges:
    """Merges of plain pre-tokens, by the bytes they make instead of by pair.

    Both give the same ids once tokens are left out that their own bytes do not merge to: while nothing reaches over
    a stretch's ends, its pairs merge as if it stood alone, so no text can make such a token.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    letter = byte_letters()
    inner, last = symbols()
    made = {letter[b]: bytes([inner[b]]) for b in range(256) if inner[b]} | {letter[b] + "</w>": bytes([last[b]]) for b in range(256) if last[b]}
    ranks, pairs = {}, {}
    ids = []
    for name, seq in made.items():
        ranks[seq] = len(ids)
        ids.append(vocabulary[name])
    for rank, (x, y) in enumerate(merges):
        if x in made and y in made:
            seq = made[x] + made[y]
            if seq in ranks:
                raise ValueError(f"two merges make {x + y}")
            pairs.setdefault((made[x], made[y]), rank)
            made[x + y] = seq
            # a token is kept if its own bytes merge to it
            parts = [seq[i : i + 1] for i in range(len(seq))]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: pairs.get((parts[i], parts[i + 1]), len(merges)))
                if (parts[best], parts[best + 1]) not in pairs:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 1:
                ranks[seq] = len(ids)
                ids.append(vocabulary[x + y])
    return Merges(ranks, np.array(ids, "<u4"))


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def symbols() -> tuple[np.ndarray, np.ndarray]:
    """Symbols of bytes within a pre-token and at its end, above the white space; 0 where there is none.

    Digits are pre-tokens of their own, capitals lower-cased, and of the bytes after C2 and C3 only those of lower-case
    letters and signs occur; so 222 symbols suffice.
    """
    inner, last = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    used = [b for b in range(0x21, 0x7F) if not chr(b).isupper()] + [0x97, *range(0x9F, 0xC0)]
    number = 33
    for b in [x for x in used if not 0x30 <= x <= 0x39] + [0xC2, 0xC3]:
        inner[b], number = number, number + 1
    for b in used:
        last[b], number = number, number + 1
    return inner, last


class CachedTokenizer:
    """Token ids as little-endian unsigned 32-bit bytes, stretch by stretch between white space, with a bounded cache.

    The vocabulary drops white space and never merges across it, so ids of the stretches concatenate to ids of the
    whole. Texts are cut and distinct stretches found in Arrow; those of Latin-1 are cut into pre-tokens by one
    regular expression, whose bytes become symbols and are merged. Texts that hold a special token's opening
    characters go to the tokenizer whole.
    """

    def __init__(self, path: str, cache_size: int = CACHE_SIZE, merges: Merges | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import tiktoken

        self.path, self.cache_size = path, cache_size
        merges = merges or plain_merges(path)
        self.rank_ids = merges.ids
        self.merge = tiktoken.Encoding("plain", pat_str=r"\S+", mergeable_ranks=merges.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.inner, self.last = symbols()
        self.words = pa.array([], pa.string())
        self.ids, self.starts, self.lengths, self.met, self.turn = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    @cached_property
    def tokenizer(self):
        """The vocabulary's own pipeline, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merged(self, plain: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of plain stretches."""
        cut = pc.replace_substring_regex(pc.utf8_lower(plain), LATIN_PARTS, r" \1 ")
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(cut)], cut), "\n")[0].as_py().encode() + b"\n"
        data = np.frombuffer(joined, np.uint8)
        full = (data != 32) & (data != 10)
        ends = np.flatnonzero(full[:-1] & ~full[1:])
        out = np.where(full, self.inner[data], np.uint8(32))
        out[ends] = self.last[data[ends]]
        ranks = list(map(self.merge, out.tobytes().split()))
        n = np.fromiter(map(len, ranks), np.int64, len(ranks))
        ids = self.rank_ids[np.fromiter(chain.from_iterable(ranks), np.int64, n.sum())]
        stretch = np.cumsum(data == 10)[ends]
        return ids, np.bincount(stretch, n, len(plain)).astype(np.int64)

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, lengths)."""
        odd = pc.or_(pc.match_substring_regex(words, NOT_PLAIN), pc.greater(pc.binary_length(words), LONGEST_PLAIN))
        where, lengths, at, ids = np.asarray(odd), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(0, "<u4")
        if len(plain := words.filter(pc.invert(odd))):
            ids, n = self.merged(plain)
            lengths[~where], at[~where] = n, np.cumsum(n) - n
        if rest := words.filter(odd).to_pylist():
            own = [np.asarray(e.ids, "<u4") for i in range(0, len(rest), 2048) for e in self.tokenizer.encode_batch_fast(rest[i : i + 2048], add_special_tokens=False)]
            n = np.array(list(map(len, own)))
            lengths[where], at[where] = n, np.cumsum(n) - n + len(ids)
            ids = np.concatenate([ids, *own])
        return ids[ranges(at, lengths)], lengths

    def remember(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        keep = np.arange(len(self.words))
        if len(self.words) > self.cache_size:
            # those of this turn stay in any case
            keep = np.sort(np.argsort(-self.met, kind="stable")[: max(self.cache_size // 2, (self.met == self.turn).sum())])
        kept = self.lengths[keep]
        self.ids = np.concatenate([self.ids[ranges(self.starts[keep], kept)], ids])
        self.words = pa.concat_arrays([self.words.take(pa.array(keep)), words])
        self.lengths = np.concatenate([kept, lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.met = np.concatenate([self.met[keep], np.full(len(words), self.turn)])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        whole = np.asarray(pc.match_substring(texts, "<|"))
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts))
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        known = pc.index_in(words, self.words)
        new = np.asarray(pc.is_null(known))
        if new.any():
            learnt = words.filter(pa.array(new))
            self.turn += 1
            self.met[known.drop_null().to_numpy()] = self.turn
            self.remember(learnt, *self.learn(learnt))
            known = pc.index_in(words, self.words)
        places = known.to_numpy()
        places = places[codes]
        lengths = self.lengths[places]
        ids = self.ids[ranges(self.starts[places], lengths)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.asarray(lists.offsets) - lists.offsets[0].as_py()] * 4
        out = [ids[a:b] for a, b in pairwise(ends.tolist())]
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.asarray(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


#: A worker's tokenizers by path and cache size, kept for its next task.
_TOKENIZERS: dict[tuple[str, int], CachedTokenizer] = {}


def worker_tokenizer(path: str, cache_size: int, merges: Merges) -> CachedTokenizer:
    if (path, cache_size) not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path, cache_size] = CachedTokenizer(path, cache_size, merges)
    return _TOKENIZERS[path, cache_size]


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Whole sequences first, then the binary digits of the rest from the highest."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(max_length.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary"


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, max_length: int = MAX_LENGTH, with_ids: bool = True, cache_size: int = CACHE_SIZE) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if asked for, ids.

    bucket is the binary logarithm of the sequence's length. sequence_id is unique in the result; its upper bits
    are the task, so it needs no global count.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    where = path or tokenizer_path(VOCABULARY)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = rows.schema["key"].dataType
    merges = df.sparkSession.sparkContext.broadcast(plain_merges(where))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        tokenizer = worker_tokenizer(where, cache_size, merges.value)
        for batch in batches:
            yield from pieces(batch, tokenizer.encode, max_length, with_ids)
        tidy()

    schema = f"key {key_type.simpleString()}, {PIECE_SCHEMA}"
    out = arrow_map(rows, run, schema).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *(["ids"] if with_ids else [])]
    return out.select(F.col("key").alias(key), *names)


def parts_of(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) of bounded size; one text that is larger is a run of its own."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def pieces(batch: pa.RecordBatch, encode: Callable[[pa.Array], list[bytes]], max_length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch's documents, sent on in parts of bounded size."""
    keys, texts, end = batch.column(0), batch.column(1), np.asarray([END_ID], "<u4").tobytes()
    for at, to in parts_of(texts):
        source, start, length, crc, total, bucket, ids = [], [], [], [], [], [], []
        for i, data in enumerate(encode(texts.slice(at, to - at)), at):
            data += end
            n_all, pos = len(data) // 4, 0
            for n in piece_lengths(n_all, max_length):
                part = data[4 * pos : 4 * (pos + n)]
                source.append(i)
                start.append(pos)
                length.append(n)
                crc.append(zlib.crc32(part))
                total.append(n_all)
                bucket.append(n.bit_length() - 1)
                if with_ids:
                    ids.append(part)
                pos += n
        packed = pa.array(ids, pa.binary()) if with_ids else pa.nulls(len(source), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(source, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(bucket, pa.int32()), packed],
            names=["key", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"],
        )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet in a folder for each length, as a trainer with a length curriculum reads them."""
    packed.write.partitionBy("bucket").parquet(path)


def op2_power_of_two_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, with_ids=False)
