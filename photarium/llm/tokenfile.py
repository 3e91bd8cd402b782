"""Token ids in a file format of their own: static range asymmetric numeral systems (rANS) in independent interleaved blocks.

A token file is a folder that Spark writes and reads, so any store that Spark reaches will do. Its records are segments in ascending
order of doc_id: `shard` (range of ids), `seq` (place within the shard), `n_ids`, `n_docs` and `content`. The content of a segment is

    magic, version, bits, lanes, n_docs, n_ids, n_blocks, size and crc32 of the rest | documents | table | directory | blocks

documents: ids and lengths. table: frequencies of the segment's symbols, which add to 2 ** bits, shared by its blocks. directory: for each
block its number of ids, the place of its words and the crc32 of its ids. block: a checkpoint every CHECKPOINT steps, which holds the
lanes' states and the place in the words from which decoding can start, then the words. Lane k of a block carries its ids k, k + lanes, ...
Blocks decode independently of each other, and from any checkpoint on.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photarium.llm.common import scratch, small_batches
from photarium.llm.known import Known

END = 2
#: Ids in a segment, after which the next document starts another; ids in a block; lanes at most; steps between checkpoints.
SEGMENT_IDS = 1 << 22
BLOCK_IDS = 1 << 20
LANES = 2048
CHECKPOINT = 256
MAGIC = b"PTOK"
HEADER = struct.Struct("<4sHBxIQQIQI")
LOW = np.uint64(1 << 31)
SCHEMA = "shard int, seq int, n_docs long, n_ids long, content binary"
#: Words remembered in a task, and twice as many pieces; characters encoded at once.
CHUNKS = 1 << 19
BATCH_CHARS = 1 << 22


class CorruptTokens(ValueError):
    """A checksum or a size doesn't fit."""


# entropy coding


def frequencies(ids: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, their frequencies, bits): frequencies are at least 1 and add to 2 ** bits."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    bits = bits or max(12, int(np.ceil(np.log2(max(2, len(symbols))))) + 3)
    total, exact = 1 << bits, counts[symbols] * ((1 << bits) / max(1, len(ids)))
    freq = np.maximum(1, np.floor(exact)).astype(np.int64)
    if not len(ids):
        return symbols, freq, bits
    spare = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if spare > 0:
        freq[order[0]] += spare
    while spare < 0:  # the rare ones were raised to 1; the frequent ones give way, none below 1
        take = np.minimum(freq[order] - 1, -(-freq[order] * -spare // max(1, int(freq.sum()))))
        take = np.minimum(take, np.maximum(0, -spare - (np.cumsum(take) - take)))
        freq[order] -= take
        spare += int(take.sum())
    return symbols, freq, bits


def encode_block(place: np.ndarray, freq: np.ndarray, cum: np.ndarray, bits: int, lanes: int) -> tuple[bytes, int]:
    """place: positions in the table. Returns the block and its number of checkpoints."""
    steps = -(-len(place) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written, shift = 0, np.uint64(bits)
    f_all, c_all = freq[place].astype(np.uint64), cum[place].astype(np.uint64)
    for step in range(steps - 1, -1, -1):
        f, c = f_all[step * lanes : (step + 1) * lanes], c_all[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << np.uint64(63 - bits))
        if full.any():
            out = x[full]
            words.append((out & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            written += len(out)
            x[full] = out >> np.uint64(32)
        q = x // f
        state[: len(f)] = (q << shift) + (x - q * f) + c
        if step % CHECKPOINT == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = b"".join(struct.pack("<Q", written - at) + s.astype("<u8").tobytes() for at, s in reversed(marks))
    return head + stream.astype("<u4").tobytes(), len(marks)


def decode_block(block: bytes, n: int, symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray, bits: int, lanes: int, mark: int = 0, until: int | None = None) -> np.ndarray:
    """Ids from checkpoint `mark` on, up to checkpoint `until` if given."""
    steps = -(-n // lanes)
    marks = -(-steps // CHECKPOINT)
    size = 8 + 8 * lanes
    at = struct.unpack_from("<Q", block, mark * size)[0]
    state = np.frombuffer(block, "<u8", lanes, mark * size + 8).astype(np.uint64)
    words = np.frombuffer(block, "<u4", offset=marks * size)
    last = steps if until is None else min(steps, until * CHECKPOINT)
    out = np.empty(min(n, last * lanes) - mark * CHECKPOINT * lanes, np.int64)
    mask, shift, done = np.uint64((1 << bits) - 1), np.uint64(bits), 0
    freq, cum = freq.astype(np.uint64), cum.astype(np.uint64)
    for step in range(mark * CHECKPOINT, last):
        x = state[: min(lanes, n - step * lanes)]
        slot = x & mask
        place = slots[slot.astype(np.int64)]
        out[done : done + len(x)] = place
        done += len(x)
        x[:] = freq[place] * (x >> shift) + slot - cum[place]
        low = np.flatnonzero(x < LOW)
        if len(low):
            if at + len(low) > len(words):
                raise CorruptTokens("a block ends early")
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
    return symbols[out]


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A segment's content."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    known = np.array([x is not None for x in doc_ids], bool)
    docs = zlib.compress(
        np.packbits(known).tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([len(x) for x in ids], "<u8").tobytes(), 1
    )
    symbols, freq, bits = frequencies(every)
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    cum = np.cumsum(freq) - freq
    rank = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
    rank[symbols] = np.arange(len(symbols))
    lanes = int(min(LANES, max(1, len(every) // 64)))
    blocks, directory, at = [], [], 0
    for k in range(0, len(every), BLOCK_IDS):
        part = every[k : k + BLOCK_IDS]
        block, marks = encode_block(rank[part], freq, cum, bits, lanes)
        directory.append(struct.pack("<IQII", len(part), at, marks, zlib.crc32(part.astype("<u4").tobytes())))
        blocks.append(block)
        at += len(block)
    body = b"".join([struct.pack("<II", len(docs), len(table)), docs, table, *directory, *blocks])
    return HEADER.pack(MAGIC, 1, bits, lanes, len(doc_ids), len(every), len(blocks), len(body), zlib.crc32(body)) + body


def unpack(content: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Documents and their ids. Raises CorruptTokens unless all sizes and checksums fit."""
    if len(content) < HEADER.size:
        raise CorruptTokens("a segment is shorter than its header")
    magic, version, bits, lanes, n_docs, n_ids, n_blocks, size, crc = HEADER.unpack_from(content)
    body = memoryview(content)[HEADER.size :]
    if magic != MAGIC or version != 1 or len(body) != size or zlib.crc32(body) != crc:
        raise CorruptTokens("a segment's header, size or checksum doesn't fit")
    docs_size, table_size = struct.unpack_from("<II", body)
    raw = zlib.decompress(body[8 : 8 + docs_size])
    flags = -(-n_docs // 8)
    known = np.unpackbits(np.frombuffer(raw, np.uint8, flags), count=n_docs).astype(bool)
    names = np.frombuffer(raw, "<i8", n_docs, flags)
    sizes = np.frombuffer(raw, "<u8", n_docs, flags + 8 * n_docs).astype(np.int64)
    pair = np.frombuffer(zlib.decompress(body[8 + docs_size : 8 + docs_size + table_size]), "<u4").astype(np.int64)
    symbols, freq = pair[: len(pair) // 2], pair[len(pair) // 2 :]
    cum = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(len(freq)), freq)
    entry = struct.Struct("<IQII")
    base = 8 + docs_size + table_size
    blocks = base + n_blocks * entry.size
    entries = [entry.unpack_from(body, base + k * entry.size) for k in range(n_blocks)]
    parts = []
    for k, (n, at, _, crc) in enumerate(entries):
        end = entries[k + 1][1] if k + 1 < n_blocks else len(body) - blocks
        part = decode_block(body[blocks + at : blocks + end], n, symbols, freq, cum, slots, bits, lanes)
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise CorruptTokens("a block's checksum doesn't fit")
        parts.append(part)
    every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(every) != n_ids or sizes.sum() != n_ids:
        raise CorruptTokens("a segment's ids don't add up")
    ends = np.cumsum(sizes)
    return [int(x) if k else None for x, k in zip(names, known)], [every[e - s : e] for s, e in zip(sizes, ends)]


# tokens


class WordTokens:
    """Ids of whole texts by a tokenizers file whose pieces never cross white space.

    Words are looked up as they stand between white space; new ones are cut into the tokenizer's pieces, and the library encodes all new
    pieces of a batch as one text. Each ends with a token that marks an end, which tells them apart again.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes out of a text as tokens of their own; texts that hold one go to it whole.
        self.marks = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.pieces = Known(CHUNKS), Known(2 * CHUNKS)

    def _pieces(self, new: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(new):  # a piece the pattern and the library cut differently: one by one
            each = [np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.pieces.add(new, np.array([len(x) for x in each], np.int64), np.concatenate(each))
        else:
            self.pieces.add(new, np.diff(ends, prepend=-1), ids)

    def _learn(self, new: list[bytes]) -> None:
        """New words that Latin-1 can write are cut here, their lower case being the library's; others are encoded by it as they are."""
        plain, odd = new, []
        try:
            text = b"\n".join(new).decode()
            text.encode("latin-1")
        except UnicodeEncodeError:
            odd = [w for w in new if _beyond(w.decode())]
            plain = list(set(new).difference(odd))
            text = b"\n".join(plain).decode()
        if plain:
            if "\n" not in self.pieces.at:
                self.pieces.add(["\n"], np.zeros(1, np.int64), np.zeros(0, np.int32))
            cut = _PIECE.findall(text.lower())
            place = self.pieces.places(cut)
            fresh = list({cut[k] for k in np.flatnonzero(place < 0)})
            if fresh:
                self._pieces(fresh)
            place = self.pieces.meet(cut, place)
            flat, size = self.pieces.ids(place)
            owner = np.cumsum(place == self.pieces.at["\n"])
            self.words.add(plain, np.bincount(owner, size, len(plain)).astype(np.int64), flat)
        if odd:
            each = [np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)]
            self.words.add(odd, np.array([len(x) for x in each], np.int64), np.concatenate(each))

    def encode(self, texts: list[str | None], end: int = END) -> list[np.ndarray]:
        out: list = []
        at, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars >= BATCH_CHARS or i + 1 == len(texts):
                out += self._encode(texts[at : i + 1], end)
                at, chars = i + 1, 0
        return out

    def _encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        self.words.trim()
        self.pieces.trim()
        marked = {i for i, t in enumerate(texts) if t and any(m in t for m in self.marks)}
        distinct, which, until = _distinct([_cased(t) if t and i not in marked else b"" for i, t in enumerate(texts)])
        place = self.words.places(distinct)
        new = [distinct[k] for k in np.flatnonzero(place < 0).tolist()]
        if new:
            self._learn(new)
        place = self.words.meet(distinct, place, np.bincount(which, minlength=len(distinct)))
        flat, size = self.words.ids(place[which])
        parts = np.split(flat, np.append(0, np.cumsum(size))[until[:-1]])
        whole = lambda t: np.array(self.tokenizer.encode(_sent(t), add_special_tokens=False).ids, np.int32)
        return [np.append(whole(t) if i in marked else part, np.int32(end)) for i, (t, part) in enumerate(zip(texts, parts))]


#: The tokenizer's pieces, and the line feed that parts words here.
_PIECE = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _beyond(text: str) -> bool:
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return True


def _sent(text: str) -> str:
    """The text as UTF-8 can carry it."""
    return text.encode("utf-8", "replace").decode()


def _cased(text: str) -> bytes:
    """The text as bytes; A-Z in lower case where no character could combine with them."""
    try:
        text.encode("latin-1")
        return text.encode().lower()
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace")


def _distinct(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space, which of them all words are, and how many words there are up to each text's end.
    Where white space begins or ends a text there is an empty word."""
    words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    return distinct, coded.indices.to_numpy(), np.asarray(words.offsets)[1:].astype(np.int64)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One a Python worker."""
    return WordTokens(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# files


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Encode docs(doc_id, text) and write a token file in ascending order of doc_id, null first; equal ids follow each other by a hash of their texts, then by text."""
    vocabulary = vocabulary or default_vocabulary()

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, shard, seq = word_tokens(vocabulary), TaskContext.get().partitionId(), 0
        names: list = []
        ids: list[np.ndarray] = []
        total = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "seq": [seq], "n_docs": [len(names)], "n_ids": [total], "content": [pack(names, ids)]})

        for batch in batches:
            texts, own = batch["text"].tolist(), [None if pd.isna(x) else int(x) for x in batch["doc_id"].astype(object)]
            for name, x in zip(own, tokens.encode(texts, end)):
                names.append(name)
                ids.append(x)
                total += len(x)
                if total >= SEGMENT_IDS:
                    yield flush()
                    names, ids, total, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    # ranges by id and text's hash, so that one id, or none, may have many rows
    hashed = small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ordered = hashed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    # the id travels as text where it may be null, since pandas would turn it into a float
    ordered = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    ordered.mapInPandas(segments, SCHEMA).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str, per_document) -> DataFrame:
    """(doc_id, start, n_tokens, value) of each document in a token file: value is a long made from its ids by per_document."""
    records = spark.read.schema(SCHEMA).parquet(path)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, seq, content in zip(batch["shard"], batch["seq"], batch["content"]):
                names, ids = unpack(content)
                size = np.array([len(x) for x in ids], np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(names, dtype="Int64"), "shard": shard, "seq": seq, "inside": np.cumsum(size) - size, "n_tokens": size,
                        "value": [per_document(x) for x in ids],
                    }
                )

    # sizes of the segments alone, not their content: a few rows a shard, summed up first by shard and then within it
    sizes = records.select("shard", "seq", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("seq_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(before, "shard").select("shard", "seq", (F.col("shard_start") + F.col("seq_start")).alias("base"))
    found = records.select("shard", "seq", "content").mapInPandas(documents, "doc_id long, shard int, seq int, inside long, n_tokens long, value long")
    return found.join(starts, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "value")


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_file_digest(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Write docs to a token file (in the shared folder if no path is given), read it back: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts consist of the end id; strings of the vocabulary's added tokens become these tokens, as the library has it; rows
    without doc_id come first; equal ids stay next to each other, in order of their texts'
    hashes, so equal rows are interchangeable; an empty table gives an empty file and no rows; other columns are not read.
    """
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary)
    return read_documents(docs.sparkSession, path, crc_of).withColumnRenamed("value", "ids_crc32")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
