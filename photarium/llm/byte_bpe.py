"""Byte-level BPE encoding and decoding with numpy matrices.

A rank file fixes the vocabulary. A text is cut by the pattern; each distinct piece is encoded once a task: pieces of similar length
form a padded matrix, in which every row merges its leftmost pair of minimum rank each round. Pair ranks come from a hash table; rows
without a pair left leave the matrix. Texts then are sequences of known pieces, and their ids one gather.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.llm.common import small_batches, tidied
from photarium.llm.known import Known

#: Rank of no pair.
NONE = np.int32(2**31 - 1)
#: Bytes of a piece above which it has a matrix of its own, of one row.
LONG_PIECE = 512
#: Distinct chunks remembered in a task and between tasks, and characters handled at once.
CHUNKS, CHUNKS_IDLE = 1 << 18, 1 << 15
BATCH_CHARS = 1 << 20

#: Where white space follows white space it belongs together, and the text is not cut there.
_BLANKS = re.compile(r"\s\s")
#: Marks a text's first chunk, which no blank precedes.
START = "\ue000"


def _chunks(text: str) -> list[str] | None:
    """A text cut before each blank and line feed, across which no piece reaches. A blank that a chunk begins with is left out, and a
    text's first chunk is marked by START. None for texts that can't be cut so: with runs of white space, or the mark in them."""
    if _BLANKS.search(text) or START in text:
        return None
    first, *rest = text.replace("\n", " \n").split(" ")
    return [START + first, *rest]


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            won = free & first
            self.keys[at[won]], self.values[at[won]] = key[todo[won]], merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair is unknown or an id is negative (padding)."""
        key = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        out[(left.ravel() < 0) | (right.ravel() < 0)] = NONE
        return out.reshape(left.shape)


class Codec:
    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        #: Bytes of each id.
        self.length = np.array([len(self.bytes_of.get(k, b"")) for k in range(max(self.bytes_of, default=-1) + 1)], np.int64)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        #: Whether every merge has a higher rank than both its parts.
        self.rising = all(r > max(a, b) for a, b, r in pairs)
        self.table = PairTable(*(np.array(x, np.int32) for x in zip(*pairs))) if pairs else PairTable(*[np.zeros(0, np.int32)] * 3)
        self.chunks, self.pieces = Known(CHUNKS), Known(CHUNKS)

    # pieces

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONG_PIECE:
                out[i] = self._long(piece)
            elif piece:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(i)
            else:
                out[i] = np.zeros(0, np.int32)
        for width, own in by_width.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < size[:, None], self.single[raw], np.int32(-1))
        done, row = [None] * len(pieces), np.arange(len(pieces))
        ranks = self.table.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(ids), 0), NONE)
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            over = least == NONE
            for k in np.flatnonzero(over):
                done[row[k]] = ids[k, : size[k]].copy()
            if over.any():
                keep = ~over
                row, ids, ranks, size, at, least = row[keep], ids[keep], ranks[keep], size[keep], at[keep], least[keep]
                if not len(row):
                    break
            every = np.arange(len(row))
            columns = np.arange(ids.shape[1] - 1)
            ids[every, at] = least
            # close the gap behind the merge: one column fewer for all
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            size = size - 1
            if ids.shape[1] > 1:
                columns = columns[:-1]
                ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
                last = ids.shape[1] - 2
                before, here = np.maximum(at - 1, 0), np.minimum(at, last)
                ranks[every, before] = np.where(at > 0, self.table.find(ids[every, before], ids[every, before + 1]), ranks[every, before])
                ranks[every, here] = np.where(at <= last, self.table.find(ids[every, here], ids[every, here + 1]), ranks[every, here])
            else:
                ranks = np.full((len(row), 0), NONE)
        return done

    def _long(self, piece: bytes) -> np.ndarray:
        """The matrix's rounds for one row as wide as the piece. A round takes all pairs of minimum rank at once, the leftmost of those that
        overlap: a merge makes pairs of higher ranks only, so the others would come next in any case. Rounds are as many as ranks met."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.table.find(ids[:-1], ids[1:])
        while len(ranks):
            least = ranks.min()
            if least == NONE:
                break
            at = np.flatnonzero(ranks == least)
            # of pairs in a row every other one, from the left; all but the first where merges may make lower ranks
            head = np.diff(at, prepend=-2) > 1
            first = at[head][np.cumsum(head) - 1]
            at = at[(at - first) % 2 == 0] if self.rising else at[:1]
            ids[at] = least
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            near = np.zeros(len(ids), bool)  # places whose pair is new
            near[at] = True
            near[np.maximum(at - 1, 0)] = True
            ids, near, old = ids[stays], near[stays], np.append(ranks, NONE)[stays][:-1]
            # a gap before a new pair: the place before the merged one may itself have been merged away
            near[:-1] |= near[1:]
            ranks = old
            new = np.flatnonzero(near[:-1])
            ranks[new] = self.table.find(ids[new], ids[new + 1])
        return ids.astype(np.int32)

    # texts

    def _learn(self, chunks: list[str], pieces: set[str]) -> None:
        """Take in new chunks, and pieces of texts that aren't cut into chunks."""
        cut = [self.pattern.findall(c[1:] if c[:1] == START else c if c[:1] == "\n" else " " + c) for c in chunks]
        new = list(pieces.union(*cut) - self.pieces.at.keys())
        if new:
            each = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])
            self.pieces.add(new, np.array([len(x) for x in each], np.int64), np.concatenate(each))
        if chunks:
            place = np.fromiter((self.pieces.at[x] for own in cut for x in own), np.int64)
            np.add.at(self.pieces.met, place, 1)
            flat, size = self.pieces.ids(place)
            owner = np.repeat(np.arange(len(cut)), [len(own) for own in cut])
            self.chunks.add(chunks, np.bincount(owner, size, len(cut)).astype(np.int64), flat)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is encoded like the empty text."""
        out: list = []
        at, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars >= BATCH_CHARS or i + 1 == len(texts):
                out += self._encode(texts[at : i + 1])
                at, chars = i + 1, 0
        return out

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        self.chunks.trim()
        self.pieces.trim()
        cut = [_chunks(t) if t else None for t in texts]
        odd = {i: self.pattern.findall(t) for i, t in enumerate(texts) if t and cut[i] is None}
        places = [self.chunks.places(c) if c else None for c in cut]
        new = {c[k] for c, p in zip(cut, places) if c for k in np.flatnonzero(p < 0)}
        self._learn(list(new), set().union(*odd.values()))
        out = []
        for i, own in enumerate(cut):
            if i in odd:
                out.append(self.pieces.ids(np.fromiter((self.pieces.at[p] for p in odd[i]), np.int64, len(odd[i])))[0])
            elif own:
                out.append(self.chunks.ids(self.chunks.meet(own, places[i]))[0])
            else:
                out.append(np.zeros(0, np.int32))
        return out

    def each(self, batches: Iterator[pd.Series], result) -> Iterator:
        """result(texts, their ids) of every batch of a task."""

        def results():
            for texts in batches:
                own = texts.tolist()
                yield result(own, self.encode(own))
            for memory in (self.chunks, self.pieces):
                memory.trim(CHUNKS_IDLE)

        return tidied(results())

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One a Python worker."""
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_of(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Array of ids; null and empty texts have none."""
    path, pattern = (path, pattern) if path else default_vocabulary()

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return codec(path, pattern).each(batches, lambda texts, ids: pd.Series(ids, dtype=object))

    return of(text)


def decode_of(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes that the ids stand for; null ids give null."""
    path, pattern = (path, pattern) if path else default_vocabulary()

    @F.pandas_udf("binary")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codec(path, pattern).decode(x) for x in rows], dtype=object)

    return of(ids)


def checked_of(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """struct(ids, round_trip): the ids, and whether they decode to the text's bytes (those of a null text: none)."""
    path, pattern = (path, pattern) if path else default_vocabulary()

    @F.pandas_udf("ids array<int>, round_trip boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)

        def checked(texts: list[str | None], ids: list[np.ndarray]) -> pd.DataFrame:
            return pd.DataFrame({"ids": ids, "round_trip": [own.decode(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]})

        return own.each(batches, checked)

    return of(text)


def digest_of(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Encode, decode the ids, and hash both: ids as little-endian unsigned 32-bit integers, and the decoded bytes."""
    path, pattern = (path, pattern) if path else default_vocabulary()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)

        def digests(texts: list[str | None], every: list[np.ndarray]) -> pd.DataFrame:
            rows = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()) for ids in every]
            return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        return own.each(batches, digests)

    return of(text)


def encoding_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row.

    Null and empty texts have no ids; a text's own special-token strings are ordinary text; pieces of any length are encoded whole; rows
    are independent, so repeated rows repeat and an empty table gives none; other columns are not read.
    """
    own = small_batches(docs).select("doc_id", digest_of(F.col("text"), path, pattern).alias("d"))
    return own.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
