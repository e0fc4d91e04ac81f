"""Operator 1: token-id shards with a minimal perfect hash index.

A shard file holds, one after the other:

    8 bytes   magic
    payload   token ids, raw little-endian unsigned integers of 2 or 4 bytes
    order     of each document in file order: key (int64), valid (uint8), tokens (uint64)
    index     a minimal perfect hash over the distinct keys: the bit arrays of its levels, then
              per slot a fingerprint (uint32), the payload offset in ids (uint64), the length (uint64)
    trailer   JSON with the places of the sections, its length (uint32), magic again

`ShardReader.get(key)` is constant time: a few hash probes, one fingerprint check, one range read.

Defined results: a null text is an empty document (its end id alone); a null key is stored and scanned,
but not indexed; of rows that repeat a key each is stored, the index leads to the first; an empty table
gives no document. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import Memory, blocks, filesystem, scratch, shuffle_partitions

MAGIC = b"ANSHARD1"
#: Words that a worker remembers at most per generation.
REMEMBERED = 400_000
#: Ids that a shard holds before the next one begins.
SHARD_IDS = 1 << 27
#: Marks that end a word.
ENDS = ".,!?;:"
#: Letters of old alphabets that are one letter in any case and normal form: what follows can't change them.
LETTERS = frozenset(c for c in map(chr, range(0x530)) if c.isalpha() and all(len(x) == 1 and x.isalpha() for x in (unicodedata.normalize("NFC", c), unicodedata.normalize("NFC", c.lower()))))
#: Marks that close a word after a letter, and words of letters that the library and Python lower alike wherever they stand and leave alone otherwise.
CLOSED = re.compile(f"[{re.escape(ENDS)}](?<=[{''.join(sorted(LETTERS))}].)[{re.escape(ENDS)}]*(?![^ ])")
PLAIN = re.compile(f"[{''.join(sorted(c for c in LETTERS if c not in 'Σςσ' and unicodedata.normalize('NFC', c) == c and c.lower() in LETTERS))}]+")
#: A tokenizer for which plain words may go to its merges at once.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key belongs to the first level where it alone takes its bit; its slot is the rank of that bit."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, at = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(at + np.cumsum(ones) - ones)
            at += int(ones.sum())
        self.ranked = at
        self.size = at + len(rest)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, most: int = 40) -> PerfectHash:
        levels: list[np.ndarray] = []
        rest = keys.astype(np.uint64)
        while len(rest) and len(levels) < most:
            m = max(64, int(gamma * len(rest)) + 63 & ~63)
            at = mixed(rest, len(levels)) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[at.astype(np.int64)]]
        return cls(levels, np.sort(rest))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot or -1 for a key that was not built in."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = mixed(keys[todo], level) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            out[todo[hit]] = ranks[w] + np.bitwise_count(bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            todo = todo[~hit]
            if not len(todo):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            out[todo] = np.where(self.rest[at] == keys[todo], self.ranked + at, -1)
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1009) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    """Streams documents into one shard; only lengths and keys stay in memory."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.out.write(MAGIC)
        self.width, self.keys, self.valid, self.lengths = width, [], [], []

    def add(self, key: int | None, payload: list[bytes]) -> int:
        for part in payload:
            self.out.write(part)
        self.keys.append(0 if key is None else key)
        self.valid.append(key is not None)
        self.lengths.append(sum(map(len, payload)) // self.width)
        return self.lengths[-1]

    def close(self) -> int:
        keys, valid = np.array(self.keys, np.int64), np.array(self.valid, np.uint8)
        lengths = np.array(self.lengths, np.uint64)
        starts = np.cumsum(lengths) - lengths
        at = np.flatnonzero(valid)
        own, first = np.unique(keys[at], return_index=True)
        first = at[first]
        mph = PerfectHash.build(own.view(np.uint64))
        slot = mph.slots(own.view(np.uint64))
        table = [np.empty(len(own), kind) for kind in (np.uint32, np.uint64, np.uint64)]
        for column, values in zip(table, (fingerprints(own.view(np.uint64)), starts[first], lengths[first]), strict=True):
            column[slot] = values
        place = len(MAGIC) + int(lengths.sum()) * self.width
        says: dict = {"width": self.width, "docs": len(keys), "tokens": int(lengths.sum()), "levels": [len(x) for x in mph.levels], "rest": len(mph.rest), "keys": len(own), "order": place}
        for part in (keys, valid, lengths, *mph.levels, mph.rest, *table):
            self.out.write(part.tobytes())
        said = json.dumps(says).encode()
        self.out.write(said + struct.pack("<I", len(said)) + MAGIC)
        self.out.close()
        return says["tokens"]


class ShardReader:
    """Keyed and sequential access to a shard."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n = struct.unpack("<I", self.file.read_at(12, size - 12)[:4])[0]
        tail = self.file.read_at(len(MAGIC), size - len(MAGIC))
        if tail != MAGIC:
            raise ValueError(f"{uri} is no complete shard")
        x = self.says = json.loads(self.file.read_at(n, size - 12 - n))
        rest = memoryview(self.file.read_at(size - 12 - n - x["order"], x["order"]))
        at = 0

        def take(kind, count):
            nonlocal at
            part = np.frombuffer(rest, kind, count, at)
            at += part.nbytes
            return part

        self.keys, self.valid, self.lengths = take("<i8", x["docs"]), take("u1", x["docs"]), take("<u8", x["docs"])
        levels = [take("<u8", m) for m in x["levels"]]
        self.mph = PerfectHash(levels, take("<u8", x["rest"]))
        self.prints, self.offsets, self.sizes = take("<u4", x["keys"]), take("<u8", x["keys"]), take("<u8", x["keys"])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of keys; a key that isn't there fails the fingerprint (but for one in 2**32)."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot = self.mph.slots(keys)
        safe = np.maximum(slot, 0)
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        found = (slot >= 0) & (self.prints[safe] == fingerprints(keys))
        return found, self.offsets[safe], self.sizes[safe]

    def ids(self, offset: int, length: int) -> np.ndarray:
        w = self.says["width"]
        return np.frombuffer(self.file.read_at(int(length) * w, len(MAGIC) + int(offset) * w), f"<u{w}")

    def get(self, key: int) -> np.ndarray | None:
        found, offset, length = self.locate(np.array([key]))
        return self.ids(offset[0], length[0]) if found[0] else None

    def scan(self, step: int = 1 << 21) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, offset, ids) in file order, each distinct key looked up through the index; the payload is read in ranges of `step` ids or one document."""
        found, offset, length = self.locate(self.keys)
        starts, lengths = self.starts.astype(np.int64), self.lengths.astype(np.int64)
        base, held = 0, np.empty(0, np.uint8)
        for i, (key, valid) in enumerate(zip(self.keys.tolist(), self.valid.tolist(), strict=True)):
            if valid and not (found[i] and (offset[i] < self.starts[i] or (offset[i] == self.starts[i] and length[i] == self.lengths[i]))):
                raise ValueError(f"the index has no entry for key {key}")
            at, n = int(starts[i]), int(lengths[i])
            if at + n > base + len(held):
                base, held = at, self.ids(at, min(max(step, n), self.says["tokens"] - at))
            yield (key if valid else None), at, held[at - base : at - base + n]


class WordEncoder:
    """A tokenizer whose result is the sum over the words between blanks, as raw ids; remembers words."""

    known: dict[str, WordEncoder] = Memory.read("shards")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.sign = os.path.commonprefix(self.added)
        self.cache = Memory(REMEMBERED, "shards")
        self.bare, self.last = self.plainly(path)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    @staticmethod
    def plainly(path: str):
        """(the same merges over lower-case letters between blanks, whether an id ends a word), or twice None for a tokenizer that is built otherwise."""
        from tokenizers import Tokenizer

        from anamnesis.llm.bpe import byte_letters

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, signs = said["model"], set(byte_letters())
        end = model.get("end_of_word_suffix")
        whole = end and all(c in model["vocab"] and c + end in model["vocab"] for c in signs)
        if not whole or model.get("dropout") or model.get("continuing_subword_prefix") or said["normalizer"] != NORMAL or said["pre_tokenizer"] != SPLIT or said["post_processor"]:
            return None, None
        said |= {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None}
        said["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, SPLIT["pretokenizers"][1]]}
        last = np.zeros(max(model["vocab"].values()) + 1, bool)
        last[[i for t, i in model["vocab"].items() if t.endswith(end)]] = True
        return Tokenizer.from_str(json.dumps(said)), last

    def raw(self, ids: list[int]) -> bytes:
        out = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def within(self, text: str) -> bool:
        """Whether an added token may show up in a text in lower case."""
        return self.sign in text and any(x in text for x in self.added)

    def look(self, new: list[str]) -> list[bytes]:
        """Raw ids of words, from the tokenizer as it is."""
        return [self.raw(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def look_plain(self, new: list[str]) -> list[bytes]:
        """Raw ids of words of plain letters in lower case: all at once, cut where a word ends."""
        if self.bare is None or not new:
            return self.look(new)
        [e] = self.bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)
        ids = np.array(e.ids, f"<u{self.width}")
        cuts = ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()
        if len(cuts) != len(new):
            raise ValueError("the tokenizer gave other words than it was asked for")
        out = ids.tobytes()
        return [out[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def learn(self, words: list[str]) -> None:
        """Plain letters go to the merges without case. Other ASCII words go to the tokenizer without case, where it makes no difference; words in
        which an added token shows up either way are left as they are: added tokens are found in the text as it stands."""
        plain, low, others, asked = [], [], [], []
        for word in words:
            small = word.lower()
            if self.within(small):
                others.append(word)
                asked.append(word)
            elif PLAIN.fullmatch(word):
                plain.append(word)
                low.append(small)
            else:
                others.append(word)
                asked.append(small if word.isascii() else word)
        self.cache.young.update(zip(plain, self.look_plain(low), strict=True))
        self.cache.young.update(zip(others, self.look(asked), strict=True))

    def words(self, block: str) -> list[str]:
        """The words of a block, with the marks that close one after a letter as words of their own, without case where it makes no difference."""
        small = block.lower()
        if self.within(small):
            return block.split(" ")
        return CLOSED.sub(r" \g<0>", small if block.isascii() else block).split(" ")

    def encode(self, text: str) -> list[bytes]:
        out = []
        for block in blocks(text.replace("\n", " ")):
            words = self.words(block)
            if new := self.cache.missing(set(words)):
                self.learn(new)
            out.append(b"".join(map(self.cache.young.__getitem__, words)))
        return out


def write_shards(docs: DataFrame, at: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", shards: int | None = None, most: int = SHARD_IDS) -> DataFrame:
    """Encodes docs into shard files below `at`, in ascending key order over the shards; one row per shard: (task, shard, path, docs, tokens).

    A task begins a new shard once one holds `most` ids, so neither a file nor its index grows with the table. Each task attempt writes a file of its own; only those that the returned rows name belong to the result, so a repeated task leaves at worst a file that nobody reads."""

    def write(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from pyspark import TaskContext

        Memory.only("shards")
        task = TaskContext.get()
        encoder = WordEncoder.of(tokenizer)
        end = encoder.raw([end_id])
        writer, no, n, held = None, 0, 0, 0

        def told():
            tokens = writer.close()
            return pa.RecordBatch.from_pylist([{"task": task.partitionId(), "shard": no, "path": uri, "docs": n, "tokens": tokens}])

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    uri = f"{at}/shard-{task.partitionId():06d}-{no:04d}-{task.taskAttemptId()}.bin"
                    writer, n, held = ShardWriter(uri, encoder.width), 0, 0
                held += writer.add(k, [*encoder.encode(x.as_py() or ""), end])
                n += 1
                if held >= most:
                    yield told()
                    writer, no = None, no + 1
        if writer:
            yield told()

    n = shards or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("x")).repartitionByRange(n, "k").sortWithinPartitions("k")
    return rows.mapInArrow(write, "task long, shard long, path string, docs long, tokens long")


def read_shards(spark: SparkSession, shards: list[tuple[str, int]]) -> DataFrame:
    """Per document of the shard files, given as (path, ids before it): doc_id, start, n_tokens, ids_crc32."""

    def read(frames):
        import pandas as pd

        for frame in frames:
            for path, base in zip(frame.path, frame.base, strict=True):
                rows = [(k, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, at, ids in ShardReader(path).scan()]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    files = spark.createDataFrame(shards, "path string, base long").repartition(max(1, len(shards)))
    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, at: str | None = None) -> DataFrame:
    """Writes docs as shards and reads every document back through the index."""
    spark = docs.sparkSession
    done = sorted(write_shards(docs, at or scratch(spark, "token-shards"), tokenizer, end_id).collect())  # a row per shard
    base, shards = 0, []
    for _, _, path, _, tokens in done:
        shards.append((path, base))
        base += tokens
    return read_shards(spark, shards)
