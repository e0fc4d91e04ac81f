"""Operator 7: byte-pair encoding as a streaming transducer with bounded lookahead, and an incremental decoder.

Every piece of a text goes through `Transducer`, which takes bytes and gives tokens once they are stable. The prefixes of a piece have one
encoding each, a prefix's last token follows on the encoding of a shorter prefix, and no token is longer than `lookahead`, the
length of the longest token of the merge list. So a token is stable once the encodings of the last `lookahead` prefixes all pass
through its end: none that follows can start before those. Stable tokens leave; what stays is a window whose size doesn't depend on the
text, with the last token before it. At the end of a piece the window's tokens are the one row that may all stand side by side. Words that came
before are looked up, which only saves work; long pieces never are. The windows of short pieces that are new in a group of texts are finished in
step, as arrays (`Steps`). Ids leave as they come, so memory doesn't grow with a text beyond the text itself.

Whether two tokens may stand side by side is read off the merge list: walking down the right edge of the first and
the left edge of the second, no merge across the boundary may come before the merges that build the edges.

Defined results: a null text is empty (no ids, empty text); ids, counts and digests are per row, so repeated rows
give repeated results; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import Memory, small_batches

#: Chunks, and pieces of other kinds, that a worker remembers at most per generation, pairs of tokens of which it is known whether they may stand side
#: by side, and characters above which a piece isn't remembered but fed in parts.
REMEMBERED, OTHERS, AGREED, LONG = 100_000, 20_000, 200_000, 256
#: Slots for pairs of tokens of pieces that are encoded in step, as a power of two, and a rank that no merge has.
PAIRS, NEVER = 18, 1 << 60
#: Ids that leave a worker at once.
IDS = 1 << 19
#: Characters of a block that is cut into chunks at once, and of a part of a long piece.
BLOCK, STEP = 1 << 18, 1 << 12
BLANKS, LONG_WORD = re.compile(r"\s "), re.compile(r"[^ ]{4096}")
#: Closing marks after a letter without an accent or of Latin-1, and what stands before them where they are chunks.
CLOSED, SIGN = re.compile(r"[.,!?;:](?<=[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF].)[.,!?;:]*(?![^ ])"), "\0"
#: Fixed: the split before the merges, white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary and its merge list: bytes of tokens, ranks of pairs, how each token is built."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.bytes = dict(zip(vocab.values(), vocab.keys(), strict=True))
        self.pair: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (x, y) in enumerate(merges):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            self.pair[a, b] = rank
            self.made.setdefault(c, (rank, a, b))
        single = {vocab[bytes([i])] for i in range(256)}
        self.ids = {t: i for t, i in vocab.items() if i in single or i in self.made}
        self.lookahead = max(map(len, self.ids))
        self.agreed: dict[tuple[int, int], bool] = {}
        self.tables()
        fine = self.reachable()
        self.ids = {t: i for t, i in self.ids.items() if i in single or fine[i]}
        #: Length of the longest token by its last three and by its first four bytes.
        self.longest: dict[bytes, int] = {}
        self.begun: dict[bytes, int] = {}
        for t in self.ids:
            self.longest[t[-3:]] = max(len(t), self.longest.get(t[-3:], 2))
            self.begun[t[:4]] = max(len(t), self.begun.get(t[:4], 3))

    def tables(self) -> None:
        """The merge list as arrays: sorted pairs with their ranks, and of each token its rank and two parts (-1: none)."""
        self.n = max(self.bytes) + 1
        pairs = np.array([a * self.n + b for a, b in self.pair], np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.int64(1) << 62)
        self.ranks = np.append(np.array(list(self.pair.values()), np.int64)[order], NEVER)
        self.rank, self.left, self.right = np.full(self.n, NEVER), np.full(self.n, -1), np.full(self.n, -1)
        if self.made:
            made = np.array(list(self.made))
            self.rank[made], self.left[made], self.right[made] = np.array(list(self.made.values())).T

    def first_merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`first_merge` of many pairs; NEVER where none crosses."""
        best = np.full(len(a), NEVER)
        at, x, x_until = np.arange(len(a)), a, np.full(len(a), NEVER)
        while len(at):
            i, u, u_until, y, y_until = at, x, x_until, b[at], np.full(len(at), NEVER)
            while len(i):
                code = u * self.n + y
                place = np.searchsorted(self.pairs, code)
                rank = np.where(self.pairs[place] == code, self.ranks[place], NEVER)
                best[i] = np.minimum(best[i], np.where((rank < u_until) & (rank <= y_until), rank, NEVER))
                y, y_until = self.left[y], self.rank[y]
                on = y >= 0
                i, u, u_until, y, y_until = i[on], u[on], u_until[on], y[on], y_until[on]
            x, x_until = self.right[x], self.rank[x]
            on = x >= 0
            at, x, x_until = at[on], x[on], x_until[on]
        return best

    def reachable(self) -> np.ndarray:
        """Whether a token's own bytes are encoded as this token: its two parts may not stand side by side."""
        made = np.flatnonzero(self.left >= 0)
        out = np.zeros(self.n, bool)
        out[made] = self.first_merges(self.left[made], self.right[made]) == self.rank[made]
        return out

    def edge(self, token: int, down: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that takes it up) down the left (1) or the right edge (2)."""
        made, at, side = self.made, token, [(token, 1 << 60)]
        while (how := made.get(at)) is not None:
            at = how[down]
            side.append((at, how[0]))
        return side

    def first_merge(self, a: int, b: int) -> int | None:
        """The rank of the first merge that crosses the boundary of a and b, if any does."""
        best = None
        left = self.edge(b, 1)
        for x, x_until in self.edge(a, 2):
            for y, y_until in left:
                rank = self.pair.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until and (best is None or rank < best):
                    best = rank
        return best

    def agree(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens."""
        if (a, b) not in self.agreed:
            if len(self.agreed) >= AGREED:
                self.agreed.clear()
            self.agreed[a, b] = self.first_merge(a, b) is None
        return self.agreed[a, b]


class Transducer:
    """Encodes a piece that arrives in parts; emits tokens once they are stable."""

    def __init__(self, merges: Merges):
        self.m, self.window = merges, 4 * merges.lookahead
        #: What is not stable yet, the last token before it (-1: none), and the bytes from which it is looked at again.
        self.open, self.before, self.until = b"", -1, self.window

    def feed(self, data: bytes) -> list[int]:
        """The tokens that have become stable."""
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.open += data[at : at + self.window]
            if len(self.open) > self.until:
                out += self.settle()
                self.until = len(self.open) + self.window
        return out

    def settle(self) -> list[int]:
        last, start = self.prefixes()
        ends = {i for i in range(max(0, len(self.open) - self.m.lookahead + 1), len(self.open) + 1) if start[i] >= 0}
        while len(ends) > 1:  # back from the farthest end, until all encodings have met
            ends.add(start[max(ends)])
            ends.remove(max(ends))
        at = upto = ends.pop()
        out = []
        while at > 0:
            out.append(last[at])
            at = start[at]
        self.open, self.before = self.open[upto:], out[0] if out else self.before
        return out[::-1]

    def prefixes(self) -> tuple[list[int], list[int]]:
        """The last token of the encoding of each prefix of the window, and where it starts (None, -1: the encoding of what is left of
        a prefix that the tokens before the window don't lead to; nothing goes on from there)."""
        data, ids, agree, longest = self.open, self.m.ids, self.m.agree, self.m.longest
        last, start = [self.before], [0]
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest.get(data[max(0, i - 3) : i], 2)), i):
                token = ids.get(data[j:i])
                if token is not None and (before := last[j]) is not None and (before < 0 or agree(before, token)):
                    last.append(token)
                    start.append(j)
                    break
            else:
                last.append(None)
                start.append(-1)
        return last, start

    def finish(self) -> list[int]:
        """The tokens of the window, as nothing follows: longest first. Where no token goes on is never tried again, as only one row of tokens leads there."""
        data, ids, agreed, agree, begun = self.open, self.m.ids, self.m.agreed, self.m.agree, self.m.begun
        n, at, out, starts, dead = len(data), 0, [], [], set()
        end = min(n, begun.get(data[:4], 3))
        while at < n:
            before = out[-1] if out else self.before
            while end > at:
                token = ids.get(data[at:end])
                if token is not None and end not in dead:
                    if before < 0:
                        break
                    fine = agreed.get((before, token))
                    if agree(before, token) if fine is None else fine:
                        break
                end -= 1
            if end > at:
                out.append(token)
                starts.append(at)
                at, end = end, min(n, end + begun.get(data[end : end + 4], 3))
            else:
                dead.add(at)
                out.pop()
                at, end = starts.pop(), at - 1
        self.open, self.before, self.until = b"", -1, self.window
        return out


class Steps:
    """`Transducer.finish` of many pieces in step: longest first, back where no token goes on. A piece is one row of tokens, so the ids are the same."""

    def __init__(self, merges: Merges):
        self.m = merges
        # A tree of all prefixes of tokens. Of a node: the longest token that it begins with. Children by a hashed table of (node, byte).
        nodes: dict[bytes, int] = {}
        for t in merges.ids:
            for i in range(1, len(t) + 1):
                nodes.setdefault(t[:i], len(nodes))
        self.token, self.shorter, self.size = np.full(len(nodes), -1, np.int64), np.full(merges.n, -1, np.int64), np.zeros(merges.n, np.int64)
        self.first, self.second = np.zeros(256, np.int64), np.full(1 << 16, -1, np.int64)
        codes, children = [], []
        for t, node in sorted(nodes.items(), key=lambda x: len(x[0])):
            own, above = merges.ids.get(t), int(self.token[nodes[t[:-1]]]) if len(t) > 1 else -1
            self.token[node] = above if own is None else own
            if own is not None:
                self.shorter[own], self.size[own] = above, len(t)
            if len(t) == 1:
                self.first[t[0]] = own
            elif len(t) == 2:
                self.second[t[0] << 8 | t[1]] = node
            else:
                codes.append(nodes[t[:-1]] << 8 | t[-1])
                children.append(node)
        self.bits = max(10, (4 * len(codes)).bit_length())
        self.codes, self.children = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, child = np.array(codes, np.int64), np.array(children, np.int32)
        slot = self.slot(left, self.bits)
        while len(left):
            free = self.codes[slot] < 0
            self.codes[slot[free]] = left[free]
            put = self.codes[slot] == left
            self.children[slot[put]] = child[put]
            left, child, slot = left[~put], child[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
        #: Pairs of which it is known whether they may stand side by side: one a slot, the latest stays.
        self.most = PAIRS
        self.pairs, self.agreed = np.full(1 << self.most, -1, np.int64), np.zeros(1 << self.most, bool)

    @staticmethod
    def slot(codes: np.ndarray, bits: int) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def child(self, codes: np.ndarray) -> np.ndarray:
        slot = self.slot(codes, self.bits)
        held = self.codes[slot]
        out = np.where(held == codes, self.children[slot], -1)
        todo = np.flatnonzero((held != codes) & (held >= 0))
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.codes[at]
            hit = held == codes[todo]
            out[todo[hit]] = self.children[at[hit]]
            todo = todo[~hit & (held >= 0)]
        return out

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token at each place before an end."""
        best = self.first[data[at]]
        i = np.flatnonzero(at + 1 < end)
        place = at[i]
        node = self.second[data[place] << 8 | data[place + 1]]
        place, end = place + 2, end[i]
        while True:
            on = node >= 0
            i, node, place, end = i[on], node[on], place[on], end[on]
            best[i] = self.token[node]
            on = place < end
            i, node, place, end = i[on], node[on], place[on], end[on]
            if not len(i):
                return best
            node, place = self.child(node << 8 | data[place]), place + 1

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        codes = a * self.m.n + b
        slot = self.slot(codes, self.most)
        out = self.agreed[slot]
        miss = np.flatnonzero(self.pairs[slot] != codes)
        if len(miss):
            new, which = np.unique(codes[miss], return_inverse=True)
            fine = self.m.first_merges(new // self.m.n, new % self.m.n) == NEVER
            out[miss] = fine[which]
            _, last = np.unique(self.slot(new, self.most), return_index=True)
            keep = self.slot(new[last], self.most)
            self.pairs[keep], self.agreed[keep] = new[last], fine[last]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as int32."""
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        #: Of each place: the token that begins there, where the one that ends there begins, and whether no token goes on.
        token, back, dead = np.full(len(data) + 1, -1, np.int64), np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, bool)
        start = np.append(0, ends[:-1])
        on = start < ends
        start, end = start[on], ends[on]
        at, before = start, np.full(len(start), -1)
        now = self.longest(data, at, end)
        while len(at):
            stop = at + self.size[now]
            fine = ~dead[stop]
            asked = np.flatnonzero(fine & (before >= 0))
            fine[asked] = self.agree(before[asked], now[asked])
            token[at[fine]], back[stop[fine]] = now[fine], at[fine]
            before, at = np.where(fine, now, before), np.where(fine, stop, at)
            now = np.where(fine, now, self.shorter[now])
            while len(none := np.flatnonzero(now < 0)):
                dead[at[none]] = True
                place = at[none] = back[at[none]]
                now[none] = self.shorter[token[place]]
                token[place] = -1
                before[none] = np.where(place > start[none], token[back[place]], -1)
            on = at < end
            start, end, at, before, now, fine = start[on], end[on], at[on], before[on], now[on], fine[on]
            now[fine] = self.longest(data, at[fine], end[fine])
        there = token >= 0
        out = token[there].astype(np.int32).tobytes()
        cuts = (4 * np.append(0, np.cumsum(there))[ends]).tolist()
        return [out[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class Codec:
    """Encodes and decodes texts block by block."""

    known: dict[str, Codec] = Memory.read("bpe")

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        vocab = {raw(t): i for t, i in said["model"]["vocab"].items() if t not in self.special}
        self.merges = Merges(vocab, [tuple(map(raw, p.split(" ") if isinstance(p, str) else p)) for p in said["model"]["merges"]])
        self.bytes = dict(self.merges.bytes) | {i: t.encode() for t, i in self.special.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.pattern = regex.compile(PATTERN)
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.transducer = Transducer(self.merges)
        self.letters = regex.compile(r"\p{L}+")
        #: Ids of a chunk as int32, and of a piece as a list.
        self.chunks, self.pieces = Memory(REMEMBERED, "bpe"), Memory(OTHERS, "bpe")
        #: Chunks of texts that come next.
        self.ready: dict[str, list[str]] = {}
        self.steps = Steps(self.merges)
        self.numbers = np.empty(self.merges.n, object)
        self.numbers[:] = range(self.merges.n)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        return self.transducer.feed(data) + self.transducer.finish()

    def pieces_of(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        """Ids of text[at:end], piece by piece; a long piece is fed in parts and never there as a whole."""
        out: list[int] = []
        for match in self.pattern.finditer(text, at, end):
            start, stop = match.span()
            if stop - start > LONG:
                yield out
                for i in range(start, stop, STEP):
                    yield self.transducer.feed(text[i : min(i + STEP, stop)].encode("utf-8", "surrogatepass"))
                out = self.transducer.finish()
                continue
            p = match.group()
            out += self.remembered(p)
            if len(out) > STEP:
                yield out
                out = []
        yield out

    def remembered(self, p: str) -> list[int]:
        ids = self.pieces.young.get(p)
        if ids is None:
            if self.pieces.missing({p}):
                self.pieces.young[p] = self.piece(p)
            ids = self.pieces.young[p]
        return ids

    def split(self, text: str) -> list[int]:
        return [i for some in self.pieces_of(text, 0, len(text)) for i in some]

    def cut(self, text: str) -> list[str] | None:
        """Chunks of a block, where no white space stands before a blank: each blank starts one. Marks that close one after a letter are pieces of their own, behind a sign
        that no text here has. Letters are remembered once, whatever closes them."""
        if SIGN in text or BLANKS.search(text):
            return None
        return CLOSED.sub(rf" {SIGN}\g<0>", text).split(" ")

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of chunks, which are words after a blank or closing marks. Most are one piece, which is known without the pattern."""
        whole, split, known, letters = [], [], self.chunks.young, self.letters.fullmatch
        for word in words:
            if len(word) >= LONG:
                known[word] = np.array(self.split(word[1:] if word[0] == SIGN else " " + word), np.int32).tobytes()
            elif (word.isalpha() if word.isascii() else letters(word)) or word[:1] == SIGN:
                whole.append(word)
            else:
                split.append((word, self.pattern.findall(" " + word)))
        parts = list({p for _, ps in split for p in ps})
        pieces = [w[1:] if w[0] == SIGN else " " + w for w in whole]
        ids = self.steps.encode([p.encode("utf-8", "surrogatepass") for p in pieces + parts])
        known.update(zip(whole, ids, strict=False))
        own = dict(zip(parts, ids[len(whole) :], strict=True))
        for word, ps in split:
            known[word] = b"".join(map(own.__getitem__, ps))

    def prepare(self, texts: list[str]) -> None:
        """Cuts short texts and learns their chunks together, which only saves work."""
        self.ready = {text: words for text in texts if (words := self.cut(text))}
        words = set().union(*(words[1:] for words in self.ready.values()))
        self.learn([word for word in self.chunks.missing(words) if len(word) < LONG])

    def stretch(self, text: str) -> list[int]:
        """Ids of a block."""
        words = self.ready.get(text) or self.cut(text)
        if words is None:
            return self.split(text)
        first, *rest = words
        try:
            ids = b"".join(map(self.chunks.young.__getitem__, rest))
        except KeyError:
            self.learn(self.chunks.missing(set(rest)))
            ids = b"".join(map(self.chunks.young.__getitem__, rest))
        return self.split(first) + self.numbers[np.frombuffer(ids, np.int32)].tolist()

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of blocks that start at a blank after something that is no white space."""
        at = 0
        while len(text) - at > BLOCK:
            end = text.find(" ", at + BLOCK)
            while end > 0 and text[end - 1].isspace():
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield at, end
            at = end
        yield at, len(text)

    def encode(self, text: str) -> Iterator[list[int]]:
        """Lists of ids, in order."""
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.special:
                yield [self.special[part]]
            elif part:
                for at, end in self.blocks(part):
                    if end - at > 2 * BLOCK or LONG_WORD.search(part, at, end):
                        yield from self.pieces_of(part, at, end)
                    else:
                        yield self.stretch(part[at:end])

    def decode(self, ids: Iterator[list[int]]) -> Iterator[str]:
        """Text of the ids as far as its characters are complete; bytes that are no UTF-8 become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for some in ids:
            yield state.decode(b"".join(map(self.bytes.__getitem__, some)))
        yield state.decode(b"", True)


def encode_decode(docs: DataFrame, tokenizer: str, with_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and ids (array of int) if `with_ids`."""

    def run(batches):
        import pyarrow as pa

        Memory.only("bpe")
        codec = Codec.of(tokenizer)
        names = codec.names.__getitem__
        kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]

        def one(x: str):
            n, own, plain, kept = 0, hashlib.sha256(), hashlib.sha256(), []

            def passed():
                nonlocal n
                for some in codec.encode(x):
                    if some:
                        own.update((("," if n else "") + ",".join(map(names, some))).encode())
                        n += len(some)
                        if with_ids:
                            kept.extend(some)
                        yield some

            for out in codec.decode(passed()):
                plain.update(out.encode("utf-8", "surrogatepass"))
            return n, own.hexdigest(), plain.hexdigest(), kept

        def prepared(column):
            """The texts; the words of those that come are learned together, up to BLOCK characters."""
            some, held = [], 0
            for x in column:
                x = x.as_py() or ""
                if some and held + len(x) > BLOCK:
                    codec.prepare(some)
                    yield from some
                    some, held = [], 0
                if len(x) > BLOCK:
                    yield x
                else:
                    some.append(x)
                    held += len(x)
            codec.prepare(some)
            yield from some

        for batch in batches:
            keys, rows, held = [], [], 0
            for k, x in zip(batch.column(0), prepared(batch.column(1)), strict=True):
                rows.append(one(x))
                keys.append(k.as_py())
                held += rows[-1][0]
                if with_ids and held > IDS:
                    yield pack(keys, rows, kinds)
                    keys, rows, held = [], [], 0
            if rows:
                yield pack(keys, rows, kinds)

    def pack(keys, rows, kinds):
        import pyarrow as pa

        columns = [keys, *zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=False)], names=[n for n, _ in kinds])

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("x")).mapInArrow(run, schema)
