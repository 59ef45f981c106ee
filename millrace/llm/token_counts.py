"""Exact token counts of every prefix of every text, stored, for budgets and cuts.

A byte-level BPE file parts a text into pieces and merges each piece by itself.
Within a piece, the encoding of a prefix is that of a shorter prefix and one
token more, and exactly one token fits: the one that stays apart from the last
token before it, which means that no merge across their border would come before
the merges that made the two.  So one walk over a piece gives the last token and
the number of tokens at each of its prefixes.  Distinct chunks of a block (blanks
and what follows up to the next blank, where pieces always part) are walked together,
each prefix that they share once; numpy adds up the counts of chunks in a text.

The table has one row for each document: doc_id, n_bytes and `counts`, of which
entry i is the number of tokens that the tokenizer gives for the first i characters
alone.  Such counts may fall from one prefix to the next.  `answers` reads the table
and says how long a text is and where it must be cut; no text is encoded again.

Defined results: a null text counts as empty and has the one count 0; every row of the
input has a row, whatever its doc_id, repeated rows and ties too; special strings
inside texts are one token each, and ordinary text as long as they are not complete;
texts of any length go through whole (a text longer than a block is a block of its
own); an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, prepare, scratch_dir, tidied
from .token_files import LAYOUT
from .token_files import LETTERS as WORD_LETTERS
from .token_files import MARKS as WORD_MARKS
from .wordcode import scramble

SCHEMA = "doc_id long, n_bytes long, counts array<int>"
BLOCK_BYTES = 1 << 20
MOST_CHUNKS = 200_000
LONGEST = 64
NEVER = 1 << 60
# The blanks at which byte-level files part texts, and what they keep apart from a word as one piece.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_CONTRACTIONS = (b"'re", b"'ve", b"'ll")
CHUNK = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
TWO_BLANKS = re.compile(f"[{BLANKS}]{{2,}}")
BLANK = re.compile(f"[{BLANKS}]")
#: a blank at most, Latin letters, and ASCII marks without the apostrophe, which starts contractions: two pieces, of which either may be empty
PLAIN = re.compile(rf"( ?[{WORD_LETTERS}]+)([{WORD_MARKS}]*)")


class Lookup:
    """A hash table of numbers from 0 on, in numpy: linear steps from a scrambled place."""

    def __init__(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (scramble(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        out, left, place = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._place(keys)
        while len(left):
            there = self.keys[place]
            hit = there == keys[left]
            out[left[hit]] = self.values[place[hit]]
            on = ~hit & (there >= 0)
            left, place = left[on], (place[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there."""
        self.n += len(keys)
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[free]
            mine = self.keys[place] == keys
            self.values[place[mine]] = values[mine]
            keys, values, place = keys[~mine], values[~mine], (place[~mine] + 1) & (len(self.keys) - 1)


class Merges:
    """The merges of a byte-level BPE file and the walk over pieces."""

    def __init__(self, model: dict) -> None:
        ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if len({a + b for a, b in pairs}) != len(pairs):
            raise ValueError("two merges make the same token")
        self.rank = {(ids[a], ids[b]): n for n, (a, b) in enumerate(pairs)}
        self.parts = {ids[a + b]: (ids[a], ids[b], n) for n, (a, b) in enumerate(pairs)}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.reached: dict[int, bool] = {}
        self.size = max(ids.values()) + 1
        # the tokens, read backwards, as a tree: (state, byte) to state, and the token that ends at a state
        self.back: dict[int, int] = {}
        token_at = [-1]
        for text, token in ids.items():
            if self.whole(token):
                state = 0
                for b in reversed(as_bytes(text).tolist()):
                    key = state << 8 | b
                    state = self.back.setdefault(key, len(token_at))
                    if state == len(token_at):
                        token_at.append(-1)
                token_at[state] = token
        self.token_at = np.array(token_at, np.int32)
        self.steps = Lookup(len(self.back).bit_length() + 1)
        self.steps.put(np.fromiter(self.back, np.int64), np.fromiter(self.back.values(), np.int32))
        self.met = Lookup(20)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols that stand at one side of a token while it grows, each with the rank of the merge that takes it up."""
        found = self.edges.get((token, side))
        if found is None:
            found, part, taken = [], token, NEVER
            while True:
                found.append((part, taken))
                if part not in self.parts:
                    break
                *both, taken = self.parts[part]
                part = both[side]
            self.edges[token, side] = found = found[::-1]
        return found

    def stay(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether, before the merge of rank `until`, nothing is merged across the border of two tokens in a row."""
        left, right, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            (x, x_taken), (y, y_taken) = left[i], right[j]
            rank = self.rank.get((x, y), NEVER)
            if rank < until and rank < x_taken and rank <= y_taken:  # of equal ranks the left one is merged first
                return False
            if x_taken >= until and y_taken >= until:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        known = self.reached.get(token)
        if known is None:
            known = True
            if token in self.parts:
                a, b, rank = self.parts[token]
                known = self.whole(a) and self.whole(b) and self.stay(a, b, rank)
            self.reached[token] = known
        return known

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether their bytes in a row are encoded as these two."""
        keys = a.astype(np.int64) * self.size + b
        known = self.met.get(keys)
        fresh = np.unique(keys[known < 0])
        if len(fresh):
            if 2 * (self.met.n + len(fresh)) > len(self.met.keys):
                self.met = Lookup(max(20, len(fresh).bit_length() + 2))
            stay = np.array([self.stay(*divmod(k, self.size)) for k in fresh.tolist()], np.int32)
            self.met.put(fresh, stay)
            missed = known < 0
            known[missed] = stay[np.searchsorted(fresh, keys[missed])]
        return known > 0

    def walk(self, piece: np.ndarray) -> np.ndarray:
        """Tokens of the first 1, 2, ... bytes of one piece, byte by byte."""
        text = piece.tolist()
        last, count = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        known: dict[tuple[int, int], bool] = {}
        token_at = self.token_at.tolist()
        for end in range(1, len(text) + 1):
            state = 0
            for start in range(end - 1, -1, -1):
                state = self.back.get(state << 8 | text[start], -1)
                if state < 0:
                    break
                token = token_at[state]
                if token >= 0 and start:
                    pair = last[start], token
                    if pair not in known:
                        known[pair] = self.stay(*pair)
                    token = token if known[pair] else -1
                if token >= 0:
                    last[end], count[end] = token, count[start] + 1
                    break
        return np.array(count[1:], np.int32)

    def counts(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """walk() of many distinct pieces, which lie in `flat` in a row; short ones together, each of their common prefixes once."""
        out, begin = np.zeros(len(flat), np.int32), np.cumsum(size) - size
        for k in np.flatnonzero(size > LONGEST):
            out[begin[k] : begin[k] + size[k]] = self.walk(flat[begin[k] : begin[k] + size[k]])
        short = np.flatnonzero((size > 0) & (size <= LONGEST))
        if not len(short):
            return out
        size, begin = size[short], begin[short]
        row = np.repeat(np.arange(len(short)), size)
        column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = np.zeros((len(short), int(size.max())), np.uint8)
        place = np.repeat(begin, size) + column
        wide[row, column] = flat[place]
        order = np.lexsort((size, wide.view(f"S{wide.shape[1]}").ravel()))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        wide, size = wide[order], size[order]
        same = np.zeros(wide.shape, bool)
        same[1:] = np.logical_and.accumulate(wide[1:] == wide[:-1], axis=1)
        at = np.arange(1, wide.shape[1] + 1)
        same[1:] &= at <= np.minimum(size[1:], size[:-1])[:, None]
        table = np.zeros(wide.shape, np.int32)  # of each piece, tokens of its prefixes
        # the nodes of all prefixes, level by level: byte, node before, last token, tokens
        byte, parent, last, count = (np.zeros(1, np.int64) for _ in range(4))
        node = np.zeros(len(short), np.int64)
        for level in range(1, wide.shape[1] + 1):
            alive = np.flatnonzero(size >= level)
            new = ~same[alive, level - 1]
            mine = len(byte) + np.cumsum(new) - 1
            head = alive[new]
            byte, parent = np.append(byte, wide[head, level - 1]), np.append(parent, node[head])
            found, many = np.full(len(head), -1, np.int64), np.zeros(len(head), np.int64)
            left, cursor, state = np.arange(len(head)), np.arange(len(byte) - len(head), len(byte)), np.zeros(len(head), np.int64)
            while len(left):
                state = self.steps.get(state << 8 | byte[cursor]).astype(np.int64)
                on = state >= 0
                left, cursor, state = left[on], parent[cursor[on]], state[on]
                token = self.token_at[state].astype(np.int64)
                fits = token >= 0
                ask = np.flatnonzero(fits & (cursor > 0))
                fits[ask] = self.apart(last[cursor[ask]], token[ask])
                found[left[fits]], many[left[fits]] = token[fits], count[cursor[fits]] + 1
                on = ~fits & (cursor > 0)
                left, cursor, state = left[on], cursor[on], state[on]
            last, count = np.append(last, found), np.append(count, many)
            node[alive] = mine
            table[alive, level - 1] = count[mine]
        out[place] = table[rank[row], column]
        return out


def _letters() -> np.ndarray:
    """The byte that each letter of a byte-level file stands for: printable ones for themselves, the others in a row from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.zeros(512, np.uint8)
    table[own] = own
    rest = [b for b in range(256) if b not in set(own)]
    table[256 : 256 + len(rest)] = rest
    return table


LETTERS = _letters()


def as_bytes(text: str) -> np.ndarray:
    """The bytes of a text that has one letter for each byte."""
    return LETTERS[np.frombuffer(text.encode("utf-16-le"), np.uint16)]


class Counter:
    """One file's counts of chunks, which are remembered up to MOST_CHUNKS of them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, cut, added = rules["model"], rules.get("pre_tokenizer") or {}, rules.get("added_tokens", [])
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not rules.get("normalizer")
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        if len(added) > 1 or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens of other kinds than one plain special string")
        self.special: str = added[0]["content"] if added else ""
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.merges = Merges(model)
        self.forget()

    def forget(self) -> None:
        #: chunk to number, and of all chunks in a row the counts after each character
        self.number: dict[str | tuple[str], int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _pieces(self, chunks: list[str]) -> list[str]:
        """Pieces of all chunks in a row; those that start with a blank and do not end with one part as well in one text."""
        found, start = [], 0
        for k, c in enumerate(chunks):
            if k and not (BLANK.match(c) and not BLANK.match(chunks[k - 1][-1])):
                found += self.cut("".join(chunks[start:k]))
                start = k
        return [p for p, _ in found + self.cut("".join(chunks[start:]))]

    def learn(self, chunks: list[str]) -> None:
        """Work out the counts of distinct new chunks after each of their characters."""
        met = list(map(PLAIN.fullmatch, chunks))
        plain = [m.groups() for m in met if m]
        others = [c for c, m in zip(chunks, met, strict=True) if not m]
        pieces = [p.encode() for pair in plain for p in pair]
        # of the others, the library says what their pieces are
        cut = self._pieces(others) if others else []
        raw = as_bytes("".join(cut)).tobytes()
        ends = np.cumsum([len(p) for p in cut], dtype=np.int64).tolist()
        pieces += [raw[i:j] for i, j in zip([0, *ends], ends)]
        runs = [(k, m.group().encode()) for k, m in enumerate(map(TWO_BLANKS.match, others), len(plain)) if m]
        every = list(dict.fromkeys(pieces + [r for _, r in runs]))
        number = {p: k for k, p in enumerate(every)}
        size = np.fromiter(map(len, every), np.int64, len(every))
        start = np.cumsum(size) - size
        flat = self.merges.counts(np.frombuffer(b"".join(every), np.uint8), size)
        total = np.where(size > 0, flat[np.maximum(start + size, 1) - 1], 0)
        used = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        chunks = [c for c, m in zip(chunks, met, strict=True) if m] + others
        text = "".join(chunks).encode()
        length = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks))
        bounds = np.concatenate([[0], np.cumsum(length)])
        n = size[used]
        sums = np.concatenate([[0], np.cumsum(total[used])])
        ends = np.concatenate([[0], np.cumsum(n)])
        body = flat[np.repeat(start[used] - ends[:-1], n) + np.arange(len(text))] + np.repeat(sums[:-1], n)
        for c in LONG_CONTRACTIONS:  # their first two letters are not one piece
            if c in number:
                at = ends[:-1][used == number[c]]
                body[at + 1] = sums[:-1][used == number[c]] + 2
        body -= np.repeat(sums[np.searchsorted(ends, bounds[:-1])], length)
        for k, run in runs:  # until another character comes, all blanks are one piece
            body[bounds[k] + len(run) - 1] = total[number[run]]
        char = np.ones(len(text), bool)  # the last byte of a character
        char[:-1] = (np.frombuffer(text, np.uint8)[1:] & 0xC0) != 0x80
        self._keep(chunks, body[char].astype(np.int32), np.fromiter(map(len, chunks), np.int64, len(chunks)))

    def _keep(self, keys: list, flat: np.ndarray, size: np.ndarray) -> None:
        self.number |= zip(keys, range(len(self.size), len(self.size) + len(keys)), strict=True)
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])

    def of(self, chunk: str) -> np.ndarray:
        k = self.number[chunk]
        end = int(self.size[: k + 1].sum())
        return self.flat[end - int(self.size[k]) : end]

    def keys_of(self, text: str) -> list:
        """The chunks of a text; a special string behind a chunk is a tuple of that chunk."""
        if not self.special or self.special not in text:
            return CHUNK.findall(text)
        first, *rest = map(CHUNK.findall, text.split(self.special))
        keys: list = first
        before = first
        for chunks in rest:
            keys += [(before[-1] if before else "",), *chunks]
            before = chunks
        return keys

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of all prefixes of all texts in a row, bounds of each text's)."""
        if len(self.number) > MOST_CHUNKS:
            self.forget()
        keys = [self.keys_of(t or "") for t in texts]
        fresh = {k for ks in keys for k in ks}.difference(self.number)
        marks = sorted(k for k in fresh if isinstance(k, tuple))
        wanted = {k for k in fresh if isinstance(k, str)} | {c for (b,) in marks for c in (b, b + self.special) if c}.difference(self.number)
        if wanted:
            self.learn(sorted(wanted))
        for (before,) in marks:
            after = self.of(before + self.special)[len(before) :] - (self.of(before)[-1] if before else 0)
            self._keep([(before,)], np.append(after[:-1], 1).astype(np.int32), np.array([len(after)]))
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        at = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(keys)), np.int64, bounds[-1])
        end = np.cumsum(self.size)
        n = self.size[at]
        sums = np.concatenate([[0], np.cumsum(self.flat[end[at] - 1])])
        base = sums[:-1] - np.repeat(sums[bounds[:-1]], np.diff(bounds))
        body = self.flat[np.repeat(end[at] - np.cumsum(n), n) + np.arange(n.sum())] + np.repeat(base, n).astype(np.int32)
        chars = np.concatenate([[0], np.cumsum(n)])[bounds]
        return np.insert(body, chars[:-1], 0), chars + np.arange(len(chars))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The one of this worker process for a file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def prefix_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_bytes, counts) of every row; nothing is shuffled."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = counter(tokenizer_path)
        for batch in blocks(batches, BLOCK_BYTES):
            texts = batch.column("text")
            flat, bounds = code.block(texts.to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), lists], ["doc_id", "n_bytes", "counts"])
        code.forget()  # idle workers hold nothing

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)


def write_counts(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> str:
    """Store the counts of every prefix; returns the table's folder."""
    path = path or scratch_dir(docs.sparkSession)
    prefix_counts(docs, tokenizer_path).write.options(**LAYOUT).parquet(path)
    return path


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def answers(counts: DataFrame, budget: int) -> DataFrame:
    """Per row of a table of counts: doc_id, n_bytes, n_tokens, and fits_chars, the longest prefix of at most `budget` tokens."""
    prepare(counts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("counts")
            at = lists.offsets.to_numpy().astype(np.int64)
            flat, at = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]
            place = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
            longest = np.maximum.reduceat(np.where(flat <= budget, place, 0), at[:-1]) if len(flat) else at[:-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(flat[at[1:] - 1].astype(np.int64)), pa.array(longest)], ["doc_id", "n_bytes", "n_tokens", "fits_chars"])

    return counts.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long, fits_chars long")


def tokens_before(counts: DataFrame, place: str) -> DataFrame:
    """The rows of a table of counts with `tokens`: those of the first `place` (a column) characters; null outside of the text."""
    return counts.withColumn("tokens", F.try_element_at("counts", (F.col(place) + 1).cast("int")))
