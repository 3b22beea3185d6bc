"""Operator 1: byte-pair encoding and decoding of whole texts.

New words of a batch are encoded together: each has one contiguous row of parts and one of the
ranks of adjacent parts; the smallest rank of each row is found by a scan, the boundary it stands
for is deleted and the ranks of the two neighbouring boundaries are refreshed, until no row has a
rank left. Words of more than ``SHORT`` bytes use a heap over linked parts instead, so one endless word costs n log n. Words
repeat, so a bounded cache of two generations holds what a worker has encoded lately; it changes
speed only. There is no shuffle: a text meets the vocabulary in the task that reads it.

Defined results: a null text counts as empty and gives no ids; an empty table gives an empty
result; repeated rows and null ids give one row each; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import map_batches, rows_of, table
from tremor.llm.registry import query

#: Words of more parts than this are merged with a heap.
SHORT = 64
#: Entries of one generation of the word cache.
CACHED = 50_000

_NONE = 1 << 60
#: Open hash table of pair ranks, for lookups of whole arrays.
_SLOTS, _SHIFT, _MIX, _EMPTY = 1 << 18, np.uint64(64 - 18), np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)
#: White_Space of Unicode, as the tokenizer's pattern \s means it.
_SPACE = "\t\n\v\f\r \x85\xa0  -     　"
_SPLIT = regex.compile(f"[{_SPACE}]+")
#: str.split() also splits here, the tokenizer does not.
#: Marks that the word expression takes as words of their own after letters.
_ENDS = ".,;:!?"
_NOT_SPACE = regex.compile("[\x1c-\x1f]")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Encoder and decoder read from a tokenizers JSON file with byte-level parts and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols])
        self.last = np.array([vocab[s + end] for s in symbols])
        self.token = {i: t for t, i in vocab.items()}
        self.rank, joined = {}, []
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 32 | vocab[b], n)
            joined.append(vocab[a + b])
        self.joined = np.array(joined)
        self.keys, self.values = np.full(_SLOTS, _EMPTY), np.zeros(_SLOTS, np.int64)
        for key, n in self.rank.items():
            at = key * int(_MIX) % 2**64 >> int(_SHIFT)
            while self.keys[at] != _EMPTY:
                at = (at + 1) % _SLOTS
            self.keys[at], self.values[at] = key, n
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.token |= {i: t for t, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACE))
        self.young: dict = {}
        self.old: dict = {}

    def _pair_ranks(self, a, b):
        """Rank of each pair of adjacent parts; pairs without a rule get _NONE."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = (key * _MIX >> _SHIFT).astype(np.int64)
        found = np.where(self.keys[at] == key, self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != _EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & (_SLOTS - 1)
            got = self.keys[at[open_]]
            hit = got == key[open_]
            found[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != _EMPTY)]
        return found

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of at most SHORT bytes, one matrix row of parts and one of ranks for each."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        width = int(n.max())
        cols = np.arange(width)
        inside = cols < n[:, None]
        parts = np.zeros((len(words), width), np.int64)
        parts[inside] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        parts[np.arange(len(n)), n - 1] = self.last[[w[-1] for w in words]]
        ranks = np.full((len(n), width), _NONE)  # the last column stays empty
        if width > 1:
            pairs = inside[:, 1:]
            ranks[:, :-1][pairs] = self._pair_ranks(parts[:, :-1][pairs], parts[:, 1:][pairs])
        out: list = [None] * len(words)
        live = np.arange(len(n))
        while len(live):
            i = ranks.argmin(1)
            row = np.arange(len(live))
            least = ranks[row, i]
            done = least == _NONE
            if done.any():
                for k, p, m in zip(live[done].tolist(), parts[done].tolist(), n[done].tolist(), strict=True):
                    out[k] = p[:m]
                live, parts, ranks, n, i, least = (x[~done] for x in (live, parts, ranks, n, i, least))
                row = np.arange(len(live))
                if not len(live):
                    break
            parts[row, i] = self.joined[least]
            n -= 1
            # delete the boundary: parts after i + 1 and ranks after i move one to the left
            parts = np.take_along_axis(parts, np.minimum(cols + (cols > i[:, None]), width - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= i[:, None]), width - 1), 1)
            left, right = np.flatnonzero(i > 0), np.flatnonzero(i < n - 1)
            ranks[left, i[left] - 1] = self._pair_ranks(parts[left, i[left] - 1], parts[left, i[left]])
            ranks[right, i[right]] = self._pair_ranks(parts[right, i[right]], parts[right, i[right] + 1])
            keep = int(n.max())
            if keep < width - 4:
                width, cols, parts, ranks = keep + 1, cols[: keep + 1], parts[:, : keep + 1], ranks[:, : keep + 1]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one word of any length, by a heap of pairs over linked parts."""
        n = len(word)
        parts = [*self.inner[np.frombuffer(word, np.uint8)].tolist()]
        parts[-1] = int(self.last[word[-1]])
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank, joined = self.rank.get, self.joined.tolist()
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = joined[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def _words(self, chunk: str) -> list[str]:
        """Words of a run without white space and special tokens."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1] in _ENDS and chunk[:-1].isalpha():  # a run of letters and one mark are two words by the expression too
                return [chunk[:-1].lower(), chunk[-1]]
        else:
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lower-casing is by character, without the final sigma
        return self.word.findall(chunk.lower())

    def _known(self, chunks: set[str]) -> dict:
        """The young generation, with an entry for each chunk: ids and tokens, joined by blanks."""
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        old, young = self.old, self.young
        new = []
        for c in chunks:
            if c not in young:
                if (known := old.get(c)) is None:
                    new.append(c)
                else:
                    young[c] = known
        split = [*map(self._words, new)]
        coded: dict[str, tuple[str, str]] = {}
        by_length: dict[int, list[str]] = {}
        for w in {w for ws in split for w in ws}:
            # a word is also the chunk that it makes alone; other letters than ASCII may change where they are split again
            if w.isascii() and (known := young.get(w) or old.get(w)) is not None:
                coded[w] = known
            else:
                by_length.setdefault(min(len(w.encode("utf-8", "replace")) + 3 >> 2, SHORT // 4 + 1), []).append(w)
        for size, ws in by_length.items():
            for at in range(0, len(ws), 20_000):
                some = [w.encode("utf-8", "replace") for w in ws[at : at + 20_000]]
                for w, ids in zip(ws[at : at + 20_000], self.merge_short(some) if size <= SHORT // 4 else map(self.merge_long, some), strict=True):
                    coded[w] = " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))
        for c, ws in zip(new, split, strict=True):
            if len(ws) == 1:
                young[c] = coded[ws[0]]
            elif len(ws) == 2:
                (a, p), (b, q) = coded[ws[0]], coded[ws[1]]
                young[c] = f"{a} {b}", f"{p} {q}"
            else:
                both = [coded[w] for w in ws]
                young[c] = " ".join([x[0] for x in both]), " ".join([x[1] for x in both])
        return young

    def written(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Decimal ids and decoded text of each text, joined by blanks."""
        runs = []  # of each text: runs of chunks, and special tokens between them
        for text in texts:
            pieces = self.specials.split(text) if text and self.specials and "<|" in text else (text or "",)
            runs.append([p if k % 2 else [c for c in _SPLIT.split(p) if c] if _NOT_SPACE.search(p) else p.split() for k, p in enumerate(pieces)])
        known = self._known({c for rs in runs for k, r in enumerate(rs) if not k % 2 for c in r})
        out = []
        for rs in runs:
            if len(rs) == 1:
                found = [*map(known.__getitem__, rs[0])]
            else:
                found = [x for k, r in enumerate(rs) for x in ([(str(self.special[r]), r)] if k % 2 else map(known.__getitem__, r))]
            out.append((" ".join([f[0] for f in found if f[0]]), " ".join([f[1] for f in found if f[0]])))
        return out

    def written_in_turn(self, texts):
        """As written(), for an Arrow column, about 2^20 characters at a time."""
        some, size = [], 0
        for t in texts:
            t = t.as_py()
            some.append(t)
            size += len(t or "")
            if size >= 1 << 20:
                yield from self.written(some)
                some, size = [], 0
        yield from self.written(some)

    def forget(self) -> None:
        """Empty the cache, so that a worker that goes on to other tasks does not keep it."""
        self.young, self.old = {}, {}

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.written([text])[0][0].split()]

    def decode(self, ids) -> str:
        """Tokens joined by blanks, special ones included; ids outside the vocabulary are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@cache
def tokenizer(path: str) -> Tokenizer:
    """One per worker process; the file must lie at ``path`` on every executor."""
    return Tokenizer(path)


DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _digest_batches(batches, path: str):
    tok = tokenizer(path)
    for batch in batches:
        out: list[list] = [[], [], []]
        for ids, decoded in tok.written_in_turn(batch.column(1)):
            out[0].append(ids.count(" ") + 1 if ids else 0)
            out[1].append(_sha(ids))
            out[2].append(_sha(decoded))
        yield rows_of(DIGESTS, [batch.column(0), *out])
    tok.forget()


def _encode_batches(batches, path: str, schema: T.StructType):
    tok = tokenizer(path)
    for batch in batches:
        yield rows_of(schema, [batch.column(0), [[int(i) for i in ids.split()] for ids, _ in tok.written_in_turn(batch.column(1))]])
    tok.forget()


def _decode_batches(batches, path: str, schema: T.StructType):
    tok = tokenizer(path)
    for batch in batches:
        yield rows_of(schema, [batch.column(0), [tok.decode(i.as_py() or ()) for i in batch.column(1)]])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_batches(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), _encode_batches, schema, path, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row of ids; null ids give an empty text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return map_batches(df.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")), _decode_batches, schema, path, schema)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, without moving ids out of the task."""
    return map_batches(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), _digest_batches, DIGESTS, path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
