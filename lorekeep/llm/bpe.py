"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens that a batch adds are laid out as one sequence of symbols. An index maps
each adjacent pair that has a rank to all its positions; the active ranks are applied in ascending
order, each to all its positions at once, and the lists of the pairs to the left and right of what
was merged are updated. A pair with a merged token in it ranks above the merge that made the token,
so ascending order over the whole batch gives what merging word by word gives.

The vocabulary file is that of a public tokenizer (``tokenizers`` JSON, byte-level BPE without
normalizer); its special tokens are found in the text first, as that library does.

Defined results: a null text is an empty one, which has no ids; texts of any length are encoded
whole; repeated rows are encoded each; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

import gc
import json
import re
import string
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, restored, whole_id, working

#: The pattern of the vocabulary's pre-tokenizer; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of text that a worker remembers from slice to slice, and the longest of them.
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
#: Characters of text handled at once.
SLICE_CHARS = 4_000_000
#: Characters that are neither letters, numbers nor white space; a run of them is one pre-token.
_MARKS = string.punctuation
#: A space that white space or the end follows, and one that white space precedes as well.
_TRAILING_SPACE = re.compile(r" (?!\S)").search
_SPACE_IN_A_RUN = re.compile(r"(?<=\s) (?!\S)").search


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairIndex:
    """Encodes by the merges of a vocabulary file."""

    #: Runs remembered from slice to slice, if not CACHE_WORDS.
    most_runs = 0

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        ids: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max(*ids.values(), *special.values()))
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.of_byte = [ids[c] for c in letters]
        self.width = len(self.bytes)
        self.parts: list[tuple[int, int]] = []
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
            self.rank[ids[a] * self.width + ids[b]] = len(self.made)
            self.made.append(ids[a + b])
            self.parts.append((ids[a], ids[b]))
        self.pair_keys = np.array(list(self.rank), np.int64)
        self.pair_ranks = np.argsort(self.pair_keys, kind="stable")
        self.pair_keys = self.pair_keys[self.pair_ranks]
        self.byte_ids = np.array(self.of_byte, np.int64)
        pairs = (self.byte_ids[:, None] * self.width + self.byte_ids).ravel().tolist()
        self.byte_ranks = np.array([self.rank.get(p, -1) for p in pairs], np.int64)
        self.special = {t: i.to_bytes(4, "little") for t, i in special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.findall = regex.compile(PATTERN).findall
        #: Ids of runs of text, as they stand and after a space.
        self.bare: dict[str, bytes] = {"": b""}
        self.spaced: dict[str, bytes] = {}

    def __reduce__(self):
        return encoder, (self.path,)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words])
        edge = np.zeros(len(raw), bool)
        edge[0] = edge[ends] = True
        ids = np.where(edge, -1, self.byte_ids[raw])  # no pair goes over a word's end
        ranks = self.byte_ranks[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        ranks[edge[:-1] | edge[1:]] = -1
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        used, starts = np.unique(ranks[places], return_index=True)
        at: dict[int, list[np.ndarray]] = dict(zip(used.tolist(), ([x] for x in np.split(places, starts[1:])), strict=True)) if len(places) else {}
        symbols, after, before = ids, np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        active = list(at)
        heapify(active)
        made_by = np.full(len(ids), -1, np.int32)  # the rank that made the token here
        while active:
            r = heappop(active)
            lists = at.pop(r)
            i = lists[0] if len(lists) == 1 else np.concatenate(lists)
            left, right = self.parts[r]
            if left == right:
                i = np.sort(i)
            i = i[symbols[i] == left]
            j = after[i]
            live = symbols[j] == right  # else one of the two has gone into another token
            i, j = i[live], j[live]
            if left == right and len(i) > 1:
                i = self._apart(i, j)
                j = after[i]
            if not len(i):
                continue
            new = self.made[r]
            symbols[i], symbols[j] = new, -2
            made_by[i] = r
            k = after[j]
            after[i], before[k] = k, i
            h = before[i]
            # the pairs that the new token is in, to the left (unless that is to the right of another one) and to the right
            before_it, after_it = symbols[h], symbols[k]
            on_left, on_right = (before_it >= 0) & (made_by[h] != r), after_it >= 0
            pairs = np.concatenate([before_it[on_left] * self.width + new, new * self.width + after_it[on_right]])
            starts = np.concatenate([h[on_left], i[on_right]])
            place = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
            known = self.pair_keys[place] == pairs
            ranks, starts = self.pair_ranks[place[known]], starts[known]
            if not len(ranks):
                continue
            order = np.argsort(ranks, kind="stable")
            ranks, starts = ranks[order], starts[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for s, found in zip(ranks[np.r_[0, cuts]].tolist(), np.split(starts, cuts) if len(cuts) else (starts,), strict=True):
                if (held := at.get(s)) is None:
                    at[s] = [found]
                    heappush(active, s)
                else:
                    held.append(found)
        flat = symbols
        keep = flat >= 0
        bounds = 4 * np.r_[0, np.cumsum(keep)[ends]]
        packed = flat[keep].astype("<u4").tobytes()
        return [packed[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    @staticmethod
    def _apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of overlapping pairs of one symbol with itself, every other one from the left of each run."""
        follows = np.r_[False, i[1:] == j[:-1]]
        run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(i))))
        return i[(np.arange(len(i)) - run) % 2 == 0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts, packed."""
        return [ids for found in self.slices(texts) for ids in found]

    def slices(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """The ids of whole texts, packed, for as many texts at once as SLICE_CHARS allow."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= SLICE_CHARS:
                yield self._slice(held)
                held, size = [], 0
        if held:
            yield self._slice(held)

    def _slice(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # many short lists without cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        # special tokens part a text, spaces part the rest; (special, None) or (first run, those after a space)
        laid_out = [self._runs(t) for t in texts]
        first = {bare for parts in laid_out for bare, after in parts if after is not None}.difference(self.bare)
        later = set().union(*(after for parts in laid_out for _, after in parts if after)).difference(self.spaced)
        self._learn(first, later)
        bare, spaced = self.bare.__getitem__, self.spaced.__getitem__
        out = []
        for parts in laid_out:
            ids = [self.special[run] if after is None else bare(run) + b"".join(map(spaced, after)) for run, after in parts]
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        if len(self.bare) + len(self.spaced) > (most := self.most_runs or CACHE_WORDS):
            # what this slice did not ask for goes, and what is long
            asked = set().union(*(after for parts in laid_out for _, after in parts if after))
            self.spaced = {r: i for r, i in self.spaced.items() if r in asked and len(r) <= CACHE_LENGTH}
            self.bare = {"": b""}
            if len(self.spaced) > most // 2:
                self.spaced.clear()
        return out

    def _runs(self, text: str) -> list[tuple[str, list[str] | None]]:
        """The text cut where no pre-token goes over: at special tokens, and before a space with something
        else than white space to its left or right."""
        if self.split_special is not None and any(map(text.__contains__, self.special)):
            return [run for part in self.split_special(text) for run in ([(part, None)] if part in self.special else self._runs(part))]
        if _TRAILING_SPACE(text) and _SPACE_IN_A_RUN(text):
            return [(text, [])]  # cut by the pattern alone
        first, *after = text.split(" ")
        return [(first, after)]

    def _learn(self, first: set[str], later: set[str]) -> None:
        """Remembers the ids of runs at a start (``bare``) and of runs that follow a space (``spaced``)."""
        bare, spaced, findall = self.bare, self.spaced, self.findall
        letters, marked, cut = [], [], []
        for r in later:
            if r.isalpha():  # a run of letters is one pre-token
                letters.append(r)
            elif (core := r.rstrip(_MARKS)).isalpha():  # and so are the marks behind it
                marked.append((r, core, r[len(core) :]))
            else:
                cut.append((r, findall(" " + r)))
        cut_first = [(r, findall(r)) for r in first]
        pieces = {w for ws in (cut, cut_first) for _, found in ws for w in found}
        alone = {m for _, _, m in marked}.union(w for w in pieces if w[0] != " ").difference(bare)
        after = {c for _, c, _ in marked}.union(w[1:] for w in pieces if w[0] == " ").difference(spaced).union(letters)
        ids = self.merge([w.encode("utf-8", "surrogatepass") for w in [*map(" ".__add__, after), *alone]])
        spaced.update(zip(after, ids, strict=False))
        bare.update(zip(alone, ids[len(after) :], strict=True))
        spaced.update([(r, spaced[c] + bare[m]) for r, c, m in marked])
        for ws, known in ((cut, spaced), (cut_first, bare)):
            known.update([(r, b"".join([spaced[w[1:]] if w[0] == " " else bare[w] for w in found])) for r, found in ws])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, PairIndex] = {}


def encoder(path: str) -> PairIndex:
    """One per worker process and file."""
    working("bpe", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = PairIndex(path)
    return _ENCODERS[path]


def _batches(batches, path: str, decoded: bool):
    for batch in batches:
        at, own = 0, encoder(path)
        for ids in own.slices(batch.text.tolist()):
            found = pd.DataFrame({c: batch[c].iloc[at : at + len(ids)].to_numpy() for c in ("doc_id", "unnamed")} | {"ids": pd.Series(ids, dtype=object)})
            at += len(ids)
            yield found.assign(text=pd.Series(list(map(own.decode, ids)), dtype=object)) if decoded else found


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids: of whole texts, packed as little-endian unsigned 32-bit integers.

    decoded: also text, what the ids decode to, in the same pass.
    """
    # a step of its own: expressions over a Python function's result would have it computed once for each
    schema = "doc_id long, unnamed boolean, ids binary" + ", text string" * decoded
    found = docs.select(*whole_id("doc_id"), "text").mapInPandas(lambda batches: _batches(batches, path, decoded), schema)
    return found.withColumn("doc_id", restored()).drop("unnamed")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, ids, text."""

    def run(batches):
        for batch in batches:
            yield batch.assign(text=pd.Series([encoder(path).decode(p) for p in batch.ids], dtype=object))

    found = encoded.select(*whole_id("doc_id"), "ids").mapInPandas(run, "doc_id long, unnamed boolean, ids binary, text string")
    return found.withColumn("doc_id", restored()).drop("unnamed")


def op9_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(read(spark, sf_dir, "documents"), vocabulary_path(), decoded=True)
    return found.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
