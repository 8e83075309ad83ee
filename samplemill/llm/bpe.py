"""Byte-pair encoding and decoding by tree concatenation.

A text falls into words (letters, a digit, or other marks). Words are looked up
by hash in a bounded table of the worker, so each is encoded once. A word's own
encoding is a tree: its bytes are cut into short leaves which are encoded
together in one parallel call; neighbours are then joined pairwise. At a join
the last tokens of the left and the first of the right side are encoded anew as
one window, which grows until its first and last token are the ones both sides
had. Every pair of neighbouring tokens is then one that the encoder itself
made, which for merge-rank BPE means that the whole is the encoder's result.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textvec as tv
from .spark_io import arrow_stage, documents, kept_between_tasks

#: Bytes of a leaf; words up to this length are one leaf.
LEAF = 64
#: Tokens on either side of a join in its first window.
WINDOW = 4
#: The worker's word table: slots, and ids kept before it starts anew.
SLOTS, KEPT_IDS = 1 << 22, 1 << 23

SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3
KIND = np.full(256, MARK, dtype=np.uint8)
KIND[[0x20, 9, 10, 11, 12, 13]] = SPACE
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = KIND[0x80:] = LETTER
#: In texts of ASCII and the Latin-1 letters, lower case is a matter of single bytes.
LOWER = tv.LOWER.copy()
LOWER[0x80:0x9F] += 32
#: Bytes that show that a text needs the tokenizer's own normaliser.
OTHER = np.zeros(256, dtype=bool)
OTHER[0xC0:0xC3] = OTHER[0xC4:] = OTHER[[0x97, 0xB7]] = True
#: Fixed values of the pre-tokenizer's pattern: what may follow an apostrophe that begins a word of its own.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """A byte-level BPE tokenizer with word ends, from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.own = Tokenizer.from_file(path)
        bare = spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "post_processor": None}
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.ending = Tokenizer.from_str(json.dumps(bare))
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        strings = [""] * (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for s, i in spec["model"]["vocab"].items():
            strings[i] = s
        for t in spec["added_tokens"]:
            strings[t["id"]] = t["content"]
        self.strings = pa.array(strings)
        self.listed = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.final = np.array([s.endswith(self.suffix) for s in strings])
        self.length = np.array([len(s.removesuffix(self.suffix)) for s in strings], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.n = np.zeros(SLOTS, np.int32)
        self.store = np.zeros(KEPT_IDS, np.uint16 if len(self.strings) <= 1 << 16 else np.int32)
        self.used = 0

    # -- one word ---------------------------------------------------------

    def _batch(self, texts: list[str], last: list[bool]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        for tokenizer, want in ((self.ending, True), (self.inner, False)):
            if at := [i for i, x in enumerate(last) if x is want]:
                for i, e in zip(at, tokenizer.encode_batch_fast([texts[i] for i in at], add_special_tokens=False), strict=True):
                    out[i] = e.ids
        return out

    def _join(self, left: list[int], right: list[int], text: str, start: int, middle: int, end: int, last: bool) -> list[int]:
        """left encodes text[start:middle], right text[middle:end]; last: the word ends there."""
        k = WINDOW
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            lo = middle - int(self.length[left[a:]].sum())
            hi = middle + int(self.length[right[:b]].sum())
            tokenizer = self.ending if last and b == len(right) else self.inner
            window = tokenizer.encode(text[lo:hi], add_special_tokens=False).ids
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            k *= 2

    def encode_words(self, texts: list[str]) -> list[list[int]]:
        """Ids of words (in byte letters), each by tree concatenation."""
        leaves: list[str] = []
        last: list[bool] = []
        spans: list[tuple[int, list[int]]] = []
        for t in texts:
            parts = 1
            while len(t) > LEAF * parts:
                parts *= 2
            cuts = [len(t) * i // parts for i in range(parts + 1)]
            spans.append((len(leaves), cuts))
            leaves += [t[a:b] for a, b in zip(cuts, cuts[1:])]
            last += [False] * (parts - 1) + [True]
        ids = self._batch(leaves, last)
        out = []
        for t, (at, cuts) in zip(texts, spans, strict=True):
            level = ids[at : at + len(cuts) - 1]
            while len(level) > 1:
                level = [self._join(level[i], level[i + 1], t, cuts[i], cuts[i + 1], cuts[i + 2], cuts[i + 2] == len(t)) for i in range(0, len(level), 2)]
                cuts = cuts[::2]
            out.append(level[0])
        return out

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count by word) of words: those of one leaf in a single call, where
        each last token bears the mark of a word's end; longer ones by their trees."""
        long = [i for i, t in enumerate(texts) if len(t) > LEAF]
        trees = dict(zip(long, self.encode_words([texts[i] for i in long]), strict=True))
        short = [t for t in texts if len(t) <= LEAF] if long else texts
        flat = np.array(self.listed.encode(" ".join(short), add_special_tokens=False).ids, dtype=self.store.dtype)
        ends = np.append(0, np.flatnonzero(self.final[flat]) + 1)
        if not long:
            return flat, np.diff(ends)
        runs, k = [], 0
        for i in range(len(texts)):
            if i in trees:
                runs.append(np.array(trees[i], dtype=self.store.dtype))
            else:
                runs.append(flat[ends[k] : ends[k + 1]])
                k += 1
        return np.concatenate(runs), np.array([len(r) for r in runs], dtype=np.int64)

    # -- whole texts ------------------------------------------------------

    def _spell(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.letters)

    def _lookup(self, hashes: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts in the store of words; spell(i): word i in byte letters."""
        slot = (hashes >> np.uint64(11)) & np.uint64(SLOTS - 1)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != hashes)
        if len(missing):
            new, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            flat, count = self.encode_flat([spell(i) for i in missing[where].tolist()])
            if self.used + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(len(flat), self.store.dtype)])
            places = self.used + np.cumsum(count) - count
            self.store[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            s = (new >> np.uint64(11)) & np.uint64(SLOTS - 1)
            self.keys[s], self.at[s], self.n[s] = new, places, count
            at[missing], n[missing] = places[back], count[back]
        return at, n

    def _flatten(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        ends = np.cumsum(n)
        return self.store[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def _latin(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = LOWER[data]
        if not len(low):
            return np.zeros(0, self.store.dtype), np.zeros(len(offs), np.int64)
        kind = KIND[low]
        new = np.empty(len(low), dtype=bool)
        new[0], new[1:] = True, kind[1:] != kind[:-1]
        new |= kind == DIGIT
        new[offs[offs < len(low)]] = True
        final = np.append(new[1:], True)
        quote = np.flatnonzero((low == 0x27) & new)
        quote = quote[final[quote] & (quote + 1 < len(low))]
        for q in quote[kind[np.minimum(quote + 1, len(low) - 1)] == LETTER].tolist():
            end = int(offs[np.searchsorted(offs, q, side="right")])
            for c in CONTRACTIONS:
                if q + len(c) < end and low[q + 1 : q + 1 + len(c)].tobytes() == c:
                    new[q + 1] = False
                    if q + 1 + len(c) < len(low):
                        new[q + 1 + len(c)] = True
                    break
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(low))
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
        hashes = tv.span_hash(tv.prefix_hash(low), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        at, n = self._lookup(hashes, lambda i: self._spell(low[starts[i] : ends[i]].tobytes()))
        total = np.append(0, np.cumsum(n))
        return self._flatten(at, n), total[np.searchsorted(starts, offs)]

    def _general(self, text: str) -> np.ndarray:
        """Any text: the tokenizer's own normaliser and pre-tokenizer, then words by their trees."""
        out: list[int] = []
        for part in self.added_pattern.split(text) if self.added_pattern else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                words = [w for w, _ in self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(part))]
                distinct = list(dict.fromkeys(words))
                ids = dict(zip(distinct, self.encode_words(distinct), strict=True))
                for w in words:
                    out += ids[w]
        return np.array(out, dtype=self.store.dtype)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts data[offs[i]:offs[i + 1]]."""
        if self.used > KEPT_IDS // 2 or self.used + len(data) > len(self.store):
            self.reset()
        odd = np.append(0, np.cumsum(OTHER[data] | (data == 0x7C)))
        general = np.flatnonzero(odd[offs[1:]] > odd[offs[:-1]])
        general = [i for i in general.tolist() if self._is_general(data[offs[i] : offs[i + 1]].tobytes())]
        if not general:
            return self._latin(data, offs)
        parts, counts, a = [], [], 0
        for i in [*general, len(offs) - 1]:
            if i > a:
                ids, at = self._latin(data[offs[a] : offs[i]], offs[a : i + 1] - offs[a])
                parts.append(ids)
                counts.append(np.diff(at))
            if i < len(offs) - 1:
                parts.append(self._general(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8")))
                counts.append(np.array([len(parts[-1])]))
            a = i + 1
        return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))

    def _is_general(self, raw: bytes) -> bool:
        return bool(OTHER[np.frombuffer(raw, np.uint8)].any()) or any(t.encode() in raw for t in self.added)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts that the tokenizer's decode gives for ids[at[i]:at[i + 1]], special tokens shown."""
        tokens = self.strings.take(pa.array(ids.astype(np.int32)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), tokens), " ")


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One per worker, until it begins a stage without one."""
    return Vocabulary(path)


kept_between_tasks(vocabulary.cache_clear)


def default_path() -> str:
    """The public tokenizer of the queries; looked up where it is called."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, as the tokenizer encodes it without special tokens.

    Null and empty texts have no ids. Repeated rows are encoded as they stand; an
    empty table gives an empty result; further columns are ignored.
    """

    def each(batch):
        for a, b, data, offs in tv.batches(batch.column(1)):
            ids, at = vocabulary(path or default_path()).encode(data, offs)
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return arrow_stage(documents(docs), each, "doc_id long, ids array<int>", keeps=True)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids count as none."""

    def each(batch):
        lists = batch.column(1)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        yield pa.record_batch([batch.column(0), vocabulary(path or default_path()).decode(ids, np.append(0, np.cumsum(counts)))], ["doc_id", "text"])

    return arrow_stage(encoded.select(encoded["doc_id"].cast("long"), encoded["ids"]), each, "doc_id long, text string", keeps=True)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): `encode` and `decode` in one
    pass, returning only digests; ids as little-endian unsigned 32-bit integers."""

    def each(batch):
        v = vocabulary(path or default_path())
        for a, b, data, offs in tv.batches(batch.column(1)):
            ids, at = v.encode(data, offs)
            raw = memoryview(ids.astype("<u4"))
            text, places = tv.byte_arrays(v.decode(ids, at))
            shown = memoryview(np.ascontiguousarray(text))
            yield pa.record_batch([
                batch.column(0).slice(a, b - a), pa.array(np.diff(at)),
                pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]),
                pa.array([hashlib.sha256(shown[x:y]).hexdigest() for x, y in zip(places[:-1].tolist(), places[1:].tolist())]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_stage(documents(docs), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)
