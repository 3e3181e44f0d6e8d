"""Token ids of a public byte-level BPE vocabulary, faster than encoding whole texts.

The vocabulary never merges across the cut before a single space or line end that stands between two other
characters. So the texts of a slice are cut there, each distinct piece is encoded once, and a text's ids are its
pieces' ids in order, gathered by numpy. Texts with other white space, with very long words or with added tokens are
encoded whole.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from orbitlake.llm import words as W

SLICE_BYTES = 1 << 20
#: Pieces a worker keeps encoded (about 25 bytes each); beyond that it starts afresh. Affects speed only.
KEPT_PIECES = 1_000_000
#: UTF-8 bytes after which another byte or two spell white space outside ASCII.
_WIDE_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_ODD_ASCII = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_SPACE = np.isin(np.arange(256), [32, 10])
#: Words beyond so many bytes are not told apart by a polynomial hash; texts that hold one are encoded whole.
LONGEST_HASHED = 256
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The worker's encoder of the vocabulary file at ``path``, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _data(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a large_string array."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def odd_texts(texts: pa.Array) -> np.ndarray:
    """Texts with white space at which pieces may depend on their neighbours: anything but single spaces and
    line ends, each followed by another character."""
    data, bounds = _data(texts)
    bad = _ODD_ASCII[data]
    space = _SPACE[data]
    bad[:-1] |= space[:-1] & space[1:]
    lead = np.flatnonzero(_WIDE_LEADS[data[:-2]]) if len(data) > 2 else np.zeros(0, np.int64)
    a, b, c = data[lead], data[lead + 1] if len(lead) else lead, data[lead + 2] if len(lead) else lead
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    bad[lead[wide]] = True
    sums = np.concatenate([[0], np.cumsum(bad)])
    found = sums[bounds[1:]] > sums[bounds[:-1]]
    full = bounds[1:] > bounds[:-1]
    found[full] |= space[bounds[1:][full] - 1]
    if len(data) > 1 and data[-2] == 0xC2 and data[-1] in (0x85, 0xA0):
        found[np.flatnonzero(full)[-1]] = True
    return found


def long_words(texts: pa.Array) -> np.ndarray:
    """Texts with a word of more than ``LONGEST_HASHED`` bytes."""
    words = W.split(texts)
    longer = np.concatenate([[0], np.cumsum(words.ends - words.starts > LONGEST_HASHED)])
    return longer[words.first[1:]] > longer[words.first[:-1]]


def _ragged(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, … (lengths[0] of them), begin[1], …"""
    ahead = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(begin - ahead, lengths)


class Encoder:
    """Reads the vocabulary as ranks; tests hold its ids against those of the ``tokenizers`` file of the same vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as source:
            added = {t["content"]: t["id"] for t in json.load(source)["added_tokens"]}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = "|".join(map(re.escape, added))
        (self.line_end,) = self.whole("\n")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text; spellings of added tokens are those tokens."""
        return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text of a large_string array without nulls."""
        odd = odd_texts(texts) | long_words(texts)
        if self.added:
            odd |= pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        whole = iter(texts.filter(pa.array(odd)).to_pylist())
        plain = self._plain(texts.filter(pa.array(~odd)))
        return [self.whole(next(whole)) if o else next(plain) for o in odd]

    def _plain(self, texts: pa.Array):
        if not len(texts):
            return
        words = W.split(texts)
        _, bounds = _data(texts)
        before = np.zeros(len(words.starts), np.uint8)  # the byte before the piece, 0 at the start of its text
        led = words.starts > np.repeat(bounds[:-1], words.counts())
        before[led] = words.data[words.starts[led] - 1]
        # 0: as it stands, 1: after a space, 2: after a line end, which then belongs to it
        kind = (before == 32).astype(np.uint64) + np.uint64(2) * (before == 10).astype(np.uint64)
        keys, sample, place = np.unique(W.mix(words.hashes + kind, 7), return_index=True, return_inverse=True)
        begin, sizes = self._lookup(keys, words, sample, kind)
        lengths = sizes[place]
        total = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.known[_ragged(begin[place], lengths)]
        ends = total[words.first]
        yield from (flat[a:b] for a, b in zip(ends[:-1], ends[1:]))

    def _lookup(self, keys: np.ndarray, words: W.Words, sample: np.ndarray, kind: np.ndarray):
        if len(self.keys) > KEPT_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            begin, sizes = self._learn(words, sample[new], kind[sample[new]])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.begin = np.insert(self.begin, at[new], begin)
            self.sizes = np.insert(self.sizes, at[new], sizes)
            at = np.searchsorted(self.keys, keys)
        return self.begin[at], self.sizes[at]

    def _learn(self, words: W.Words, sample: np.ndarray, kind: np.ndarray):
        """Encode the sampled pieces; where their ids begin among the known ones, and how many they are."""
        begin, sizes = np.zeros(len(sample), np.int64), np.zeros(len(sample), np.int64)
        for lead in (b"\n", b"\n "):  # a line end before each piece marks where it begins
            own = np.flatnonzero((kind == 1) == (len(lead) == 2))
            if not len(own):
                continue
            lengths = words.ends[sample[own]] - words.starts[sample[own]]
            stream = np.empty(lengths.sum() + len(lead) * len(own), np.uint8)
            heads = np.cumsum(lengths + len(lead)) - lengths - len(lead)
            for i, byte in enumerate(lead):
                stream[heads + i] = byte
            stream[_ragged(heads + len(lead), lengths)] = words.data[_ragged(words.starts[sample[own]], lengths)]
            ids = self.whole(stream.tobytes().decode())
            cuts = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            begin[own] = len(self.known) + cuts[:-1] + (kind[own] != 2)
            sizes[own] = np.diff(cuts) - (kind[own] != 2)
            self.known = np.concatenate([self.known, ids])
        return begin, sizes
