"""Byte-level BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of a word. If every proposed token is what the merges make of its own
bytes, and no merge ever reaches across the seam of two neighbours, then the proposal is the encoding. The seam test
looks only at the two tokens: it takes their last merges back, the later one first, and asks at every step whether
the two pieces that meet at the seam would have been merged before they were consumed. Numpy runs it for all seams of
a slice of texts at once. Words that fail it are merged exactly, pair by pair in order of rank.

Words are compared by their characters, never by a hash. Memory is bounded by a slice of texts (or its longest text)
and by the words a worker keeps.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import words as W

SLICE_BYTES = 1 << 20
#: Words a worker keeps encoded, and the longest kept, in characters. Affects speed only.
KEPT_WORDS, KEPT_LENGTH = 400_000, 40
#: Words up to so many bytes are merged side by side, longer ones one at a time with a heap.
SHORT = 40
_BETWEEN = "\u0100"  # stands between words; no byte
ID_BYTES = 4
_NEVER = np.iinfo(np.int64).max


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str, special: bool = True) -> Encoder:
    """The worker's encoder of the vocabulary file at ``path``, made once."""
    return Encoder(path, special)


@cache
def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable Latin-1 as it is, the others from
    U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@cache
def _splitter():
    """The pre-tokenizer's pattern, and the letters and digits that only the pattern's library knows yet."""
    import public_tokenizers
    import regex

    known = (chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn")
    newer = regex.findall(r"[\p{L}\p{N}]", "".join(known))
    return regex.compile(public_tokenizers.PATTERN), frozenset(newer)


def _packed(ids) -> bytes:
    return np.asarray(ids, "<i4").tobytes()


class Merges:
    """The merge rules as arrays over token ids: ``born`` is the rank of the merge that makes a token (-1: a byte),
    ``left`` and ``right`` are its parts."""

    def __init__(self, ids: dict[bytes, int], pairs: list[tuple[bytes, bytes]]):
        size = max(ids.values(), default=0) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)
        a = np.array([ids[x] for x, _ in pairs], np.int64)
        b = np.array([ids[y] for _, y in pairs], np.int64)
        made = np.array([ids[x + y] for x, y in pairs], np.int64)
        self.left[made], self.right[made], self.born[made] = a, b, np.arange(len(pairs))
        keys = a * size + b
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[order], order.astype(np.int64)
        self.made = made
        #: Seams tell the truth if every token has one rule, later than those of its parts.
        self.ordered = len(np.unique(made)) == len(made) and bool((self.born[made] > np.maximum(self.born[a], self.born[b])).all())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of every pair, ``_NEVER`` where there is none."""
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For every pair of tokens whether no merge before rank ``until`` reaches across their seam."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_ends = np.full(len(a), _NEVER) if until is None else until.astype(np.int64)
        y_ends = x_ends.copy()
        while len(live):
            rank = self.rank(x, y)
            # of equal merges the left one comes first
            crossed = (rank < x_ends) & (rank <= y_ends) & (rank != _NEVER)
            good[live[crossed]] = False
            go = ~crossed & ((self.born[x] >= 0) | (self.born[y] >= 0))
            live, x, y, x_ends, y_ends = live[go], x[go], y[go], x_ends[go], y_ends[go]
            undo_x = self.born[x] > self.born[y]
            x_ends = np.where(undo_x, self.born[x], x_ends)
            y_ends = np.where(undo_x, y_ends, self.born[y])
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    @cached_property
    def stable(self) -> np.ndarray:
        """Tokens that the merges make of their own bytes."""
        stable = np.ones(self.size, bool)
        whole = self.compatible(self.left[self.made], self.right[self.made], np.arange(len(self.made)))
        for token, good in zip(self.made.tolist(), whole.tolist()):
            stable[token] = good and stable[self.left[token]] and stable[self.right[token]]
        return stable

    @cached_property
    def rules(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) → (rank, product)."""
        made = self.made.tolist()
        return {(k // self.size, k % self.size): (r, made[r]) for k, r in zip(self.keys.tolist(), self.ranks.tolist())}

    def merge(self, tokens: list[int]) -> list[int]:
        """Exact merging: always the pair of least rank, of equal ones the leftmost."""
        rules, n = self.rules, len(tokens)
        tokens, after, before = list(tokens), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rules[pair][0], i, rules[pair][1]) for i, pair in enumerate(zip(tokens, tokens[1:])) if pair in rules]
        heapq.heapify(heap)
        while heap:
            rank, i, product = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j >= n or rules.get((tokens[i], tokens[j])) != (rank, product):
                continue
            tokens[i], tokens[j] = product, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for at, pair in ((i, (product, tokens[k] if k < n else -1)), (before[i], (tokens[before[i]], product))):
                if at >= 0 and pair in rules:
                    heapq.heappush(heap, (rules[pair][0], at, rules[pair][1]))
        return [t for t in tokens if t >= 0]

    def merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many token rows of one length at once: the merged rows, and how long each still is."""
        rows, n = rows.astype(np.int64), rows.shape[1]
        lengths = np.full(len(rows), n)
        ranks = np.full((len(rows), n), _NEVER)
        ranks[:, : n - 1] = self.rank(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), n - 1)
        places, live = np.arange(n), np.arange(len(rows))
        while len(live):
            own = ranks[live]
            at = own.argmin(1)
            least = own[np.arange(len(live)), at]
            go = least != _NEVER
            live, at, least, own = live[go], at[go], least[go], own[go]
            # everything behind the merged pair moves up by one
            source = np.minimum(places + (places > at[:, None]), n - 1)
            row, own = np.take_along_axis(rows[live], source, 1), np.take_along_axis(own, source, 1)
            each = np.arange(len(live))
            row[each, at] = self.made[least]
            lengths[live] -= 1
            last = lengths[live] - 1
            own[each, last] = _NEVER
            left, right = at > 0, at < last
            own[each[left], at[left] - 1] = self.rank(row[each[left], at[left] - 1], row[each[left], at[left]])
            own[each[right], at[right]] = self.rank(row[each[right], at[right]], row[each[right], at[right] + 1])
            rows[live], ranks[live] = row, own
        return rows, lengths


class Encoder:
    """Reads the vocabulary file. ``special``: spellings of added tokens in a text are those tokens."""

    def __init__(self, path: str, special: bool = True):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as source:
            stated = json.load(source)
        if stated.get("normalizer") or (stated["pre_tokenizer"] or {}).get("type") != "ByteLevel" or stated["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        added = {t["content"]: t["id"] for t in stated["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in stated["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        letters = byte_of_letter()
        ids = {bytes(letters[c] for c in piece): i for piece, i in stated["model"]["vocab"].items() if piece not in added}
        pairs = (p.split(" ") if isinstance(p, str) else p for p in stated["model"]["merges"])
        self.merges = Merges(ids, [(bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in pairs])
        self.ids_of_bytes = [ids[bytes([b])] for b in range(256)]
        stable = self.merges.stable
        self.proposed = ahocorasick.Automaton()
        for piece, i in ids.items():
            if stable[i]:
                self.proposed.add_word(piece.decode("latin-1"), i)
        self.proposed.make_automaton()
        size = max([*ids.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for piece, i in [*ids.items(), *((t.encode(), i) for t, i in added.items())]:
            self.bytes_of[i] = piece
        self.added = {t: _packed([i]) for t, i in added.items()} if special else {}
        spelled = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.added_pattern = regex.compile(f"({spelled})") if spelled else None
        self.known: dict[str, bytes] = dict(self.added)
        self._library = (path, None)

    def split(self, text: str) -> list[str]:
        """The words of a text without added tokens, as the vocabulary's pre-tokenizer cuts them."""
        pattern, newer = _splitter()
        if text.isascii() or newer.isdisjoint(text):
            return pattern.findall(text)
        path, library = self._library
        if library is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path).pre_tokenizer
            self._library = (path, library)
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """The words of a text and the added tokens between them. No word is spelled like an added token, as texts are
        cut at those first."""
        parts = [text] if self.added_pattern is None else self.added_pattern.split(text)
        if len(parts) == 1:
            return self.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.split(part))]

    def propose(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The greedy longest matches of all given words, one after the other, and which word each belongs to."""
        ends = np.cumsum([len(r) + 1 for r in raw])
        joined = _BETWEEN.join([r.decode("latin-1") for r in raw])
        found = np.fromiter(chain.from_iterable(self.proposed.iter_long(joined) if joined else ()), np.int64).reshape(-1, 2)
        return found[:, 1], np.searchsorted(ends, found[:, 0], "right")

    def merge_words(self, raw: list[bytes]) -> list[bytes]:
        """The packed ids of words by exact merging."""
        out = [b""] * len(raw)
        of_byte, sizes = np.array(self.ids_of_bytes), np.array([len(r) for r in raw], np.int64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size).tolist()
            if size > SHORT:
                for i in own:
                    out[i] = _packed(self.merges.merge(of_byte[np.frombuffer(raw[i], np.uint8)].tolist()))
                continue
            data = np.frombuffer(b"".join([raw[i] for i in own]), np.uint8).reshape(-1, size)
            rows, lengths = self.merges.merge_rows(of_byte[data])
            packed, width = _packed(rows.ravel()), ID_BYTES * size
            for i, at, length in zip(own, range(0, len(packed), width), (ID_BYTES * lengths).tolist()):
                out[i] = packed[at : at + length]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The packed ids of every given word."""
        raw = [w.encode() for w in words]
        flat, word = self.propose(raw)
        seam = np.flatnonzero(word[1:] == word[:-1])
        if self.merges.ordered:
            seam = seam[~self.merges.compatible(flat[seam], flat[seam + 1])]
        packed, bounds = _packed(flat), (ID_BYTES * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        out = [packed[a:b] for a, b in zip(bounds, bounds[1:])]
        failing = np.unique(word[seam]).tolist()
        for i, ids in zip(failing, self.merge_words([raw[i] for i in failing])):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, packed as little-endian 32-bit numbers."""
        cut = [self.words(text) if text else [] for text in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = dict(self.added)
        known = self.known
        new = list(set(chain.from_iterable(cut)).difference(known))
        known.update(zip(new, self.encode_words(new)))
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > KEPT_LENGTH:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, ids outside the vocabulary nothing."""
        table, size = self.bytes_of, len(self.bytes_of)
        if ids and (min(ids) < 0 or max(ids) >= size):
            ids = [i for i in ids if 0 <= i < size]
        return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


def list_array(packed: list[bytes]) -> pa.Array:
    """Packed ids as an array of lists."""
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // ID_BYTES for x in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, path: str | None = None, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``ids``, an array of token ids. Added tokens are recognised in texts unless
    ``special`` is false; none are put in.

    Null and empty texts have no ids. Repeated rows are encoded as often as they occur, null ids stay null, other
    columns are ignored, an empty table gives no rows. A text is encoded whole by one task. ``path`` names a vocabulary
    file that every worker can open. No shuffle.
    """
    path = path or vocabulary()

    def run(batches):
        use = encoder(path, special)
        for batch in batches:
            for at, texts in W.slices(batch["text"], SLICE_BYTES):
                ids = use.encode(texts.to_pylist())
                yield pa.record_batch({"id": batch["id"].slice(at, len(texts)), "ids": list_array(ids)})

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: its id, its ids and their ``text``, added tokens spelled out.

    Null ids give an empty text; ids that the vocabulary lacks give nothing; the rest is as in :func:`encode`.
    """
    path = path or vocabulary()

    def run(batches):
        use = encoder(path)
        for batch in batches:
            at, ids = 0, batch["ids"]
            while at < len(ids):
                part = ids.slice(at, 200)
                bounds, flat = part.offsets.to_numpy(), part.values
                flat = (flat.fill_null(-1) if flat.null_count else flat).to_numpy()
                texts = [use.decode(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.record_batch({"id": batch["id"].slice(at, 200), "ids": part, "text": pa.array(texts, pa.string())})
                at += 200

    kind = encoded.schema[id_col].dataType
    array = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", array), T.StructField("text", T.StringType())])
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast(array).alias("ids"))
    return source.mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids", "text")
