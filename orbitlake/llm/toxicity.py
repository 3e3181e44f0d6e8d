"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers each read the tags of a clause and say what they know: whether an insult is negated, whether it is
reported speech, whether somebody is addressed. Their composition, one machine over product states, reads a clause
once and scores what it matches: an insult by its own weight, in a state that says how it was meant. The lexicon of
insults and its weights, and the weight of every kind of match, are learned from labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import words as W

# Seed lexicons
INSULTS = "idiot idiots stupid moron morons scum trash loser losers worthless pathetic disgusting clown dumb fool vermin filth".split()
THREATS = "kill hurt destroy beat smash stab shoot burn murder crush punish töten tuer matar".split()
TARGETS = "you your yours u he him his she her they them their du dich dein ihr euch tu te toi vous ton sie usted eres tú él ella".split()
NEGATIONS = "not never no nobody isn't aren't wasn't don't nicht kein keine nie pas jamais ne nunca jamás ningún".split()
REPORTS = "said says saying called calls wrote writes quoted reported claims claimed told sagte dit dijo según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEEDS = {INSULT: INSULTS, THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
REACH = 4  # words over which a negation or a target bears on what follows
KINDS = ("plain", "aimed", "negated", "reported", "threat")

LABELLED_DOCUMENTS = 20_000  # labelled documents learned from at most, chosen by a hash of the id
LEXICON = 5_000  # learned words at most
LEAST_DOCUMENTS = 3
LEAST_ODDS = 2.0  # least log odds of a learned word
SEED_ODDS = 4.0
STEM = 7  # bytes of a word's beginning that stand for an unknown word

_WORD = np.ones(256, bool)  # blank: every ASCII character that is no letter, digit, apostrophe or underscore
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, 95, *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:\n"]] = True


# --- transducers -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """States 0 … n - 1 (0 the start); ``step[state][tag]`` is the next state, ``says[state]`` what holds for the word
    read next."""

    step: tuple[tuple[int, ...], ...]
    says: tuple[str, ...]


def within_reach(tag: int, said: str, reach: int) -> Transducer:
    """Says ``said`` for ``reach`` words after a ``tag``."""
    rows = [tuple(reach if t == tag else max(0, s - 1) for t in range(6)) for s in range(reach + 1)]
    return Transducer(tuple(rows), ("", *[said] * reach))


def from_then_on(tag: int, said: str) -> Transducer:
    """Says ``said`` after a ``tag`` to the end of the clause."""
    return Transducer((tuple(int(t == tag) for t in range(6)), (1,) * 6), ("", said))


def compose(parts: list[Transducer]) -> tuple[np.ndarray, list[frozenset[str]]]:
    """One machine over the product of the parts' states: its steps, and what its states say together."""
    states = list(product(*(range(len(p.step)) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    step = np.array([[number[tuple(p.step[x][t] for p, x in zip(parts, s))] for t in range(6)] for s in states])
    return step, [frozenset(p.says[x] for p, x in zip(parts, s)) - {""} for s in states]


STEP, SAYS = compose([within_reach(NEGATION, "negated", REACH), within_reach(TARGET, "aimed", REACH), from_then_on(REPORT, "reported")])


def _kind(tag: int, said: frozenset[str], target_later: bool) -> str | None:
    """What a match is: a threat needs somebody it is aimed at; negation and report outrank the target."""
    aimed = "aimed" in said or target_later
    if tag == THREAT and not aimed:
        return None
    for kind in ("negated", "reported"):
        if kind in said:
            return kind
    return "threat" if tag == THREAT else "aimed" if aimed else "plain"


def clause_matches(clause: list[tuple[int, int, float]]):
    """(kind, weight) of the matches in a clause, given as (place, tag, weight) of its tagged words."""
    state, at = 0, 0
    targets = [place for place, tag, _ in clause if tag == TARGET]
    for place, tag, weight in clause:
        for _ in range(min(place - at, REACH + 1)):  # beyond that, other words change nothing
            state = STEP[state, OTHER]
        if tag in (INSULT, THREAT):
            kind = _kind(tag, SAYS[state], any(0 < t - place <= REACH for t in targets))
            if kind:
                yield kind, weight
        state, at = STEP[state, tag], place + 1


# --- tagging -----------------------------------------------------------------------------------------------------------


def _words(texts: pa.Array) -> W.Words:
    return W.split(texts, lower=True, blank=_WORD)


def _stems(words: W.Words) -> np.ndarray:
    """Hash of the first bytes of every longer word; 0 for the others."""
    longer = words.ends - words.starts > STEM
    found = np.zeros(len(words.starts), np.uint64)
    found[longer] = W.byte_hashes(words.data, words.starts[longer], words.starts[longer] + STEM, salt=6)
    return found


@dataclass
class Lexicon:
    """Sorted hashes of words and stems with tag and weight."""

    hashes: np.ndarray
    tags: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, learned: dict[int, float]) -> Lexicon:
        known: dict[int, tuple[int, float]] = {}
        for tag, seeds in SEEDS.items():
            words = W.split(pa.array(seeds, pa.large_string()), lower=True, blank=_WORD)
            known.update({int(h): (tag, SEED_ODDS) for h in words.hashes})
        for h, odds in learned.items():  # what labels say about an insult outranks the seed's weight
            if known.get(h, (INSULT,))[0] == INSULT:
                known[h] = (INSULT, odds)
        hashes = np.array(sorted(known), np.uint64)
        tags, weights = zip(*(known[int(h)] for h in hashes))
        return cls(hashes, np.array(tags), np.array(weights))

    def tag(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.tags[at], OTHER), np.where(known, self.weights[at], 0.0)


N_FEATURES = 2 * len(KINDS) + 3


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: matches and their weight of every kind, the strongest clause, weight per word, and length."""
    words = _words(texts)
    tags, weights = lexicon.tag(words.hashes)
    stem_tags, stem_weights = lexicon.tag(_stems(words))
    unknown = tags == OTHER
    tags[unknown], weights[unknown] = stem_tags[unknown], stem_weights[unknown]
    stops = np.concatenate([[0], np.cumsum(_STOP[words.data])])
    clause = stops[words.starts]
    counts = words.counts()
    text = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros((len(counts), N_FEATURES))
    out[:, -1] = np.log1p(counts)
    # clauses that hold an insult or a threat; all others score nothing
    group = text.astype(np.int64) * (int(stops[-1]) + 1) + clause
    hot = np.unique(group[(tags == INSULT) | (tags == THREAT)])
    rows = np.flatnonzero((tags != OTHER) & np.isin(group, hot))
    first = np.searchsorted(group, group[rows])
    edges = np.flatnonzero(np.diff(group[rows], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(rows))):
        own, total = rows[a:b], 0.0
        d = text[own[0]]
        for kind, weight in clause_matches(list(zip((own - first[a:b]).tolist(), tags[own].tolist(), weights[own].tolist()))):
            k = KINDS.index(kind)
            out[d, 2 * k] += 1
            out[d, 2 * k + 1] += weight
            total += weight
        out[d, -3] = max(out[d, -3], total)
    matched = out[:, 1 : 2 * len(KINDS) : 2].sum(axis=1)
    out[:, -2] = 100 * matched / np.maximum(counts, 20)
    out[:, : 2 * len(KINDS)] = np.log1p(out[:, : 2 * len(KINDS)])
    return out


# --- learning ----------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        x = (features(texts, self.lexicon) - self.mean) / self.scale
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


def _counted(batches):
    """Documents of either label that hold a word or stem, per batch."""
    for batch in batches:
        found = []
        for at, texts in W.slices(batch["text"]):
            words = _words(texts)
            text = np.repeat(np.arange(len(texts)), words.counts())
            toxic = np.array(batch["toxic"].slice(at, len(texts)).to_pylist(), bool)
            for hashes in (words.hashes, _stems(words)):
                order = np.lexsort((hashes, text))
                h, t = hashes[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                found.append((h[new & (h != 0)], toxic[t[new & (h != 0)]]))
        if found:
            hashes, toxic = (np.concatenate(x) for x in zip(*found))
            keys, place = np.unique(hashes, return_inverse=True)
            ones = np.bincount(place, toxic, len(keys)).astype(np.int64)
            yield pa.record_batch({"hash": pa.array(keys.view(np.int64)), "toxic": pa.array(ones), "clean": pa.array(np.bincount(place, minlength=len(keys)) - ones)})


def _featured(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            for at, texts in W.slices(batch["text"]):
                x = features(texts, lexicon)
                yield pa.record_batch({"toxic": batch["toxic"].slice(at, len(texts)), "x": pa.array(list(x), pa.list_(pa.float64()))})

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps for logistic regression; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the documents that ``labels`` (id, label 0 or 1) names, from about ``LABELLED_DOCUMENTS`` of them at
    most, drawn by a hash of the id; the drawn labels are what is broadcast. Null labels and ids are left out, null texts
    are empty. Without both labels the seeds alone decide."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("toxic"))
    share = min(1.0, LABELLED_DOCUMENTS / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit("labels")), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("text"))
    rows = texts.join(F.broadcast(drawn), F.col("_id") == F.col("id")).select("text", "toxic")
    ones, total = rows.agg(F.sum(F.col("toxic").cast("int")), F.count("*")).first()
    if not ones or ones == total:
        return Model(Lexicon.of({}), np.zeros(N_FEATURES), np.ones(N_FEATURES), np.eye(N_FEATURES)[-3], -SEED_ODDS / 2)
    counts = rows.mapInArrow(_counted, "hash long, toxic long, clean long").groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (ones + 1)) - F.log((F.col("clean") + 0.5) / (total - ones + 1))
    telling = counts.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    best = telling.orderBy(F.desc("odds"), F.desc("toxic"), "hash").limit(LEXICON).collect()
    lexicon = Lexicon.of({r["hash"] & (2**64 - 1): r["odds"] for r in best})
    seen = rows.mapInArrow(_featured(lexicon), "toxic boolean, x array<double>").collect()
    x, y = np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float)
    order = np.lexsort((*x.T[::-1], y))  # the order of tasks must not show
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights, bias = _logistic((x - mean) / scale, y)
    return Model(lexicon, mean, scale, weights, bias)


def _scored(model: Model, id_type: pa.DataType):
    def run(batches):
        for batch in batches:
            for at, texts in W.slices(batch["text"]):
                yield pa.record_batch({"id": batch["id"].slice(at, len(texts)).cast(id_type), "score": pa.array(model.score(texts))})

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and score, from 0 to 1.

    Null texts score like empty ones. Repeated rows score alike. Only the text enters a score. An empty table gives no
    rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(_scored(model, to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)
