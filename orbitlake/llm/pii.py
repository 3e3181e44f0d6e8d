"""Personal data: high-recall generators propose spans, boosted trees choose among those that no fixed pattern settles.

The fixed patterns (e-mail, IP address, payment card, phone number) always stand. Generators also propose looser,
possibly overlapping spellings: national phone numbers, cards with other separators, spelled-out addresses, addresses
with bracketed dots. The trees see format and context, but nothing that the fixed patterns check (the plus sign, the
check digit, the range of an IP address's parts), and learn from which candidates pass those checks; so they can tell
a look-alike apart. Thresholds are calibrated per kind on candidates that were not fitted.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import boosting
from orbitlake.llm.words import string_array
from orbitlake.workspace import write_through

# Kinds in order, patterns of the contract, words that announce a kind
KINDS = ("email", "ip", "card", "phone")
NAME_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # what fails at the first digit of a run fails at the others
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "ruf"),
}
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Generators: looser spellings
NUMBER = re.compile(r"[0-9 ().+/\[\]-]{7,}+")  # whole runs: begins at a digit, parenthesis or plus sign, ends at a digit
NUMBER_BEGINS = re.compile(r"[0-9(+]")
AT = re.compile(r"@|[\[(]at[\])]| at (?=[A-Za-z0-9-]+(?: dot | ?[\[(]dot[\])] ?|\.)[A-Za-z])", re.I)
LOOSE_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]+(?:(?:\s?[\[(]dot[\])]\s?|\sdot\s|\.)[A-Za-z0-9-]+)+", re.I)
LOOSE_IP = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}")
LOOSE_CARD = re.compile(r"[0-9](?:[ ./-]?[0-9]){12,18}")
LOOSE_PHONE = re.compile(r"(?:\([0-9]{2,5}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}")

FEW_CELLS = 50_000  # distinct binned candidates, some 60 bytes each, from which the driver grows the trees itself
PRECISION = 0.97
CONTEXT = 30

Span = tuple[int, int, int]  # start, kind, end; sorts as the contract asks


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind, without those that fail their check."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:  # an address reaches back from its sign as far as its characters allow
        start = at
        while start > end and text[start - 1] in _NAME_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _numbers(text: str) -> list[tuple[int, int]]:
    """Where loose spellings of numbers may lie, at least seven characters each."""
    regions = []
    for run in NUMBER.finditer(text):
        begins = NUMBER_BEGINS.search(text, run.start(), run.end())
        end = run.start() + len(run[0].rstrip(" ().+/[]-"))
        if begins and end - begins.start() >= 7:
            regions.append((begins.start(), end))
    return regions


def candidates(text: str) -> list[Span]:
    """Spans of looser spellings; they may overlap."""
    found: set[Span] = set()
    for sign in AT.finditer(text):
        start = sign.start() - (text[sign.start() - 1 : sign.start()] == " " and sign[0] != " at ")
        name = start
        while name > 0 and text[name - 1] in _NAME_CHARS:
            name -= 1
        domain = LOOSE_DOMAIN.match(text, sign.end())
        if name < start and domain:
            found.add((name, 0, domain.end()))
    for low, high in _numbers(text):
        for kind, pattern in ((1, LOOSE_IP), (2, LOOSE_CARD), (3, LOOSE_PHONE)):
            for m in pattern.finditer(text, low, high):
                if kind != 3 or 7 <= len(_digits(m[0])) <= 15:
                    found.add((m.start(), kind, m.end()))
    return sorted(found)


def _side(c: str) -> float:
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, kind, end = span
    inner, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", inner) if g]
    digits = _digits(inner)
    breaks = [c for c in inner if not c.isalnum()]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(end - start),
        float(len(digits)),
        len(digits) / (end - start),
        float(len(breaks)),
        float(len(set(breaks))),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(groups[-1] if groups else 0),
        float(len(set(digits))),
        float(sum(c.isupper() for c in inner)),
        float(inner.count(".")),
        float(any(c in before for c in CUES[KINDS[kind]])),
        _side(text[start - 1 : start] if text[start - 1 : start] != "+" else text[max(0, start - 2) : max(0, start - 1)]),
        _side(text[end : end + 1]),
    ]


def passes(text: str, span: Span, base: list[Span]) -> bool:
    """Whether a match of the fixed pattern of its kind covers the candidate, or the candidate it."""
    start, kind, end = span
    return any(k == kind and s <= end and start <= e and min(e, end) - max(s, start) >= 0.6 * (end - start) for s, k, e in base)


@dataclass
class Model:
    trees: boosting.Boosted
    thresholds: list[float]

    def choose(self, text: str, found: list[Span], base: list[Span]) -> list[Span]:
        """Of the candidates that touch no base span, those over their kind's threshold; of overlapping ones the
        likeliest."""
        loose = [c for c in found if not any(s < c[2] and c[0] < e for s, _, e in base)]
        if not loose:
            return []
        p = self.trees.probability(np.array([features(text, c) for c in loose]))
        kept: list[Span] = []
        for i in np.lexsort((np.arange(len(loose)), -p)):
            start, kind, end = loose[i]
            if p[i] >= self.thresholds[kind] and not any(s < end and start < e for s, _, e in kept):
                kept.append(loose[i])
        return kept


FEATURES = 19
_CELL = "held boolean, kind int, label int, bins binary, n bigint"


def _examples(batches):
    """Kind, features and label of every candidate; those of a quarter of the texts are held out."""
    for batch in batches:
        held, kind, label, rows = [], [], [], []
        for text in string_array(batch["text"]).to_pylist():
            found = candidates(text)
            base = base_spans(text) if found else []
            out = zlib.crc32(text.encode("utf-8", "surrogatepass")) % 4 == 0 if found else False
            held += [out] * len(found)
            kind += [c[1] for c in found]
            label += [int(passes(text, c, base)) for c in found]
            rows += [features(text, c) for c in found]
        if rows:
            own = [pa.array(held), pa.array(kind, pa.int32()), pa.array(label, pa.int32()), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.record_batch(own, ["held", "kind", "label", "row"])


def _binned(trees: boosting.Boosted):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bins = trees.binned(np.array(batch["row"].to_pylist(), np.float64)).astype(np.uint8)
                own = [batch[c] for c in ("held", "kind", "label")]
                yield pa.record_batch([*own, pa.array([b.tobytes() for b in bins], pa.binary()), batch["n"]], ["held", "kind", "label", "bins", "n"])

    return run


def _bins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FEATURES).astype(np.int64)


def _cells(batch: pa.RecordBatch) -> boosting.Cells:
    return boosting.Cells(_bins(batch["bins"]), batch["label"].to_numpy(), batch["n"].to_numpy())


def _sums(cells: DataFrame) -> boosting.Sums:
    """Sums over cells in Spark: of every task one row per node, feature and bin."""

    def sums(model: boosting.Boosted, features: np.ndarray, cuts: np.ndarray, level: int) -> np.ndarray:
        shape = (2, 2**level, FEATURES, boosting.BINS + 1)

        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                total += _cells(batch).sums(model, features, cuts, level)
            slope, curve = total.reshape(2, -1)
            place = np.flatnonzero(curve)
            yield pa.record_batch([pa.array(place), pa.array(slope[place]), pa.array(curve[place])], ["place", "slope", "curve"])

        each = cells.mapInArrow(run, "place bigint, slope double, curve double").groupBy("place").agg(F.sum("slope"), F.sum("curve"))
        total = np.zeros((2, int(np.prod(shape[1:]))))
        for place, slope, curve in each.collect():
            total[:, place] = slope, curve
        return total.reshape(shape)

    return sums


def _rate(trees: boosting.Boosted):
    def run(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-trees.margin_of(_bins(batch["bins"]))))
            own = [batch["kind"], pa.array(p), batch["label"], batch["n"]]
            yield pa.record_batch(own, ["kind", "p", "label", "n"])

    return run


def _pool(batches):
    """Blocks of sorted rows, pooled as far as a task sees them; they are many fewer than its rows."""
    blocks: dict[int, list[boosting.Block]] = {}
    for batch in batches:
        for kind, p, positives, n in zip(*(batch[c].to_pylist() for c in ("kind", "p", "positives", "n"))):
            own = blocks.setdefault(kind, [])
            own.append((positives, n, p))
            if len(own) % 10_000 == 0:
                blocks[kind] = boosting.pooled(own)
    rows = [(kind, *block) for kind, own in blocks.items() for block in boosting.pooled(own)]
    if rows:
        yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["kind", "positives", "n", "low"])


def _thresholds(held: DataFrame, trees: boosting.Boosted) -> list[float]:
    """Per kind, from all held-out cells."""
    rated = held.mapInArrow(_rate(trees), "kind int, p double, label int, n bigint")
    each = rated.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("n")).alias("positives"), F.sum("n").alias("n"))
    blocks = each.repartitionByRange("kind", "p").sortWithinPartitions("kind", "p")
    rows = blocks.mapInArrow(_pool, "kind bigint, positives bigint, n bigint, low double").collect()
    by_kind = [sorted((r.low, r.positives, r.n) for r in rows if r.kind == k) for k in range(len(KINDS))]
    return [boosting.threshold_of([(positives, n, low) for low, positives, n in own], PRECISION) for own in by_kind]


def fit(docs: DataFrame, text_col: str = "text") -> Model | None:
    """Trees and thresholds from the candidates of all documents; None where there are no candidates of both sorts.

    Candidates are counted by bins and label. Of up to ``FEW_CELLS`` such cells the trees are grown in the driver, else
    every level of every tree is a pass over the cells; both add up the same whole units and give the same trees.
    Thresholds come from all candidates of a quarter of the texts, which the trees do not see.
    """
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_examples, "held boolean, kind int, label int, row array<double>")
    found = write_through(found.groupBy("held", "kind", "label", "row").agg(F.count("*").alias("n")), "pii-candidates")
    fitted = found.where("not held")
    quantiles = [F.percentile(F.col("row")[j], [float(q) for q in boosting.QUANTILES], F.col("n")).alias(f"q{j}") for j in range(FEATURES)]
    total = found.agg(F.sum("n")).first()[0] or 0
    seen = fitted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("positives"), *quantiles).first()
    if total < 40 or not seen.n or not 0 < seen.positives < seen.n:
        return None
    edges = [np.unique(seen[f"q{j}"]) for j in range(FEATURES)]
    cells = found.mapInArrow(_binned(boosting.Boosted(edges)), _CELL).groupBy("held", "kind", "label", "bins").agg(F.sum("n").alias("n"))
    cells = write_through(cells, "pii-cells")
    fitted = cells.where("not held")
    few = fitted.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    sums = _cells(fitted.toArrow().combine_chunks().to_batches()[0]).sums if few else _sums(fitted)
    trees = boosting.grow(edges, seen.positives / seen.n, sums)
    return Model(trees, _thresholds(cells.where("held"), trees))


def _search(model: Model | None, id_type: pa.DataType):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for text in string_array(batch["text"]).to_pylist():
                base = base_spans(text)
                more = model.choose(text, candidates(text), base) if model else []
                every = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in every])
            yield pa.record_batch({"id": batch["id"].cast(id_type), "spans": pa.array(rows, pa.list_(span))})

    return run


def find(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and spans, an array of (kind, start, end, base) by start, then kind as listed; bounds are
    code points, the end exclusive. ``base`` marks matches of the fixed patterns, which are always there.

    Null and empty texts have no spans. Repeated rows are searched each. Other columns are ignored. An empty table
    gives no rows. Without a model only base spans are found.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    span = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    schema = T.StructType([T.StructField("id", kind), T.StructField("spans", T._parse_datatype_string(span))])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_search(model, to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)


def redact(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            out += [text[at : span["start"]], f"<{span['kind']}>"]
        at = max(at, span["end"])
    return "".join(out) + text[at:]
