"""Fuzzy line deduplication: MinHash over character shingles, exact verification, union-find. Column functions only.

A shingle is the run of eight characters from any character of a line onwards. Signatures are minima of the shingles' hashes under fixed
exclusive-ors, which Spark computes as plain aggregates. Lines that agree in a band of minima are compared with one
line of that band, its hub; those that reach the Jaccard threshold are linked. Of the other pairs of a
band, those that these links already join need no comparison; all the rest are compared. Before two lines are compared
by their shingles, sketches of their sets rule out most of those that are too different.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake.llm.components import components
from orbitlake.llm.sizes import broadcast_if_small
from orbitlake.workspace import write_through

THRESHOLD = 0.75
CHARACTERS = 8  # of a shingle
WIDTH = 4  # bytes of a character in UTF-32
SKETCH = 16  # words of a sketch of a set, a power of two; it tells apart sets of up to some 100 shingles a word
BANDS, ROWS = 8, 3  # a pair of similarity 0.75 shares a band with probability 0.988, one of 0.9 with 0.9999
#: Fixed pseudo-random masks: each makes another order of the hashes.
MASKS = [(0x9E3779B1 * (i + 1) ^ 0x85EBCA77 * (i * i + 7)) % 2**32 - 2**31 for i in range(BANDS * ROWS)]
#: Bytes of a line from which on only hashes that share so many first bits with the least of a mask are minded.
DEPTHS = {5: 256, 6: 512}


def _characters(line: Column) -> Column:
    """A line in lower case with four bytes a character, so that each is found at once, however far from the start."""
    return F.encode(F.lower(line), "UTF-32")


def _each_shingle(line: Column, made: Callable[[Column], Column]) -> Column:
    """What ``made`` makes of every shingle of a line, a shingle being given as the bytes of its characters."""
    reach = WIDTH * CHARACTERS

    def of(characters: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(characters) - (reach - 1), F.lit(1)), F.lit(WIDTH))
        return F.transform(starts, lambda i: made(F.substring(characters, i, F.lit(reach))))

    # an array of one element, so that the characters are made once and not at every shingle
    return F.transform(F.array(_characters(line)), of)[0]


def shingles(line: Column) -> Column:
    """Character shingles of a line in lower case, one from every character; a shorter line is one shingle."""
    return _each_shingle(line, lambda s: F.decode(s, "UTF-32"))


def _hashes(line: Column) -> Column:
    """The hash of every shingle of a line, repeated ones included."""
    return _each_shingle(line, F.xxhash64)


def _is_blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def _lines(rows: DataFrame) -> DataFrame:
    """(key, id, line_no, line) of every line; ``rows`` has key, id and text."""
    # here and below: what never is empty goes through an outer generator, since Spark would make it twice otherwise, once
    # in a filter of its own for empty ones
    return rows.where(F.col("text").isNotNull()).select("key", "id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))


def _minima(lines: DataFrame, depths: dict[int, int]) -> DataFrame:
    """(line_id, bands, sure): the hash of each band of minima, for every distinct line that is not blank. A line of at
    least ``depths[k]`` bytes only minds hashes that share their first k bits with what a mask has least, as the minimum
    does unless no hash does: then ``sure`` is false."""
    lower = F.lower("line")
    octets = F.octet_length(lower)
    # a line of one-byte characters needs no look at where they start; either way the hash is that of the shingle as a string
    narrow = octets == F.length(lower)
    depth, minded = F.lit(1), F.lit(3).cast("long")
    for k in sorted(depths):
        bits = sum(1 << prefix for prefix in {(m % 2**32 ^ 2**31) >> 32 - k for m in MASKS})
        deep = octets >= depths[k]
        depth, minded = F.when(deep, k).otherwise(depth), F.when(deep, F.lit((bits + 2**63) % 2**64 - 2**63).cast("long")).otherwise(minded)
    rows = lines.where(~_is_blank(F.col("line"))).select(
        F.xxhash64("line").alias("line_id"),
        lower.cast("binary").alias("bytes"),
        narrow.alias("narrow"),
        F.when(narrow, CHARACTERS).otherwise(WIDTH * CHARACTERS).alias("reach"),
        F.sequence(F.lit(0), octets - F.octet_length(F.right(lower, F.lit(CHARACTERS)))).alias("starts"),
        depth.alias("depth"),
        minded.alias("minded"),
    )
    starts = rows.select("line_id", "bytes", "narrow", "reach", "depth", "minded", F.explode_outer("starts").alias("start"))
    ahead = starts.select("line_id", "narrow", "depth", "minded", "start", F.substring("bytes", F.col("start") + 1, F.col("reach")).alias("ahead"))
    begins = (F.col("ahead") < F.lit(b"\x80")) | (F.col("ahead") >= F.lit(b"\xc0"))  # a character, and is not within one
    h = F.when(F.col("narrow"), F.hash("ahead")).when(begins, F.hash(F.substring(F.col("ahead").cast("string"), 1, CHARACTERS)))
    # out of a generator, so that Spark does not make the hash again in the filter
    hashed = ahead.select("line_id", "depth", "minded", "start", F.explode(F.array(h)).alias("h"))
    is_minded = F.expr("getbit(minded, shiftrightunsigned(h, 32 - depth)) > 0")
    # the first one stays, so that no line goes
    hashed = hashed.where(F.col("h").isNotNull() & ((F.col("start") == 0) | is_minded))
    least = hashed.groupBy("line_id", "depth").agg(*(F.min(F.col("h").bitwiseXOR(F.lit(m).cast("int"))).alias(f"m{i}") for i, m in enumerate(MASKS)))
    bands = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)]
    greatest = F.greatest(*(f"m{i}" for i in range(len(MASKS)))).cast("long")
    sure = (F.col("depth") == 1) | (greatest < F.expr("shiftleft(1L, 32 - depth)") - 2**31)
    return least.select("line_id", F.array(*bands).alias("bands"), sure.alias("sure"))


def _signatures(lines: DataFrame) -> DataFrame:
    """(line_id, bands): the hash of each band of minima, for every distinct line that is not blank. The few lines whose
    minima are not sure are read again."""
    made = write_through(_minima(lines, DEPTHS), "line-signatures")
    unsure = broadcast_if_small(made.where("not sure").select(F.col("line_id").alias("_line_id")))
    left = lines.join(unsure, F.xxhash64("line") == F.col("_line_id"), "left_semi")
    again = write_through(_minima(left, {}), "unsure-signatures")
    return made.where("sure").unionByName(again).select("line_id", "bands")


def _bands(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line_id, band) of all lines, and (band, n, least, most) of the bands that lines share."""
    held = signatures.select("line_id", F.explode("bands").alias("band"))
    groups = held.groupBy("band").agg(F.count("*").alias("n"), F.min("line_id").alias("least"), F.max("line_id").alias("most"))
    return held, write_through(groups.where("n > 1"), "bands")


def _large(held: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, line_id, hub) of the bands that more than two lines share. All other bands of all lines stay where they are,
    unless these bands are too many to broadcast. The hub of a band is the line of it that meets the most lines in all its
    bands: what the others are copies of shares more bands with them than they do with each other."""
    several = broadcast_if_small(groups.where("n > 2").select("band", "n"))
    rows = write_through(held.join(several, "band").select("band", "line_id", "n"), "large-rows")
    met = write_through(rows.groupBy("line_id").agg(F.sum("n").alias("met")), "met-lines")
    hubs = rows.join(met, "line_id").groupBy("band").agg(F.max(F.struct("met", "line_id"))["line_id"].alias("hub"))
    return write_through(rows.join(write_through(hubs, "hubs"), "band").select("band", "line_id", "hub"), "large-bands")


def _candidates(groups: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines that share a band: each with the hub of it."""
    small = groups.where("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b"))
    rays = large.where("line_id <> hub").select(F.least("line_id", "hub").alias("a"), F.greatest("line_id", "hub").alias("b"))
    return small.unionByName(rays).distinct()


def _sketches(texts: DataFrame) -> DataFrame:
    """(line_id, size, p0, p1, …): size of the set of hashes of each line, and its parities: bit i of word j says whether
    an odd number of hashes fall there. Two sets differ in at least as many hashes as their parities differ in bits."""
    # dealt by line, so that both sums of a line are made where its hashes are; word by word, so that a hash is added once
    hashes = texts.repartition("line_id").select("line_id", F.explode_outer(F.array_distinct(_hashes(F.col("line")))).alias("h"))
    word = F.shiftright("h", 6).bitwiseAND(F.lit(SKETCH - 1)).alias("word")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = hashes.groupBy("line_id", word).agg(F.count("*").alias("n"), F.bit_xor(bit).alias("bits"))
    parities = [F.bit_xor(F.when(F.col("word") == j, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"p{j}") for j in range(SKETCH)]
    return words.groupBy("line_id").agg(F.sum("n").alias("size"), *parities)


def _of(side: str, columns: list[str]) -> list[Column]:
    return [F.col(c).alias(f"{c}_{side}") for c in columns]


def _near(percent: int) -> Column:
    """Whether the sketches of a and b leave it open that they reach the threshold."""
    # sets that reach it differ in at most (100 - percent) / (100 + percent) of the sum of their sizes
    least, most = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    apart = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(SKETCH)), F.lit(0))
    return (100 * least >= percent * most) & ((100 + percent) * apart <= (100 - percent) * (least + most))


def _near_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, size_a, size_b) of the pairs that their sketches do not rule out."""
    of_set = sketches.columns[1:]
    one, two = (sketches.select(F.col("line_id").alias(side), *_of(side, of_set)) for side in "ab")
    return pairs.join(one, "a").join(two, "b").where(_near(percent)).select("a", "b", "size_a", "size_b")


def _other_pairs(large: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, size_a, size_b) of the lines that share a band, are not in one component, and that ``_candidates`` left out,
    but for those that their sketches rule out."""
    large = large.join(roots, F.col("line_id") == F.col("node"), "left")
    large = large.select("band", "line_id", "hub", F.coalesce("root", "line_id").alias("component"))
    large = write_through(large, "large-components")
    # a pair of which one line is the hub has been compared
    large_open = large.where("line_id <> hub").drop("hub")
    several = large_open.groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d")
    several = write_through(several.select("band"), "open-bands")
    open_lines = large_open.join(several, "band", "left_semi").groupBy("line_id", "component").agg(F.sort_array(F.collect_set("band")).alias("bands"))
    each = open_lines.join(sketches, "line_id").select("*", F.posexplode("bands").alias("at", "band"))
    each = write_through(each, "open-sketches")
    of_line = [c for c in each.columns if c != "band"]
    one, two = each.select("band", *_of("a", of_line)), each.select(F.col("band").alias("_band"), *_of("b", of_line))
    ordered = (F.col("line_id_a") < F.col("line_id_b")) & (F.col("component_a") != F.col("component_b"))
    # a pair is made in the first band that its lines share, and nowhere else; a function of an element also keeps Spark
    # from making one method of the join, too long for the JVM to compile
    first = ~F.exists(F.slice("bands_a", F.lit(1), F.col("at_a")), lambda band: F.array_contains("bands_b", band))
    pairs = one.join(two, (F.col("band") == F.col("_band")) & ordered & _near(percent) & first)
    return pairs.select(F.col("line_id_a").alias("a"), F.col("line_id_b").alias("b"), "size_a", "size_b")


def _texts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_id, line) of the lines of ``pairs``, each once."""
    wanted = pairs.select(F.col("a").alias("line_id")).unionByName(pairs.select(F.col("b").alias("line_id"))).distinct()
    wanted = broadcast_if_small(write_through(wanted, "candidate-lines"))
    found = lines.select(F.xxhash64("line").alias("line_id"), "line").join(wanted, "line_id", "left_semi")
    return write_through(found.dropDuplicates(["line_id"]), "line-texts")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets of shingles reach the threshold; ``pairs`` tells their sizes. The lines travel to the pairs, not
    their sets, which take eight bytes a character; a pair makes its two sets where it is compared."""
    one, two = (texts.select(F.col("line_id").alias(side), F.col("line").alias(f"line_{side}")) for side in "ab")
    common = F.size(F.array_intersect(_hashes(F.col("line_a")), _hashes(F.col("line_b"))))
    reached = (100 + percent) * common >= percent * (F.col("size_a") + F.col("size_b"))
    return pairs.join(one, "a").join(two, "b").where(reached).select("a", "b")


def line_links(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Links (a, b) between the ids (64-bit hashes) of different lines whose Jaccard similarity reaches ``threshold``:
    as many as join all the lines that pairs sharing a band would join."""
    lines = _lines(docs.select(F.lit(None).alias("key"), F.lit(None).alias("id"), F.col(text_col).alias("text")))
    percent = round(100 * threshold)
    held, groups = _bands(_signatures(lines))
    large = _large(held, groups)
    pairs = write_through(_candidates(groups, large), "line-pairs")
    texts = _texts(pairs, lines)
    sketches = write_through(_sketches(texts), "line-sketches")
    near = write_through(_near_pairs(pairs, sketches, percent), "near-pairs")
    links = write_through(_verified(near, texts, percent), "line-links")
    others = write_through(_other_pairs(large, components(links, "a", "b"), sketches, percent), "other-pairs")
    return links if others.isEmpty() else links.unionByName(_verified(others, texts, percent))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text); the key stands for rows of equal id and text."""
    return docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def line_decisions(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, keep) per document: keep has a truth value for every line."""
    rows = _keyed(docs, id_col, text_col)
    places = _lines(rows).select("key", "id", "line_no", F.when(~_is_blank(F.col("line")), F.xxhash64("line")).alias("line_id"))
    places = write_through(places, "line-places")
    roots = components(write_through(line_links(docs, threshold, text_col), "line-links"), "a", "b")
    first = places.where("line_id is not null").groupBy("line_id").agg(F.min(F.struct("id", "key", "line_no")).alias("first"))
    grouped = first.join(roots, F.col("line_id") == F.col("node"), "left").groupBy(F.coalesce("root", "line_id").alias("component"))
    kept = grouped.agg(F.min("first").alias("first")).select(F.col("first.key").alias("_key"), F.col("first.line_no").alias("_line_no"))
    kept = write_through(kept, "kept-lines")
    same = (F.col("key") == F.col("_key")) & (F.col("line_no") == F.col("_line_no"))
    told = places.join(kept, same, "left").select("key", F.struct("line_no", (F.col("line_id").isNull() | F.col("_key").isNotNull()).alias("keep")).alias("line"))
    return told.groupBy("key").agg(F.transform(F.array_sort(F.collect_set("line")), lambda x: x["keep"]).alias("keep"))


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_lines, n_removed and removed, the numbers (from 0) of the lines to leave out."""
    told = line_decisions(docs, threshold, id_col, text_col).withColumnRenamed("key", "_key")
    rows = _keyed(docs, id_col, text_col).select("key", "id").join(told, F.col("key") == F.col("_key"), "left")
    numbered = F.transform("keep", lambda k, i: F.when(~k, i))
    removed = F.coalesce(F.filter(numbered, lambda i: i.isNotNull()), F.array().cast("array<int>"))
    return rows.select(
        F.col("id").alias(id_col),
        F.coalesce(F.size("keep"), F.lit(0)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"),
        removed.alias("removed"),
    )


def dedup_lines(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False
) -> DataFrame:
    """``docs`` with one line of every component of similar lines left, the first by id and line number.

    Lines end at a line feed. Blank lines always stay. Null texts stay null. A text that loses all its lines holds its
    blank ones only, or nothing; with ``drop_emptied`` such rows go, but not those that were blank before. Rows that repeat id and text keep the same lines; rows without an id come first. All columns are kept. An
    empty table stays empty. Similarity is that of the sets of ``shingles``; candidate search is by MinHash and finds
    pairs with the probability stated at ``BANDS``.
    """
    told = line_decisions(docs, threshold, id_col, text_col)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.xxhash64(id_col, text_col).alias("_key"))
    joined = rows.join(told, F.col("_key") == F.col("key"), "left")
    left = F.filter(F.split(F.col("row")[text_col], "\n"), lambda line, i: F.col("keep")[i])
    made = joined.select("row", F.array_join(left, "\n").alias("made"))
    if drop_emptied:
        emptied = _is_blank(F.col("made")) & ~_is_blank(F.col("row")[text_col])
        made = made.where(~F.coalesce(emptied, F.lit(False)))
    return made.select(*((F.col("made") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
