"""One query per operator: (spark, folder of test tables) → DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm import align, bpe, decontaminate, importance, jaccard_join, line_dedup, oracle, packing, pii, runs, substring_dedup, topk_search, toxicity, warc
from orbitlake.llm.sizes import broadcast_if_small
from orbitlake.session import ship_package
from orbitlake.workspace import fresh_path, write_through

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, folder, "documents"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    """Learned from the labelled documents that are not held out."""
    return toxicity.fit(table(spark, folder, "documents"), table(spark, folder, "labels").where(~held_out()))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(table(spark, folder, "documents"), toxicity_model(spark, folder))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    usual = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = table(spark, folder, "embeddings").where(usual).select("vec_id", scaled.alias("embedding"))
    found = topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
    return found.withColumn("score", F.col("score").cast("long"))


def op4_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = broadcast_if_small(table(spark, folder, "labels").where("quality = 1").select("doc_id"))
    good = docs.join(good, "doc_id", "left_semi")
    return importance.resample(docs, good)


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), keep_ids=False)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), path)
    stated = F.regexp_extract(F.decode("metadata.payload", "UTF-8"), "(?m)^id: (-?[0-9]+)", 1)
    found = warc.captures(warc.read_warc(spark, path)).select(
        F.when(stated != "", stated.cast("long")).alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        "record_id",
        F.col("refers_to").alias("first_record"),
    )
    found = write_through(found, "captures")
    firsts = found.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"))
    firsts = write_through(firsts.dropDuplicates(["_id"]), "responses")
    return found.join(firsts, F.col("first_record") == F.col("_id"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _base_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    base = _joined(F.filter("spans", lambda s: s["base"]))
    return pii.find(docs, pii.fit(docs)).select(
        "doc_id", *map(_base_count, pii.KINDS), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.repeated_spans(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents"))


def _crc(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten repeats the words from some place on; a document without an id stays as it is."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    planted = docs.select("doc_id", "text", F.when(_crc() % 10 == 0, words).alias("_words")).withColumn("_n", F.size("_words"))
    g = F.floor(_crc() / 10)
    planted = planted.withColumn("_a", g % F.col("_n")).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    n, a, p = (F.col(c).cast("int") for c in ("_n", "_a", "_p"))
    period = F.slice("_words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.when(F.col("_n") > 0, F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    return planted.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    # the greatest by length, then by least start and period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.s")).alias("start"),
        F.col("_longest.l").alias("length"),
        (-F.col("_longest.p")).alias("period"),
        F.expr("1000 * _longest.l div -_longest.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(table(spark, folder, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = align.align(table(spark, folder, "documents"), keep=lambda groups: F.sha2(groups, 256))
    digest = F.coalesce("groups", F.lit("")).alias("groups_sha256")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def queries() -> dict[str, Query]:
    every = (
        op1_line_dedup,
        op2_toxicity,
        op3_topk_search,
        op4_importance_resampling,
        op5_best_fit_packing,
        op6_warc,
        op7_benchmark_decontamination,
        op8_pii,
        op9_substring_dedup,
        op10_jaccard_join,
        op11_periodic_runs,
        op12_bpe_round_trip,
        op13_token_alignment,
    )
    return {query.__name__: query for query in every}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
