"""The thirteen operators over their whole tables, with the digests that they are compared by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefweave.llm.bpe import round_trip_digests, shipped_vocabulary
from prefweave.llm.columns import bound_batches
from prefweave.llm.conversations import audits, conversation_digests, ordered_turns, repaired_turns
from prefweave.llm.decontaminate import contamination
from prefweave.llm.exact_dedup import exact_duplicates, normalised
from prefweave.llm.language import fit_language_model, identified
from prefweave.llm.license_scan import license_scan
from prefweave.llm.line_dedup import line_duplicates
from prefweave.llm.near_dedup import near_duplicates
from prefweave.llm.periodic_runs import periodic_runs
from prefweave.llm.pii import KINDS as PII_KINDS
from prefweave.llm.pii import candidate_spans, decided, learn_spans
from prefweave.llm.quality import fit_quality, quality_score
from prefweave.llm.secret_scan import secret_spans
from prefweave.llm.simhash_dedup import simhash_duplicates
from prefweave.llm.storage import Shipped, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(text: Column | str) -> Column:
    return F.sha2(text, 256)


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts."""
    digest = {"text_sha256": sha(normalised(F.col("text")))}
    return exact_duplicates(table(spark, sf_dir, "documents"), carry=digest)


def joined_spans(kinds: Column, starts: Column, ends: Column, wanted: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined, of all spans or those of the `wanted` kinds."""
    spans = F.arrays_zip(kinds.alias("kind"), starts.alias("start"), ends.alias("end"))
    if wanted:
        spans = F.filter(spans, lambda s: s["kind"].isin(*wanted))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == kind)).cast("bigint")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    bound_batches(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("s")).select("doc_id", "s.*")
    kind, start, end = F.col("kind"), F.col("start"), F.col("end")
    return found.select(
        "doc_id",
        *[count_of(kind, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        sha(joined_spans(kind, start, end, ("assign", "access", "hex"))).alias("base_sha256"),
        joined_spans(kind, start, end).alias("spans"),
    )


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    bound_batches(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", license_scan(F.col("text")).alias("s"))
    return found.select("doc_id", "s.*").drop("similarity").withColumn("spans", F.array_join("spans", ","))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    bound_batches(spark)
    vocabulary = shipped_vocabulary(spark, word_vocabulary())
    coded = round_trip_digests(F.col("text"), vocabulary)
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("c")).select("doc_id", "c.*")


def held_out() -> Column:
    """Rows that nothing may be learned from: crc32 of the id leaves 2 when divided by 4. Null ids are not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from trusted positives and unlabelled documents."""
    bound_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trusted = (
        labels.filter(F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .filter("quality = 1").select("doc_id")
    )
    model = fit_quality(docs.select("doc_id", "text").filter(~held_out()), trusted)
    shipped = Shipped(spark, model)
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(F.col("text"), shipped).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.select("doc_id", "text", "lang").filter(~held_out()))
    shipped = Shipped(spark, model)
    found = docs.select("doc_id", held_out().alias("held_out"), identified(F.col("text"), shipped).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), "f.score", "f.rejected")


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = written(docs.select("doc_id", candidate_spans(F.col("text")).alias("c")).select("doc_id", "c.*"))
    spans = decided(found, learn_spans(found)).withColumn("base", F.filter("spans", lambda s: s["strict"]))

    def joined(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return spans.select(
        "doc_id",
        *[count_of(F.col("base.kind"), kind).alias(f"n_{kind}") for kind in PII_KINDS],
        sha(joined("base")).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha(F.array_join("items", ",")).alias("items_sha256"),
        "contaminated",
    )


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    bound_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that an earlier occurrence makes needless."""
    bound_batches(spark)
    found = line_duplicates(table(spark, sf_dir, "documents"))
    n_dropped = F.size("dropped").cast("bigint")
    return found.select(
        "doc_id", "n_lines", (F.col("n_lines") - n_dropped).alias("n_kept"), n_dropped.alias("n_dropped"),
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"),
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in the tenth of documents whose crc32 of the id ends in 0, the words from one place on are repeated."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    # The words are a column of their own, for few rows, so that they are split once.
    split = docs.select("doc_id", "text", F.expr("crc32(CAST(doc_id AS STRING)) DIV 10").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    placed = split.withColumn("n", F.size("w")).withColumn("a", F.expr("CAST(g % n AS INT)"))
    placed = placed.withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    repeated = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), CAST((n - a + p - 1) DIV p AS INT))), 1, n - a)")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", 1, F.col("a")), repeated), " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some of which are given a run first."""
    bound_batches(spark)
    docs = planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", periodic_runs(F.col("text")).alias("r")).select("doc_id", "r.*")
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    first = found.withColumn("top", F.array_min(ranked))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return first.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.s").alias("start"),
        (-F.col("top.l")).alias("length"),
        F.col("top.p").alias("period"),
        F.expr("-1000 * top.l DIV top.p").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha("collapsed").alias("collapsed_sha256"),
    )


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Conversations with turns dropped, emptied, cut, repeated or given to the user, by crc32 of `conv_id:turn`."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text, role, kind = F.coalesce("text", blank), F.coalesce("role", blank), F.col("kind")
    told = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("kind"))
    changed = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    rows = told.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")
    )
    return rows.drop("copy")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged first: what is wrong with it, and the cheapest repair."""
    bound_batches(spark)
    conversations = table(spark, sf_dir, "conversations")
    ordered = ordered_turns(damaged_turns(conversations))
    audited = written(audits(ordered))
    digests = conversation_digests(repaired_turns(ordered, audited)).withColumnRenamed("conv", "_conv")
    every = conversations.select("conv_id").distinct()
    found = every.join(audited, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    found = found.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", sha(F.lit(""))).alias("repaired_sha256"),
    )


@query
def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with close SimHash fingerprints."""
    bound_batches(spark)
    found = simhash_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
