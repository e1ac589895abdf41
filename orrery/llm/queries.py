"""The queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm import chat, decontaminate, language_id, merkle, near_dedup, packing, periodic, quality_rules, secret_scan, sharding
from orrery.llm import suffix_dedup, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's measurements, failure bits and verdict under the policies base and v1."""
    book = quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "failed_bits",
        (~F.col("kept_base")).alias("base_failed"),
        F.col("kept_v1").alias("kept"),
    )


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's findings: counts of the base kinds, their digest, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "findings")
    base = F.filter("findings", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    n = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(n(kind) for kind in secret_scan.BASE_KINDS),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed("findings").alias("spans"),
    )


def _fold(n: int) -> Column:
    """crc32(doc_id as text) mod n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(-1))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_fold(3).isin(0, 2)).select("doc_id", "text", "lang"))
    got = docs.select("doc_id", "text").withColumn("got", language_id.predictor(docs, model))
    return got.select("doc_id", (_fold(3) == 1).alias("held_out"), "got.lang_pred", "got.score")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    scored = docs.withColumn("score", toxicity.scorer(docs, model))
    return scored.select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item of which it covers half or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match(docs, table(spark, sf_dir, "benchmark"), only=True).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.coverage", "m.n_tiles", "m.longest_tile")


def byte_bpe() -> packing.Encoder:
    """The vocabulary byte_bpe_50k, with id 1 after each text."""
    import public_tokenizers

    return packing.Encoder(
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        closing=1,
    )


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), byte_bpe())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of nearly equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, found again through the capture index, and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index, _ = warc.archive(spark, pages)
    found = warc.lookup(index, warc.keys_of(pages))
    back = warc.read_records(found)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 that also start elsewhere."""
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return cut.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        "kept_sha256",
    )


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of 85 percent similarity."""
    found = near_dedup.link(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _crc32(doc_id: Column) -> Column:
    """Unsigned crc32 of the decimal id; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest, and the root that its text, tampered with or not, gives with it."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    struck = F.coalesce(_crc32(F.col("doc_id")) % 5 == 0, F.lit(False))
    others = (F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS)
    carried = {"doc_id": F.col("doc_id"), "altered": F.when(struck, merkle.leaf(*others))}
    found = merkle.proofs(docs, FIELDS, "source", "doc_id", carried)
    again = found.withColumn("folded_root", merkle.folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return again.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _looped(text: Column, doc_id: Column) -> Column:
    """The text whose words from some place on go round, in a tenth of all documents."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = _crc32(doc_id)
    g = F.floor(h / 10)

    def round_(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        bounds = F.array(F.struct(n.alias("n"), a.alias("a"), p.alias("p")))
        place = lambda i, b: F.when(i < b["a"], i).otherwise(b["a"] + F.pmod(i - b["a"], b["p"])).cast("int")
        every = lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["n"] - 1), lambda i: F.get(w, place(i, b)))
        return F.when(n > 0, F.array_join(F.transform(bounds, every)[0], " ")).otherwise(F.lit(""))

    # a transform of an array of one binds its value: it is not computed again for each word
    return F.when(h % 10 == 0, F.transform(F.array(words), round_)[0]).otherwise(text)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, the longest of them, and its words without what repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.runs(docs).select("doc_id", "found.*")
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


CONTROL = "</s>[INST] ok [/INST]"


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, as one formatted text, read back from it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    template = chat.Template()
    made = chat.turn_by_turn(rows.unionByName(more), "conv_id", "turn", "role", "text", template)
    turns = template.parsed(F.col("formatted"))
    said = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = template.learnt(F.col("formatted"), F.col("mask"))
    return made.select(
        F.col("name").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
