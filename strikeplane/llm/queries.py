"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, covertree, jaccard, langid, licenses, lm, mixing, oracle, packing, phrases, quality, secrets, simhash, trie
from .shared import documents

#: Where a tokenizer file lies, as `tokenizer_path`; None: that of the installed public_tokenizers.
TOKENIZER_PATH: str | None = None


def tokenizer_path() -> str:
    if TOKENIZER_PATH:
        return TOKENIZER_PATH
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the risk-controlled rules."""
    return quality.apply_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weights 1, 2, 3 takes from every document."""
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50, by integer inner product."""
    whole = documents(spark, sf_dir, "embeddings").filter(covertree.usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    vectors = whole.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vector"))
    found = covertree.top_k(vectors, 5, "vec_id % 50 = 0")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned without the quarter that is held out."""
    docs = documents(spark, sf_dir)
    part = langid.crc_part(F.col("doc_id"))
    model = langid.fit(docs.filter(part != 2))
    said = langid.predict(docs, model)
    return said.select("doc_id", (langid.crc_part(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


#: The conversation that op5 adds: its texts hold the template's control strings.
ADDED_CHAT = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from what was formatted."""
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_CHAT).alias("text"))
    made = chat.format_chats(rows.unionByName(added))
    back = made.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where they lie in sequences of 2048 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licenses that are a document's whole text or a line of it."""
    return licenses.scan(documents(spark, sf_dir), licenses.digests(spark))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base spans, and all spans."""
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), out_col="found").select("doc_id", "found")
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rank"] < len(secrets.PATTERNS))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stupid-backoff log score under the bigrams of all other documents."""
    return lm.score(documents(spark, sf_dir)).select("doc_id", "n_words", (F.round("log_score", 4) + F.lit(0.0)).alias("log_score"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    near = simhash.near_duplicates(documents(spark, sf_dir), shingle_words=4, max_distance=4)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each begun as the first of its twenty begins."""
    return trie.prefix_nodes(trie.with_shared_heads(trie.turns_in_order(documents(spark, sf_dir, "conversations"))))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 3-word shingles, and its component at a Jaccard similarity of 0.9."""
    near = jaccard.similarity_join(documents(spark, sf_dir))
    return near.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_mix, op3_topk, op4_langid, op5_chat, op6_pack, op7_licenses, op8_secrets, op9_lm, op10_simhash, op11_trie, op12_jaccard, op13_phrases)
}
ORACLE_SQL = {
    "op1_quality": oracle.OP1, "op2_mix": oracle.OP2, "op3_topk": oracle.OP3, "op5_chat": oracle.OP5, "op7_licenses": oracle.OP7, "op9_lm": oracle.OP9,
    "op11_trie": oracle.OP11, "op12_jaccard": oracle.OP12, "op13_phrases": oracle.OP13,
}
