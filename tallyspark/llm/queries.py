"""One query per operator, over its whole table, and the reference SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import chat, fill_middle, lang_id, line_dedup, mixing, near_dup, packing, prefix_trie, quality, reference_sql, secret_scan, syncmers, token_files, urls
from tallyspark.llm.common import table, text_of
from tallyspark.llm.tokens import default_path, id_counts
from tallyspark.session import discarding, stage


_AWKWARD = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are records of one turn each; conversation -7 is one record of messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", "text").alias("record"))
    said = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(_AWKWARD).alias("content")) for r in ("user", "assistant")])
    extra = spark.range(1).select(F.lit(-7).alias("conv_id"), F.lit(0).alias("turn"), F.struct(said.alias("messages")).alias("record"))
    return chat.read_back(chat.format_records(rows).unionByName(chat.format_records(extra))).drop("n_unread")


#: Shares of the mixture, as parameters of the query.
DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.3, "code": 0.2}
LANG_WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def domain_of(source: str = "source"):
    """Domain by the number at the end of a source's name; web where there is none."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 4
    return F.when(number <= 1, "web").when(number == 2, "books").otherwise("code")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets and prefixes in token ids, which are counted once; the mixture needs no texts after that."""
    docs = table(spark, sf_dir, "documents")
    tokens = id_counts(default_path("byte_bpe_50k.json"))
    with discarding(spark):
        counted = stage(docs.select("doc_id", "lang", "source", tokens(text_of()).alias("tokens")), "token-counts")
        taken = mixing.mix(counted, ["doc_id"], domain_of(), fraction=0.5, max_epochs=3, seed=17, domain_weights=DOMAIN_WEIGHTS,
                           lang_weights=LANG_WEIGHTS, text_col="tokens", size=lambda c: c.cast("bigint"))
        return stage(taken.select("row.doc_id", "domain", "lang", "source", F.col("words").alias("tokens"), "epoch"), "mixture", keep=True)


URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), rules, ["page_id"])
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link_documents(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, default_path("byte_bpe_50k.json"), end_id=0, window=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.token_files(docs, default_path("word_bpe_49k.json"), digest=True, caseless=True, end_id=2)


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.cleaned_texts(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def op11_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lang_id.identify_languages(table(spark, sf_dir, "documents"), held_out=lang_id.held_out("doc_id"))
    return found.select("doc_id", lang_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with discarding(spark):
        turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
        rebuilt, ids = prefix_trie.with_shared_heads(stage(turns, "turns"))
        return stage(prefix_trie.prefix_trie(rebuilt, ids), "trie", keep=True)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.with_restored(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": (pipeline, None),
    "op1_chat": (op1_chat, reference_sql.chat(_AWKWARD)),
    "op2_mixing": (op2_mixing, None),
    "op3_urls": (op3_urls, reference_sql.urls(URL_RULES)),
    "op4_near_dup": (op4_near_dup, None),
    "op8_secrets": (op8_secrets, None),
    "op7_line_dedup": (op7_line_dedup, reference_sql.line_dedup_sql()),
    "op10_quality": (op10_quality, reference_sql.quality_sql()),
    "op5_packing": (op5_packing, None),
    "op6_token_files": (op6_token_files, None),
    "op9_syncmers": (op9_syncmers, None),
    "op11_lang_id": (op11_lang_id, None),
    "op12_prefix_trie": (op12_prefix_trie, reference_sql.prefix_trie()),
    "op13_fill_middle": (op13_fill_middle, reference_sql.fill_middle()),
}
