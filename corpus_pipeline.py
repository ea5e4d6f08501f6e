"""Five stages from raw documents to packed token sequences.

``run`` applies them in order; every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm import line_dedup, mixing, near_dup, packing, quality
from tallyspark.llm.common import WORD, sent, table
from tallyspark.llm.queries import DOMAIN_WEIGHTS, LANG_WEIGHTS, domain_of
from tallyspark.llm.tokens import default_path, id_counts
from tallyspark.session import stage

SHINGLE_WORDS, LIKENESS_PERCENT = 5, 80
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 0.8, 2, 17
WINDOW, END_ID = 1024, 0
#: Rows without an id are numbered from here on; ids are below it.
_ABOVE_IDS = 1 << 62


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the thresholds of their group reject."""
    return quality.quality_filter(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; a text of which no word is left goes.

    ``n_chars`` follows the text.  Texts that lose no line stay as they are.
    """
    done = line_dedup.dedup_lines(docs, docs.columns)
    rest = done.filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    changed = F.col("n_removed") > 0

    def column(name: str):
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("row")["n_chars"]).alias(name)
        return F.col("row")[name].alias(name)

    return rest.select(*[column(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Rows without a doc_id are linked like all others, under a number from their text above
    every id, so a copy with an id is preferred.  Of rows that share an id or that number,
    one stays.
    """
    def numbered(part: DataFrame, number: Column) -> DataFrame:
        return part.select(F.struct(*docs.columns).alias("row"), "text", number.alias("number"))

    above = F.lit(_ABOVE_IDS) + F.xxhash64("text").bitwiseAND(F.lit(_ABOVE_IDS - 1))
    unnamed = stage(numbered(docs.filter("doc_id is null"), above), "unnamed")
    rows = numbered(docs.filter("doc_id is not null"), F.col("doc_id").cast("bigint")).unionByName(unnamed)
    linked = near_dup.link_documents(rows, SHINGLE_WORDS, LIKENESS_PERCENT, id_col="number").withColumnRenamed("doc_id", "number")
    gone = linked.filter("not kept").select("number").distinct()
    several = linked.groupBy("number").agg(F.count("*").alias("n")).filter("n > 1").select("number")
    apart = stage(gone.unionByName(several).distinct(), "apart")
    # Most documents are kept and occur once; only the others are looked at by number.
    once = rows.join(sent(apart), "number", "left_anti").select("row.*")
    again = stage(several.join(gone, "number", "left_anti"), "again")
    repeated = rows.join(sent(again), "number", "left_semi")
    same = Window.partitionBy("number").orderBy(F.xxhash64("text"))
    single = repeated.select("row", F.row_number().over(same).alias("copy")).filter("copy = 1").select("row.*")
    return once.unionByName(single)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of domains, languages and sources take, in token ids; a row per epoch."""
    taken = mixing.mix(docs, docs.columns, domain_of(), fraction=MIX_FRACTION, max_epochs=MIX_EPOCHS, seed=MIX_SEED,
                       domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS,
                       size=id_counts(default_path("byte_bpe_50k.json")))
    return taken.select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids, a row per piece of a document."""
    return packing.pack_documents(docs, default_path("byte_bpe_50k.json"), end_id=END_ID, window=WINDOW)


STAGES = [
    ("quality rules", filter_quality),
    ("line dedup", remove_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the tokenizer nor the signatures; tests compare with plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
