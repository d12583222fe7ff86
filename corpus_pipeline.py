"""The corpus pipeline: five stages over documents, each written and reread before the next.

Language ID drops documents in no language; exact dedup keeps one row of equal texts; SimHash
near-dedup keeps one document of each component; mixing repeats documents up to their source's
target; packing cuts what the mix takes into token sequences.
"""

from tidewindow.llm import exact_dedup, language_id, mixing, packing, simhash
from tidewindow.sources.staging import stage


def identify_language(spark, docs, sf_dir):
    return language_id.keep_identified(docs)


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    return simhash.one_per_component(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Tokenising and learned languages are not SQL; tests/llm holds brute-force versions of the stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
