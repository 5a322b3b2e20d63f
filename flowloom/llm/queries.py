"""Registered queries of this package and the SQL that some of them must equal."""

from flowloom.llm import chat, decontaminate, embeddings, jaccard, lines, lm, manifest, mixing, packing, repair, secrets, substrings, toxicity
from flowloom.llm.text import table


def op1_suffix_array_dedup(spark, sf_dir):
    return substrings.digest(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return lines.digest(table(spark, sf_dir, "documents"))


def op5_source_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_embedding_near_dup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_lm_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.drop("_text")


def op9_chat_format(spark, sf_dir):
    return chat.recover(table(spark, sf_dir, "conversations"))


def op10_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark, sf_dir):
    return repair.digest(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark, sf_dir):
    return manifest.digest(table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark, sf_dir):
    return packing.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_ngram_jaccard, op3_secret_scan, op4_line_dedup, op5_source_mix, op6_embedding_near_dup,
        op7_lm_score, op8_decontaminate, op9_chat_format, op10_toxicity,
        op11_conversation_repair, op12_merkle_manifest, op13_best_fit_packing,
    )
}
ORACLES = {
    "op2_ngram_jaccard": jaccard.SQL,
    "op4_line_dedup": lines.SQL,
    "op6_embedding_near_dup": embeddings.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op11_conversation_repair": repair.SQL,
    "op12_merkle_manifest": manifest.SQL,
}
