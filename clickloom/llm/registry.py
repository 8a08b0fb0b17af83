"""Queries of the operators and the SQL they must agree with, where SQL can say it."""

from __future__ import annotations

from clickloom.llm import centroids, chat, decontaminate, jaccard, langid, packing, paragraphs, repair, suffixes, topk, toxicity, vectors, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_chat_format": chat.op2,
    "op3_best_fit_packing": packing.op3,
    "op4_ngram_jaccard_join": jaccard.op4,
    "op5_benchmark_decontamination": decontaminate.op5,
    "op6_language_id": langid.op6,
    "op7_substring_dedup": paragraphs.op7,
    "op8_suffix_array_dedup": suffixes.op8,
    "op9_warc": warc.op9,
    "op10_embedding_near_dedup": vectors.op10,
    "op11_conversation_structure_repair": repair.op11,
    "op12_exact_top_k_search": topk.op12,
    "op13_centroid_clustering": centroids.op13,
}
ORACLE = {"op2_chat_format": chat.SQL, "op9_warc": warc.SQL, "op12_exact_top_k_search": topk.SQL,
          "op13_centroid_clustering": centroids.SQL}
