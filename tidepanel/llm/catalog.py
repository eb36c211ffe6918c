"""Queries over the whole training-data tables, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tidepanel.llm import (
    bitplanes, decontaminate, hilbert_packing, licenses, lsh_forest, merkle, pairwise_quality, presence_masks, rendezvous, streaming_dedup, suffixes,
    toxic_crf, warc,
)
from tidepanel.llm.workers import reaching

QUERIES = {
    "op1_bit_planes": bitplanes.query,
    "op2_license_scan": licenses.query,
    "op3_streaming_dedup": streaming_dedup.query,
    "op4_rendezvous_shards": rendezvous.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_pairwise_quality": pairwise_quality.query,
    "op7_warc_derivatives": warc.query,
    "op8_lsh_forest_join": lsh_forest.query,
    "op9_sparse_suffixes": suffixes.query,
    "op10_hilbert_packing": hilbert_packing.query,
    "op11_toxic_spans": toxic_crf.query,
    "op12_merkle_manifest": merkle.query,
    "op13_presence_masks": presence_masks.query,
    "pipeline": corpus_pipeline.run,
}
QUERIES = {name: reaching(query) for name, query in QUERIES.items()}

SQL = {
    "op2_license_scan": licenses.SQL,
    "op3_streaming_dedup": streaming_dedup.SQL,
    "op4_rendezvous_shards": rendezvous.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_presence_masks": presence_masks.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
