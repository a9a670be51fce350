"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.decontaminate import op4_spaced_seeds
from lattica.llm.embeddings import op9_pca_tiles
from lattica.llm import decontaminate, embeddings, licences
from lattica.llm.licences import op10_licence_digests
from lattica.llm.maxent import op6_class_maxent
from lattica.llm.packing import op1_window_packing
from lattica.llm.quality import op7_neighbour_votes
from lattica.llm.sharding import op8_virtual_slots
from lattica.llm.simhash import op3_simhash_index
from lattica.llm.token_counts import op2_transducer_counts
from lattica.llm.toxicity import op5_noisy_channel


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_window_packing, op2_transducer_counts, op3_simhash_index, op4_spaced_seeds, op5_noisy_channel, op6_class_maxent, op7_neighbour_votes, op8_virtual_slots, op9_pca_tiles, op10_licence_digests]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_spaced_seeds": decontaminate.oracle(), "op9_pca_tiles": embeddings.ORACLE, "op10_licence_digests": licences.oracle()}
