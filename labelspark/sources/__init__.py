"""Readers (triplet corpora, validated loads, corpus registry, hierarchy
dimension, results files) and sinks (numbered batches, results)."""
