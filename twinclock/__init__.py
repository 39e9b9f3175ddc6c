"""Bitemporal history on Spark: validity timelines, past beliefs, and questions on both clocks."""
