"""Operators of a training-data pipeline: filtering, de-duplication, decontamination, counting and mixing."""
