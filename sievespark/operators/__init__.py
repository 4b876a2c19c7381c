"""Operators on sets of ids as DataFrames.

Forms: membership (filter_id, id), words (filter_id, word_idx, word), containers (filter_id, key, ctype, card, n_runs, arr, runs,
words) and Spark's own bitmaps (filter_id, bucket, bm). Words and containers without a set bit have no row.
"""
