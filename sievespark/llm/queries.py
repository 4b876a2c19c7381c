"""The queries of this package and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import language, media, mixing, neighbours, passages, pieces, sharding, simhash, token_counts, token_files

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_projected_neighbours": neighbours.op2_projected_neighbours,
    "op3_language_id": language.op3_language_id,
    "op4_jump_sharding": sharding.op4_jump_sharding,
    "op5_golay_simhash": simhash.op5_golay_simhash,
    "op6_repeated_passages": passages.op6_repeated_passages,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_piece_viterbi": pieces.op8_piece_viterbi,
    "op9_media_columns": media.op9_media_columns,
    "op10_token_counts": token_counts.op10_token_counts,
}

#: DuckDB. The caps are reached one source after another in the order of cap to weight, as in ``mixing.targets``.
_OP7 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source IS NULL, true) AS nul, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT nul, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY nul, source) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nul, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, nul, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT nul, source, source_size, least(cap, coalesce(max(CASE WHEN lev <= cap / weight THEN lev END) OVER () * weight, cap)) AS target FROM o),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget, greatest(t.source_size, 1) AS total,
             coalesce(sum(d.size) OVER (PARTITION BY d.nul, d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.nul = t.nul AND d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((budget // total) * size + least(greatest(budget % total - before, 0), size))::BIGINT AS taken
FROM p
"""

#: DuckDB has no CRC-32: its table of 256 follows from the polynomial, and each text's bytes run through it.
_OP4 = r"""
WITH RECURSIVE
poly AS (SELECT list_transform(range(0, 256), lambda v: list_reduce(list_prepend(v, range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 0)::BIGINT AS k, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
walk AS (
  SELECT r, CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616::HUGEINT ELSE k::HUGEINT END::UHUGEINT AS state, -1::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL
  SELECT r, n, j, floor((j + 1) * (2147483648::DOUBLE / ((n >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, (state * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS n, j FROM walk WHERE j < 25)),
goal AS (SELECT r, max(CASE WHEN b < 24 THEN b END)::INTEGER AS shard, max(CASE WHEN b < 25 THEN b END)::INTEGER AS grown_shard FROM walk GROUP BY r)
SELECT doc_id, size, text_crc32, law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY (((k % 1024) + 1024) % 1024 + text_crc32 % 1024) % 1024, k, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM (SELECT doc_id, k, (n + 8)::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
       'key' AS law, shard, grown_shard
FROM d JOIN goal USING (r), poly)
"""

ORACLES = {"op4_jump_sharding": _OP4, "op7_mix_sources": _OP7}
