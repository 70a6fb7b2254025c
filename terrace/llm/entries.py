"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import bpe, fingerprints, language, mixing, neighbours, periods, private, quality, ranking, simhash, substrings, suffixes, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": substrings.op1_substrings,
    "op2_simhash": simhash.op2_simhash,
    "op3_tokens": tokens.op3_tokens,
    "op4_mixing": mixing.op4_mixing,
    "op5_bpe": bpe.op5_bpe,
    "op6_private": private.op6_private,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_quality": quality.op8_quality,
    "op9_language": language.op9_language,
    "op10_suffixes": suffixes.op10_suffixes,
    "op11_periods": periods.op11_periods,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_ranking": ranking.op13_ranking,
}

#: Windows of 20 words; those that are not the first of their words, and the words that they cover.
SUBSTRINGS = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM docs WHERE len(words) >= 20),
keys AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS k FROM starts),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM keys),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE n > 1),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS line, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

#: Windows of 100 bytes, written as 200 hex digits; runs of those that are not the first of their bytes.
SUFFIXES = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM docs WHERE len(h) >= 200),
keys AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM starts),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM keys),
later AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS opens FROM ranked WHERE n > 1),
runs AS (SELECT doc_id, i, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, b AS p, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS q FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS h FROM edges JOIN docs USING (doc_id) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: The check sum of the id bit by bit; pairs of places with the same six words, and stretches of such pairs at one distance.
PERIODS = r"""
WITH ids AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, CAST(doc_id AS VARCHAR) AS key FROM documents),
bits AS (SELECT *, list_transform(range(8 * len(key)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(key, i // 8 + 1, 1)) ELSE 0 END) AS fed FROM ids),
hashed AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, fed), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) AS h FROM bits),
docs AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN list_transform(range(len(words)), lambda i: words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE words END AS words
  FROM (SELECT *, (h // 10) % greatest(len(words), 1) AS a, 1 + (len(words) - a) // (3 + (h // 10) % 8) AS p FROM hashed)),
six AS (SELECT doc_id, unnest(range(len(words) - 5)) AS i, words FROM docs WHERE len(words) >= 12),
grams AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 6], ' ') AS k FROM six),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 AS same FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, same + q AS length, min(q) AS period FROM islands WHERE same + q >= greatest(12, 2 * q) GROUP BY doc_id, start, same + q),
summed AS (
  SELECT doc_id, count(*) AS n_runs, max_by({'s': start, 'l': length, 'p': period}, {'l': length, 's': -start, 'p': -period}) AS best,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM docs) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
  CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM docs d LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Terms of documents and items; the weight in doubles, the rest in integers.
RANKING = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, nn),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS part FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (term), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op1_substrings": SUBSTRINGS, "op10_suffixes": SUFFIXES, "op11_periods": PERIODS, "op13_ranking": RANKING}
