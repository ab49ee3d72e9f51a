"""Queries of the training-data operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, jaccard, licences, line_dedup, manifest, media, mixing, packing, phrases, sentencepieces, sharding, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_warc": lambda s, d: warc.archive_rows(s, table(s, d, "pages")),
        "op2_sharding": lambda s, d: sharding.shard_rows(table(s, d, "documents")),
        "op3_toxicity": lambda s, d: toxicity.toxicity_rows(table(s, d, "documents"), table(s, d, "labels")),
        "op4_line_dedup": lambda s, d: line_dedup.dedup_rows(table(s, d, "documents")),
        "op5_mixing": lambda s, d: mixing.mix_rows(table(s, d, "documents")),
        "op6_jaccard": lambda s, d: jaccard.join_rows(table(s, d, "documents")),
        "op7_licences": lambda s, d: licences.licence_rows(table(s, d, "documents")),
        "op8_packing": lambda s, d: packing.pack_documents(table(s, d, "documents")),
        "op9_media": lambda s, d: media.copy_rows(table(s, d, "embeddings")),
        "op10_neighbours": lambda s, d: ann.neighbours(table(s, d, "embeddings")),
        "op11_manifest": lambda s, d: manifest.manifest_rows(table(s, d, "documents")),
        "op12_sentencepiece": lambda s, d: sentencepieces.piece_rows(table(s, d, "documents")),
        "op13_phrases": lambda s, d: phrases.phrase_rows(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op11_manifest": op11(), "op13_phrases": OP13}


OP1 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, j, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_parts AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL
), kept AS (
  SELECT w.* FROM worst AS w LEFT JOIN inner_parts AS i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * w.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked AS r JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) AS t ON t.lang = r.lang
WHERE rank <= 2000
"""


def op11(levels: int = 8) -> str:
    """SQL of the manifest with so many levels within a source and as many above; enough for 16 ** levels documents of a source."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in fields) + ")"

    crc = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x::BIGINT) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    ctes = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(low)} END AS bad FROM documents)",
        "s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents))",
        "w0 AS (SELECT doc_id, g, leaf, coalesce(bad, leaf) AS fold, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)",
        "t0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM w0)",
    ]

    def climb(k: int, rows: str, tree: str) -> None:
        """Level k to k + 1 of the tree, and of the rows' places, folds and proofs."""
        ctes.append(f"r{tree}{k} AS (SELECT g, i // 16 AS b, list(h ORDER BY i) AS run, any_value(n) AS n FROM {tree}{k} WHERE n > 1 GROUP BY ALL)")
        ctes.append(
            f"{rows}{k + 1} AS (SELECT w.* EXCLUDE (fold, i, proof), coalesce(w.i // 16, w.i) AS i,"
            " CASE WHEN run IS NULL THEN fold ELSE sha256(array_to_string(run[1:w.i % 16], '') || fold || array_to_string(run[w.i % 16 + 2:], '')) END AS fold,"
            " CASE WHEN run IS NULL THEN proof ELSE proof || array_to_string(run[1:w.i % 16], '') || array_to_string(run[w.i % 16 + 2:], '') END AS proof"
            f" FROM {rows}{k} AS w LEFT JOIN r{tree}{k} AS r ON r.g = w.g AND r.b = w.i // 16)"
        )
        ctes.append(f"{tree}{k + 1} AS (SELECT g, b AS i, sha256(array_to_string(run, '')) AS h, (n + 15) // 16 AS n FROM r{tree}{k} UNION ALL SELECT * FROM {tree}{k} WHERE n = 1)")

    for k in range(levels):
        climb(k, "w", "t")
    ctes.append(f"u0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM t{levels})")
    ctes.append(f"v0 AS (SELECT w.doc_id, w.leaf, w.fold, w.proof, t.h AS subroot, 0 AS g, w.g AS i FROM w{levels} AS w JOIN t{levels} AS t ON t.g = w.g)")
    for k in range(levels):
        climb(k, "v", "u")
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.h AS verified"
        f" FROM v{levels} AS v CROSS JOIN (SELECT h FROM u{levels}) AS u"
    )
