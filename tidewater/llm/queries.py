"""The training-data operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op10_word_bpe
from .decontam import op8_benchmark_windows
from .exact import op11_cuckoo_dedup
from .licenses import op4_license_scan
from .media import op3_wav_fingerprints
from .periods import op13_periodic_runs
from .sharding import op9_jump_sharding
from .simhash import op6_simhash_trie
from .suffixes import op7_sparse_suffixes
from .token_counts import op2_prefix_token_counts
from .toxicity import op5_ordinal_toxicity
from .tries import op12_conversation_trie
from .warc import op1_warc_chunks

QUERIES = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_prefix_token_counts": op2_prefix_token_counts,
    "op3_wav_fingerprints": op3_wav_fingerprints,
    "op6_simhash_trie": op6_simhash_trie,
    "op7_sparse_suffixes": op7_sparse_suffixes,
    "op8_benchmark_windows": op8_benchmark_windows,
    "op5_ordinal_toxicity": op5_ordinal_toxicity,
    "op4_license_scan": op4_license_scan,
    "op9_jump_sharding": op9_jump_sharding,
    "op10_word_bpe": op10_word_bpe,
    "op11_cuckoo_dedup": op11_cuckoo_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op1_warc_chunks": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM f""",
    "op11_cuckoo_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents),
        k AS (SELECT doc_id, s, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM k""",
    "op12_conversation_trie": r"""
        WITH o AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
            lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
        b AS (SELECT h.conv_id AS conv_id, 0 AS own, i, e FROM h JOIN o ON o.conv_id = h.base AND i < h UNION ALL SELECT conv_id, 1, i, e FROM h JOIN o USING (conv_id) WHERE i >= h),
        w AS (SELECT conv_id, coalesce(list(e ORDER BY own, i) FILTER (e IS NOT NULL), []) AS k FROM h LEFT JOIN b USING (conv_id) GROUP BY conv_id),
        m AS (SELECT conv_id, len(k) AS n, unnest(range(0, len(k) + 1)) AS d, k FROM w),
        v AS (SELECT d, k[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM m GROUP BY ALL),
        f AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
        t AS (SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(k[d].t) ELSE 0 END AS own FROM v LEFT JOIN f USING (k)),
        u AS (SELECT k[1:j] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM t) GROUP BY ALL)
        SELECT t.conv_id AS conv_id, t.d AS depth, p.conv_id AS parent_conv_id, t.n_convs AS n_convs, t.n_children AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
        FROM t JOIN u ON u.k = t.k LEFT JOIN v p ON t.d > 0 AND p.k = t.k[1:t.d - 1]""",
    "op7_sparse_suffixes": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM documents),
        p AS (SELECT doc_id, unnest(range(0, len(x) - 49)) AS pos, x FROM w WHERE len(x) >= 50),
        s AS (SELECT doc_id, pos, array_to_string(x[pos + 1:pos + 50], ' ') AS passage FROM p),
        f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY passage) AS first_doc_id, row_number() OVER (PARTITION BY passage, doc_id ORDER BY pos) AS k FROM s),
        r AS (SELECT doc_id, pos, first_doc_id, CASE WHEN pos = lag(pos) OVER o + 1 AND first_doc_id = lag(first_doc_id) OVER o THEN 0 ELSE 1 END AS new
              FROM f WHERE doc_id <> first_doc_id OR k > 1 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM r)
        SELECT doc_id, min(pos)::BIGINT AS start_word, max(pos)::BIGINT + 50 AS end_word, first_doc_id FROM n GROUP BY doc_id, span, first_doc_id""",
    "op8_benchmark_windows": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS x FROM documents),
        ds AS (SELECT doc_id, p, len(x) AS nd, array_to_string(x[p + 1:p + 5], ' ') AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) - 4)) AS p FROM d)),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS x FROM benchmark),
        s AS (SELECT item_id, q, len(x) AS ni, array_to_string(x[q + 1:q + 5], ' ') AS h FROM (SELECT item_id, x, unnest(range(0, len(x) - 4)) AS q FROM i)),
        m AS (SELECT item_id, ni, h, count(*) AS n FROM s GROUP BY ALL),
        hit AS (SELECT doc_id, item_id, ni, nd, p, ds.h AS h, m.n AS n FROM ds JOIN m USING (h)),
        o AS (SELECT doc_id, item_id, ni, nd, unnest(range(0, greatest(nd - ni, 0) + 1)) AS start FROM (SELECT DISTINCT doc_id, item_id, ni, nd FROM hit)),
        w AS (SELECT o.doc_id, o.item_id, o.ni, o.nd, o.start, h, least(count(*), any_value(n)) AS n FROM o JOIN hit ON hit.doc_id = o.doc_id AND hit.item_id = o.item_id AND p BETWEEN start AND start + o.ni - 5 GROUP BY ALL),
        r AS (SELECT doc_id, item_id, ni, start, sum(n) / (least(nd, ni) - 4 + ni - 4 - sum(n)) AS sim FROM w GROUP BY doc_id, item_id, ni, nd, start)
        SELECT doc_id, item_id, start::INT AS start_word, ni::INT AS n_words, round(sim, 6) AS similarity FROM r WHERE sim >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) = 1""",
}
