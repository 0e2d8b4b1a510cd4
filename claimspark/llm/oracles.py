"""DuckDB SQL for the corpus queries that SQL can express."""

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(x: str) -> str:
    return f"translate({x}, '{ASCII_UPPER}', '{ASCII_LOWER}')"


def sql_field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"


def sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(map(sql_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def sql_tree(name: str, start: str) -> str:
    """Nodes of all levels and, for each with others at its level, the digests beside it in its run of three."""
    return f"""
        {name} AS (
            SELECT tree, 0 AS level, place, n, digest FROM {start}
            UNION ALL
            SELECT tree, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM {name}
            WHERE n > 1 GROUP BY tree, level, place // 3, n
        ), {name}_steps AS (
            SELECT u.tree, u.level, u.place, coalesce(string_agg(v.digest, '' ORDER BY v.place) FILTER (v.place < u.place), '') AS before,
                   coalesce(string_agg(v.digest, '' ORDER BY v.place) FILTER (v.place > u.place), '') AS after
            FROM {name} u JOIN {name} v ON v.tree = u.tree AND v.level = u.level AND v.place // 3 = u.place // 3
            WHERE u.n > 1 GROUP BY ALL
        )"""


# Unsigned CRC-32 of the decimal id, bit by bit.
SQL_CRC32 = """xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda c, b: list_reduce(
        list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))"""

ORACLES = {
    "op13_merkle": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, {sql_leaf("text")} AS digest, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                   CASE WHEN {SQL_CRC32} % 2 = 0 THEN {sql_leaf("replace(text, chr(10), '')")} ELSE {sql_leaf("text")} END AS shown,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
            FROM documents
        ), {sql_tree("own", "leaves")}, subroots AS (
            SELECT 0 AS tree, tree AS place, digest, count(*) OVER () AS n FROM own WHERE n = 1
        ), {sql_tree("high", "subroots")}, steps AS (
            SELECT l.doc_id, s.level, before, after FROM leaves l JOIN own_steps s ON s.tree = l.tree AND s.place = l.place // (3 ** s.level)::BIGINT
            UNION ALL
            SELECT l.doc_id, 100 + s.level, before, after FROM leaves l JOIN high_steps s ON s.place = l.tree // (3 ** s.level)::BIGINT
        ), paths AS (
            SELECT doc_id, string_agg(before || after, '' ORDER BY level) AS proof, list(before || '|' || after ORDER BY level) AS path
            FROM steps GROUP BY doc_id
        ), result AS (
            SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root,
                   sha256(coalesce(p.proof, '')) AS proof_sha256,
                   list_reduce(list_prepend(l.shown, coalesce(p.path, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
            FROM leaves l JOIN subroots s ON s.place = l.tree LEFT JOIN paths p ON p.doc_id = l.doc_id
        )
        SELECT *, folded_root = root AS verified FROM result""",
    "op1_url_filter": rf"""
        WITH parts AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), urls AS (
            SELECT page_id, {lower_ascii("regexp_extract(rest, '^[^/?#]*')")} AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), rules(host, path, verdict) AS (VALUES
            ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
            ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        )
        SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
        FROM urls u LEFT JOIN LATERAL (
            SELECT r.host || r.path AS rule, r.verdict FROM rules r
            WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
            ORDER BY length(r.host || r.path) DESC LIMIT 1
        ) best ON true""",
    "op4_ngram_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({lower_ascii("coalesce(text, '')")}, '{WORD}') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
        ), reach(doc_id, r) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
        )
        SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id
        FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id""",
    "op9_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY norm)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (
            SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p
        ), last AS (SELECT digest, max(page_id) AS response FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN response <> page_id THEN response END AS refers_to
        FROM d LEFT JOIN last ON last.digest = d.digest""",
    "op10_line_dedup": rf"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
        ), k AS (
            SELECT *, {lower_ascii("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
        ), o AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
        FROM o GROUP BY doc_id""",
}
