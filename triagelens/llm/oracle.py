"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32)"


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# kind, expression, group, least length of the group
SECRETS = [
    (
        "assign",
        "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")[""'']?\x20*[:=]\x20*[""'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("private_key", "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 1),
    ("code_host", "gh[pousr]_[A-Za-z0-9]{36,255}", 0, 1),
    ("chat_bot", "xox[abprs]-[A-Za-z0-9-]{10,255}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
]


def _secrets() -> str:
    found = " UNION ALL ".join(
        f"""SELECT r, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS ms,
            regexp_extract_all(t, '{pattern}', {group}) AS vs, string_split_regex(t, '{pattern}') AS gaps, {least} AS least
        FROM d WHERE regexp_matches(t, '{pattern}')"""
        for rank, (kind, pattern, group, least) in enumerate(SECRETS)
    )
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({found}),
    each AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found),
    spans AS (
        SELECT r, rank, kind, least, length(vs[i]) AS n,
            list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, length(ms[i]) AS m
        FROM each),
    kept AS (SELECT r, rank, kind, s::BIGINT AS s, (s + m)::BIGINT AS e FROM spans WHERE n >= least),
    per_doc AS (
        SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex, {listed} FILTER (rank < 3) AS base, {listed} AS spans
        FROM kept GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN per_doc USING (r)"""


TOP_K = """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

JACCARD = f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS x
        FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(x[i : i + least(len(x), 5) - 1], ' ') || '/' || least(len(x), 5) AS shingle
        FROM (SELECT doc_id, x, unnest(range(1, len(x) - least(len(x), 5) + 2)) AS i FROM w WHERE len(x) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
    reach AS (
        SELECT a AS doc_id, a AS other FROM links
        UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
    first AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(first.component_id, w.doc_id) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN first USING (doc_id)"""

HOSTS = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS x FROM d),
    windows AS (SELECT r, i, x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] AS g FROM (SELECT r, x, unnest(range(1, len(x) - 1)) AS i FROM w)),
    twins AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows),
    covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twins, range(3) AS t(k) WHERE n > 1 GROUP BY r),
    lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {BLANKS}) <> '' GROUP BY r),
    base AS (
        SELECT r, doc_id, host, len(x)::BIGINT AS n_words, coalesce(list_sum(list_transform(x, lambda y: length(y))), 0)::BIGINT AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
    hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM judged WHERE host IS NOT NULL GROUP BY host),
    prior AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v, avg(n) AS size FROM hosts),
    strength AS (SELECT m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 1e-6) ELSE size END AS k FROM prior),
    rates AS (SELECT host, (bad + m * k) / (n + k) AS rate FROM hosts, strength)
    SELECT doc_id, judged.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        round(rate, 6) AS host_rate, NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept
    FROM judged LEFT JOIN rates USING (host)"""

MIX = f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
    weighed AS (SELECT *, ([5.0::DOUBLE, 2.0, 1.0])[(place % 3 + 1)::INTEGER] AS w, (3 * source_size)::DOUBLE AS most FROM ranked),
    levelled AS (
        SELECT *, row_number() OVER o AS k,
            (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
        FROM weighed
        WINDOW o AS (ORDER BY most / w, place), b AS (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    opened AS (SELECT *, min(k) FILTER (level * w < most) OVER () AS first FROM levelled),
    goals AS (
        SELECT source, source_size, CASE WHEN k >= first THEN max(level) FILTER (k = first) OVER () * w ELSE most END AS target FROM opened),
    weighted AS (SELECT *, CASE WHEN size < 50 THEN 1.0::DOUBLE WHEN size < 200 THEN 2.0 ELSE 4.0 END AS cw FROM d),
    masses AS (
        SELECT source, cw, sum(size) AS mass, any_value(source_size) AS source_size, any_value(target) AS target
        FROM weighted w JOIN goals USING (source) WHERE source IS NOT NULL GROUP BY ALL
        UNION ALL
        SELECT NULL, cw, sum(size), any_value(source_size), any_value(target)
        FROM weighted w, goals WHERE w.source IS NULL AND goals.source IS NULL GROUP BY cw),
    levels AS (
        SELECT *, (target - 3 * coalesce(sum(mass) OVER (PARTITION BY source ORDER BY cw DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / nullif(sum(cw * mass) OVER (PARTITION BY source ORDER BY cw DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lv
        FROM masses),
    fixed AS (SELECT *, max(cw) FILTER (lv * cw < 3) OVER (PARTITION BY source) AS o FROM levels),
    copies AS (
        SELECT source, cw, source_size, target,
            CASE WHEN cw <= o THEN least((max(lv) FILTER (cw = o) OVER (PARTITION BY source)) * cw, 3) ELSE 3 END::DOUBLE AS c
        FROM fixed),
    expected AS (
        SELECT w.doc_id, w.source, w.size, copies.source_size, copies.target, c,
            (('0x' || substr(md5('7:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
        FROM weighted w JOIN copies ON w.source IS NOT DISTINCT FROM copies.source AND w.cw = copies.cw),
    odds AS (
        SELECT *, floor(c) AS whole, c - floor(c) AS p,
            CASE WHEN c > floor(c) AND size > 0 THEN (u / (1 - u)) * (1 - (c - floor(c))) / (c - floor(c)) END AS rank
        FROM expected),
    running AS (
        SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS words,
            coalesce(sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM odds),
    taken AS (
        SELECT *, CASE WHEN size > 0 THEN least(whole + (p > 0 AND words > 0 AND before + size / 2 <= words)::INTEGER, 3) ELSE 0 END::BIGINT AS copies
        FROM running)
    SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken"""

ARCHIVE = """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    last AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest),
    j AS (SELECT p.*, CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to FROM p LEFT JOIN last USING (payload_digest))
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j"""

CHAT = r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    t AS (
        SELECT *, md5(role || chr(10) || text) AS tie, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS escaped,
            length(replace(replace(replace(role, chr(92), '..'), chr(10), '..'), '|', '..')) AS header
        FROM c),
    g AS (
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(12 + header + 1 + escaped + 10 + 1)::BIGINT AS formatted_chars, false AS rewritten
        FROM t GROUP BY conv_id)
    SELECT * FROM g"""


def _manifest(levels: int = 5) -> str:
    """Leaves and ``levels`` levels of each tree: enough for 16 ** 5 documents a source."""

    def field(column: str) -> str:
        return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    bytes_of = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    parts = [
        f"""crc AS (
        SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_of}), lambda c, b: {bits}), 4294967295::BIGINT) AS crc FROM documents)""",
        f"""h AS (
        SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND crc % 5 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS fold0 FROM crc)""",
        "r AS (SELECT *, row_number() OVER () AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM h)",
        "a0 AS (SELECT r, doc_id, leaf, tree, fold0 AS fold, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx FROM r)",
        "n0 AS (SELECT tree, idx, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM a0)",
    ]

    def climb(k: int, node: str, at: str, tree: str) -> None:
        """Level k + 1 of nodes and of what climbs, from level k."""
        parts.append(
            f"""{node}{k + 1} AS (
        SELECT {tree}, idx // 16 AS idx, CASE WHEN n = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY idx)) END AS hash,
            (n + 15) // 16 AS n, n = 1 AS done, string_agg(hash, '' ORDER BY idx) AS kids
        FROM {node}{k} GROUP BY {tree}, idx // 16, n)"""
        )
        left, right = "substr(kids, 1, (64 * (c.idx % 16))::INTEGER)", "substr(kids, (64 * (c.idx % 16) + 65)::INTEGER)"
        parts.append(
            f"""{at}{k + 1} AS (
        SELECT c.r, c.doc_id, c.leaf, c.tree, CASE WHEN done THEN fold ELSE sha256({left} || fold || {right}) END AS fold,
            CASE WHEN done THEN proof ELSE proof || {left} || {right} END AS proof, c.idx // 16 AS idx
        FROM {at}{k} c JOIN {node}{k + 1} n ON {"c.tree = n.tree AND " if tree == "tree" else ""}c.idx // 16 = n.idx)"""
        )

    for k in range(levels):
        climb(k, "n", "a", "tree")
    parts.append(f"s AS (SELECT tree, hash FROM n{levels})")
    parts.append("u0 AS (SELECT 0 AS top, tree AS idx, hash, count(*) OVER () AS n FROM s)")
    parts.append(f"b0 AS (SELECT r, doc_id, leaf, tree, fold, proof, tree AS idx FROM a{levels})")
    for k in range(levels):
        climb(k, "u", "b", "top")
    return f"""
    WITH {", ".join(parts)}
    SELECT doc_id, leaf, s.hash AS subroot, u.hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.hash AS verified
    FROM b{levels} JOIN s USING (tree), u{levels} u"""


ORACLES: dict[str, str] = {
    "op1_secret_scans": _secrets(),
    "op2_top_k": TOP_K,
    "op4_jaccard_join": JACCARD,
    "op6_host_rules": HOSTS,
    "op7_source_mix": MIX,
    "op8_warc": ARCHIVE,
    "op11_chat_format": CHAT,
    "op12_merkle_manifest": _manifest(),
}
