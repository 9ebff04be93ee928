"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: A word, in RE2's notation.
WORD = r"[^\x20\x09-\x0D]+"

_MIX_HOUSE = """
{g}_a AS (SELECT *, sum(votes) OVER w AS every, count(*) OVER w AS n FROM {g} WINDOW w AS (PARTITION BY grp)),
{g}_b AS (SELECT *, CASE WHEN every > 0 THEN CAST(floor(votes * house / every + 0.5) AS BIGINT) ELSE 0 END AS q FROM {g}_a),
{g}_c AS (SELECT *, CASE WHEN every > 0 THEN CAST(house - sum(q) OVER (PARTITION BY grp) AS BIGINT) ELSE 0 END AS m FROM {g}_b),
{g}_d AS (SELECT *, unnest(generate_series(1, greatest(1, CAST(abs(m) AS BIGINT)))) AS e FROM {g}_c),
{g}_e AS (SELECT *, CASE WHEN votes > 0 AND m > 0 THEN votes / (2 * (q + e) - 1)
                        WHEN votes > 0 AND m < 0 AND q >= e THEN -votes / (2 * (q - e) + 1) END AS quotient FROM {g}_d),
{g}_f AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY quotient DESC NULLS LAST, CASE WHEN m < 0 THEN -party ELSE party END) AS place FROM {g}_e),
{g}_g AS (SELECT grp, party, any_value(q) + CAST(sum(CASE WHEN place <= abs(m) THEN sign(m) ELSE 0 END) AS BIGINT) AS seats FROM {g}_f GROUP BY grp, party)
"""

_DRAWN = """((({u} * (quota % blocks) + start) // blocks * words
  + ((({u} + 1) * (quota % blocks) + start) // blocks - ({u} * (quota % blocks) + start) // blocks) * (({x}) * blocks - {u} * words)) // blocks)"""


def mixing_rows(documents: str = "documents") -> str:
    """WITH clause up to `mix`: doc_id, rank, size, source_size, target, taken."""
    drawn = lambda x: _DRAWN.replace("{u}", f"(({x}) * blocks // words)").replace("{x}", x)
    return f"""
rec AS (SELECT *, CAST(('0x' || substr(draw, 1, 8)) AS BIGINT) AS number FROM (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
           md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '?')) AS draw FROM {documents})),
src_a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rec GROUP BY source),
src_b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM src_a),
src_c AS (SELECT *, [5, 2, 1][(rnk - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM src_b),
src_d AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER s, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER s, 0)) AS lvl FROM src_c
          WINDOW s AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src AS (SELECT source, source_size, rnk, least(CAST(cap AS DOUBLE), max(lvl) OVER () * weight) AS target,
        greatest(1, least(4096, CAST(ceil(source_size / {16 * 65536}) AS BIGINT))) AS n_shards FROM src_d),
placed AS (SELECT rec.*, rnk, source_size, target, number % n_shards AS shard FROM rec JOIN src ON rec.source IS NOT DISTINCT FROM src.source),
shd AS (SELECT rnk, shard, CAST(sum(size) AS BIGINT) AS words, any_value(target) AS target, any_value(source_size) AS source_size FROM placed GROUP BY rnk, shard),
shb AS (SELECT *, CASE WHEN words > 0 THEN greatest(1, (2 * words + 16) // 32) ELSE 0 END AS blocks FROM shd),
par AS (SELECT rnk, CAST(sum(blocks) AS BIGINT) AS all_blocks, any_value(target) AS target, any_value(source_size) AS source_size FROM shb GROUP BY rnk),
ent AS (SELECT *, CASE WHEN source_size > 0 THEN target * all_blocks / source_size ELSE 0.0 END AS votes FROM par),
top AS (SELECT 0 AS grp, rnk AS party, votes, CAST(round(sum(votes) OVER ()) AS BIGINT) AS house FROM ent),
{_MIX_HOUSE.format(g="top")},
own AS (SELECT rnk AS grp, shard AS party, blocks AS votes, least(top_g.seats, all_blocks * 3) AS house, words FROM shb JOIN par USING (rnk) JOIN top_g ON top_g.party = rnk),
{_MIX_HOUSE.format(g="own")},
quotas AS (SELECT o.grp AS rnk, o.party AS shard, words, votes AS blocks, least(seats, votes * 3) AS quota,
    CASE WHEN votes > 0 THEN CAST(('0x' || substr(md5('mix-1:' || o.grp || ':' || o.party), 1, 8)) AS BIGINT) % votes END AS start
    FROM own o JOIN own_g g ON o.grp = g.grp AND o.party = g.party),
along AS (SELECT placed.*, words, blocks, quota, start, CAST(sum(size) OVER (PARTITION BY rnk, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
    FROM placed JOIN quotas USING (rnk, shard)),
mix AS (SELECT doc_id, rnk, size, source_size, target,
    CASE WHEN words > 0 AND size > 0 THEN CAST(quota // blocks * size + {drawn("upto")} - {drawn("upto - size")} AS BIGINT) ELSE 0 END AS taken FROM along)
"""


def near_duplicate_rows(n: int, documents: str = "documents", threshold: int = 80) -> str:
    """WITH RECURSIVE clause up to `near`: doc_id, n_shingles, component_id; shingles of n words, similarity of `threshold` percent."""
    return f"""
nd_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM {documents}),
nd_sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN generate_series(1, len(w) - {n - 1})]) END AS s FROM nd_words),
nd_size AS (SELECT doc_id, len(s) AS n FROM nd_sets),
nd_long AS (SELECT doc_id, unnest(s) AS t FROM nd_sets),
nd_both AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM nd_long a JOIN nd_long b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
nd_link AS (SELECT x, y FROM nd_both JOIN nd_size p ON p.doc_id = x JOIN nd_size q ON q.doc_id = y WHERE 100 * k >= {threshold} * (p.n + q.n - k)),
nd_edge AS (SELECT x, y FROM nd_link UNION ALL SELECT y, x FROM nd_link),
nd_reach AS (SELECT doc_id AS x, doc_id AS y FROM {documents} UNION SELECT r.x, e.y FROM nd_reach r JOIN nd_edge e ON r.y = e.x),
near AS (SELECT z.doc_id, z.n AS n_shingles, c.component_id FROM nd_size z JOIN (SELECT x, min(y) AS component_id FROM nd_reach GROUP BY x) c ON c.x = z.doc_id)
"""


ORACLES = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM stored AND stored IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM stored THEN stored END AS refers_to FROM m""",
    "op8_minhash": f"WITH RECURSIVE {near_duplicate_rows(4)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near",
    "op12_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
d AS (SELECT *, [CAST(('0x' || substr(x, 8 * i + 1, 8)) AS BIGINT) FOR i IN range(4)] AS h FROM h),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p""",
    "op13_jaccard": f"WITH RECURSIVE {near_duplicate_rows(3, threshold=90)} SELECT doc_id, n_shingles, component_id FROM near",
    "op7_mixing": f"WITH {mixing_rows()} SELECT doc_id, size, source_size, target, taken FROM mix",
}
