"""DuckDB SQL for the queries opN_<name>, by plain definitions: every window, every pair, every quotient, every bit.

XXH64 is written out as common table expressions, in unsigned 128-bit numbers. A rotation of 64 bits is there a product
modulo 2^64 - 1 (which would be wrong for the all-ones word only).
"""

from __future__ import annotations

#: Fixed values of the hash XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_MOD = 1 << 64


def _n(x: int) -> str:
    return f"{x}::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) % {_n(_MOD)})"


def _times(x: str, factor: int) -> str:
    return _mod(f"({x}) * {_n(factor)}")


def _rotated(x: str, bits: int) -> str:
    return f"(({x}) * {_n(1 << bits)} % {_n(_MOD - 1)})"


def _bytes(start: str, count: int) -> str:
    """The number that count bytes of the hex string hx are, lowest first; start: the first byte, from 0."""
    pairs = " || ".join(f"substring(hx, 2 * ({start}) + {2 * k + 1}, 2)" for k in reversed(range(count)))
    return f"('0x' || {pairs})::UBIGINT::UHUGEINT"


def _xxh64(table: str, out: str) -> str:
    """Table expression out: table (with hx, a hex string, and sd, a seed below 2^64) and h, the XXH64 of the bytes."""
    lane = _times(_rotated(_times("k", P2), 31), P1)
    starts = [f"sd + {_n((P1 + P2) % _MOD)}", f"sd + {_n(P2)}", "sd", f"sd + {_n(_MOD - P1)}"]
    step = _times(_rotated(_mod(f"a + {_times('k', P2)}"), 31), P1)
    accs = ", ".join(f"list_reduce(list_transform(range(nb // 32), lambda i: lanes[4 * i + {m + 1}]), lambda a, k: {step}, {_mod(x)}) AS a{m}" for m, x in enumerate(starts))
    merged = " + ".join(_rotated(f"a{m}", r) for m, r in enumerate((1, 7, 12, 18)))
    merged = f"list_reduce([a0, a1, a2, a3], lambda a, k: {_mod(_times(f'xor(a, {lane})', P1) + f' + {_n(P4)}')}, {_mod(merged)})"
    eight = _mod(_times(_rotated(f"xor(a, {lane})", 27), P1) + f" + {_n(P4)}")
    four = _mod(_times(_rotated(f"xor(g, {_times(_bytes('nb - nb % 8', 4), P1)})", 23), P2) + f" + {_n(P3)}")
    one = _times(_rotated(f"xor(a, {_times('k', P5)})", 11), P1)
    return f"""
        {out}_1 AS (SELECT *, length(hx) // 2 AS nb, list_transform(range(length(hx) // 16), lambda i: {_bytes("8 * i", 8)}) AS lanes FROM {table}),
        {out}_2 AS (SELECT *, {accs} FROM {out}_1),
        {out}_3 AS (SELECT * EXCLUDE (a0, a1, a2, a3), CASE WHEN nb >= 32 THEN {merged} ELSE {_mod(f"sd + {_n(P5)}")} END AS f FROM {out}_2),
        {out}_4 AS (SELECT * EXCLUDE (f, lanes), list_reduce(lanes[4 * (nb // 32) + 1:], lambda a, k: {eight}, {_mod("f + nb::UHUGEINT")}) AS g FROM {out}_3),
        {out}_5 AS (SELECT * EXCLUDE (g), CASE WHEN nb % 8 >= 4 THEN {four} ELSE g END AS g FROM {out}_4),
        {out}_6 AS (SELECT * EXCLUDE (g), list_reduce(list_transform(range(nb - nb % 4, nb), lambda i: {_bytes("i", 1)}), lambda a, k: {one}, g) AS g FROM {out}_5),
        {out}_7 AS (SELECT * EXCLUDE (g), {_times("xor(g, g >> 33)", P2)} AS g FROM {out}_6),
        {out}_8 AS (SELECT * EXCLUDE (g), {_times("xor(g, g >> 29)", P3)} AS g FROM {out}_7),
        {out} AS (SELECT * EXCLUDE (g, nb, hx, sd), xor(g, g >> 32) AS h FROM {out}_8)"""


def _hex(number: str, size: int) -> str:
    """The size bytes of a number (below zero: its complement), lowest first, in hex."""
    return "concat(" + ", ".join(f"printf('%02x', ((({number})::HUGEINT + {_MOD}) // {1 << 8 * k} % 256)::INT)" for k in range(size)) + ")"


_SIGNED = f"CASE WHEN h >= {_n(_MOD // 2)} THEN h::HUGEINT - {_MOD} ELSE h::HUGEINT END"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _components(nodes: str, links: str) -> str:
    """reach (node, c): of every node of nodes(node) the smaller nodes, itself included, that a chain of links (a, b), both ways, leads to; the least is its component."""
    return f"reach AS (SELECT node, node AS c FROM {nodes} UNION SELECT l.b, r.c FROM reach r JOIN {links} l ON r.node = l.a WHERE r.c < l.b)"


OP1 = rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    x AS (SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM x),
    least_id AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM g JOIN least_id USING (s) WHERE doc_id > first_id),
    lost AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
        sha256(coalesce(array_to_string(list_filter(w, lambda v, k: NOT list_contains(coalesce(js, []), k)), ' '), '')) AS kept_sha256
    FROM d LEFT JOIN lost USING (doc_id)"""

# Bytes are pairs of hex digits; texts are cut into overlapping pieces first, so that a window is found near its piece's start.
OP3 = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
    p AS (SELECT doc_id, length(hx) // 2 AS nb, unnest(range(0, length(hx) // 2 - 99, 512)) AS o, hx FROM d),
    q AS (SELECT doc_id, nb, o, substring(hx, 2 * o + 1, 2 * 611) AS part FROM p),
    j AS (SELECT doc_id, part, o, unnest(range(least(512, nb - 99 - o))) AS k FROM q),
    w AS (SELECT doc_id::HUGEINT * 4294967296 + o + k AS place, doc_id, o + k AS i, md5_number(substring(part, 2 * k + 1, 200)) AS s FROM j),
    f AS (SELECT s, min(place) AS first_place FROM w GROUP BY s HAVING count(*) > 1),
    late AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS apart FROM w JOIN f USING (s) WHERE place > first_place),
    runs AS (SELECT doc_id, i, sum(coalesce(apart, false)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM late),
    spans AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM runs GROUP BY doc_id, run),
    gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM spans),
    kept AS (SELECT doc_id, count(*) AS n, sum(hi - lo) AS gone, max(hi) AS rest, string_agg(substring(hx, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS body FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
        sha256(unhex(coalesce(body, '') || substring(hx, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)"""

OP6 = f"""
    WITH RECURSIVE v AS (
        SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
    nodes AS (SELECT vec_id AS node FROM embeddings),
    {_components("nodes", "links")},
    com AS (SELECT node, min(c) AS component_id FROM reach GROUP BY node),
    deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM com LEFT JOIN deg ON a = node"""

# Quotients are written out a little beyond each party's exact share, which no quota exceeds by more than the number of parties.
OP7 = f"""
    WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
    src AS (SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
    wgt AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total, 3.0::DOUBLE * source_size AS cap FROM src),
    lev AS (
        SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM wgt WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
    tgt AS (
        SELECT key, source, source_size, least(cap, (SELECT level FROM lev WHERE level * weight <= cap ORDER BY cap / weight LIMIT 1) * weight) AS target, total, greatest(1, total // 10000000) AS block FROM lev),
    prt AS (SELECT *, CAST(round(total / block) AS BIGINT) AS seats, greatest(1, least(4096, CAST(ceil(source_size / 65536) AS BIGINT))) AS shards FROM tgt),
    qs AS (SELECT key, seats, target / (2 * k + 1) AS quotient, source FROM (SELECT *, unnest(range(CAST(ceil(target / total * seats) AS BIGINT) + (SELECT count(*) FROM prt))) AS k FROM prt WHERE target > 0)),
    won AS (SELECT key, count(*) AS quota FROM (SELECT key, seats FROM qs QUALIFY row_number() OVER (ORDER BY quotient DESC, source NULLS LAST) <= seats) GROUP BY key),
    per AS (SELECT prt.*, coalesce(quota, 0) AS quota FROM prt LEFT JOIN won USING (key)),
    l0 AS (SELECT doc_id, key, size, {_hex("doc_id", 8)} AS hx, {_n(42)} AS sd FROM d),
    {_xxh64("l0", "l1")},
    l2 AS (SELECT * EXCLUDE (h), {_hex("42", 4)} AS hx, h AS sd FROM l1),
    {_xxh64("l2", "l3")},
    l4 AS (SELECT * EXCLUDE (h), {_SIGNED} AS lot FROM l3),
    l5 AS (SELECT *, {_hex("lot", 8)} AS hx, {_n(42)} AS sd FROM l4),
    {_xxh64("l5", "l6")},
    l7 AS (SELECT * EXCLUDE (h), {_hex("43", 4)} AS hx, h AS sd FROM l6),
    {_xxh64("l7", "l8")},
    x AS (SELECT doc_id, key, size, source_size, target, block, quota, CAST((lot % shards + shards) % shards AS BIGINT) AS shard, {_SIGNED} AS place FROM l8 JOIN per USING (key)),
    sh AS (SELECT key, shard, CAST(sum(size) AS BIGINT) AS words, any_value(quota) AS quota, any_value(block) AS block FROM x GROUP BY key, shard),
    sq AS (
        SELECT key, shard, quota, words / (2 * k + 1) AS quotient
        FROM (SELECT *, unnest(range(CAST(ceil(words / (SELECT source_size FROM per WHERE per.key = z.key) * quota) AS BIGINT) + (SELECT shards FROM per WHERE per.key = z.key))) AS k FROM sh z WHERE words > 0)),
    sw AS (SELECT key, shard, count(*) AS blocks FROM (SELECT key, shard, quota FROM sq QUALIFY row_number() OVER (PARTITION BY key ORDER BY quotient DESC, shard) <= quota) GROUP BY key, shard),
    s0 AS (SELECT sh.*, least(coalesce(blocks, 0) * block, 3 * words) AS budget, hex(encode(key)) AS hx, {_n(42)} AS sd FROM sh LEFT JOIN sw USING (key, shard)),
    {_xxh64("s0", "s1")},
    s2 AS (SELECT * EXCLUDE (h), {_hex("shard", 8)} AS hx, h AS sd FROM s1),
    {_xxh64("s2", "s3")},
    s4 AS (SELECT * EXCLUDE (h), {_hex("42", 4)} AS hx, h AS sd FROM s3),
    {_xxh64("s4", "s5")},
    s6 AS (SELECT key, shard, words, budget, greatest(1, CAST(ceil(words / block) AS BIGINT)) AS spots, block, {_SIGNED} AS drawn FROM s5),
    s7 AS (SELECT key, shard, words, CASE WHEN words > 0 THEN budget // words ELSE 0 END AS passes, (drawn % spots + spots) % spots * block AS start, budget FROM s6),
    s8 AS (SELECT *, start + budget - passes * words AS stop FROM s7),
    y AS (SELECT x.*, sum(size) OVER (PARTITION BY key, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS hi FROM x)
    SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(hi, stop) - greatest(hi - size, start)) + greatest(0, least(hi, stop - words) - (hi - size)) AS BIGINT) AS taken
    FROM y JOIN s8 USING (key, shard)"""

_FP = " + ".join(f"CASE WHEN 2 * sum(h >> {b} & 1) > count(*) THEN {_n(1 << b)} ELSE {_n(0)} END" for b in range(64))
OP8 = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM d WHERE len(w) > 0),
    e AS (SELECT s, hex(encode(s)) AS hx, {_n(42)} AS sd FROM (SELECT DISTINCT s FROM g)),
    {_xxh64("e", "hs")},
    hashed AS MATERIALIZED (SELECT s, h::UBIGINT AS h FROM hs),
    own AS (SELECT doc_id, CAST({_FP} AS UBIGINT) AS fp FROM g JOIN hashed USING (s) GROUP BY doc_id),
    fps AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN own USING (doc_id)),
    nodes AS (SELECT fp, min(doc_id) AS node FROM fps GROUP BY fp),
    links AS (SELECT x.node AS a, y.node AS b FROM nodes x JOIN nodes y ON x.node <> y.node AND bit_count(xor(x.fp, y.fp)) <= 2),
    {_components("nodes", "links")},
    com AS (SELECT node, min(c) AS component_id FROM reach GROUP BY node)
    SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM fps JOIN nodes USING (fp) JOIN com USING (node)"""

OP9 = r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    x AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
            sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS formatted
        FROM c GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
        CAST(formatted AS BIGINT) AS formatted_chars FROM x"""

OP10 = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

#: None for op2, op4 and op5: a trained model and a tokenizer have no SQL.
ORACLES = {"op1_phrase_dedup": OP1, "op3_suffix_dedup": OP3, "op6_embedding_dedup": OP6, "op7_mixing": OP7, "op8_simhash_dedup": OP8, "op9_chat_format": OP9, "op10_exact_dedup": OP10}
