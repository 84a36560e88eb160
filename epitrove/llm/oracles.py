"""DuckDB SQL for the queries of this package that SQL can answer over whole tables.

It compares windows, shingles and vectors outright, so it suits small tables only.
"""

from __future__ import annotations

from epitrove.llm.url_filter import Rule

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _reached(links: str) -> str:
    """The smallest node that each node of ``links`` (a, b; both ways) reaches."""
    return f"""
    reached AS (WITH RECURSIVE r(node, seen) AS (
        SELECT a, a FROM {links} UNION SELECT l.b, r.seen FROM r JOIN {links} l ON l.a = r.node) SELECT * FROM r),
    components AS (SELECT node, min(seen) AS component FROM reached GROUP BY node)"""


def substring_dedup(window: int) -> str:
    return f"""
    WITH docs AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM docs),
    runs AS (SELECT doc_id, place, array_to_string(w[place:place + {window - 1}], ' ') AS run
             FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS place FROM docs)),
    firsts AS (SELECT run, min(doc_id) AS holder FROM runs GROUP BY run),
    gone AS (SELECT DISTINCT doc_id, place + step AS place
             FROM runs JOIN firsts USING (run), range({window}) AS steps(step) WHERE holder < doc_id),
    kept AS (SELECT doc_id, count(*) AS n_words, count(g.place) AS n_removed,
                    string_agg(word, ' ' ORDER BY w.place) FILTER (g.place IS NULL) AS left_over
             FROM words w LEFT JOIN gone g USING (doc_id, place) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)"""


def sharding(count: int) -> str:
    return f"""
    WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS step),
    sized AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n, hex(coalesce(text, '')) AS h FROM documents),
    placed AS (SELECT doc_id, n + 1 AS size, md5(t) AS mark, h, sum(n + 1) OVER (ORDER BY md5(t), doc_id) - n - 1 AS start, sum(n + 1) OVER () AS total FROM sized),
    cut AS (SELECT *, CAST((2 * start + size) * {count} // (2 * total) AS INTEGER) AS shard FROM placed)
    SELECT doc_id, size, xor(4294967295, list_reduce(list_transform(range(size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
             lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32,
           'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY mark, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM cut, steps"""


def embedding_dedup(threshold: float) -> str:
    return f"""
    WITH usable AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
        ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {threshold}),{_reached("linked")}
    SELECT vec_id, (SELECT count(*) FROM linked WHERE a = vec_id) AS n_links, coalesce(component, vec_id) AS component_id,
           coalesce(component, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN components ON node = vec_id"""


def minhash(size: int, percent: int) -> str:
    return f"""
    WITH docs AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), {_LETTERS})")} AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, array_to_string(w[place:place + {size - 1}], ' ') AS shingle
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS place FROM docs WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
    linked AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
               WHERE 100 * c.n >= {percent} * (x.n + y.n - c.n)),{_reached("linked")}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
    FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN components ON node = doc_id"""


def mixing(parts: dict[str, int], others: str, block_rows: int) -> str:
    """The schedule slot by slot: the earliest due of the released blocks, and a new start when a source is used up."""
    named = {name: part for name, part in sorted(parts.items())}
    listed = ", ".join(f"({n}, '{name}', {part})" for n, (name, part) in enumerate(named.items(), 1))
    known = ", ".join(f"'{name}'" for name in parts if name != others)
    return f"""
    WITH RECURSIVE parts(i, name, part) AS (VALUES {listed}),
    docs AS (SELECT doc_id, source, CASE WHEN source IN ({known}) THEN source ELSE '{others}' END AS mix_source FROM documents),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY mix_source ORDER BY doc_id) - 1 AS n FROM docs),
    used AS (SELECT row_number() OVER (ORDER BY i) AS i, name, part, (rows + {block_rows - 1}) // {block_rows} AS blocks
             FROM parts JOIN (SELECT mix_source AS name, count(*) AS rows FROM docs GROUP BY 1) USING (name)),
    lists AS (SELECT list(part ORDER BY i) AS p, list(blocks ORDER BY i) AS blocks FROM used),
    run(turn, slot, total, remaining, taken, source, block) AS (
        SELECT 0, 0::BIGINT, list_sum(p)::BIGINT, blocks, list_transform(p, lambda x: 0::BIGINT), NULL::BIGINT, NULL::BIGINT FROM lists
        UNION ALL
        SELECT turn + 1, CASE WHEN ends THEN 0 ELSE slot + 1 END,
               CASE WHEN ends THEN list_sum(list_transform(p, lambda x, i: CASE WHEN remaining[i] > taken[i] THEN x ELSE 0 END))::BIGINT ELSE total END,
               CASE WHEN ends THEN list_transform(remaining, lambda x, i: x - taken[i]) ELSE remaining END,
               list_transform(taken, lambda x, i: CASE WHEN ends THEN 0 WHEN i = best THEN x + 1 ELSE x END),
               CASE WHEN NOT ends THEN best END, CASE WHEN NOT ends THEN blocks[best] - remaining[best] + taken[best] END
        FROM (SELECT *, taken[best] = remaining[best] AS ends FROM (
            SELECT run.*, p, blocks, list_min(list_filter(list_transform(p, lambda x, i: CASE
                WHEN remaining[i] > 0 AND taken[i] * total // x <= slot THEN ((taken[i] + 1) * total + x - 1) // x * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS best
            FROM run, lists WHERE list_sum(remaining) > 0))),
    slots AS (SELECT row_number() OVER (ORDER BY turn) - 1 AS mix_slot, name AS mix_source, block AS mix_block
              FROM run JOIN used ON used.i = run.source)
    SELECT doc_id, d.source, mix_source, mix_block::BIGINT AS mix_block, mix_slot,
           row_number() OVER (ORDER BY mix_slot, n) - 1 AS mix_position
    FROM numbered d JOIN slots USING (mix_source) WHERE mix_block = n // {block_rows}"""


def url_filter(rules: list[Rule], default: str = "allow") -> str:
    listed = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    part = r"coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', {n}), '')"
    return f"""
    WITH rules(verdict, rule_host, rule_path) AS (VALUES {listed}),
    parted AS (SELECT row_number() OVER () AS line, page_id, translate({part.format(n=1)}, {_LETTERS}) AS host, {part.format(n=2)} AS path FROM pages),
    best AS (SELECT line, rule_host || rule_path AS rule, verdict FROM parted
             JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
             QUALIFY row_number() OVER (PARTITION BY line ORDER BY length(rule_host || rule_path) DESC) = 1)
    SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM parted LEFT JOIN best USING (line)"""


_STEPS = """steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS step)"""


def _crc32(text: str) -> str:
    """The checksum of a text of ASCII characters, with ``steps`` in the FROM clause."""
    return f"""xor(4294967295, list_reduce(list_transform(range(strlen({text})), lambda i: ascii(substr({text}, i + 1, 1))::BIGINT),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"""


def periodic_runs(least: int) -> str:
    """All pairs of equal words of a document, as stretches of one distance."""
    return f"""
    WITH {_STEPS},
    split AS (SELECT row_number() OVER () AS line, doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} AS h, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents, steps),
    sized AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
    docs AS (SELECT line, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
                 w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w FROM sized),
    words AS (SELECT line, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM docs),
    pairs AS (SELECT x.line, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.line = y.line AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
    placed AS (SELECT *, i - row_number() OVER (PARTITION BY line, q ORDER BY i) AS stretch FROM pairs),
    stretches AS (SELECT line, q, min(i) AS start, count(*) + q AS length FROM placed GROUP BY line, q, stretch HAVING count(*) >= greatest(q, {least} - q)),
    runs AS (SELECT line, start, length, min(q) AS period FROM stretches GROUP BY line, start, length),
    gone AS (SELECT DISTINCT words.line, i FROM words JOIN runs ON words.line = runs.line AND i >= start + period AND i < start + length),
    kept AS (SELECT w.line, string_agg(word, ' ' ORDER BY w.i) AS left_over FROM words w ANTI JOIN gone g ON w.line = g.line AND w.i = g.i GROUP BY w.line),
    found AS (SELECT line, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
                     first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
                     first(period ORDER BY length DESC, start, period) AS period FROM runs GROUP BY line)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
           CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
    FROM docs LEFT JOIN found USING (line) LEFT JOIN kept USING (line)"""


def merkle(fields: list[str], arity: int = 16) -> str:
    """Level by level, and every leaf's siblings looked up level by level."""
    part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = " || ".join(part.format(f) for f in fields)
    told = " || ".join(part.format(f"translate(text, {_LETTERS})" if f == "text" else f) for f in fields)
    return f"""
    WITH RECURSIVE {_STEPS},
    hashed AS (SELECT doc_id, source, sha256({leaf}) AS leaf,
                      sha256(CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {told} ELSE {leaf} END) AS told FROM documents, steps),
    trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
    leaves AS (SELECT h.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, told) - 1 AS pos
               FROM hashed h JOIN trees t ON h.source IS NOT DISTINCT FROM t.source),
    nodes(tree, level, pos, digest) AS (
        SELECT tree, 0, pos, leaf FROM leaves
        UNION ALL
        SELECT tree, level + 1, pos // {arity}, sha256(string_agg(digest, '' ORDER BY pos))
        FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM nodes) WHERE size > 1 GROUP BY tree, level, pos // {arity}),
    heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
    subroots AS (SELECT tree, height, digest FROM nodes JOIN heights USING (tree) WHERE level = height),
    tops(level, pos, digest) AS (
        SELECT 0, tree, digest FROM subroots
        UNION ALL
        SELECT level + 1, pos // {arity}, sha256(string_agg(digest, '' ORDER BY pos))
        FROM (SELECT *, count(*) OVER () AS size FROM tops) WHERE size > 1 GROUP BY level, pos // {arity}),
    upper AS (SELECT max(level) AS height FROM tops),
    members AS (
        SELECT n.tree, n.level, n.pos, n.digest, n.level AS step, h.height AS below FROM nodes n JOIN heights h USING (tree) WHERE n.level < h.height
        UNION ALL
        SELECT s.tree, t.level, t.pos, t.digest, s.height + t.level, s.height FROM subroots s, tops t, upper u WHERE t.level < u.height),
    runs AS (SELECT tree, step, level, below, pos // {arity} AS run, list(digest ORDER BY pos) AS run_members FROM members GROUP BY ALL),
    ways AS (SELECT l.doc_id, l.leaf, l.told, l.tree, l.pos AS leaf_pos, r.step, r.run_members,
                    CASE WHEN r.step < r.below THEN l.pos // CAST({arity} ** r.level AS BIGINT) ELSE l.tree // CAST({arity} ** r.level AS BIGINT) END % {arity} + 1 AS place
             FROM leaves l JOIN runs r ON r.tree = l.tree
              AND r.run = CASE WHEN r.step < r.below THEN l.pos // CAST({arity} ** (r.level + 1) AS BIGINT) ELSE l.tree // CAST({arity} ** (r.level + 1) AS BIGINT) END),
    folded(tree, leaf_pos, step, digest) AS (
        SELECT tree, pos, 0, told FROM leaves
        UNION ALL
        SELECT f.tree, f.leaf_pos, f.step + 1,
               sha256(array_to_string(w.run_members[1:w.place - 1], '') || f.digest || array_to_string(w.run_members[w.place + 1:], ''))
        FROM folded f JOIN ways w ON f.tree = w.tree AND f.leaf_pos = w.leaf_pos AND f.step = w.step),
    proofs AS (SELECT tree, leaf_pos, string_agg(array_to_string(run_members[1:place - 1], '') || array_to_string(run_members[place + 1:], ''), '' ORDER BY step) AS proof
               FROM ways GROUP BY tree, leaf_pos),
    ends AS (SELECT tree, leaf_pos, last(digest ORDER BY step) AS folded_root FROM folded GROUP BY tree, leaf_pos)
    SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM tops, upper WHERE level = height) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
           folded_root, folded_root = (SELECT digest FROM tops, upper WHERE level = height) AS verified
    FROM leaves l JOIN subroots s USING (tree) JOIN ends e ON e.tree = l.tree AND e.leaf_pos = l.pos LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_pos = l.pos"""
