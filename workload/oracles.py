"""SQL that answers the registered queries in DuckDB.

The relations are spelt out again here, not shared with the Spark adapters, so that both sides
check each other.
"""

from __future__ import annotations

# Relations over the given tables.
CTES = {
    "bases": """
  SELECT * FROM (VALUES
    (0, 'M1', 'MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVK'),
    (1, 'HA', 'MGSSHHHHHHSSGLVPRGSHMASMTGGQQMGRGSEFELRRQACGRTRVTSKPLAWDNIYE'),
    (2, 'NP', 'MADEEKLPPGWEKRMSRSSGRVYYFNHITNASQWERPSGNSSSGGKNGQGEPARVRCSHL')) t(k, protein, base)""",
    "isolates": """
  SELECT o.o_orderkey AS seq_id, b.protein,
    concat('H', c.c_custkey % 5 + 1, 'N', c.c_custkey % 3 + 1) AS genotype,
    CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Homo sapiens' WHEN 'MACHINERY' THEN ' Gallus gallus '
         WHEN 'BUILDING' THEN NULL ELSE c.c_mktsegment END AS host,
    n.n_name AS country,
    CASE o.o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN substr(o.o_orderdate::DATE::VARCHAR, 1, 4)
         WHEN 2 THEN substr(o.o_orderdate::DATE::VARCHAR, 1, 7)
         WHEN 3 THEN o.o_orderdate::DATE::VARCHAR
         ELSE CASE o.o_custkey % 4 WHEN 1 THEN concat(o.o_orderdate::DATE::VARCHAR, ' junk')
              WHEN 3 THEN concat(o.o_orderdate::DATE::VARCHAR, 'Txx') ELSE 'unknown' END END AS collection_date,
    o.o_orderdate::DATE::VARCHAR AS release_date,
    -- Letters are replaced one by one: none, one by customer, or a second one by order.
    list_aggregate(list_transform(range(1, 61), lambda i: CASE
      WHEN o.o_orderkey % 4 >= 1 AND o.o_orderkey % 16 <> 1 AND i = o.o_orderkey // 4 % 60 + 1 THEN substr('ACDEFGHIKLMNPQRSTVWY-', (o.o_orderkey // 240)::INT % 21 + 1, 1)
      WHEN o.o_orderkey % 4 >= 1 AND i = o.o_custkey % 60 + 1 THEN substr('ACDEFGHIKLMNPQRSTVWY-', (o.o_custkey // 60)::INT % 21 + 1, 1)
      ELSE substr(b.base, i::INT, 1) END), 'string_agg', '') AS sequence
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN bases b ON greatest(o.o_orderkey % 7 - 4, 0) = b.k""",
    "refs": """
  SELECT protein, concat(substr(base, 1, 25), '--', substr(base, 26)) AS aligned_sequence FROM bases""",
    "uploads": """
  SELECT p.p_partkey AS peptide_id, b.protein,
    CASE WHEN p.p_partkey % 5 > 1 THEN substr(b.base, (p.p_partkey % 60 + 1)::INT, (8 + p.p_size % 7)::INT)
      ELSE concat(substr(b.base, (p.p_partkey % 60 + 1)::INT, 3), substr('ACDEFGHIKLMNPQRSTVWY', (p.p_partkey // 60)::INT % 20 + 1, 1),
        substr('ACDEFGHIKLMNPQRSTVWY', (p.p_partkey // 1200)::INT % 20 + 1, 1),
        substr(b.base, (p.p_partkey % 60 + 6)::INT, (3 + p.p_size % 7)::INT)) END AS peptide,
    p.p_brand AS attribute_1, CASE WHEN p.p_size % 4 = 0 THEN '' ELSE p.p_type END AS attribute_2,
    NULL::VARCHAR AS attribute_3
  FROM part p JOIN bases b ON p.p_partkey % 3 = b.k""",
    "letters": """
  SELECT protein, aligned_sequence, replace(aligned_sequence, '-', '') AS bare,
    list_filter(range(1, length(aligned_sequence) + 1), lambda i: substr(aligned_sequence, i, 1) <> '-') AS places
  FROM refs""",
    "matched": """
  SELECT u.*, r.aligned_sequence, r.places,
    CASE WHEN strpos(r.bare, u.peptide) > 0 THEN strpos(r.bare, u.peptide) END AS raw
  FROM uploads u LEFT JOIN letters r USING (protein) WHERE length(u.peptide) > 0""",
    "aligned": """
  SELECT peptide_id, protein, peptide, attribute_1, attribute_2, attribute_3, length(peptide)::INT AS length_raw,
    (places[raw + length(peptide) - 1] - places[raw] + 1)::INT AS length, raw::INT AS start_raw, places[raw]::INT AS start,
    substr(aligned_sequence, places[raw], places[raw + length(peptide) - 1] - places[raw] + 1) AS peptide_aligned
  FROM matched""",
    "scanned": """
  SELECT (s_suppkey + 1)::INT AS seq_index, s_name AS seq_id, b.protein,
    concat(substr(b.base, 1, (s_suppkey % 60)::INT), substr('ACDEFGHIKLMNPQRSTVWY', (s_suppkey // 60)::INT % 20 + 1, 1),
           substr(b.base, (s_suppkey % 60)::INT + 2, 60)) AS sequence
  FROM supplier JOIN bases b ON s_suppkey % 3 = b.k""",
    "scan": """
  SELECT w.seq_index AS seq_no, w.protein, w.len, w.start, (w.start + w.len - 1)::INT AS end_pos, a.allele,
    substr(w.sequence, w.start, w.len) AS peptide,
    CASE WHEN (w.start * 7 + w.seq_index) % 97 <> 0 THEN
      ((w.start * 37 + w.len * 101 + w.seq_index * 53 + a.ai * 211) % 1000)::DOUBLE / 10 END AS el,
    ((w.start * 91 + w.len * 17 + w.seq_index * 29 + a.ai * 307) % 1000)::DOUBLE / 10 AS ba
  FROM (SELECT seq_index, protein, sequence, len, unnest(generate_series(1, 61 - len))::INT AS start
        FROM (SELECT *, unnest([8, 9, 10]) AS len FROM scanned)) w,
    (VALUES (0, 'HLA-A*02:01'), (1, 'HLA-A*11:01'), (2, 'HLA-B*35:03'), (3, 'HLA-C*04:01')) a(ai, allele)""",
    "predictions": """
  SELECT allele, peptide, min(el) AS netmhcpan_el_percentile, min(ba) AS netmhcpan_ba_percentile
  FROM scan GROUP BY allele, peptide""",
    "hla": """
  SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '  '
      ELSE concat(' HLA-A*', lpad((c_custkey % 90)::VARCHAR, 2, '0'), ':01') END AS "Class I",
    CASE WHEN c_custkey % 5 = 0 THEN concat('HLA-DRB1*', lpad(c_nationkey::VARCHAR, 2, '0'), ':01 ') END AS "Class II"
  FROM customer""",
}
NEEDS = {
    "isolates": ["bases"], "refs": ["bases"], "uploads": ["bases"], "letters": ["refs"],
    "matched": ["uploads", "letters"], "aligned": ["matched"], "scanned": ["bases"], "scan": ["scanned"],
    "predictions": ["scan"],
}


def _frequencies(source: str, by: str = "") -> str:
    """One group per position and letter: its rows, its distinct sequences, and their sums over the position."""
    keys = f"{by}, " if by else ""
    return f"""
  SELECT {keys}position::INT AS position, aminoacid, n::BIGINT AS frequency_all, (sum(n) OVER here)::BIGINT AS total_all, n / sum(n) OVER here AS value,
    u::BIGINT AS frequency_unique, (sum(u) OVER here)::BIGINT AS total_unique, u / sum(u) OVER here AS value_unique
  FROM (SELECT {keys}position, substr(sequence, position, 1) AS aminoacid, count(*) AS n, count(DISTINCT sequence) AS u
        FROM (SELECT {keys}sequence, unnest(generate_series(1, length(sequence))) AS position FROM {source}) GROUP BY ALL)
  WINDOW here AS (PARTITION BY {keys}position)"""


def _tallies(source: str, windows: str, by: str = "") -> str:
    """One group per window and substring: its rows, its distinct sequences, and their sums over the window.

    ``by`` names a column of both sides by which all of it is done.
    """
    keys, pairs = (f"{by}, ", f"{source} JOIN {windows} USING ({by})") if by else ("", f"{source}, {windows}")
    return f"""
  SELECT {keys}start, len, peptide, n::BIGINT AS frequency_all, (sum(n) OVER here)::BIGINT AS total_all, n / sum(n) OVER here AS proportion_all,
    u::BIGINT AS frequency_unique, (sum(u) OVER here)::BIGINT AS total_unique, u / sum(u) OVER here AS proportion_unique
  FROM (SELECT {keys}start, len, substr(sequence, start, len) AS peptide, count(*) AS n, count(DISTINCT sequence) AS u
        FROM {pairs} GROUP BY ALL)
  WINDOW here AS (PARTITION BY {keys}start, len)"""


CTES |= {
    "m1": "SELECT * FROM isolates WHERE protein = 'M1'",
    "nonhuman": "SELECT * FROM isolates WHERE protein = 'M1' AND host <> 'Homo sapiens'",
    "windows": "SELECT * FROM (VALUES (1, 9), (5, 9), (20, 10), (55, 9)) t(start, len)",
    "upload_windows": "SELECT DISTINCT protein, start, length AS len FROM aligned WHERE start > 0 AND length > 0",
    "first_window": "SELECT * FROM (VALUES (1, 9)) t(start, len)",
    "frequencies": _frequencies("isolates", "protein"),
    "live": _frequencies("nonhuman"),
    "tallies": _tallies("isolates", "upload_windows", "protein"),
    "first_tallies": _tallies("m1", "first_window"),
    "candidates": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protein, start, len ORDER BY proportion_all DESC, peptide) AS r_all,
      row_number() OVER (PARTITION BY protein, start, len ORDER BY proportion_unique DESC, peptide) AS r_u FROM tallies)
  WHERE r_all <= 5 OR r_u <= 5""",
    "roots": """
  SELECT DISTINCT protein, c.peptide, r.root FROM
    (SELECT protein, start, len, upper(replace(peptide, '-', '')) AS peptide FROM candidates) c
    JOIN (SELECT protein, start, length AS len, peptide AS root FROM aligned WHERE start > 0) r USING (protein, start, len)
  WHERE c.peptide <> ''
  UNION SELECT protein, peptide, peptide FROM aligned""",
    "annotated": """
  SELECT protein, allele, p.peptide, netmhcpan_el_percentile, netmhcpan_ba_percentile,
    coalesce(fa, 0)::BIGINT AS frequency_all, coalesce(ta, 0)::BIGINT AS total_all, coalesce(fa::DOUBLE / ta, 0) AS proportion_all,
    coalesce(fu, 0)::BIGINT AS frequency_unique, coalesce(tu, 0)::BIGINT AS total_unique,
    coalesce(fu::DOUBLE / tu, 0) AS proportion_unique, coalesce(root, '') AS root
  FROM predictions p CROSS JOIN (SELECT protein FROM bases) LEFT JOIN (
    SELECT protein, replace(peptide, '-', '') AS peptide, sum(frequency_all) AS fa, max(total_all) AS ta,
      sum(frequency_unique) AS fu, max(total_unique) AS tu FROM tallies GROUP BY 1, 2) t USING (protein, peptide)
  LEFT JOIN (SELECT protein, peptide, string_agg(root, ';' ORDER BY root) AS root FROM roots GROUP BY 1, 2) r USING (protein, peptide)""",
    "facet_counts": """
  SELECT facet, place AS position, substr(sequence, place, 1) AS aminoacid, count(*) AS cnt
  FROM nonhuman_facets, range(1, 61) AS places(place)
  WHERE place <= length(sequence) AND facet IN (
    SELECT facet FROM nonhuman_facets GROUP BY facet QUALIFY row_number() OVER (ORDER BY count(*) DESC, facet) <= 6)
  GROUP BY ALL""",
    "facet_ranks": """
  SELECT facet, position::INT AS position, aminoacid, cnt::BIGINT AS frequency, (sum(cnt) OVER here)::BIGINT AS total,
    cnt / sum(cnt) OVER here AS share, (row_number() OVER (here ORDER BY cnt DESC, aminoacid))::INT AS r
  FROM facet_counts WINDOW here AS (PARTITION BY facet, position)""",
    "nonhuman_facets": "SELECT country AS facet, sequence FROM nonhuman",
    "nonhuman_genotypes": "SELECT DISTINCT genotype AS facet, sequence FROM nonhuman",
    "half_cached": "SELECT * FROM predictions WHERE netmhcpan_el_percentile < 3",
    "alleles": "SELECT unnest(['HLA-A*02:01', 'HLA-A*11:01', 'HLA-B*35:03', 'HLA-C*04:01']) AS allele",
    "missing": """
  SELECT allele, peptide FROM alleles CROSS JOIN (SELECT DISTINCT peptide FROM uploads WHERE length(peptide) BETWEEN 8 AND 14) w
  WHERE NOT EXISTS (SELECT 1 FROM half_cached h WHERE h.allele = alleles.allele AND h.peptide = w.peptide)""",
    "occurrences": """
  SELECT s.seq_index, s.seq_id, s.peptide, s.start, s.len AS length FROM (
    SELECT seq_index, seq_id, len, start, substr(sequence, start, len) AS peptide FROM (
      SELECT seq_index, seq_id, sequence, len, unnest(generate_series(1, length(sequence) - len + 1))::INT AS start
      FROM scanned, (SELECT DISTINCT length(peptide)::INT AS len FROM uploads WHERE length(peptide) > 0) l)) s
  JOIN (SELECT DISTINCT peptide FROM uploads) p USING (peptide)""",
    "consensus_all": """
  SELECT protein, position, aminoacid FROM (SELECT *, row_number() OVER (
    PARTITION BY protein, position ORDER BY value DESC, aminoacid) AS r FROM frequencies) WHERE r = 1""",
    "qualifying": """
  SELECT a.allele, a.peptide, a.one_root, a.root, a.protein, a.proportion_all FROM (
    SELECT *, unnest(string_split(root, ';')) AS one_root FROM annotated
    WHERE netmhcpan_el_percentile <= 20 AND root <> '') a
  WHERE EXISTS (SELECT 1 FROM annotated q WHERE q.peptide = q.root AND q.netmhcpan_el_percentile <= 20
    AND q.peptide = a.one_root AND q.allele = a.allele AND q.protein = a.protein)""",
}
NEEDS |= {
    "m1": ["isolates"], "nonhuman": ["isolates"], "upload_windows": ["aligned"], "frequencies": ["isolates"],
    "live": ["nonhuman"], "tallies": ["isolates", "upload_windows"], "first_tallies": ["m1", "first_window"],
    "candidates": ["tallies"], "roots": ["candidates", "aligned"], "annotated": ["bases", "predictions", "tallies", "roots"],
    "nonhuman_facets": ["nonhuman"], "nonhuman_genotypes": ["nonhuman"], "facet_counts": ["nonhuman_facets"],
    "facet_ranks": ["facet_counts"], "half_cached": ["predictions"], "missing": ["alleles", "uploads", "half_cached"],
    "occurrences": ["scanned", "uploads"], "consensus_all": ["frequencies"], "qualifying": ["annotated"],
}


def _ordered(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        _ordered(NEEDS.get(name, []), seen)
        if name not in seen:
            seen.append(name)
    return seen


def sql(needs: str, body: str) -> str:
    relations = _ordered(needs.split(), [])
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in relations) + "\n" + body


_WIDE = 'CASE WHEN seq_no > 1 THEN seq_no END'
_PARTIAL = "try_strptime(collection_date, ['%Y-%m-%d', '%Y-%m', '%Y'])::DATE"
_NOTE = """concat(attribute_1, ', "new"')"""

ORACLES: dict[str, str] = {
    # Sources
    "scan_sequences": sql("m1", "SELECT seq_id, protein, genotype, host, sequence FROM m1"),
    "scan_position_frequencies": sql("frequencies", "SELECT * EXCLUDE (protein) FROM frequencies WHERE protein = 'HA'"),
    "load_profile": sql("frequencies", """
SELECT e.protein, e.position, f.aminoacid, f.value FROM (
  SELECT protein, unnest(generate_series(1, max(position)))::INT AS position FROM frequencies GROUP BY protein) e
LEFT JOIN frequencies f USING (protein, position)"""),
    "read_allele_list": sql("hla", """SELECT DISTINCT trim("Class I") AS allele FROM hla WHERE trim("Class I") <> ''"""),
    "read_fasta": sql("scanned", "SELECT seq_id AS protein, sequence AS raw_sequence FROM scanned"),
    "read_fasta_strict": sql("scanned", """
, clash AS (SELECT seq_index % 3 AS part, row_number() OVER (PARTITION BY seq_index % 3 ORDER BY seq_index) AS n, sequence,
    CASE WHEN seq_index % 5 < 2 THEN 'hot' WHEN seq_index % 5 = 2 THEN concat('hot_', seq_index % 23)
         WHEN seq_index % 5 = 3 THEN concat('hot_2_', seq_index % 7) ELSE replace(seq_id, '#', '_') END AS base FROM scanned),
-- One entry after the other: its name, or the first suffixed one that no entry before it has.
settled AS (SELECT * FROM (
  WITH RECURSIVE named(part, n, taken, id, sequence) AS (
    SELECT DISTINCT part, 0, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM clash
    UNION ALL
    SELECT part, n, list_append(taken, id), id, sequence FROM (
      SELECT c.part, c.n, c.sequence, taken, CASE WHEN list_contains(taken, base)
        THEN concat(base, '_', list_filter(range(2, c.n + 2), lambda k: NOT list_contains(taken, concat(base, '_', k)))[1]) ELSE base END AS id
      FROM named JOIN clash c ON c.part = named.part AND c.n = named.n + 1))
  SELECT id, sequence FROM named WHERE n > 0))
SELECT id, sequence, NULL AS type, NULL AS chars FROM settled
UNION ALL SELECT replace(seq_id, '#', '_') AS id,
  CASE WHEN seq_index % 7 > 0 AND seq_index % 11 > 0 THEN sequence END AS sequence,
  CASE WHEN seq_index % 7 = 0 THEN 'invalid_chars' WHEN seq_index % 11 = 0 THEN 'empty_after_clean' END AS type,
  CASE WHEN seq_index % 7 = 0 THEN 'BX' END AS chars FROM scanned"""),
    "read_peptides_csv": sql("uploads", f"""
SELECT peptide, protein, {_NOTE.replace('new', 'x')} AS attribute_1, attribute_2, NULL::VARCHAR AS attribute_3 FROM uploads"""),
    "read_peptides_csv_simple": sql("uploads", "SELECT peptide, protein FROM uploads WHERE length(peptide) > 0"),
    "read_peptide_list": sql("uploads", "SELECT peptide FROM uploads WHERE length(peptide) > 0 AND peptide_id % 9 > 0"),
    "read_predictions_csv": sql("predictions", """
SELECT 'M1' AS protein, allele, peptide, peptide AS root, netmhcpan_ba_percentile / 100 AS proportion_all,
  netmhcpan_el_percentile FROM predictions"""),
    "read_predictions_csv_wide": sql("predictions", """
SELECT allele, peptide, netmhcpan_el_percentile::FLOAT AS netmhcpan_el_percentile,
  netmhcpan_ba_percentile::FLOAT AS netmhcpan_ba_percentile FROM predictions"""),
    "parse_prediction_json": sql("scan", "SELECT allele, peptide, start, ba FROM scan"),
    "inline_windows": sql("isolates windows", """
SELECT protein, start, len, count(*) AS n, count(DISTINCT substr(sequence, start, len)) AS peptides
FROM isolates CROSS JOIN windows GROUP BY ALL"""),
    # Sinks
    "slim_predictions": sql("predictions", """
SELECT allele, peptide, round_even(netmhcpan_el_percentile / 7, 2)::FLOAT AS netmhcpan_el_percentile,
  round_even(netmhcpan_ba_percentile / 20 + 0.005, 2)::FLOAT AS netmhcpan_ba_percentile FROM predictions"""),
    "slim_peptide_table": sql("scan", f"""
SELECT ({_WIDE})::INT AS "seq #", len::SMALLINT AS "peptide length", allele, peptide, start::INT AS start, end_pos AS "end",
  round_even(el / 7, 2)::FLOAT AS "netmhcpan_el percentile", round_even(ba, 2)::FLOAT AS "netmhcpan_ba percentile" FROM scan"""),
    "partition_by_protein": sql("isolates", """
SELECT seq_id, protein, genotype, host, country, sequence FROM isolates WHERE protein IN ('M1', 'NP')"""),
    "append_predictions": sql("predictions", """
SELECT allele, peptide, netmhcpan_el_percentile::FLOAT AS netmhcpan_el_percentile,
  netmhcpan_ba_percentile::FLOAT AS netmhcpan_ba_percentile FROM predictions"""),
    "export_csv_quoted": sql("uploads", """
SELECT concat('"', peptide_id, '","', attribute_1, ', ""new"" line","', peptide, '",""') AS line FROM uploads"""),
    "export_csv_minimal": sql("uploads", '''
SELECT concat(peptide_id, ',"', attribute_1, ', ""new""",') AS line FROM uploads
UNION ALL SELECT concat(peptide_id, ',,', peptide) FROM uploads'''),
    "export_fasta": sql("scanned", """
SELECT concat('> ', CASE WHEN seq_index % 3 > 0 THEN seq_id ELSE concat('seq_', seq_index) END, chr(10),
  substr(sequence || sequence, 1, 60), chr(10), substr(sequence || sequence, 61)) AS record FROM scanned"""),
    # Filters
    "filter_in": sql("isolates", """
SELECT seq_id, genotype, host FROM isolates WHERE genotype IN ('H1N1', 'H2N2') AND host IN ('Homo sapiens', 'Gallus gallus')"""),
    "filter_in_trimmed": sql("isolates", """
SELECT seq_id, genotype, host FROM isolates WHERE trim(host) IN ('Homo sapiens', 'Gallus gallus')"""),
    "filter_host_category": sql("isolates", """
SELECT 'human' AS choice, seq_id, host FROM isolates WHERE host = 'Homo sapiens'
UNION ALL SELECT 'other', seq_id, host FROM isolates WHERE host <> 'Homo sapiens'
UNION ALL SELECT 'both', seq_id, host FROM isolates"""),
    "filter_partial_date": sql("isolates", f"""
SELECT 'range' AS choice, seq_id, collection_date FROM isolates WHERE {_PARTIAL} BETWEEN DATE '1995-01-01' AND DATE '1997-06-30'
UNION ALL SELECT 'from', seq_id, collection_date FROM isolates WHERE {_PARTIAL} >= DATE '1998-02-01'
UNION ALL SELECT 'to', seq_id, collection_date FROM isolates WHERE {_PARTIAL} <= DATE '1994-12-31'"""),
    "filter_isolates": sql("isolates", f"""
SELECT seq_id, genotype, host, country, collection_date, release_date, sequence FROM isolates
WHERE protein = 'NP' AND genotype IN ('H1N1', 'H2N2', 'H3N3', 'H4N1') AND TRUE AND host <> 'Homo sapiens'
  AND country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5') AND {_PARTIAL} >= DATE '1993-01-01'
  AND TRY_CAST(release_date AS DATE) BETWEEN DATE '1993-01-01' AND DATE '2000-12-31'"""),
    "filter_nonblank": sql("hla", """
SELECT "Class I" AS allele FROM hla WHERE "Class I" IS NOT NULL AND length(trim("Class I")) > 0"""),
    "search_values": sql("isolates", """
, h AS (SELECT seq_id, CASE WHEN seq_id % 3 = 0 AND host IS NOT NULL THEN 'a' || chr(92) || 'b ' || host ELSE host END AS host FROM isolates)
SELECT 'galL%S' AS text, seq_id, host FROM h WHERE regexp_matches(host, 'gall.*s', 'is')
UNION ALL SELECT 'A' || chr(92) || 'b%o', seq_id, host FROM h WHERE regexp_matches(host, 'a\\\\b.*o', 'is')
UNION ALL SELECT 'h' || chr(92), seq_id, host FROM h WHERE contains(lower(host), 'h' || chr(92))"""),
    "filter_peptide_length": sql("uploads", """
, gapped AS (SELECT peptide_id, CASE WHEN peptide_id % 2 = 0 THEN concat(substr(peptide, 1, 3), '--', substr(peptide, 4))
  ELSE peptide END AS peptide FROM uploads)
SELECT 'I' AS mhc_class, 'kept' AS part, peptide_id, replace(peptide, '-', '') AS peptide FROM gapped
  WHERE length(replace(peptide, '-', '')) BETWEEN 8 AND 14
UNION ALL SELECT 'I', 'excluded', peptide_id, peptide FROM gapped WHERE length(replace(peptide, '-', '')) NOT BETWEEN 8 AND 14
UNION ALL SELECT 'II', 'kept', peptide_id, peptide FROM gapped WHERE length(peptide) BETWEEN 11 AND 30
UNION ALL SELECT 'II', 'excluded', peptide_id, peptide FROM gapped WHERE length(peptide) NOT BETWEEN 11 AND 30"""),
    "filter_alphabet": sql("isolates", """
SELECT seq_id, sequence FROM isolates WHERE translate(sequence, 'ACDEFGHIKLMNPQRSTVWY', '') = '' AND sequence <> ''"""),
    "filter_root_rows": sql("annotated", "SELECT allele, peptide, root FROM annotated WHERE peptide = root AND peptide <> ''"),
    "filter_frequency": sql("frequencies", """
SELECT protein, position, aminoacid, frequency_all FROM frequencies
WHERE frequency_all >= 8 AND aminoacid <> '-' AND protein NOT IN ('HA')"""),
    "select_metric": sql("live", """
SELECT position, aminoacid, value_unique AS value, frequency_unique AS frequency, total_unique AS total FROM live"""),
    "select_facet": sql("isolates", """
SELECT host AS facet, count(*) AS n, count(DISTINCT sequence) AS sequences FROM isolates
WHERE host IN ('Homo sapiens', 'AUTOMOBILE') GROUP BY host"""),
    "resolve_percentile_column": sql("scan", """
SELECT allele, peptide, start, el, ba, ba AS ba_by_class, NULL::DOUBLE AS el_by_row, NULL::DOUBLE AS ba_by_row, NULL::DOUBLE AS ba_explicit FROM scan
UNION ALL SELECT allele, peptide, start, NULL, NULL, NULL, el, ba, CASE start % 6 WHEN 3 THEN ba + 1 WHEN 5 THEN ba END FROM scan"""),
    "resolve_length_column": sql("scan", """
SELECT seq_no, len AS length, allele, peptide FROM scan UNION ALL SELECT 1, len, allele, peptide FROM scan"""),
    "normalize_predictions": sql("scan", """
SELECT allele, peptide, el AS netmhcpan_el_percentile, ba AS netmhcpan_ba_percentile FROM scan"""),
    "filter_predictions_slice": sql("scan", """
SELECT allele, peptide, start, ba FROM scan WHERE seq_no = 1 AND len = 9 AND allele = 'HLA-A*11:01'"""),
    "filter_aligned_for_sequence": sql("occurrences", "SELECT * FROM occurrences WHERE seq_index = 2 AND length = 9"),
    "classify_aligned": sql("aligned", """
SELECT peptide_id, CASE peptide_id % 4 WHEN 0 THEN 'Misaligned' WHEN 1 THEN 'ALIGNED ok' WHEN 2 THEN 'new' END AS status,
  CASE peptide_id % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE coalesce(length(peptide_aligned), 0) > 0 END AS is_aligned
FROM aligned"""),
    "percentile_band": sql("scan", """
SELECT allele, CASE WHEN el IS NULL THEN 'no data' WHEN el <= 2 THEN 'strong' WHEN el <= 50 THEN 'medium' ELSE 'weak' END AS band,
  count(*) AS n FROM scan GROUP BY ALL"""),
    "residue_group": sql("isolates", """
, cells AS (SELECT protein, substr(sequence, position, 1) AS aa FROM (
  SELECT protein, sequence, unnest(generate_series(1, length(sequence))) AS position FROM isolates))
SELECT protein, CASE WHEN aa IN ('P','G','A','L','V','I') THEN 'aliphatic' WHEN aa IN ('Y','W','F') THEN 'aromatic'
  WHEN aa IN ('M','C') THEN 'sulfur-containing' WHEN aa IN ('S','T') THEN 'hydroxylic' WHEN aa IN ('H','K','R') THEN 'basic'
  WHEN aa IN ('D','E') THEN 'acidic' WHEN aa IN ('N','Q') THEN 'amidic' END AS residue_group, count(*) AS n
FROM cells GROUP BY ALL"""),
    "attribute_categories": sql("uploads", """
SELECT DISTINCT CASE WHEN trim(attribute_2) <> '' THEN attribute_2 END AS category,
  coalesce(trim(attribute_2), '') = '' AS missing FROM uploads"""),
    # Joins and lateral operators
    "explode_positions": sql("isolates", """
, cells AS (SELECT seq_id, sequence, unnest(generate_series(1, length(sequence)))::INT AS position FROM isolates)
SELECT position, substr(sequence, position, 1) AS aminoacid, count(*) AS n, sum(seq_id)::BIGINT AS id_sum FROM cells GROUP BY ALL"""),
    "cross_windows": sql("isolates windows", """
SELECT seq_id, start, len, substr(sequence, start, len) AS peptide FROM isolates CROSS JOIN windows"""),
    "full_outer_all_unique": sql("isolates windows", """
SELECT protein, start, len, substr(sequence, start, len) AS peptide, count(*) AS frequency_all, count(DISTINCT sequence) AS frequency_unique
FROM isolates, windows GROUP BY ALL"""),
    "left_join_totals": sql("frequencies", """
SELECT protein, position, aminoacid, frequency_all, total_all, value FROM frequencies"""),
    "join_top_facets": sql("isolates", """
, once AS (SELECT country AS facet, sequence, count(*) AS copies FROM isolates GROUP BY ALL)
SELECT facet, sequence, copies FROM once
JOIN (SELECT facet FROM once GROUP BY facet ORDER BY count(*) DESC, facet LIMIT 6) USING (facet)"""),
    "missing_predictions": sql("missing", "SELECT allele, peptide FROM missing"),
    "missing_request": sql("missing", """
SELECT DISTINCT 'allele' AS kind, allele AS name FROM missing UNION ALL SELECT DISTINCT 'peptide', peptide FROM missing"""),
    "merge_predictions": sql("scan", """
SELECT allele, peptide, el, ba FROM (SELECT *, row_number() OVER (
  PARTITION BY allele, peptide ORDER BY ba >= 60 DESC, seq_no DESC, start DESC) AS r FROM scan) WHERE r = 1"""),
    "restrict_predictions": sql("predictions uploads", """
SELECT * FROM predictions WHERE allele IN ('HLA-A*02:01', 'HLA-A*11:01') AND peptide IN (SELECT peptide FROM uploads)"""),
    "predictions_for_peptides": sql("scan uploads", """
SELECT seq_no, allele, peptide, start FROM scan WHERE peptide IN (SELECT peptide FROM uploads)"""),
    "overlay_percentiles": sql("scan uploads", """
SELECT peptide_id, u.peptide, a.allele, netmhcpan_el_percentile, netmhcpan_ba_percentile
FROM uploads u CROSS JOIN (VALUES ('HLA-A*02:01'), ('HLA-A*11:01')) a(allele)
LEFT JOIN (SELECT allele, peptide, arg_max(el, seq_no * 1000 + start) FILTER (el IS NOT NULL) AS netmhcpan_el_percentile,
  arg_max(ba, seq_no * 1000 + start) AS netmhcpan_ba_percentile FROM scan GROUP BY ALL) p ON p.peptide = u.peptide AND p.allele = a.allele"""),
    "percentile_by_allele_key": sql("aligned scan", """
, known AS (SELECT peptide, arg_max(el, seq_no * 1000 + start) AS el FROM scan
  WHERE allele = 'HLA-A*02:01' AND el IS NOT NULL GROUP BY peptide)
SELECT peptide_id, coalesce(u.el, g.el) AS percentile FROM aligned a
LEFT JOIN known u ON a.peptide_id % 2 = 0 AND u.peptide = a.peptide
LEFT JOIN known g ON g.peptide = replace(a.peptide_aligned, '-', '')"""),
    "allele_matrix": sql("predictions", """
SELECT peptide, max(netmhcpan_ba_percentile) FILTER (allele = 'HLA-A*02:01') AS "HLA-A*02:01",
  max(netmhcpan_ba_percentile) FILTER (allele = 'HLA-A*11:01') AS "HLA-A*11:01",
  max(netmhcpan_ba_percentile) FILTER (allele = 'HLA-B*35:03') AS "HLA-B*35:03"
FROM predictions WHERE allele <> 'HLA-C*04:01' GROUP BY peptide"""),
    "align_peptides": sql("aligned", """
SELECT peptide_id, protein, peptide, length_raw, length, start_raw, start, peptide_aligned, length AS aligned_length FROM aligned"""),
    "find_occurrences": sql("occurrences", "SELECT * FROM occurrences"),
    "compare_reference_consensus": sql("refs consensus_all", """
, r AS (SELECT protein, position, substr(aligned_sequence, position, 1) AS reference FROM (
  SELECT protein, aligned_sequence, unnest(generate_series(1, length(aligned_sequence)))::INT AS position FROM refs))
SELECT protein, position, reference, aminoacid AS consensus, coalesce(reference = aminoacid, false) AS is_match,
  coalesce(reference = '-' AND aminoacid = '-', false) AS both_gap
FROM r FULL JOIN consensus_all USING (protein, position)"""),
    "mismatch_template": sql("first_tallies", """
, shown AS (SELECT 'MKTAYIAKQ' AS k UNION ALL (SELECT peptide FROM first_tallies
  WHERE upper(replace(peptide, '-', '')) <> 'MKTAYIAKQ' ORDER BY proportion_all DESC, peptide LIMIT 4)),
bare AS (SELECT upper(replace(k, '-', '')) AS k FROM shown),
d AS (SELECT k, substr(k, 1, 4) || '--' || substr(k, 5) AS display FROM bare)
SELECT k AS ungapped_key, display AS display_peptide,
  list_aggregate(list_transform(range(1, length(display) + 1), lambda i:
    CASE WHEN substr(display, i, 1) = substr('MKTA--YIAKQ', i, 1) THEN '.' ELSE 'x' END), 'string_agg', '') AS mismatches FROM d"""),
    "peptide_proportion_lookup": sql("aligned tallies", """
SELECT peptide_id, coalesce(max(proportion_all), 0) AS proportion FROM aligned a
LEFT JOIN tallies t ON t.protein = a.protein AND t.start = a.start AND t.len = a.length
  AND replace(t.peptide, '-', '') = replace(coalesce(a.peptide_aligned, a.peptide), '-', '')
GROUP BY peptide_id"""),
    "window_roots": sql("roots", "SELECT protein, peptide, root FROM roots"),
    "annotate_predictions": sql("annotated", "SELECT * FROM annotated"),
    "label_sequences": sql("scan scanned", """
SELECT coalesce(q.seq_id, concat('seq', seq_no)) AS label, allele, peptide, start FROM scan
LEFT JOIN scanned q ON q.seq_index = scan.seq_no AND q.seq_index % 4 > 0"""),
    "qualifying_root_join": sql("qualifying", "SELECT allele, peptide, one_root, root FROM qualifying"),
    # Aggregations
    "position_frequencies": sql("live", "SELECT * FROM live"),
    "position_frequencies_fast": sql("frequencies", "SELECT * EXCLUDE (protein) FROM frequencies WHERE protein = 'NP'"),
    "build_position_table": sql("frequencies", "SELECT * FROM frequencies"),
    "window_tallies": sql("nonhuman windows", f"SELECT * FROM ({_tallies('nonhuman', 'windows')})"),
    "window_tallies_selected": sql("first_tallies", """
SELECT * EXCLUDE (start, len) FROM first_tallies UNION ALL
SELECT 'QQQQQQQQQ', 0, max(total_all), 0.0, 0, max(total_unique), 0.0 FROM first_tallies"""),
    "upload_window_tallies": sql("tallies", "SELECT * FROM tallies"),
    "peptide_tallies": sql("tallies aligned", """
, s AS (SELECT protein, peptide, sum(frequency_all)::BIGINT AS fa, arg_min(total_all, start * 1000 + len) AS ta,
  sum(frequency_unique)::BIGINT AS fu, arg_min(total_unique, start * 1000 + len) AS tu FROM tallies
  WHERE (protein, upper(peptide)) IN (SELECT (protein, upper(peptide_aligned)) FROM aligned WHERE start > 0) GROUP BY ALL)
SELECT protein, peptide, fa AS frequency_all, ta AS total_all, fa::DOUBLE / ta AS proportion_all,
  fu AS frequency_unique, tu AS total_unique, fu::DOUBLE / tu AS proportion_unique FROM s"""),
    "distinct_values": sql("isolates", """
SELECT trim(host) AS val, count(*) AS n FROM isolates WHERE host IS NOT NULL AND length(trim(host)) > 0 GROUP BY 1"""),
    "consensus": sql("live", """
SELECT position, aminoacid FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY value_unique DESC, aminoacid) AS r
  FROM live) WHERE r = 1"""),
    "conservation_series": sql("live", """
SELECT position, value, aminoacid FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY value DESC, aminoacid) AS r
  FROM live) WHERE r = 1"""),
    "facet_conservation": sql("facet_ranks", """
SELECT facet, position, aminoacid, frequency, total, share AS value FROM facet_ranks WHERE r = 1"""),
    "facet_conservation_unique": sql("nonhuman_genotypes", f"""
, facet_counts AS ({CTES['facet_counts'].replace('nonhuman_facets', 'nonhuman_genotypes')}),
facet_ranks AS ({CTES['facet_ranks']})
SELECT facet, position, aminoacid, frequency, total, share AS value_unique FROM facet_ranks WHERE r = 1"""),
    "diversity_stack": sql("frequencies", """
, b AS (SELECT *, max(value) OVER (PARTITION BY protein, position) AS top FROM frequencies),
s AS (SELECT protein, position, aminoacid, value, sum(value) OVER (PARTITION BY protein, position ORDER BY value DESC, aminoacid
  ROWS UNBOUNDED PRECEDING) AS y1 FROM b WHERE value <> top)
SELECT protein, position, aminoacid, round(y1 - value, 9) AS y0, round(y1, 9) AS y1 FROM s"""),
    "sequence_totals": sql("nonhuman", """
SELECT count(*) AS total_all, count(DISTINCT sequence) AS total_unique FROM nonhuman"""),
    "metric_delta": sql("m1 nonhuman", """
, a AS (SELECT count(*) AS n, count(DISTINCT sequence) AS u FROM m1), b AS (SELECT count(*) AS n, count(DISTINCT sequence) AS u FROM nonhuman)
SELECT a.n AS total_all_previous, b.n AS total_all_current, a.u AS total_unique_previous, b.u AS total_unique_current,
  b.n - a.n AS total_all_delta, b.u - a.u AS total_unique_delta FROM a, b"""),
    "aligned_summary": sql("aligned", """
SELECT protein, count(*) FILTER (length(peptide_aligned) > 0) AS aligned,
  count(*) FILTER (coalesce(length(peptide_aligned), 0) = 0) AS not_aligned FROM aligned GROUP BY protein"""),
    "conserved_summary": sql("aligned tallies", """
, u AS (SELECT DISTINCT protein, peptide FROM aligned),
s AS (SELECT u.protein, u.peptide, coalesce(max(proportion_all), 0) AS share FROM u
  LEFT JOIN tallies t ON t.protein = u.protein AND replace(t.peptide, '-', '') = u.peptide GROUP BY 1, 2)
SELECT protein, count(*) FILTER (share > 0.95) AS conserved, count(*) FILTER (share < 0.95) AS not_conserved FROM s GROUP BY protein"""),
    "frequency_summary": sql("aligned tallies", """
, r AS (SELECT DISTINCT protein, peptide AS root, start, length AS len FROM aligned WHERE start > 0),
g AS (SELECT protein, root, replace(t.peptide, '-', '') AS peptide, sum(frequency_all)::BIGINT AS fa, max(total_all) AS ta,
  sum(frequency_unique)::BIGINT AS fu, max(total_unique) AS tu FROM r JOIN tallies t USING (protein, start, len)
  WHERE replace(t.peptide, '-', '') <> '' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY protein, root, peptide = root ORDER BY fa DESC, fu DESC, peptide) AS place FROM g)
SELECT peptide, protein, fa AS frequency_all, ta AS total_all, fa::DOUBLE / ta AS proportion_all,
  fu AS frequency_unique, tu AS total_unique, fu::DOUBLE / tu AS proportion_unique, root AS root_peptide
FROM k WHERE place <= 4 AND (protein, root) IN (SELECT (protein, root) FROM g WHERE peptide = root)"""),
    "min_percentile_by_position": sql("scan", """
, cells AS (SELECT *, unnest(generate_series(start, end_pos))::INT AS position FROM scan WHERE el IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY seq_no, len, allele, position ORDER BY el, start, peptide) AS r FROM cells)
SELECT seq_no, len AS peptide_length, allele, position, el AS pct, peptide, substr(peptide, position - start + 1, 1) AS aminoacid
FROM k WHERE r = 1"""),
    "position_extent": sql("scan", """
SELECT seq_no, len AS peptide_length, 1 AS first, max(end_pos) AS last FROM scan WHERE el IS NOT NULL GROUP BY ALL"""),
    "min_percentile_by_peptide": sql("scan", """
SELECT peptide, min(el) AS pct, 'any' AS allele FROM scan WHERE seq_no = 1 AND len = 9 AND el IS NOT NULL GROUP BY peptide
UNION ALL SELECT peptide, arg_max(el, start), 'HLA-B*35:03' FROM scan
WHERE seq_no = 2 AND len = 9 AND allele = 'HLA-B*35:03' AND el IS NOT NULL GROUP BY peptide"""),
    "available_lengths": sql("scan", """
SELECT DISTINCT seq_no, len AS length FROM scan WHERE (seq_no = 1 OR len < 8 + seq_no % 4) AND len BETWEEN 9 AND 11"""),
    "binders_per_peptide": sql("annotated", """
SELECT protein, peptide, min(proportion_all) AS proportion_all, count(*) FILTER (netmhcpan_el_percentile <= 20) AS binders,
  count(DISTINCT allele) AS alleles FROM annotated WHERE peptide = root AND peptide <> '' GROUP BY ALL"""),
    "windows_score": sql("qualifying", """
SELECT protein, one_root AS peptide, round(sum(proportion_all), 9) AS score, count(*) AS count,
  count(DISTINCT allele) AS allele_count FROM qualifying GROUP BY ALL"""),
    "proportion_histogram": sql("scan", """
, edges AS (SELECT unnest(generate_series(1, 19)) * 0.05::DOUBLE AS edge)
SELECT (SELECT count(*) FROM edges WHERE edge <= ba / 100)::INT AS bin, protein, count(*) AS n FROM scan GROUP BY ALL"""),
    "protein_row_counts": sql("isolates", """
SELECT protein, count(*) AS rows, (SELECT count(DISTINCT protein) FROM isolates) AS proteins FROM isolates
WHERE protein IS NOT NULL GROUP BY protein ORDER BY rows DESC, protein LIMIT 20"""),
    "max_overlap_depth": sql("aligned", """
, p AS (SELECT DISTINCT protein, start AS position FROM aligned WHERE start > 0)
SELECT protein, max(n) AS lanes FROM (SELECT p.protein, p.position, count(*) AS n FROM p
  JOIN aligned a ON a.protein = p.protein AND a.start <= p.position AND p.position < a.start + a.length GROUP BY ALL)
GROUP BY protein"""),
    "generate_peptides": sql("frequencies", """
, f AS MATERIALIZED (SELECT protein, aminoacid, position, dense_rank() OVER (PARTITION BY protein ORDER BY position) AS nth
  FROM frequencies WHERE frequency_all >= total_all * 0.002 + 6 AND aminoacid <> '-' AND protein <> 'HA'),
grown AS (WITH RECURSIVE g(protein, nth, size, start_position, end_position, peptide) AS (
  SELECT protein, nth, 1, position, position, aminoacid FROM f UNION ALL
  SELECT g.protein, f.nth, g.size + 1, g.start_position, f.position, g.peptide || f.aminoacid
  FROM g JOIN f ON f.protein = g.protein AND f.nth = g.nth + 1 WHERE g.size < 14) SELECT * FROM g)
SELECT protein, size AS peptide_len, min(start_position) AS start_position, min(end_position) AS end_position, peptide
FROM grown WHERE size >= 8 GROUP BY protein, size, peptide"""),
    "class_one_workset": sql("uploads candidates", """
SELECT DISTINCT protein, p AS peptide FROM (SELECT protein, peptide AS p FROM uploads
  UNION ALL SELECT protein, replace(peptide, '-', '') FROM candidates) WHERE length(p) BETWEEN 8 AND 14"""),
    "request_batches": sql("predictions", """
, n AS (SELECT peptide, row_number() OVER (ORDER BY peptide) - 1 AS n FROM (SELECT DISTINCT peptide FROM predictions))
SELECT n // 1000 + 1 AS batch, count(*) AS peptides, string_agg(concat('>p', n % 1000 + 1, chr(10), peptide), chr(10) ORDER BY n) AS fasta
FROM n GROUP BY 1"""),
    "request_batches_by_length": sql("predictions", """
, n AS (SELECT length(peptide)::INT AS len, peptide, row_number() OVER (PARTITION BY length(peptide) ORDER BY peptide) - 1 AS n
  FROM (SELECT DISTINCT peptide FROM predictions))
SELECT row_number() OVER (ORDER BY len, n // 1000) AS batch, len AS peptide_len, count(*) AS peptides,
  string_agg(concat('>', n % 1000 + 1, chr(10), peptide), chr(10) ORDER BY n) AS fasta FROM n GROUP BY len, n // 1000"""),
    # Ranking, sorting, paging, set operations
    "rank_facet_residue": sql("facet_ranks", "SELECT * FROM facet_ranks"),
    "top_candidates_by_window": sql("candidates", """
SELECT protein, start, len, peptide, r_all, r_u, proportion_all, proportion_unique, frequency_all, total_all, frequency_unique, total_unique
FROM candidates"""),
    "top_alternates": sql("first_tallies", """
, rest AS (SELECT *, row_number() OVER (ORDER BY proportion_all DESC, peptide) AS r FROM first_tallies
  WHERE upper(replace(peptide, '-', '')) <> 'MKTAYIAKQ')
SELECT 0 AS rank, peptide, proportion_all AS proportion, frequency_all AS frequency, total_all AS total, peptide AS ungapped_key
FROM first_tallies WHERE peptide = 'MKTAYIAKQ'
UNION ALL SELECT r::INT, peptide, proportion_all, frequency_all, total_all, replace(peptide, '-', '') FROM rest WHERE r <= 4"""),
    "residue_ranking": sql("frequencies", """
SELECT protein, position, aminoacid, value, row_number() OVER (PARTITION BY protein, position ORDER BY value DESC, aminoacid)::INT AS rank
FROM frequencies"""),
    "page_values": sql("isolates", """
SELECT val, 'first' AS page FROM (SELECT trim(country) AS val, count(*) AS n FROM isolates WHERE length(trim(country)) > 0
  GROUP BY 1 ORDER BY n DESC, val LIMIT 20 OFFSET 3)
UNION ALL SELECT val, 'search' FROM (SELECT trim(country) AS val FROM isolates WHERE country ILIKE '%nation_1%'
  GROUP BY 1 ORDER BY val LIMIT 50 OFFSET 2)"""),
    "top_facets": sql("isolates", """
SELECT host AS facet, count(*) AS n FROM isolates GROUP BY host ORDER BY n DESC, host NULLS LAST LIMIT 6"""),
    "allele_options": sql("hla", """
SELECT name AS allele, replace(kind, 'Class ', '') AS page FROM (
  SELECT kind, trim(written) AS name FROM (UNPIVOT hla ON "Class I", "Class II" INTO NAME kind VALUE written)
  WHERE kind = 'Class I' OR contains(lower(written), 'drb1*1'))
WHERE name <> '' GROUP BY kind, name
QUALIFY CASE kind WHEN 'Class I' THEN row_number() OVER (PARTITION BY kind ORDER BY name) BETWEEN 6 AND 25
  ELSE row_number() OVER (PARTITION BY kind ORDER BY name) BETWEEN 2 AND 51 END"""),
    "distinct_sequences": sql("isolates", "SELECT protein, sequence, count(*) AS copies FROM isolates GROUP BY ALL"),
    "distinct_windows": sql("aligned", "SELECT DISTINCT protein, start, length AS len FROM aligned WHERE start > 0 AND length > 0"),
    "ordered_positions": sql("live", "SELECT position, aminoacid, frequency_all FROM live"),
}

ORACLES["align_references"] = sql("scanned frequencies", """
, raw AS (SELECT seq_index, protein, concat(substr(sequence, 1, 20 + seq_index % 9), substr(sequence, 24 + seq_index % 13)) AS raw_sequence FROM scanned),
profiles AS (SELECT protein, max(position) AS columns FROM frequencies GROUP BY protein),
given AS (SELECT row_number() OVER () AS id, protein, columns, raw_sequence, length(raw_sequence) AS letters,
    greatest(75, abs(columns - length(raw_sequence)) + 20) AS band
  FROM (SELECT DISTINCT protein, raw_sequence FROM raw) JOIN profiles USING (protein)),
-- What a letter scores in a column: by its share, else 0 where X occurs, else -5.
fits AS (SELECT p.protein, l.letter, list(CASE WHEN f.value > 0 THEN 2 * ln(f.value / 0.05) WHEN x.value IS NOT NULL THEN 0 ELSE -5 END ORDER BY p.position) AS fit
  FROM (SELECT protein, unnest(generate_series(1, columns)) AS position FROM profiles) p
  CROSS JOIN (SELECT DISTINCT unnest(string_split(raw_sequence, '')) AS letter FROM raw) l
  LEFT JOIN frequencies f ON f.protein = p.protein AND f.position = p.position AND f.aminoacid = l.letter
  LEFT JOIN frequencies x ON x.protein = p.protein AND x.position = p.position AND x.aminoacid = 'X'
  GROUP BY p.protein, l.letter),
-- The fits of a sequence, letter by letter.
scored AS (SELECT g.id, list(f.fit ORDER BY s.j) AS fit FROM (SELECT *, unnest(generate_series(1, letters)) AS j FROM given) s
  JOIN given g USING (id) JOIN fits f ON f.protein = s.protein AND f.letter = substr(s.raw_sequence, s.j, 1) GROUP BY g.id),
aligned_texts AS (
  WITH RECURSIVE cells(id, d, before, last) USING KEY (id) AS (
    -- Of each column, three scores and their texts: the letter on the column, the column skipped, the letter on its own.
    SELECT id, 0, list_transform(range(columns + 1), lambda i: {m: -1e9, x: -1e9, y: -1e9, tm: '', tx: '', ty: ''}),
      list_transform(range(columns + 1), lambda i: {m: CASE WHEN i = 0 THEN 0e0 ELSE -1e9 END, x: -1e9, y: -1e9, tm: '', tx: '', ty: ''})
    FROM given
    UNION
    SELECT id, d + 1, last, list_transform(steps, lambda s: CASE
        WHEN NOT s.inside THEN {m: -1e9, x: -1e9, y: -1e9, tm: '', tx: '', ty: ''}
        WHEN s.j = 0 THEN {m: -1e9, x: -5 - 2e0 * d, y: -1e9, tm: '', tx: repeat('-', d + 1), ty: ''}
        WHEN s.i = 0 THEN {m: -1e9, x: -1e9, y: -5 - 2e0 * d, tm: '', tx: '', ty: substr(raw_sequence, 1, d + 1)}
        ELSE {m: greatest(s.p.m + s.fit, s.p.x + s.fit, s.p.y + s.fit), x: greatest(s.l.m - 5, s.l.x - 2), y: greatest(s.u.m - 5, s.u.y - 2),
              tm: CASE WHEN s.p.m + s.fit >= greatest(s.p.x + s.fit, s.p.y + s.fit) THEN s.p.tm WHEN s.p.x + s.fit >= s.p.y + s.fit THEN s.p.tx ELSE s.p.ty END || substr(raw_sequence, s.j, 1),
              tx: CASE WHEN s.l.m - 5 >= s.l.x - 2 THEN s.l.tm ELSE s.l.tx END || '-',
              ty: CASE WHEN s.u.m - 5 >= s.u.y - 2 THEN s.u.tm ELSE s.u.ty END || substr(raw_sequence, s.j, 1)} END)
    FROM (SELECT c.id, c.d, c.last, g.raw_sequence, list_transform(range(g.columns + 1), lambda i: {
            i: i, j: c.d + 1 - i, inside: c.d + 1 - i BETWEEN 0 AND g.letters AND abs(2 * i - c.d - 1) <= g.band,
            p: c.before[i], l: c.last[i], u: c.last[i + 1], fit: s.fit[c.d + 1 - i][i]}) AS steps
          FROM cells c JOIN given g USING (id) JOIN scored s USING (id) WHERE c.d < g.columns + g.letters))
  SELECT g.protein, g.raw_sequence, CASE WHEN e.m >= greatest(e.x, e.y) THEN e.tm WHEN e.x >= e.y THEN e.tx ELSE e.ty END AS aligned_sequence
  FROM (SELECT id, last[-1] AS e FROM cells) JOIN given g USING (id))
SELECT seq_index, raw_sequence, aligned_sequence FROM raw LEFT JOIN aligned_texts USING (protein, raw_sequence)""")
ORACLES["merge_stored_predictions"] = ORACLES["merge_predictions"]
ORACLES["read_prediction_json"] = sql("scan", """
SELECT 'name' AS naming, allele, ((ba * 10)::INT)::VARCHAR AS peptide, start::VARCHAR AS start FROM scan
UNION ALL SELECT 'filled', allele, peptide, ((ba * 10)::INT)::VARCHAR FROM scan""")
