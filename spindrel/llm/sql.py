"""SQL for those queries of this subpackage that SQL can express."""

# Components as all pairs of a record and what it reaches over its keys.
P1_FOUND = r"""WITH RECURSIVE s AS (SELECT sample_id AS id, min(depositor) AS d, min(source_ref) AS r, min(regexp_replace(lower(split), '^\s+|\s+$', '', 'g')) AS split FROM smiles GROUP BY 1),
 a AS (SELECT graph_id AS id, string_agg(coalesce(atom_type, -1)::varchar, ',' ORDER BY node_id) AS k FROM (SELECT DISTINCT graph_id, node_id, atom_type FROM nodes WHERE node_id IS NOT NULL) GROUP BY 1),
 e AS (SELECT id, 'd' || regexp_replace(lower(d), '[\s\-\x{00a0}\x{2010}-\x{2015}]', '', 'g') AS k FROM s WHERE d IS NOT NULL UNION SELECT id, 'r' || trim(r) FROM s WHERE r IS NOT NULL UNION SELECT id, 'm' || a.k FROM a JOIN s USING (id)),
 u AS (SELECT id::varchar AS x, k AS y FROM e WHERE length(k) > 1 UNION ALL SELECT k, id::varchar FROM e WHERE length(k) > 1),
 c(root, x) AS (SELECT id, id::varchar FROM s UNION SELECT c.root, u.y FROM c JOIN u ON u.x = c.x),
 g AS (SELECT root, min(try_cast(x AS bigint)) AS component FROM c GROUP BY 1),
 mixed AS (SELECT component FROM g JOIN s ON s.id = root WHERE split IN ('train', 'valid', 'test') GROUP BY 1 HAVING count(DISTINCT split) > 1)
 SELECT root AS sample_id FROM g JOIN mixed USING (component)"""

# All pairs that share a stretch, with how many they share.
P3_FOUND = r"""WITH p AS (SELECT protein_id AS id, regexp_replace(upper(min(sequence)), '[^A-Z]', '', 'g') AS s FROM sequences WHERE sequence IS NOT NULL GROUP BY 1),
 g AS (SELECT DISTINCT id, s[k:k + 4] AS w FROM (SELECT id, s, unnest(range(1, length(s) - 3)) AS k FROM p)), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
 m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM g a JOIN g b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2)
 SELECT id_a, id_b FROM m JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE shared >= 0.5 * (x.n + y.n - shared)"""

# Parts between marks with residues, and turns of the chain in the table of residues.
P6_FOUND = r"""WITH p AS (SELECT protein_id AS id, min(sequence) AS t FROM sequences WHERE sequence IS NOT NULL GROUP BY 1),
 parts AS (SELECT id, unnest(string_split_regex(t, '[^A-Za-z\s\d*\-\x{00ad}\x{200b}-\x{200f}\x{2060}\x{feff}]+')) AS s, unnest(range(length(t) + 1)) AS k FROM p),
 sized AS (SELECT id, k, length(regexp_replace(s, '[^A-Za-z]', '', 'g')) AS n FROM parts WHERE s IS NOT NULL),
 starts AS (SELECT id, n, sum(n) OVER (PARTITION BY id ORDER BY k) - n AS pos, sum(n) OVER (PARTITION BY id) AS total FROM sized),
 r AS (SELECT graph_id, residue_id, min(coalesce(chain_id, '')) AS c FROM residues WHERE graph_id IS NOT NULL AND residue_id IS NOT NULL GROUP BY 1, 2),
 turns AS (SELECT graph_id AS id, residue_id AS pos FROM (SELECT *, lag(c) OVER (PARTITION BY graph_id ORDER BY residue_id) AS b FROM r) WHERE b <> c),
 long AS (SELECT DISTINCT id, total FROM starts WHERE total > 512)
 SELECT id AS protein_id, pos::bigint AS chain_start FROM starts WHERE n > 0 AND total > 512
 UNION SELECT id, pos::bigint FROM turns JOIN long USING (id) WHERE pos > 0 AND pos < total"""
