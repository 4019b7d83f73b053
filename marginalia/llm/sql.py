r"""DuckDB SQL of the queries that SQL can express over whole tables, written from the contracts and not from the operators.

Not here: op2 and op9 (units, alignment), op5 (trees), op6 (a search that may miss), op7 (tokenizer), op10 (markup), op13 (a trained model).
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')"

#: All pairs that share a shingle, then reachability.
OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(shingle) AS h, n FROM s JOIN n USING (doc_id)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
near AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
edge AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT DISTINCT a, a AS b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root.root, d.doc_id) AS component_id, coalesce(root.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.a = d.doc_id
"""

OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

#: The line rules of the quality operator, with its phrases and limits.
OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
phrase AS (SELECT unnest(['enable javascript', 'cookie policy', 'cookies to', 'privacy policy', 'terms of use', 'terms of service', 'all rights reserved', 'lorem ipsum', 'click here', 'sign up for our newsletter', 'share this']) AS p),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
line AS (SELECT *, len(regexp_extract_all(line, '[^ \t-\r]+')) AS k, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM cut),
rated AS (SELECT *, (SELECT sum((length(low) - length(replace(low, p, ''))) // length(p) * len(string_split(p, ' '))) FROM phrase) AS boiler, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup FROM line WHERE k > 0),
judged AS (SELECT *, CASE WHEN 3 * sym >= k THEN 'symbols' WHEN k >= 4 AND regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '\p{Ll}') THEN 'shouting'
  WHEN boiler > 0 AND (k <= 30 OR 5 * boiler >= k) THEN 'boilerplate' WHEN k < 8 AND NOT regexp_matches(line, '[.!?:;"'')…”»。][ \t-\r]*$') THEN 'navigation' END AS why FROM rated),
lines AS (SELECT doc_id, count_if(dup) AS dup, sum(CASE WHEN dup OR why IS NOT NULL THEN k ELSE 0 END) AS lost, count_if(why = 'symbols') AS s, count_if(why = 'shouting') AS c, count_if(why = 'boilerplate') AS b, count_if(why = 'navigation') AS v FROM judged GROUP BY doc_id),
ws AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t-\r]+') AS ws FROM d),
spot AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM ws),
three AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM spot WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM three WHERE c IS NOT NULL),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT ws.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
  coalesce(lost, 0)::BIGINT AS n_lost_words, coalesce(s, 0) AS n_symbol_lines, coalesce(c, 0) AS n_shout_lines, coalesce(b, 0) AS n_boilerplate_lines, coalesce(v, 0) AS n_nav_lines FROM ws LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept FROM f
"""

#: Every seat of every source and shard is ranked, where the operator ranks only those near the common divisor.
OP3 = rf"""
WITH s AS (SELECT doc_id, source, len({WORDS}) AS size, md5(concat_ws(':', 7, doc_id, md5(text))) AS mark FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM s GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w FROM per),
before AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER o, 0) AS size_before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left FROM weighed WINDOW o AS (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (total - 3 * size_before) / w_left * w > 3 * source_size AS capped FROM before),
t AS (SELECT source, source_size, docs, CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE (total - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN w END) OVER () * w END AS target FROM capped),
seat AS (SELECT source, target, unnest(range(ceil(3 * source_size / 16)::BIGINT)) AS k FROM t),
won AS (SELECT source, count(*) AS quota FROM (SELECT source FROM seat ORDER BY target / (2 * k + 1) DESC, source IS NULL, source LIMIT (SELECT round(round(sum(target) / 16, 6))::BIGINT FROM t)) GROUP BY source),
placed AS (SELECT s.*, source_size, target, coalesce(quota, 0) AS quota, ('0x' || substr(mark, 17, 15))::BIGINT % ceil(docs / 1000)::BIGINT AS shard FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON s.source IS NOT DISTINCT FROM won.source),
shard AS (SELECT source, shard, any_value(quota) AS source_quota, sum(size)::BIGINT AS shard_size, greatest(1, round(sum(size) / 16))::BIGINT AS ring FROM placed GROUP BY source, shard),
place AS (SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1) DESC, shard) AS r FROM (SELECT *, unnest(range(CASE WHEN shard_size > 0 THEN 3 * ring ELSE 0 END)) AS k FROM shard)),
held AS (SELECT source, shard, count(*) AS q FROM place WHERE r <= source_quota GROUP BY source, shard),
turn AS (SELECT shard.*, coalesce(q, 0) // ring AS copies, coalesce(q, 0) % ring AS extra, ('0x' || substr(md5(concat_ws(':', 7, (shard.source IS NULL)::VARCHAR, coalesce(shard.source, ''), shard.shard)), 1, 15))::BIGINT % ring AS first FROM shard LEFT JOIN held ON shard.source IS NOT DISTINCT FROM held.source AND shard.shard = held.shard),
run AS (SELECT p.*, copies, first * shard_size // ring AS a, least(first + extra, ring) * shard_size // ring AS b, greatest(first + extra - ring, 0) * shard_size // ring AS c,
  (sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM placed p JOIN turn ON p.source IS NOT DISTINCT FROM turn.source AND p.shard = turn.shard)
SELECT doc_id, size, source_size, target, copies * size + greatest(0, least(e, b) - greatest(e - size, a)) + greatest(0, least(e, c) - (e - size)) AS taken, source, shard FROM run
"""

#: Every cell of source and term, then sums over them.
OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS size FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, cell.n, 1 + (1000000000::HUGEINT * (cell.n + 5)) // (size + 5 * v) AS p, 1 + (1000000000::HUGEINT * (n_lang + 5)) // (total.n + 5 * v) AS q FROM cell JOIN total USING (lang)),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 50
"""

_PREIMAGE = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", "text"))
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _up(name: str, leaves: str, tree: str) -> str:
    """A recursive view of the nodes of all levels of trees."""
    return f"{name} AS (SELECT {tree}, 0 AS level, i, n, h FROM {leaves} UNION ALL SELECT {tree}, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY {tree}, level, i // 3)"


def _steps(leaves: str, nodes: str, tree: str, offset: int) -> str:
    """The siblings of each leaf's ancestors on either side."""
    at = f"({leaves}.i // power(3, {nodes}.level)::BIGINT)"
    return f"SELECT {leaves}.{tree}, {leaves}.i, {nodes}.level + {offset} AS level, coalesce(string_agg({nodes}.h, '' ORDER BY {nodes}.i) FILTER ({nodes}.i < {at}), '') AS before, coalesce(string_agg({nodes}.h, '' ORDER BY {nodes}.i) FILTER ({nodes}.i > {at}), '') AS after FROM {leaves} JOIN {nodes} ON {leaves}.{tree} IS NOT DISTINCT FROM {nodes}.{tree} AND {nodes}.n > 1 AND {nodes}.i // 3 = {at} // 3 GROUP BY ALL"


#: Trees by recursion, the proofs from all nodes of all levels.
OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_PREIMAGE}) AS h, CASE WHEN {_CRC} % 2 = 0 THEN sha256({_PREIMAGE.replace("(text::", "(replace(text, chr(10), '')::").replace("|| text::", "|| replace(text, chr(10), '')::")}) END AS changed FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
{_up("node", "leaf", "source")},
sub AS (SELECT 0 AS top, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
{_up("high", "sub", "top")},
root AS (SELECT h AS root FROM high WHERE n = 1),
low_step AS ({_steps("leaf", "node", "source", 0)}),
high_step AS ({_steps("sub", "high", "top", 1000)}),
low AS (SELECT source, i, list({{'h': '', 'before': before, 'after': after}} ORDER BY level) AS steps, string_agg(before || after, '' ORDER BY level) AS said FROM low_step GROUP BY source, i),
upper AS (SELECT i, list({{'h': '', 'before': before, 'after': after}} ORDER BY level) AS steps, string_agg(before || after, '' ORDER BY level) AS said FROM high_step GROUP BY i),
proof AS (SELECT leaf.*, sub.h AS subroot, root, coalesce(low.said, '') || coalesce(upper.said, '') AS said, list_concat(coalesce(low.steps, []), coalesce(upper.steps, [])) AS steps
  FROM leaf JOIN sub ON leaf.source IS NOT DISTINCT FROM sub.source CROSS JOIN root LEFT JOIN low ON low.source IS NOT DISTINCT FROM leaf.source AND low.i = leaf.i LEFT JOIN upper ON upper.i = sub.i),
folded AS (SELECT doc_id, h AS leaf, subroot, root, sha256(said) AS proof_sha256, list_reduce(list_prepend({{'h': coalesce(changed, h), 'before': '', 'after': ''}}, steps), lambda x, y: {{'h': sha256(y.before || x.h || y.after), 'before': '', 'after': ''}}).h AS folded_root FROM proof)
SELECT *, folded_root = root AS verified FROM folded
"""
