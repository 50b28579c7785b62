"""The SQL of prose chunks: sections by windows, sentences and chunks by walking along numbered pieces."""

from __future__ import annotations

_S = "[\\s\\x0B\\p{Z}\\x{85}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def _tokens(c: str) -> str:
    return f"CAST(greatest(1, round(len(list_filter(regexp_split_to_array({c}, '{_S}+'), lambda x: x <> '')) / 0.75)) AS INTEGER)"


def prose_ctes(parts: str, budget: int = 1000, overlap: int = 150) -> str:
    """Common table expressions that end in ``prose``; ``parts`` selects key, part (its order), page, text."""
    return f"""part AS MATERIALIZED ({parts}),
    line AS (SELECT key, part, page, i, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM
             (SELECT key, part, page, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM part WHERE text IS NOT NULL))),
    kinds AS (SELECT *, CASE WHEN {_strip('line')} = '' THEN 'blank' WHEN regexp_matches(line, '^{_S}*#{{1,6}}{_S}+[^\\s\\x0B\\p{{Z}}\\x{{85}}]') THEN 'heading'
                             WHEN starts_with({_strip('line')}, '|') THEN 'table' ELSE 'text' END AS kind FROM line),
    runs AS (SELECT *, sum(CASE WHEN kind = before AND kind <> 'heading' THEN 0 ELSE 1 END) OVER (PARTITION BY key, part ORDER BY i) AS r
             FROM (SELECT *, lag(kind) OVER (PARTITION BY key, part ORDER BY i) AS before FROM kinds)),
    item AS (SELECT key, part, r, any_value(page) AS page, any_value(kind) AS kind, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS raw FROM runs WHERE kind <> 'blank' GROUP BY key, part, r),
    typed AS (SELECT key, page, kind, row_number() OVER (PARTITION BY key ORDER BY part, r) AS ord,
              CASE WHEN kind = 'heading' THEN length(regexp_extract(raw, '^(#{{1,6}})', 1)) END AS level,
              CASE WHEN kind = 'heading' THEN regexp_replace(raw, '^#{{1,6}}{_S}+', '') ELSE raw END AS text FROM item),
    placed AS (SELECT *, sum(CASE WHEN level <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ord) AS s FROM typed),
    head AS (SELECT key, s, text AS heading, level AS head_level, page AS head_page FROM placed WHERE level <= 2),
    cell AS (SELECT key, s, cell, min(ord) AS at FROM (SELECT key, s, ord, unnest(list_transform(regexp_split_to_array(text, '[|\\n]'), lambda c: {_strip('c')})) AS cell
             FROM placed WHERE kind = 'table') WHERE cell <> '' GROUP BY ALL),
    content AS (SELECT p.key, p.s, p.ord, p.page, p.kind, p.text AS bare, CASE WHEN p.kind = 'heading' THEN repeat('#', p.level) || ' ' || p.text ELSE p.text END AS text
                FROM placed p LEFT JOIN cell c ON c.key = p.key AND c.s = p.s AND p.kind = 'text' AND c.cell = p.text WHERE coalesce(p.level > 2, true) AND coalesce(c.at > p.ord, true)),
    section AS (SELECT c.key, c.s, any_value(h.heading) AS heading, any_value(h.head_level) AS head_level, coalesce(any_value(h.head_page), arg_min(c.page, c.ord) FILTER (c.page IS NOT NULL)) AS page,
                  list(c.bare ORDER BY c.ord) FILTER (c.kind = 'heading') AS subs FROM content c LEFT JOIN head h ON h.key = c.key AND h.s = c.s GROUP BY c.key, c.s),
    pathed AS (SELECT *, CASE WHEN heading IS NULL THEN coalesce(subs, []) ELSE list_prepend(heading, coalesce(subs, [])) END AS path FROM section),
    sized AS (SELECT *, {_tokens('text')} AS n FROM (SELECT key, s, ord, CASE WHEN kind = 'heading' THEN 'text' ELSE kind END AS kind, text FROM content)),
    sentence AS (SELECT key, s, ord, i, z[i] AS text, {_tokens('z[i]')} AS n FROM (SELECT *, unnest(range(1, len(z) + 1)) AS i FROM (SELECT key, s, ord,
                 list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_S}+([A-Z("''])', '\\1\x01\\2', 'g'), '\x01'), lambda x: {_strip('x')}), lambda x: x <> '') AS z
                 FROM sized WHERE kind = 'text' AND n > {budget}))),
    run_of AS (SELECT key, s, ord, i, n AS load, 1 AS run FROM sentence WHERE i = 1
               UNION ALL SELECT x.key, x.s, x.ord, x.i, CASE WHEN r.load + x.n > {budget} THEN x.n ELSE r.load + x.n END, CASE WHEN r.load + x.n > {budget} THEN r.run + 1 ELSE r.run END
               FROM run_of r JOIN sentence x ON x.key = r.key AND x.s = r.s AND x.ord = r.ord AND x.i = r.i + 1),
    cut AS (SELECT key, s, ord, run, 'text' AS kind, string_agg(text, ' ' ORDER BY i) AS text FROM run_of JOIN sentence USING (key, s, ord, i) GROUP BY key, s, ord, run
            UNION ALL SELECT key, s, ord, 1, kind, text FROM sized WHERE kind <> 'text' OR n <= {budget}),
    piece AS MATERIALIZED (SELECT *, sum(n) OVER w AS total, max(CASE WHEN kind <> 'text' THEN i ELSE 0 END) OVER w AS wall FROM
              (SELECT key, s, kind, text, {_tokens('text')} AS n, row_number() OVER (PARTITION BY key, s ORDER BY ord, run) AS i FROM cut) WINDOW w AS (PARTITION BY key, s ORDER BY i)),
    tail AS MATERIALIZED (SELECT a.key, a.s, a.i, coalesce(min(b.i), a.i + 1) AS t FROM piece a LEFT JOIN piece b ON b.key = a.key AND b.s = a.s AND b.i <= a.i AND b.i > a.wall
              AND (b.i = a.i OR a.total - b.total + b.n <= {overlap}) GROUP BY a.key, a.s, a.i),
    step AS MATERIALIZED (SELECT p.*, b.total AS total_before, b.i AS i_before, t.t AS tail_before, max(p.i) OVER (PARTITION BY p.key, p.s) AS most FROM piece p
              LEFT JOIN piece b ON b.key = p.key AND b.s = p.s AND b.i = p.i - 1 LEFT JOIN tail t ON t.key = b.key AND t.s = b.s AND t.i = b.i),
    start_of AS (SELECT key, s, 0 AS i, 1 AS first, 0::HUGEINT AS load, 0 AS a, -1 AS b, 0 AS alone FROM (SELECT DISTINCT key, s FROM piece)),
    walk AS (SELECT key, s, i::BIGINT AS i, first::BIGINT AS first, load, a::BIGINT AS a, b::BIGINT AS b, alone::BIGINT AS alone FROM start_of
             UNION ALL SELECT key, s, i, CASE move WHEN 'alone' THEN i + 1 WHEN 'full' THEN lead ELSE first END,
                CASE move WHEN 'alone' THEN 0 WHEN 'full' THEN total - total_before + (total_before - coalesce(before_lead, 0)) * CASE WHEN lead < i THEN 1 ELSE 0 END ELSE load + n END,
                CASE WHEN move = 'add' THEN 0 ELSE first END, CASE WHEN move = 'add' THEN -1 ELSE i - 1 END, CASE WHEN move = 'alone' THEN i ELSE 0 END
             FROM (SELECT x.*, (SELECT 1) AS one, p.total AS before_lead FROM
                     (SELECT w.key, w.s, q.i, w.first, w.load, q.n, q.total, q.total_before, greatest(q.tail_before, w.first) AS lead,
                        CASE WHEN q.kind <> 'text' AND q.n > {budget} THEN 'alone' WHEN w.first < q.i AND w.load + q.n > {budget} THEN 'full' ELSE 'add' END AS move
                      FROM walk w JOIN step q ON q.key = w.key AND q.s = w.s AND q.i = w.i + 1) x
                   LEFT JOIN piece p ON p.key = x.key AND p.s = x.s AND p.i = x.lead - 1)),
    ranges AS (SELECT key, s, a, b FROM walk WHERE a <= b AND b >= 1 UNION ALL SELECT key, s, alone, alone FROM walk WHERE alone > 0
               UNION ALL SELECT w.key, w.s, w.first, w.i FROM walk w JOIN step q ON q.key = w.key AND q.s = w.s AND q.i = w.i WHERE w.i = q.most AND w.first <= w.i),
    prose AS (SELECT r.key, row_number() OVER (PARTITION BY r.key ORDER BY r.s, r.b) - 1 AS chunk_index,
                any_value(CASE WHEN x.heading IS NULL THEN '' ELSE repeat('#', x.head_level) || ' ' || x.heading || chr(10) || chr(10) END) || string_agg(p.text, chr(10) || chr(10) ORDER BY p.i) AS text,
                any_value(x.page) AS page, any_value(x.heading) AS heading, any_value(CASE WHEN len(x.path) > 1 THEN x.path[1] || ' > ' || x.path[len(x.path)] ELSE x.path[1] END) AS heading_path,
                bool_or(p.kind = 'table') AS has_table, bool_or(p.kind = 'image') AS has_image
              FROM ranges r JOIN piece p ON p.key = r.key AND p.s = r.s AND p.i BETWEEN r.a AND r.b JOIN pathed x ON x.key = r.key AND x.s = r.s GROUP BY r.key, r.s, r.a, r.b)"""
