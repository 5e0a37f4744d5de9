"""SQL of the bootstraps, every pick of every draw, its number reached from the seed by the bits of its place; and of
scores of renames, every pair of files."""

from __future__ import annotations

from ..sources.tables import relation_sql


def _powers(step: tuple[int, int], bits: int = 40) -> tuple[list[int], list[int]]:
    """Multipliers and increments of 1, 2, 4, ... steps, each the one before taken twice."""
    a, c = [step[0]], [step[1]]
    for _ in range(bits - 1):
        c.append((a[-1] * c[-1] + c[-1]) % (1 << 32))
        a.append(a[-1] * a[-1] % (1 << 32))
    return a, c


def _state(step: tuple[int, int], steps: str, seed: str) -> str:
    a, c = _powers(step)
    return f"list_reduce(list_prepend(CAST({seed} AS HUGEINT), CAST(range(0, 40) AS HUGEINT[])), lambda s, k: CASE WHEN ({steps} >> CAST(k AS BIGINT)) & 1 = 1 THEN (CAST({a} AS HUGEINT[])[CAST(k AS BIGINT) + 1] * s + CAST({c} AS HUGEINT[])[CAST(k AS BIGINT) + 1]) % 4294967296 ELSE s END)"


def _picks(step, draws):
    """picks(draw, k) from seed(s0) and size(m)."""
    return f"""picks AS (SELECT i // m AS draw, CAST(floor(CAST(state AS DOUBLE) / CAST(4294967296 AS DOUBLE) * m) AS BIGINT) AS k
        FROM (SELECT i, m, {_state(step, "(i + 1)", "s0")} AS state FROM (SELECT unnest(range(0, {draws} * m)) AS i, m, s0 FROM size, seed)))"""


def _seed(json: str, order: str, source: str) -> str:
    return f"seed AS (SELECT CAST(concat('0x', substr(sha256(concat('[', coalesce(string_agg({json}, ',' ORDER BY {order}), ''), ']')), 1, 8)) AS BIGINT) AS s0 FROM {source})"


SQL = {
    "cluster_bootstrap": f"""{relation_sql("cases")}, seen AS (SELECT case_id, organization, producer, consumer, weight, coalesce(label_action IN ('coordinate', 'already_coordinated', 'accepted_risk'), false) AS hit FROM cases
            WHERE policy_selected AND detector_output = 'candidate' AND NOT suppressed AND claim_action = 'coordinate' AND coalesce(label_action, '') <> 'indeterminate'),
        {_seed("concat('\"', case_id, '\"')", "case_id", "seen")}, cl AS (SELECT row_number() OVER (ORDER BY min(case_id)) - 1 AS k, sum(weight) AS d, coalesce(sum(weight) FILTER (hit), 0) AS n FROM seen GROUP BY organization, producer, consumer),
        size AS (SELECT count(*) AS m FROM cl), {_picks((1664525, 1013904223), 1000)}, e AS (SELECT draw, CASE WHEN sum(d) = 0 THEN 0 ELSE sum(n) / sum(d) END AS e FROM picks JOIN cl USING (k) GROUP BY draw), o AS (SELECT list(e ORDER BY e) AS l FROM e)
        SELECT round((SELECT coalesce(sum(n) / sum(d), 0) FROM cl), 12) AS estimate, (SELECT m FROM size) AS clusters, round(coalesce(l[26], 0), 12) AS lower95, round(coalesce(l[976], 1), 12) AS upper95, coalesce(len(l), 0) AS iterations FROM o""",
    "agreement_intervals": f"""WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, CAST(quality AS VARCHAR) AS a, CAST(1 - toxic AS VARCHAR) AS b FROM labels),
        {_seed("concat('[\"', a, '\",\"', b, '\"]')", "k", "p")}, size AS (SELECT count(*) AS m FROM p), {_picks((1103515245, 12345), 500)}, r AS (SELECT draw, a, b FROM picks JOIN p USING (k)),
        o AS (SELECT draw, count(*) AS n, 1 - count(*) FILTER (a = b) / count(*) AS observed FROM r GROUP BY draw), x AS (SELECT draw, v, count(*) AS c FROM (SELECT draw, a AS v FROM r UNION ALL SELECT draw, b FROM r) GROUP BY draw, v),
        e AS (SELECT o.draw, any_value(observed) AS observed, 1 - sum((c / (2 * n)) ** 2) AS expected FROM x JOIN o USING (draw) GROUP BY o.draw), l AS (SELECT list(CASE WHEN expected = 0 THEN 1 ELSE 1 - observed / expected END ORDER BY CASE WHEN expected = 0 THEN 1 ELSE 1 - observed / expected END) AS l FROM e)
        SELECT 'edge' AS axis, round(l[13], 12) AS lower95, round(l[488], 12) AS upper95 FROM l""",
    # Chunks are cut from the bytes in hexadecimal: pairs of digits, of which 0A ends a line.
    "rename_scores": r"""WITH d AS (SELECT source AS diff, doc_id AS k, replace(text, ' ', chr(10)) AS t FROM documents WHERE text IS NOT NULL),
        base AS (SELECT diff, concat('src/f', k % 40, '/', k) AS path, t FROM d),
        head AS (SELECT diff, concat('src/f', k % 40, '/', k) AS path, CASE WHEN k % 4 = 1 THEN concat(t, chr(10), 'end') ELSE t END AS t FROM d WHERE k % 3 <> 0
            UNION ALL SELECT diff, concat('lib/f', k % 40, '/', k), CASE k % 5 WHEN 0 THEN t WHEN 1 THEN replace(t, 'a', '4') WHEN 2 THEN substr(t, 1, CAST(floor(length(t) * (k % 9 + 1) / 9) AS INTEGER)) WHEN 3 THEN concat(t, chr(10), repeat(concat('more', chr(10)), k % 30)) ELSE replace(t, 'the', 'teh') END FROM d WHERE k % 3 = 0 OR k % 8 = 1),
        s AS (SELECT DISTINCT diff, sha256(t) AS content, t FROM base WHERE (diff, path) NOT IN (SELECT (diff, path) FROM head)), g AS (SELECT DISTINCT diff, sha256(t) AS content, t FROM head WHERE (diff, path) NOT IN (SELECT (diff, path) FROM base)),
        c AS (SELECT side, diff, content, size, chunk, sum(length(chunk) // 2) AS bytes FROM (SELECT side, diff, content, strlen(t) AS size, unnest(regexp_extract_all(hex(encode(replace(t, concat(chr(13), chr(10)), chr(10)))), '(?:[1-9A-F][0-9A-F]|0[0-9B-F]){0,63}0A|(?:[1-9A-F][0-9A-F]|0[0-9B-F]){1,64}')) AS chunk
            FROM (SELECT 's' AS side, * FROM s UNION ALL SELECT 'g', * FROM g)) GROUP BY ALL),
        p AS (SELECT x.diff, x.content AS source, y.content AS target, any_value(greatest(x.size, y.size)) AS larger, sum(least(x.bytes, y.bytes)) AS shared FROM c x JOIN c y ON x.side = 's' AND y.side = 'g' AND x.diff = y.diff AND x.chunk = y.chunk AND x.content <> y.content GROUP BY 1, 2, 3)
        SELECT diff, source, target, CAST(shared * 60000 // larger AS BIGINT) AS score FROM p WHERE shared * 60000 // larger >= 30000""",
}
