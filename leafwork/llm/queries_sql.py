"""DuckDB SQL of the operators whose results take recursion to express: trees, folds and components."""

from __future__ import annotations


def crc32(x: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = f"flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), "
        "lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT)"
    )


def _url_filter() -> str:
    rest = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    host = lambda u: f"translate(regexp_extract({rest(u)}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = lambda u: f"regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1)"

    def node(u: str) -> str:
        query = (
            f"array_to_string(list_filter(string_split(regexp_extract({rest(u)}, '^[^?#]*\\?([^#]*)', 1), '&'), "
            "lambda p: NOT regexp_matches(p, '^(?i:utm_[a-z]+|gclid|fbclid|msclkid)(=|$)')), '&')"
        )
        plain = f"CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END"
        return f"CASE WHEN {host(u)} <> '' THEN {host(u)} || {plain} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"

    def attribute(name: str) -> str:
        forms = ('"([^"]*)"', "''([^'']*)''", "([^\\s\"''>]+)")
        found = ", ".join(f"nullif(regexp_extract(t, '(?is)[\\s\"'']{name}\\s*=\\s*{f}', 1), '')" for f in forms)
        return f"trim(replace(coalesce({found}, ''), '&amp;', '&'))"

    # Dot segments of relative links are left to tests/llm.
    return rf"""
        WITH RECURSIVE rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<(?:link|meta)\s[^>]*>')) AS t
                 FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
        hrefs AS (SELECT url, {attribute("href")} AS h FROM tags WHERE regexp_matches(t, '(?is)^<link') AND regexp_matches({attribute("rel")}, '(?i)(^|\s)canonical(\s|$)')
                  UNION ALL SELECT url, regexp_extract({attribute("content")}, '(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=)?\s*["'']?([^"'']*)', 1) FROM tags
                  WHERE regexp_matches(t, '(?is)^<meta') AND lower({attribute("http-equiv")}) = 'refresh'),
        parts AS (SELECT url, h, regexp_extract(url, '^[^:/?#]+://[^/?#]*') AS o, regexp_replace({path("url")}, '[^/]*$', '') AS d FROM hrefs),
        links AS (SELECT url, CASE WHEN h = '' THEN NULL WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h
                WHEN h LIKE '//%' THEN regexp_extract(url, '^[^:/?#]+:') || h WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') OR o = '' THEN NULL
                WHEN h LIKE '#%' THEN url WHEN h LIKE '?%' THEN o || {path("url")} || h WHEN h LIKE '/%' THEN o || h
                ELSE o || CASE WHEN d = '' THEN '/' ELSE d END || h END AS target FROM parts),
        urls AS (SELECT DISTINCT url AS u FROM (SELECT url FROM pages UNION ALL SELECT target FROM links) WHERE url IS NOT NULL),
        split AS (SELECT u, {host("u")} AS host, {path("u")} AS path, {node("u")} AS node FROM urls),
        judged AS (SELECT u, host, path, node, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS v
                   FROM split LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
        edges AS (SELECT {node("url")} AS a, {node("target")} AS b FROM links WHERE target IS NOT NULL UNION SELECT {node("target")}, {node("url")} FROM links WHERE target IS NOT NULL),
        bad(n) AS (SELECT node FROM judged WHERE v = 'block' AND node IS NOT NULL UNION SELECT b FROM edges, bad WHERE a = n)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               coalesce(v, CASE WHEN node IN (SELECT n FROM bad WHERE n IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict,
               coalesce(node IN (SELECT n FROM bad WHERE n IS NOT NULL), false) AS alias_blocked
        FROM pages LEFT JOIN judged ON url = u"""


def _merkle() -> str:
    def leaf(n_chars: str) -> str:
        texts = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + "))"

    def tree(name: str, start: str) -> str:
        """All nodes of all levels: grp, lev, idx, node, size."""
        return f"""{name}(grp, lev, idx, node, size) AS ({start} UNION ALL
            SELECT grp, lev + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), any_value((size + 1) // 2) FROM {name} WHERE size > 1 GROUP BY grp, lev, idx // 2)"""

    def steps(tree: str, rows: str) -> str:
        """Each row's sibling on each level below the top; an empty one where it is alone."""
        return f"""SELECT r.row, t.lev, CASE WHEN s.idx < t.idx THEN s.node ELSE '' END AS l, CASE WHEN s.idx > t.idx THEN s.node ELSE '' END AS r
            FROM {rows} r JOIN {tree} t ON t.grp = r.grp AND t.size > 1 AND t.idx = r.idx >> t.lev
            LEFT JOIN {tree} s ON s.grp = t.grp AND s.lev = t.lev AND s.idx = xor(t.idx, 1)"""

    return f"""
        WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS row, concat(CASE WHEN lang IS NULL THEN '' ELSE '=' END, lang) AS grp, {leaf("n_chars")} AS leaf,
            CASE WHEN n_chars IS NOT NULL AND ({crc32("doc_id::VARCHAR")}) % 7 = 0 THEN {leaf("(n_chars + 1)")} END AS changed FROM documents),
        placed AS (SELECT row, doc_id, leaf, coalesce(changed, leaf) AS now, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS size FROM d),
        {tree("low", "SELECT grp, 0, idx, leaf, size FROM placed")},
        subs AS (SELECT grp AS lang, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS size FROM low WHERE size = 1),
        {tree("top", "SELECT '', 0, idx, subroot, size FROM subs")},
        owned AS (SELECT lang AS row, '' AS grp, idx FROM subs),
        upper AS ({steps("top", "owned")}), lower AS ({steps("low", "placed")}),
        path AS (SELECT row, lev, l, r FROM lower UNION ALL SELECT p.row, 1000 + u.lev, u.l, u.r FROM placed p JOIN upper u ON u.row = p.grp),
        proof AS (SELECT row, list({{'l': coalesce(l, ''), 'r': coalesce(r, '')}} ORDER BY lev) AS steps FROM path GROUP BY row),
        climb(row, i, acc) AS (SELECT row, 1, now FROM placed UNION ALL
            SELECT c.row, i + 1, sha256(concat(p.steps[i].l, acc, p.steps[i].r)) FROM climb c JOIN proof p ON p.row = c.row WHERE i <= len(p.steps)),
        ended AS (SELECT row, arg_max(acc, i) AS folded_root FROM climb GROUP BY row)
        SELECT doc_id, leaf, subroot, t.node AS root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s.l || s.r), ''), '')) AS proof_sha256, folded_root,
               folded_root = t.node AS verified
        FROM placed p JOIN subs ON lang = p.grp JOIN ended e ON e.row = p.row JOIN top t ON t.size = 1 LEFT JOIN proof q ON q.row = p.row"""


def _turns() -> str:
    """A way is its cost in nine digits followed by its audit, so that the least string is the best way."""
    add = lambda w, n, x: f"(lpad((substr({w}, 1, 9)::BIGINT + {n})::VARCHAR, 9, '0') || substr({w}, 10) || {x})"
    say = lambda w, c: f"CASE WHEN fault NOT IN ('b', 'd') THEN {add(w, f'CASE WHEN fault = $$t$$ THEN 5 ELSE 0 END + CASE WHEN ini = $${c}$$ THEN 0 ELSE 1 END', f'CASE WHEN ini = $${c}$$ THEN $$K$$ ELSE $$R$$ END')} END"
    system = f"CASE WHEN fault NOT IN ('b', 'd') AND ini = 's' THEN {add('w0', 'CASE WHEN fault = $$t$$ THEN 5 ELSE 0 END', '$$K$$')} END"
    cut = lambda w: add(w, 2, "'D'")
    white = r"\x20\x09-\x0D"
    return rf"""
        WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            ({crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")}) % 20 AS k FROM conversations),
        damaged AS (SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
            CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE k <> 0),
        rows AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(concat(strlen(role), ':', role, text)), copy) AS i, role[1:1] AS ini,
            regexp_extract(text, '([^{white}])[{white}]*$', 1) AS fin FROM damaged),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth, lag(ini) OVER (PARTITION BY conv ORDER BY i) AS prev FROM rows),
        flags AS (SELECT *, CASE WHEN fin = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN fin NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM seen),
        faults AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
            count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM flags GROUP BY conv),
        fold(conv, i, w0, w1, w2, w3) AS (SELECT DISTINCT conv, 0::BIGINT, '000000000', NULL::VARCHAR, '000000005I', '000000010II' FROM flags
            UNION ALL SELECT conv, i, n0, n1, u, least(n3, {add("u", 5, "'I'")}) FROM (
                SELECT *, least(n2, {add("least(n0, n1, n3)", 5, "'I'")}) AS u FROM (
                    SELECT f.conv, f.i, {cut("w0")} AS n0, least({cut("w1")}, {system}) AS n1, least({cut("w2")}, {say("least(w0, w1, w3)", "u")}) AS n2, least({cut("w3")}, {say("w2", "a")}) AS n3
                    FROM fold b JOIN flags f ON f.conv = b.conv AND f.i = b.i + 1))),
        best AS (SELECT conv, arg_max(least(w0, w3), i) AS w FROM fold GROUP BY conv),
        letters AS (SELECT conv, unnest(string_split(substr(w, 10), '')) AS x, generate_subscripts(string_split(substr(w, 10), ''), 1) AS p FROM best WHERE length(w) > 9),
        counted AS (SELECT *, count(*) FILTER (x <> 'I') OVER (PARTITION BY conv ORDER BY p) AS at, count(*) FILTER (x <> 'D') OVER (PARTITION BY conv ORDER BY p) AS e,
            count(*) FILTER (x <> 'D') OVER (PARTITION BY conv) AS n FROM letters),
        said AS (SELECT c.conv, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (e + n) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha
            FROM counted c LEFT JOIN flags f ON f.conv = c.conv AND f.i = c.at WHERE x <> 'D' GROUP BY c.conv)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(w, 1, 9)::BIGINT, 0)::BIGINT AS cost, coalesce(substr(w, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN faults f ON f.conv = coalesce(o.conv_id::VARCHAR, '')
            LEFT JOIN best b ON b.conv = f.conv LEFT JOIN said s ON s.conv = f.conv"""


SQL = {"op11_url_filter": _url_filter(), "op12_merkle": _merkle(), "op13_turns": _turns()}
