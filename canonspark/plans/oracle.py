"""DuckDB SQL builders for the correctness oracle.

The oracle restates each operator the plain way: all pairs of a group, LCS by
a dynamic-programming ``list_reduce``, and the two clustering rules as
sequential recursive CTEs that walk the values in first-occurrence order.
"""

from __future__ import annotations

# Unicode whitespace and the separators 1C-1F, written for RE2
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def norm(x: str) -> str:
    return f"regexp_replace(lower({strip(f'CAST({x} AS VARCHAR)')}), '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g')"


def words(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '[{WS}]+') END"


def sorted_tokens(x: str) -> str:
    return f"array_to_string(list_sort({words(x)}), ' ')"


def lcs(a: str, b: str) -> str:
    """LCS length, bit-parallel over ``a`` in a HUGEINT (strings up to 120 chars)."""
    full = f"((1::HUGEINT << CAST(length({a}) AS HUGEINT)) - 1)"
    mask = (f"coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: "
            f"CASE WHEN substr({a}, i::BIGINT, 1) = ch THEN (1::HUGEINT << CAST(i - 1 AS HUGEINT)) "
            f"ELSE 0::HUGEINT END)), 0::HUGEINT)")
    return (f"(length({a}) - bit_count(list_reduce(string_split({b}, ''), "
            f"lambda v, ch: ((v + (v & {mask})) | (v - (v & {mask}))) & {full}, {full})))")


def ratio(a: str, b: str) -> str:
    ls = f"(length({a}) + length({b}))"
    return (f"(CASE WHEN {ls} = 0 THEN 100.0 "
            f"ELSE (1.0 - ({ls} - 2 * {lcs(a, b)}) / {ls}) * 100.0 END)")


def token_set(a: str, b: str) -> str:
    """token_set_ratio over precomputed word lists ``{a}_w`` / ``{b}_w``."""
    return f"""(CASE
      WHEN len(list_distinct({a}_w)) = 0 OR len(list_distinct({b}_w)) = 0 THEN 0.0
      WHEN len(list_intersect({a}_w, {b}_w)) > 0
           AND (len(list_filter(list_distinct({a}_w), lambda w: NOT list_contains({b}_w, w))) = 0
                OR len(list_filter(list_distinct({b}_w), lambda w: NOT list_contains({a}_w, w))) = 0) THEN 100.0
      ELSE greatest({ratio('t1', 't2')},
                    CASE WHEN sect = '' THEN 0.0 ELSE greatest({ratio('sect', 't1')}, {ratio('sect', 't2')}) END)
    END)"""


def token_parts(a: str, b: str) -> str:
    """Columns sect, t1, t2 of the token-set comparison."""
    sect = f"array_to_string(list_sort(list_distinct(list_intersect({a}_w, {b}_w))), ' ')"
    dab = f"array_to_string(list_sort(list_filter(list_distinct({a}_w), lambda w: NOT list_contains({b}_w, w))), ' ')"
    dba = f"array_to_string(list_sort(list_filter(list_distinct({b}_w), lambda w: NOT list_contains({a}_w, w))), ' ')"
    return (f"{sect} AS sect, trim(concat({sect}, ' ', {dab})) AS t1, "
            f"trim(concat({sect}, ' ', {dba})) AS t2")


def melt_sql(source: str, columns: list[str], category: str | None) -> str:
    parts = []
    for i, c in enumerate(columns):
        gk = f"CAST({category} AS VARCHAR)" if category else f"'{c}'"
        parts.append(f"SELECT {gk} AS group_key, CAST(row_id AS BIGINT) AS row_id, '{c}' AS col_name, "
                     f"{i} AS col_ord, CAST({c} AS VARCHAR) AS value FROM ({source}) src_{i} "
                     f"WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


def node_ctes(long_sql: str, mode: str) -> str:
    keep = "group_key IS NOT NULL" if mode == "category" else f"{strip('norm')} <> ''"
    return f"""
    lng AS ({long_sql}),
    nl AS (SELECT *, {norm('value')} AS norm,
                  CAST(col_ord AS BIGINT) * 1000000000000 + row_id AS okey FROM lng),
    nlf AS (SELECT * FROM nl WHERE {keep}),
    nodes AS MATERIALIZED (SELECT group_key, norm, min(okey) AS okey, count(*) AS n,
                     row_number() OVER (PARTITION BY group_key ORDER BY min(okey)) AS idx
              FROM nlf GROUP BY group_key, norm)"""


def edge_ctes(scorer: str, t: float) -> str:
    """``edges(group_key, ui, vi, a, b, score)`` for the scorers with an SQL form."""
    pairs = ("SELECT x.group_key, x.idx AS ui, y.idx AS vi, x.norm AS a, y.norm AS b "
             "FROM nodes x JOIN nodes y ON x.group_key = y.group_key AND x.idx < y.idx")
    if scorer in ("ratio", "QRatio"):
        score = ratio("a", "b")
        if scorer == "QRatio":
            score = f"(CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE {score} END)"
        return f"""
    pairs AS ({pairs}),
    edges AS MATERIALIZED (SELECT group_key, ui, vi, a, b, score
              FROM (SELECT *, {score} AS score FROM pairs)
              WHERE score >= {t})"""
    if scorer == "token_sort_ratio":
        return f"""
    pairs AS (SELECT *, {sorted_tokens('a')} AS sa, {sorted_tokens('b')} AS sb FROM ({pairs})),
    edges AS MATERIALIZED (SELECT group_key, ui, vi, a, b, score
              FROM (SELECT *, {ratio('sa', 'sb')} AS score FROM pairs)
              WHERE score >= {t})"""
    if scorer in ("token_set_ratio", "token_ratio"):
        sort_score = ratio("sa", "sb")
        final = "tset" if scorer == "token_set_ratio" else f"greatest(tset, {sort_score})"
        return f"""
    pw AS (SELECT *, {words('a')} AS a_w, {words('b')} AS b_w,
                  {sorted_tokens('a')} AS sa, {sorted_tokens('b')} AS sb FROM ({pairs})),
    pt AS (SELECT *, {token_parts('a', 'b')} FROM pw),
    edges AS MATERIALIZED (SELECT group_key, ui, vi, a, b, score
              FROM (SELECT *, {final} AS score FROM (SELECT *, {token_set('a', 'b')} AS tset FROM pt))
              WHERE score >= {t})"""
    raise ValueError(f"no SQL form for {scorer}")


def cluster_ctes(algorithm: str) -> str:
    """Sequential C1 / C2 over ``nodes`` and ``edges``: ``clustered``."""
    if algorithm == "first_fit":
        step = "coalesce(list_min(list_transform(nn.lower, lambda j: s.labels[j])), s.i + 1)"
    else:
        step = "coalesce(list_min(list_filter(nn.lower, lambda j: s.labels[j] = j)), s.i + 1)"
    return f"""
    nb AS (SELECT group_key, vi AS idx, list(ui) AS lower FROM edges GROUP BY group_key, vi),
    nn AS MATERIALIZED (SELECT n.*, coalesce(nb.lower, []::BIGINT[]) AS lower FROM nodes n LEFT JOIN nb USING (group_key, idx)),
    seq(group_key, i, labels) AS (
        SELECT DISTINCT group_key, CAST(0 AS BIGINT), []::BIGINT[] FROM nodes
        UNION ALL
        SELECT s.group_key, s.i + 1, list_append(s.labels, {step})
        FROM seq s JOIN nn ON nn.group_key = s.group_key AND nn.idx = s.i + 1),
    fin AS (SELECT group_key, labels FROM
              (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY i DESC) AS rn FROM seq) WHERE rn = 1),
    lab AS (SELECT group_key, unnest(labels) AS leader, generate_subscripts(labels, 1) AS idx FROM fin),
    clustered AS (SELECT n.group_key, n.norm, n.okey, n.n, n.idx, l.leader,
                         dense_rank() OVER (PARTITION BY n.group_key ORDER BY l.leader) AS cluster_id
                  FROM nodes n JOIN lab l USING (group_key, idx))"""


def suggestion_ctes() -> str:
    """G1 without dictionary over ``clustered``: ``sugg``."""
    return f"""
    cstats AS (SELECT group_key, cluster_id, sum(n) AS size, count(*) AS ndist,
                      arg_min(norm, (-n, okey)) AS top_v, arg_min(n, (-n, okey)) AS top_k
               FROM clustered GROUP BY group_key, cluster_id),
    cvote AS (SELECT group_key, cluster_id, arg_min(corr, (-k, o)) AS corr_vote FROM (
                SELECT group_key, cluster_id, corr, count(*) AS k, min(okey) AS o FROM (
                  SELECT group_key, cluster_id, okey,
                         CASE WHEN array_to_string({words('norm')}, ' ') = '' THEN norm
                              ELSE array_to_string({words('norm')}, ' ') END AS corr
                  FROM clustered) GROUP BY ALL) GROUP BY group_key, cluster_id),
    sugg AS (SELECT s.group_key, s.cluster_id, 'cluster_' || s.cluster_id AS cluster_tag,
                    CAST(s.size AS BIGINT) AS size,
                    CASE WHEN s.size = 1 THEN s.top_v
                         WHEN s.ndist = s.size THEN v.corr_vote ELSE s.top_v END AS suggestion,
                    CASE WHEN s.size = 1 THEN 'single_member'
                         WHEN s.ndist = s.size THEN 'spell_checker' ELSE 'majority' END AS suggestion_mode,
                    CASE WHEN s.size = 1 THEN 1.0
                         WHEN s.ndist = s.size THEN 0.9
                         ELSE round_even(s.top_k / s.size, 2) END AS confidence
             FROM cstats s JOIN cvote v USING (group_key, cluster_id))"""


def override_ctes(with_overrides: bool = True) -> str:
    """Fixture overrides over ``sugg`` / ``cstats`` / ``nlf`` / ``clustered``:
    the last member of every cluster with more than one distinct value keeps
    its own value; single-member clusters get a custom upper-case suggestion,
    clusters about gears a knowledge-graph one, about bolts a model one."""
    ov = "true" if with_overrides else "false"
    return """
    members AS MATERIALIZED (
        SELECT n.group_key, n.row_id, n.col_name, n.value, n.norm, n.okey, c.cluster_id,
               row_number() OVER (PARTITION BY n.group_key, c.cluster_id ORDER BY n.okey) - 1 AS member_idx
        FROM nlf n JOIN clustered c USING (group_key, norm)),
    mo AS (SELECT m.group_key, m.cluster_id, m.member_idx, m.norm AS value
           FROM members m JOIN cstats s USING (group_key, cluster_id)
           WHERE s.ndist > 1 AND m.member_idx = s.size - 1 AND {ov}),
    so AS (SELECT group_key, cluster_id,
                  CASE WHEN suggestion_mode = 'single_member' THEN upper(suggestion)
                       WHEN contains(suggestion, 'gear') THEN 'Gear' ELSE 'Bolt' END AS suggestion,
                  CASE WHEN suggestion_mode = 'single_member' THEN 'custom'
                       WHEN contains(suggestion, 'gear') THEN 'google_kg' ELSE 'llm_suggest' END AS suggestion_mode
           FROM sugg
           WHERE (suggestion_mode = 'single_member' OR contains(suggestion, 'gear') OR contains(suggestion, 'bolt'))
             AND {ov}),
    sugg2 AS (SELECT s.group_key, s.cluster_id, s.size,
                     CASE WHEN o.cluster_id IS NOT NULL THEN o.suggestion ELSE s.suggestion END AS suggestion,
                     CASE WHEN o.cluster_id IS NOT NULL THEN o.suggestion_mode ELSE s.suggestion_mode END AS suggestion_mode
              FROM sugg s LEFT JOIN so o USING (group_key, cluster_id)),
    resolved AS (SELECT m.row_id, m.col_name, m.group_key,
                        CASE WHEN mo.member_idx IS NOT NULL THEN mo.value ELSE s.suggestion END AS cleaned,
                        mo.member_idx IS NOT NULL AS overridden
                 FROM members m JOIN sugg2 s USING (group_key, cluster_id)
                 LEFT JOIN mo USING (group_key, cluster_id, member_idx)),
    lc AS (SELECT l.row_id, l.col_name,
                  CASE WHEN r.row_id IS NOT NULL THEN r.cleaned ELSE l.value END AS cleaned
           FROM lng l LEFT JOIN resolved r USING (row_id, col_name))""".replace("{ov}", ov)


def summary_select(mode: str, groups_sql: str) -> str:
    counted = "suggestion IS NOT NULL" + (" AND suggestion <> ''" if mode == "category" else "")
    modes = [("majority", "num_of_majority"), ("single_member", "total_num_of_single"),
             ("spell_checker", "num_of_spell_check"), ("custom", "num_of_global_manual"),
             ("google_kg", "num_of_gkg"), ("llm_suggest", "num_of_llm")]
    sums = ",\n".join(
        f"CAST(coalesce(sum(CASE WHEN {counted} AND suggestion_mode = '{m}' THEN size ELSE 0 END), 0) AS BIGINT) AS {c}"
        for m, c in modes)
    manual = ("CAST(coalesce(mc.manual, 0) AS BIGINT)" if mode == "direct" else "CAST(NULL AS BIGINT)")
    return f"""
    per AS (SELECT group_key, CAST(count(*) AS BIGINT) AS num_of_clusters,
                   CAST(count(DISTINCT CASE WHEN {counted} THEN suggestion END) AS BIGINT) AS num_of_after_unique,
                   {sums}
            FROM sugg2 GROUP BY group_key),
    st AS (SELECT group_key, count(*) AS total_values, count(DISTINCT value) AS num_of_before_unique
           FROM lng WHERE group_key IS NOT NULL AND {strip('value')} <> '' GROUP BY group_key),
    mc AS (SELECT col_name AS group_key, sum(CASE WHEN overridden THEN 1 ELSE 0 END) AS manual
           FROM resolved GROUP BY col_name),
    grp AS ({groups_sql}),
    summ AS (
      SELECT g.group_key AS "column",
             CAST(coalesce(st.total_values, 0) AS BIGINT) AS total_values,
             CAST(coalesce(st.num_of_before_unique, 0) AS BIGINT) AS num_of_before_unique,
             coalesce(p.num_of_after_unique, 0) AS num_of_after_unique,
             {manual} AS manual_corrections,
             coalesce(p.num_of_clusters, 0) AS num_of_clusters,
             coalesce(p.num_of_majority, 0) AS num_of_majority,
             coalesce(p.total_num_of_single, 0) AS total_num_of_single,
             coalesce(p.num_of_spell_check, 0) AS num_of_spell_check,
             coalesce(p.num_of_global_manual, 0) AS num_of_global_manual,
             coalesce(p.num_of_gkg, 0) AS num_of_gkg,
             coalesce(p.num_of_llm, 0) AS num_of_llm,
             CASE WHEN coalesce(p.num_of_majority + p.num_of_spell_check + p.total_num_of_single
                                + p.num_of_global_manual + p.num_of_gkg + p.num_of_llm, 0) > 0
                  THEN round_even((p.num_of_majority + p.num_of_spell_check + p.total_num_of_single)
                        / (p.num_of_majority + p.num_of_spell_check + p.total_num_of_single
                           + p.num_of_global_manual + p.num_of_gkg + p.num_of_llm), 3) * 100.0
                  ELSE 0.0 END AS acceptance_ratio
      FROM grp g LEFT JOIN per p USING (group_key) LEFT JOIN st USING (group_key)
      LEFT JOIN mc USING (group_key))"""


def partial_ratio(a: str, b: str) -> str:
    """Best ratio of the shorter text against every window of the longer one
    (clipped windows at both ends included); equal lengths try both ways."""
    def best(s: str, l: str) -> str:
        ls, ll = f"length({s})", f"length({l})"
        wins = (f"list_concat(list_transform(range(1, {ls}), lambda p: substr({l}, 1, p::BIGINT)), "
                f"list_transform(range(1, {ll} - {ls} + 2), lambda p: substr({l}, p::BIGINT, {ls})), "
                f"list_transform(range({ll} - {ls} + 2, {ll} + 1), lambda p: substr({l}, p::BIGINT)))")
        return f"list_max(list_transform({wins}, lambda w: {ratio(s, 'w')}))"
    la, lb = f"length({a})", f"length({b})"
    return (f"(CASE WHEN {la} = 0 AND {lb} = 0 THEN 100.0 WHEN {la} = 0 OR {lb} = 0 THEN 0.0 "
            f"WHEN {la} < {lb} THEN {best(a, b)} WHEN {la} > {lb} THEN {best(b, a)} "
            f"ELSE greatest({best(a, b)}, {best(b, a)}) END)")


def partial_edge_ctes(scorer: str, t: float) -> str:
    """``edges`` for the partial-family scorers and WRatio (all pairs, plain)."""
    pairs = ("SELECT x.group_key, x.idx AS ui, y.idx AS vi, x.norm AS a, y.norm AS b "
             "FROM nodes x JOIN nodes y ON x.group_key = y.group_key AND x.idx < y.idx")
    dist = "list_distinct"
    dab = f"array_to_string(list_sort(list_filter({dist}(a_w), lambda q: NOT list_contains(b_w, q))), ' ')"
    dba = f"array_to_string(list_sort(list_filter({dist}(b_w), lambda q: NOT list_contains(a_w, q))), ' ')"
    shared = "len(list_intersect(a_w, b_w)) > 0"
    p_sort = partial_ratio("sa", "sb")
    p_diff = partial_ratio("dab", "dba")
    scores = {
        "partial_ratio": partial_ratio("a", "b"),
        "partial_token_sort_ratio": p_sort,
        "partial_token_set_ratio": (f"(CASE WHEN len(a_w) = 0 OR len(b_w) = 0 THEN 0.0 "
                                    f"WHEN {shared} THEN 100.0 ELSE {p_diff} END)"),
        "partial_token_ratio": f"(CASE WHEN {shared} THEN 100.0 ELSE greatest({p_sort}, {p_diff}) END)",
    }
    if scorer == "WRatio":
        lr = "(greatest(length(a), length(b)) / least(length(a), length(b)))"
        ptr = scores["partial_token_ratio"]
        tset = token_set("a", "b")
        tok = f"greatest({tset}, {ratio('sa', 'sb')})"
        score = (f"(CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 "
                 f"WHEN {lr} < 1.5 THEN greatest({ratio('a', 'b')}, {tok} * 0.95) "
                 f"ELSE greatest({ratio('a', 'b')}, {partial_ratio('a', 'b')} * "
                 f"(CASE WHEN {lr} < 8.0 THEN 0.9 ELSE 0.6 END), "
                 f"{ptr} * 0.95 * (CASE WHEN {lr} < 8.0 THEN 0.9 ELSE 0.6 END)) END)")
    else:
        score = scores[scorer]
    return f"""
    pw AS (SELECT *, {words('a')} AS a_w, {words('b')} AS b_w,
                  {sorted_tokens('a')} AS sa, {sorted_tokens('b')} AS sb FROM ({pairs})),
    pt AS (SELECT *, {dab} AS dab, {dba} AS dba, {token_parts('a', 'b')} FROM pw),
    edges AS MATERIALIZED (SELECT group_key, ui, vi, a, b, score
              FROM (SELECT *, {score} AS score FROM pt) WHERE score >= {t})"""


def search_ctes(queries: str, col: str) -> str:
    """The name search over ``e(name, ent_ord)``, every entity scored: at most five by the
    weight of shared neighbouring characters, of these the best partial ratio: ``best``."""
    def keys(x: str) -> str:
        return (f"(CASE WHEN length({x}) >= 2 THEN list_distinct(list_transform(range(1, length({x})), "
                f"lambda i: substr({x}, i::BIGINT, 2))) ELSE [{x}] END)")
    return f"""
s AS (SELECT {col} AS query, name, ent_ord, lower({col}) AS ql, lower(name) AS el FROM {queries} qq, e
      WHERE {col} <> ''),
ek AS (SELECT name, ent_ord, unnest({keys('lower(name)')}) AS k FROM e),
kw AS (SELECT k, CAST(floor(1000.0 * (1.0 + ln((SELECT count(*) FROM e) / CAST(count(*) AS DOUBLE)))) AS BIGINT) AS w
       FROM ek GROUP BY k),
common AS (SELECT *, unnest(list_intersect({keys('ql')}, {keys('el')})) AS k FROM s),
sh AS (SELECT query, name, ent_ord, ql, el, sum(w) AS shared FROM common JOIN kw USING (k) GROUP BY ALL),
place AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, ent_ord, name) AS place
          FROM sh WHERE shared > 0),
sc AS (SELECT query, name, place, {partial_ratio('ql', 'el')} AS score FROM place WHERE place <= 5),
best AS (SELECT query, name, score FROM (
           SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS rk FROM sc) WHERE rk = 1)"""


def dictionary_suggestion_ctes(number_pattern: str, slack: int) -> str:
    """G1 with the table ``dict(word, freq)`` over ``clustered``: ``sugg``."""
    return f"""
    ws AS (SELECT DISTINCT unnest({words('norm')}) AS word FROM clustered),
    longest AS (SELECT max(length(word)) AS m FROM dict),
    chk AS (SELECT ws.word FROM ws, longest WHERE ws.word NOT IN (SELECT word FROM dict)
              AND NOT regexp_full_match(lower(ws.word), '{number_pattern}')
              AND lower(ws.word) <> 'nan' AND length(ws.word) <= longest.m + {slack}),
    near AS (SELECT chk.word, d.word AS dword, d.freq, damerau_levenshtein(chk.word, d.word) AS tier
             FROM chk JOIN dict d ON abs(length(chk.word) - length(d.word)) <= 2
             WHERE damerau_levenshtein(chk.word, d.word) BETWEEN 1 AND 2),
    fix AS (SELECT word, arg_min(dword, (tier, -freq, dword)) AS correction FROM near GROUP BY word),
    cw AS (SELECT c.group_key, c.cluster_id, c.norm, c.okey, c.i, coalesce(f.correction, c.w) AS w
           FROM (SELECT *, unnest({words('norm')}) AS w, generate_subscripts({words('norm')}, 1) AS i
                 FROM clustered) c LEFT JOIN fix f ON f.word = c.w),
    ph AS (SELECT group_key, cluster_id, norm, okey, string_agg(w, ' ' ORDER BY i) AS corr FROM cw GROUP BY ALL),
    cph AS (SELECT c.group_key, c.cluster_id, c.norm, c.okey, c.n,
                   CASE WHEN coalesce(p.corr, '') = '' THEN c.norm ELSE p.corr END AS corr,
                   c.norm IN (SELECT word FROM dict) AS known
            FROM clustered c LEFT JOIN ph p USING (group_key, cluster_id, norm, okey)),
    cstats AS (SELECT group_key, cluster_id, sum(n) AS size, count(*) AS ndist,
                      arg_min(norm, (-n, okey)) AS top_v, arg_min(n, (-n, okey)) AS top_k,
                      arg_min(norm, okey) FILTER (WHERE known) AS dict_word
               FROM cph GROUP BY group_key, cluster_id),
    cvote AS (SELECT group_key, cluster_id, arg_min(corr, (-k, o)) AS corr_vote FROM (
                SELECT group_key, cluster_id, corr, count(*) AS k, min(okey) AS o FROM cph GROUP BY ALL)
              GROUP BY group_key, cluster_id),
    sugg AS (SELECT s.group_key, s.cluster_id, 'cluster_' || s.cluster_id AS cluster_tag,
                    CAST(s.size AS BIGINT) AS size,
                    CASE WHEN s.size = 1 OR s.ndist < s.size THEN s.top_v
                         ELSE coalesce(s.dict_word, v.corr_vote) END AS suggestion,
                    CASE WHEN s.size = 1 THEN 'single_member'
                         WHEN s.ndist = s.size THEN 'spell_checker' ELSE 'majority' END AS suggestion_mode,
                    CASE WHEN s.size = 1 THEN 1.0
                         WHEN s.ndist < s.size THEN round_even(s.top_k / s.size, 2)
                         WHEN s.dict_word IS NOT NULL THEN round_even(1.0 / s.size, 2)
                         ELSE 0.9 END AS confidence
             FROM cstats s JOIN cvote v USING (group_key, cluster_id))"""
