"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

_LETTERS = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
_KEYWORDS = "".join(_LETTERS.get(c, c) for c in "(password|passwd|secret|token|api_?key)")

# The patterns, the group whose length counts, and that length.
_SECRETS = {
    "assign": (_KEYWORDS + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}

_FOUND = " union all ".join(
    f"select doc_id, {n} as number, '{kind}' as kind, regexp_extract_all(body, '{pattern}', 0) as found,"
    f" regexp_extract_all(body, '{pattern}', {group}) as taken, string_split_regex(body, '{pattern}') as gaps,"
    f" {least} as least from bodies where regexp_matches(body, '{pattern}')"
    for n, (kind, (pattern, group, least)) in enumerate(_SECRETS.items())
)

_SQL: dict[str, str] = {
    "op2_secret_scans": f"""
        with bodies as (select doc_id, coalesce(text, '') as body from documents),
        found as ({_FOUND}),
        matches as (
            select *, unnest(generate_series(1, len(found))) as i from found
        ),
        spans as (
            select doc_id, number, kind,
                cast(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as begins,
                length(found[i]) as size
            from matches where length(taken[i]) >= least
        ),
        joined as (
            select doc_id,
                count(*) filter (where kind = 'assign') as n_assign,
                count(*) filter (where kind = 'access') as n_access,
                count(*) filter (where kind = 'hex') as n_hex,
                string_agg(kind || ':' || begins || ':' || (begins + size), ',' order by begins, number) as spans
            from spans group by doc_id
        )
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
            coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
        from documents left join joined using (doc_id)
    """,
    "op6_exact_dedup": """
        with texts as (
            select doc_id, length(coalesce(text, '')) as size,
                regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as content
            from documents
        ),
        ranked as (
            select doc_id, content,
                first_value(doc_id) over (partition by content order by size desc, doc_id) as keep_id,
                count(*) over (partition by content) as group_size
            from texts
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(content) as text_sha256 from ranked
    """,
    "op12_filter_audit": """
        with texts as (
            select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body,
                regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
            from documents
        ),
        marks as (
            select doc_id, max(case when quality = 1 then 1 else 0 end) as good,
                max(case when toxic = 1 then 1 else 0 end) as toxic
            from labels where doc_id is not null group by doc_id
        ),
        tested as (
            select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                case when len(words) < 100 then 1 else 0 end
                + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
                + case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) then 4 else 0 end
                + case when regexp_matches(body, '[#$%&*|]') then 8 else 0 end
                + case when min(doc_id) over (partition by body) < doc_id then 16 else 0 end as failed
            from texts left join marks using (doc_id)
        ),
        counted as (
            select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from tested group by part, failed
        ),
        filters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(name, bit)),
        orders as (
            select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
            from filters a, filters b, filters c, filters d, filters e
            where a.bit + b.bit + c.bit + d.bit + e.bit = 31
                and a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ),
        steps as (
            select filter_order, step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as integer) as earlier
            from orders, (select unnest([1, 2, 3, 4, 5]) as step)
        ),
        sums as (
            select part, filter_order, step, bit,
                sum(case when failed & (earlier | bit) = 0 then n else 0 end) as kept,
                sum(case when failed & earlier = 0 and failed & bit <> 0 then n else 0 end) as removed,
                sum(case when failed & earlier <> 0 and failed & bit <> 0 then n else 0 end) as redundant,
                sum(case when failed = bit then n else 0 end) as unique_fails,
                sum(case when failed & earlier = 0 and failed & bit <> 0 then good else 0 end) as good_lost,
                sum(case when failed & earlier = 0 and failed & bit <> 0 then toxic else 0 end) as toxic_lost
            from counted, steps group by part, filter_order, step, bit
        )
        select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept,
            cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
            cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
            cast(toxic_lost as bigint) as toxic_lost,
            cast(sum(removed) over (partition by part, bit) as bigint) as shapley
        from sums
    """,
    "op13_embedding_dedup": """
        with recursive vectors as (
            select vec_id, cast(embedding as double[]) as x from embeddings
            where vec_id is not null and len(embedding) > 0
                and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
                and len(list_filter(embedding, lambda v: v <> 0)) > 0
        ),
        pairs as (
            select a.vec_id as one, b.vec_id as two from vectors a join vectors b
                on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
            where list_cosine_similarity(a.x, b.x) >= 0.9
        ),
        reached as (
            select one as origin, two as stop from pairs
            union
            select origin, two from reached join pairs on stop = one
        ),
        degrees as (select one as vec_id, count(*) as n_links from pairs group by one),
        roots as (select origin as vec_id, min(stop) as root from reached group by origin)
        select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(root, vec_id)) as component_id,
            vec_id <= coalesce(root, vec_id) as kept
        from embeddings left join degrees using (vec_id) left join roots using (vec_id)
    """,
}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
