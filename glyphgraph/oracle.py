"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

# Fixed values, with the characters that SQL text cannot hold plainly written as chr().
_EXCLUDED = (
    "('。','，','！','？','：','；','～','（','）',' ','~','?',';','.','&',chr(0),chr(39),'(',')','[',']',"
    "',',chr(92),'$','@','/','0','1','2','3','4','5','6','7','8','9')"
)


def _code(name: str) -> str:
    parts = " || ".join(f"substr(hex(encode({name})), {i}, 2)" for i in range(15, 0, -2))
    return f"cast('0x' || {parts} as bigint)"


# Every common table expression, with those it builds on.
_TABLES = {
    "docs": ([], "select doc_id as comment_id, text as content from documents where text is not null"),
    "chars": (
        ["docs"],
        "select comment_id, cast(generate_subscripts(string_split(content, ''), 1) - 1 as bigint) as pos,"
        " unnest(string_split(content, '')) as ch from docs",
    ),
    "near": (
        ["chars"],
        "select comment_id, pos, ch, lag(ch) over w as prev, lead(ch) over w as next from chars"
        " window w as (partition by comment_id order by pos)",
    ),
    "pairs": (
        ["near"],
        "select comment_id, pos, ch as src, next as dst from near where next is not null",
    ),
    "kept": (["pairs"], f"select * from pairs where src not in {_EXCLUDED} and dst not in {_EXCLUDED}"),
    "bigrams": (["kept"], "select src, dst, count(*) as weight from kept group by src, dst"),
    "names": (["bigrams"], "select src as name from bigrams union select dst from bigrams"),
    "cv": (["names"], f"select {_code('name')} as id, name from names"),
    "ce": (
        ["bigrams"],
        f"select {_code('src')} as src, {_code('dst')} as dst, weight from bigrams",
    ),
    "ranked": (
        ["names"],
        "select row_number() over (order by name) - 1 as vertex_id, name from names",
    ),
    "id_edges": (
        ["bigrams", "ranked"],
        "select coalesce(s.vertex_id, 0) as source_id, coalesce(d.vertex_id, 0) as des_id, weight"
        " from bigrams b left join ranked s on b.src = s.name left join ranked d on b.dst = d.name",
    ),
    "weighted": (
        ["pairs", "bigrams"],
        "select comment_id, pos, p.src as src_name, p.dst as dst_name, coalesce(b.weight, 0) as weight"
        " from pairs p left join bigrams b on p.src = b.src and p.dst = b.dst",
    ),
    "sides": (
        ["chars", "weighted"],
        "select c.comment_id, c.pos, c.ch, coalesce(i.weight, 0) as w_in, coalesce(o.weight, 0) as w_out"
        " from chars c"
        " left join weighted i on c.comment_id = i.comment_id and c.pos = i.pos + 1"
        " left join weighted o on c.comment_id = o.comment_id and c.pos = o.pos",
    ),
    "labelled": (
        ["sides"],
        "select comment_id, pos, ch, w_out, case when pos = 0 then 'A' when w_out = 0 then 'E'"
        " when 10 * w_in < 7 * w_out then 'B' when (w_in - w_out) // w_out > 0.1 then 'E' else 'I' end"
        " as label from sides",
    ),
    "segmented": (
        ["labelled"],
        "select comment_id, string_agg(case label when 'E' then ch || ' ' when 'B' then ' ' || ch"
        " else ch end, '' order by pos) as segmented from labelled group by comment_id",
    ),
    "starts": (
        ["docs"],
        "select comment_id, cast(sum(greatest(length(content), 1)) over (order by comment_id)"
        " - greatest(length(content), 1) as bigint) as first from docs",
    ),
    "followed": (
        ["ce"],
        "select src, dst from (select src, dst, row_number() over (partition by src order by weight desc, dst) as n"
        " from ce) h where n = 1",
    ),
    "reached": (
        ["cv", "followed"],
        "select id as origin, id as stop from cv union select origin, b from reached"
        " join (select src as a, dst as b from followed union select dst, src from followed) n on stop = a",
    ),
    "slice": (
        ["docs"],
        "select comment_id, content from docs where comment_id > 1 order by comment_id"
        " limit 50 offset 320",
    ),
}

_FINAL = {
    "scan_comments": ([], "select doc_id as comment_id, text as content from documents"),
    "comment_slice": (["slice"], "select * from slice"),
    "counted_slice": (["slice"], "select * from slice"),
    "scan_comments_table": ([], "select doc_id as comment_id, text as content from documents"),
    "char_positions": (["chars"], "select * from chars"),
    "pair_filter": (["kept"], "select * from kept"),
    "char_codes": (
        ["chars"],
        f"select ch, {_code('ch')} as code from (select distinct ch from chars)",
    ),
    "comment_edges": (
        ["pairs"],
        "select comment_id, pos, src as src_name, dst as dst_name, cast(0 as bigint) as weight from pairs",
    ),
    "bigram_edges": (["bigrams"], "select * from bigrams order by weight desc, src, dst"),
    "bigram_top_k": (["bigrams"], "select * from bigrams order by weight desc, src, dst limit 300"),
    "bigram_edges_roundtrip": (["bigrams"], "select * from bigrams"),
    "bigram_edges_json": (
        ["bigrams"],
        "select src, dst, weight, cast(null as varchar) as reason from bigrams"
        " union all select null, null, null, 'no JSON object'"
        " union all select null, null, null, 'weight is no bigint'",
    ),
    "corpus_vertices": (["cv"], "select * from cv"),
    "corpus_edges": (["ce"], "select * from ce"),
    "vertex_ids": (["ranked"], "select * from ranked"),
    "edges_with_ids": (["id_edges"], "select * from id_edges"),
    "graph_vertices_roundtrip": (["ranked"], "select * from ranked"),
    "graph_edges_roundtrip": (["id_edges"], "select * from id_edges"),
    "graph_counts": (
        ["names", "bigrams"],
        "select (select count(*) from names) as n_vertices, (select count(*) from bigrams) as n_edges",
    ),
    "graph_from_store": (
        ["names", "bigrams"],
        "select (select count(*) from names) as n_vertices, (select count(*) from bigrams) as n_edges,"
        " (select cast(sum(weight) as bigint) from bigrams) as weight",
    ),
    "graph_build": (
        ["cv", "ce"],
        "select e.id, v.name from (select src as id from ce union select dst from ce) e"
        " left join (select * from cv where id in (select dst from ce)) v on e.id = v.id",
    ),
    "out_degrees": (["ce"], "select src as id, count(*) as degree from ce group by src"),
    "in_degrees": (["ce"], "select dst as id, count(*) as degree from ce group by dst"),
    "source_vertices": (
        ["cv", "ce"],
        "select id, name from cv where not exists (select 1 from ce where ce.dst = cv.id)",
    ),
    "sink_vertices": (
        ["cv", "ce"],
        "select id, name from cv where not exists (select 1 from ce where ce.src = cv.id)",
    ),
    "reverse_edges": (["ce"], "select dst as src, src as dst, weight from ce"),
    "triplets": (
        ["cv", "ce"],
        "select e.src, s.name as src_name, e.dst, d.name as dst_name, e.weight"
        " from ce e join cv s on e.src = s.id join cv d on e.dst = d.id",
    ),
    "map_vertices": (["cv"], "select id, name, 'A' as label, cast(0 as bigint) as out_weight from cv"),
    "map_edges": (["ce"], "select src, dst, weight as link_weight from ce"),
    "join_vertices": (
        ["cv", "ce"],
        "select id, coalesce(n, 0) as out_degree from cv"
        " left join (select src, count(*) as n from ce group by src) d on cv.id = d.src",
    ),
    "agg_messages_in": (
        ["ce"],
        "select dst as id, cast(sum(weight) as bigint) as in_weight from ce group by dst",
    ),
    "agg_messages_out": (["ce"], "select src as id, max(weight) as out_weight from ce group by src"),
    "agg_messages_names": (
        ["cv", "ce"],
        "select e.src as id, string_agg(d.name, '::' order by d.name) as neighbours"
        " from ce e join cv d on e.dst = d.id group by e.src",
    ),
    "pregel_components": (
        ["cv", "ce", "followed", "reached"],
        "select origin as id, min(stop) as component from reached group by origin",
    ),
    "comment_vertices": (
        ["chars", "starts"],
        "select first + pos as id, comment_id, pos, ch as name from chars join starts using (comment_id)",
    ),
    "comment_sources": (
        ["chars", "pairs"],
        "select comment_id, pos, ch as name from chars c where not exists (select 1 from pairs p"
        " where p.comment_id = c.comment_id and p.pos + 1 = c.pos)",
    ),
    "comment_sinks": (
        ["chars", "pairs"],
        "select comment_id, pos, ch as name from chars c where not exists (select 1 from pairs p"
        " where p.comment_id = c.comment_id and p.pos = c.pos)",
    ),
    "weighted_comment_edges": (["weighted"], "select * from weighted"),
    "path_starts": (
        ["chars", "pairs"],
        "select comment_id, pos from chars c where not exists (select 1 from pairs p"
        " where p.comment_id = c.comment_id and p.pos + 1 = c.pos)",
    ),
    "path_ends": (
        ["chars", "pairs"],
        "select comment_id, pos from chars c where not exists (select 1 from pairs p"
        " where p.comment_id = c.comment_id and p.pos = c.pos)",
    ),
    "label_chars": (["labelled"], "select comment_id, pos, ch, label from labelled"),
    "pregel_labels": (["labelled"], "select comment_id, pos, ch, label from labelled"),
    "segment_text": (["segmented"], "select * from segmented"),
    "segment_slice": (
        ["segmented", "slice"],
        "select comment_id, segmented from segmented where comment_id in (select comment_id from slice)",
    ),
    "segment_labelled": (["segmented"], "select * from segmented"),
    "segment_relabelled": (
        ["labelled"],
        "select comment_id, string_agg(case when pos = start then ch when kind in ('E', 'S') then ch || ' '"
        " when kind = 'B' then ' ' || ch else ch end, '' order by pos) as segmented from ("
        "select *, max(case when pos = 0 or kind = 'U' then pos end) over (partition by comment_id) as start from ("
        "select comment_id, pos, ch, case when ch = '.' then 'S' when ch = chr(10) then 'U'"
        " when label = 'I' and pos % 2 = 1 then 'M' else label end as kind from labelled) k) s"
        " where pos >= start group by comment_id",
    ),
    "segment_slice_paths": (
        ["segmented", "slice"],
        "select comment_id, segmented from segmented where comment_id in (select comment_id from slice)",
    ),
    "cut_result_file": (
        ["segmented"],
        "select cast(0 as bigint) as line_no, '【原始】' || replace(segmented, ' ', '') as value from segmented"
        " union all select 1, '【分词】' || segmented from segmented union all select 2, '' from segmented",
    ),
    "cut_result_lines": (
        ["segmented"],
        "select comment_id, cast(0 as bigint) as line_no, '【原始】' || replace(segmented, ' ', '') as value"
        " from segmented union all select comment_id, 1, '【分词】' || segmented from segmented"
        " union all select comment_id, 2, '' from segmented",
    ),
    "export_nodes": (
        ["labelled"],
        "select comment_id || ':' || pos as id, ch || label || w_out as label"
        " from labelled",
    ),
    "export_edges": (
        ["weighted"],
        "select comment_id || ':' || pos || '->' || comment_id || ':' || (pos + 1) as id,"
        " comment_id || ':' || pos as src, comment_id || ':' || (pos + 1) as dst,"
        " cast(weight as varchar) as label, cast(0.1 as double) as layout_weight"
        " from weighted",
    ),
}


def all_sql() -> dict[str, str]:
    return {name: _with_tables(needed, final) for name, (needed, final) in _FINAL.items()}


def _with_tables(needed: list[str], final: str) -> str:
    used: list[str] = []

    def add(table: str) -> None:
        for other in _TABLES[table][0]:
            add(other)
        if table not in used:
            used.append(table)

    for table in needed:
        add(table)
    if not used:
        return final
    return "with recursive " + ",\n".join(f"{t} as ({_TABLES[t][1]})" for t in used) + "\n" + final
