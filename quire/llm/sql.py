"""The same results in DuckDB's SQL, where SQL can express them on whole tables."""

_P4 = r"""
with s as (select distinct section_key, doc_id, raw_text from sections where raw_text is not null),
l as (select section_key, d.doc_id, source, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) n, unnest(string_split(raw_text, chr(10))) line
      from s join documents d on s.doc_id = d.doc_id where source is not null),
k as (select section_key, doc_id, source, n, regexp_replace(lower(line), '[\p{Nd}\s\p{Z}]+', '', 'g') as key from l where length(regexp_replace(line, '\P{L}+', '', 'g')) >= 12),
t as (select source, count(distinct d.doc_id) total from sections s join documents d on s.doc_id = d.doc_id where source is not null group by 1),
c as (select source, key, count(distinct doc_id) docs from k group by 1, 2),
h as (select c.source, c.key from c join t on c.source = t.source where docs >= 2 and docs * 5 >= total)
select distinct section_key, cast(n as int) line_no from k join h on k.source = h.source and k.key = h.key
"""

_P6 = r"""
with f as (select section_key, 'content' as field, content as t from sections union all select section_key, 'layout_text', layout_text from sections)
select distinct section_key, field, case when regexp_matches(t, '[A-Za-z0-9]{1000}[A-Za-z0-9]{1000}[A-Za-z0-9]') then 'forced' else 'natural' end as cut
from f where length(t) > 2000
"""

SQL = {"p4_found": _P4, "p6_found": _P6}
