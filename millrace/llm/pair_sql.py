"""SQL for the operators on word sequences, plain where the operators are not: all windows, all shared shingles."""

BLANK_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""with recursive d as materialized (select doc_id, {BLANK_WORDS.format(text=LOWER_ASCII)} as w from documents),
    s as materialized (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
        from d, unnest(range(1, greatest(len(w) - 3, 2))) as t(i) where len(w) > 0),
    n as materialized (select doc_id, count(*) as n from s group by 1),
    p as (select a.doc_id as u, b.doc_id as v, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    e as materialized (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * shared >= 85 * (a.n + b.n - shared)),
    r(u, v) as (select u, v from e union select r.u, e.v from r join e on r.v = e.u),
    c as (select u, min(v) as least_v from r group by 1)
    select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(least_v, d.doc_id)) as component_id, d.doc_id <= coalesce(least_v, d.doc_id) as kept
    from d left join n using (doc_id) left join c on c.u = d.doc_id"""

_ALNUM = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""with i as (select item_id, {_ALNUM.format(text=LOWER_ASCII)} as w from benchmark),
    p as materialized (select distinct item_id, least(10, len(w)) as k, array_to_string(w[a:a + least(10, len(w)) - 1], ' ') as g from i, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(a) where len(w) > 0),
    d as materialized (select doc_id, {_ALNUM.format(text=LOWER_ASCII)} as w from documents),
    o as materialized (select doc_id, a, x.k, item_id from (select doc_id, a, z.k, array_to_string(w[a:a + z.k - 1], ' ') as g from d, (select distinct k from p) z, unnest(range(1, len(w) - z.k + 2)) as t(a)) x join p on p.k = x.k and p.g = x.g),
    h as (select doc_id, count(distinct a + j) as n_hit from (select distinct doc_id, a, k from o), unnest(range(k)) as t(j) group by 1),
    m as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from o group by 1)
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join h using (doc_id) left join m using (doc_id)"""

PASSAGES = f"""with d as materialized (select doc_id, {BLANK_WORDS.format(text="coalesce(text, '')")} as w from documents),
    g as (select doc_id, a, array_to_string(w[a:a + 19], ' ') as k from d, unnest(range(1, len(w) - 18)) as t(a)),
    r as (select doc_id, a from g qualify row_number() over (partition by k order by doc_id, a) > 1),
    c as materialized (select distinct doc_id, a + j as place from r, unnest(range(20)) as t(j)),
    x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from d),
    k as (select x.doc_id, string_agg(word, ' ' order by x.place) as kept, count(*) as n from x left join c on c.doc_id = x.doc_id and c.place = x.place where c.place is null group by 1)
    select d.doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)"""
