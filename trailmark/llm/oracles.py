"""The corpus operators that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from .common import LOWER, UPPER
from .decontamination import WINDOW
from .license_scan import BASE, LEAST_FUZZY, MORE
from .mixing import MIX
from .url_filters import RULES


def license_scan_sql(slack: int = 2, coverage: float = 0.75) -> str:
    rows = []
    for phrase, (said, label) in enumerate([*BASE.items(), *MORE.items()]):
        w = said.split()
        rows += [f"({phrase}, {j}, '{w[j]} {w[j + 1]}', {len(w) - 1}, '{label}', {phrase < len(BASE)})" for j in range(len(w) - 1)]
    return f"""
with pairs(phrase, j, pair, size, label, base) as (values {", ".join(rows)}),
texts as (
    select row_number() over () as doc_row, doc_id,
        list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as words
    from documents),
rolling as (select doc_row, i, words[i + 1] || ' ' || words[i + 2] as seen from (select doc_row, words, unnest(range(len(words) - 1)) as i from texts)),
met as (select doc_row, phrase, size, label, base, i, j, i - j as diagonal from rolling join pairs on seen = pair),
votes as (select doc_row, phrase, diagonal, count(*) as n, any_value(size) as size, any_value(label) as label, any_value(base) as base from met group by doc_row, phrase, diagonal),
seen as (
    select v.doc_row, v.phrase, v.diagonal, m.i, m.j, coalesce(m.j > max(m.j) over (partition by v.doc_row, v.phrase, v.diagonal order by m.i, m.j rows between unbounded preceding and 1 preceding), true) as ahead
    from votes v join met m on m.doc_row = v.doc_row and m.phrase = v.phrase and m.diagonal between v.diagonal and v.diagonal + {slack}),
shares as (select doc_row, phrase, diagonal, count(*) filter (where ahead) as k, min(i) as lo, max(i) as hi from seen group by doc_row, phrase, diagonal),
judged as (
    select *, base and n = size as place, cast(k as double) / size as share, case when base then base and n = size else cast(k as double) / size >= case when size >= {LEAST_FUZZY} then {coverage} else 1.0 end end as accepted
    from votes join shares using (doc_row, phrase, diagonal)),
ends as (select *, case when accepted then case when base then diagonal else lo end end as s, case when accepted then case when base then diagonal + size + 1 else hi + 2 end end as e from judged),
held as (select *, coalesce(max(e) over (partition by doc_row order by s nulls first, e desc, phrase rows between unbounded preceding and 1 preceding) >= e, false) as within from ends),
found as (
    select doc_row, count(*) filter (where place) as n_base, min(diagonal) filter (where place) as first_word, max(diagonal) filter (where place) as last_word,
        array_to_string(list_sort(list_distinct(list(label) filter (where place))), ',') as base_labels,
        array_to_string(list_sort(list_distinct(list(label) filter (where accepted and (base or not within)))), ',') as labels, max(share) as score
    from held group by doc_row)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from texts left join found using (doc_row)"""


#: Documents with a Jaccard similarity of 85 % of their word 5-grams, and what is reachable over such links.
NEAR_DUPLICATES = f"""
with recursive texts as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words
    from documents),
shingles as (
    select distinct doc_id, hash(array_to_string(words[i:i + 4], ' ')) as s
    from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from texts where len(words) > 0)),
sizes as (select doc_id, count(*) as n, sum(s) as total, bit_xor(s) as bits from shingles group by doc_id),
classes as (select n, total, bits, min(doc_id) as rep from sizes group by n, total, bits),
own as (select doc_id, n, rep from sizes join classes using (n, total, bits)),
unique_shingles as (select s, doc_id as rep from shingles where doc_id in (select rep from classes)),
shared as (select a.rep as a, b.rep as b, count(*) as k from unique_shingles a join unique_shingles b on a.s = b.s and a.rep < b.rep group by a.rep, b.rep),
links as (select a, b from shared join classes x on x.rep = a join classes y on y.rep = b where 100 * k >= 85 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, root) as (select rep, rep from classes union select b, root from reach join both_ways on node = a),
components as (select node, min(root) as component from reach group by node)
select t.doc_id, coalesce(o.n, 0) as n_shingles, coalesce(component, t.doc_id) as component_id, coalesce(component, t.doc_id) = t.doc_id as kept
from (select doc_id from documents) t left join own o using (doc_id) left join components on node = o.rep"""


def url_filters_sql(min_share: float = 0.01, min_count: int = 8, z: float = 2.0, prior: float = 4.0, threshold: float = 0.7) -> str:
    name, suffix = "regexp_replace(x, '\\.[A-Za-z]{1,5}$', '')", "regexp_extract(x, '\\.[A-Za-z]{1,5}$')"
    general = f"case when regexp_matches({name}, '^[0-9]+$') then '<number>' || {suffix} when regexp_matches({name}, '^[0-9A-Fa-f-]{{8,}}$') and regexp_matches({name}, '[0-9]') then '<hex>' || {suffix} when regexp_matches({name}, '[0-9]') then '<mixed>' || {suffix} else x end"
    rules = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{said}')" for r, said in RULES.items())
    pooled = "((m.gb + {p} * m.gp / m.gn) + (x.b + {p} * x.p0)) / (m.gs + x.said + 2 * {p})".replace("{p}", str(prior))
    alike = f"abs(x.r - (m.gb + {prior} * m.gp / m.gn) / (m.gs + {prior})) <= {z} * sqrt(({pooled}) * (1 - ({pooled})) * (1 / (m.gs + {prior}) + 1 / (x.said + {prior})))"
    carry = ", ".join(f"case when {alike} then m.{g} else 0 end + x.{c} as {g}" for g, c in (("gb", "b"), ("gs", "said"), ("gp", "pn"), ("gn", "n")))
    return f"""
with recursive rules(rule, domain, start, said) as (values {rules}),
parts as (
    select row_number() over () as page_row, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
    from (select page_id, coalesce(url, '') as url from pages)),
fits as (select page_row, max_by(rule, (length(rule), rule)) as rule, max_by(said, (length(rule), rule)) as listed from parts join rules on (host = domain or ends_with(host, '.' || domain)) and starts_with(path, start) group by page_row),
urls as (select p.*, f.rule, f.listed, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {general}) as seg from parts p left join fits f using (page_row)),
counts as (select host, seg, count(*) as n, count(*) filter (where listed = 'block') as b, count(*) filter (where listed = 'allow') as a from urls group by host, seg),
walk(level, host, seg, n, b, a, above, template, open) as (
    select 0, host, seg, n, b, a, '', '', len(seg) > 0 from counts
    union all
    select level + 1, host, seg, n, b, a, template, template || '/' || step, step <> '**' and len(seg) > level + 1
    from (
        select *, case when total < {min_count} then '**' when own >= {min_count} and own >= {min_share} * total then seg[level + 1] else '*' end as step
        from (select *, sum(n) over (partition by host, template) as total, sum(n) over (partition by host, template, seg[level + 1]) as own from walk where open))),
cells as (select * from walk where not open),
leaves as (select host, above, template, cast(sum(n) as double) as n, cast(sum(b) as double) as b, cast(sum(a) as double) as a from cells group by host, above, template),
everywhere as (select template, (sum(b) + {prior} * ((select sum(b) from leaves) + 1) / ((select sum(b) from leaves) + (select sum(a) from leaves) + 2)) / (sum(b) + sum(a) + {prior}) as p0 from leaves group by template),
rated as (select l.*, b + a as said, p0, p0 * n as pn, (b + {prior} * (p0 * n) / n) / (b + a + {prior}) as r from leaves l join everywhere using (template)),
ranked as (select *, row_number() over (partition by host, above order by r, template) as k from rated),
merging(host, above, template, k, grp, gb, gs, gp, gn) as (
    select host, above, template, k, 1, b, said, pn, n from ranked where k = 1
    union all
    select x.host, x.above, x.template, x.k, m.grp + case when {alike} then 0 else 1 end, {carry}
    from merging m join ranked x on x.host = m.host and x.above = m.above and x.k = m.k + 1),
groups as (select host, above, grp, arg_max((gb + {prior} * gp / gn) / (gs + {prior}), k) as block_rate from merging group by host, above, grp),
rates as (select host, template, block_rate from merging join groups using (host, above, grp))
select page_id, u.host, u.path, u.rule, coalesce(u.listed, case when block_rate >= {threshold} then 'block' else 'allow' end) as verdict, case when c.template = '' then '/' else c.template end as template, round(block_rate, 6) as block_rate
from urls u join cells c on u.host = c.host and u.seg = c.seg join rates r on r.host = c.host and r.template = c.template"""


def mixing_sql(fraction: float = 0.5, epochs: int = 2, seed: int = 17) -> str:
    weight = f"case name {' '.join(f"when '{k}' then cast({v} as double)" for k, v in MIX.items())} else cast(1 as double) end"
    levels, steps = ["domain", "lang", "source"], []
    for k, name in enumerate(levels):
        above = levels[:k]
        by = ", ".join(above) or "1"
        plan = f"shared{k - 1}" if k else "total"
        join = f"join {plan} using ({', '.join(above)})" if k else f"cross join {plan}"
        filling = f"(partition by {by} order by most / w, name"
        steps.append(f"""
nodes{k} as (select *, name as {name}, {weight} as w from (select {', '.join([*above, f'{name} as name'])}, sum(n) * {epochs} as most from leaves group by all) {join}),
capped{k} as (select * replace (least(budget, sum(most) over (partition by {by})) as budget) from nodes{k} where w > 0 and most > 0),
filled{k} as (select *, (budget - coalesce(sum(most) over {filling} rows between unbounded preceding and 1 preceding), 0)) * w >= most * sum(w) over {filling} rows between current row and unbounded following) as fits,
    sum(w) over {filling} rows between current row and unbounded following) as open_w from capped{k}),
full{k} as (select *, min(fits) over {filling} rows between unbounded preceding and current row) as filled from filled{k}),
rest{k} as (select *, budget - coalesce(sum(most) filter (where filled) over (partition by {by}), 0) as rest, max(open_w) filter (where not filled) over (partition by {by}) as total_w from full{k}),
want{k} as (select *, case when filled then cast(most as double) else cast(rest as double) * w / total_w end as want from rest{k}),
whole{k} as (select *, cast(floor(want) as hugeint) as whole from want{k}),
turn{k} as (select *, rest - sum(whole) filter (where not filled) over (partition by {by}) as over_, row_number() over (partition by {by} order by filled, whole - want, name) as turn from whole{k}),
shared{k} as (select {', '.join([*above, name])}, whole + case when not filled and turn <= over_ then 1 else 0 end as budget from turn{k}),""")
    return f"""
with named as (
    select doc_id, text, regexp_extract(coalesce(source, ''), '^([^0-9]*)', 1) || '-' || regexp_extract(coalesce(source, ''), '([0-9])$', 1) as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
        len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as n_tokens
    from documents),
leaves as (select domain, lang, source, sum(n_tokens) as n from named group by all),
total as (select cast(floor(sum(n) * cast({fraction} as double)) as hugeint) as budget from leaves),
{"".join(steps)}
plan as (select *, budget // n as whole, budget % n as rest from shared2 join leaves using (domain, lang, source) where budget > 0),
placed as (select d.*, whole, rest, sum(n_tokens) over (partition by domain, lang, source order by substr(md5('{seed}:' || coalesce(cast(doc_id as varchar), '') || ':' || whole), 1, 15), doc_id, text range between unbounded preceding and current row) as upto from named d join plan using (domain, lang, source)),
times as (select *, whole + case when rest > 0 and upto <= rest then 1 else 0 end as n_times from placed)
select doc_id, domain, lang, source, cast(n_tokens as bigint) as n_tokens, unnest(range(cast(n_times as bigint))) as epoch from times"""


_LEAK_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

#: Every window of every item looked up at every place of every document.
DECONTAMINATION = f"""
with texts as (select row_number() over () as doc_row, doc_id, {_LEAK_WORDS} as words from documents),
items as (select item_id, {_LEAK_WORDS} as words from benchmark),
windows as (
    select distinct item_id, least(len(words), {WINDOW}) as size, array_to_string(words[i + 1:i + {WINDOW}], ' ') as win
    from (select *, unnest(range(greatest(len(words) - {WINDOW - 1}, 1))) as i from items where len(words) > 0)),
places as (
    select doc_row, i, size, array_to_string(words[i + 1:i + size], ' ') as win
    from (select *, unnest(range(greatest(len(words) - size + 1, 0))) as i from texts, (select distinct size from windows))),
found as (select distinct doc_row, i, size, item_id from places join windows using (size, win)),
hits as (select doc_row, count(distinct i + k) as n_hit from (select doc_row, i, unnest(range(size)) as k from found) group by doc_row),
listed as (select doc_row, count(distinct item_id) as n_items, coalesce(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)), '') as ids from found group by doc_row)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from texts left join hits using (doc_row) left join listed using (doc_row)"""

ORACLE_SQL = {"op11_decontamination": DECONTAMINATION, "op5_mixing": mixing_sql(), "op1_url_filters": url_filters_sql(), "op2_license_scan": license_scan_sql(), "op3_near_duplicates": NEAR_DUPLICATES}
