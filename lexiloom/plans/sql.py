"""DuckDB SQL of the driver's queries, written apart from the operators: joins of all prefixes, depths by running sums, recursive scans."""

from __future__ import annotations

# Words that are spelled in two ways.
_PAIRS = """
centre center, theatre theater, metre meter, behaviour behavior, favour favor, favourite favorite, harbour harbor, labour labor, neighbour neighbor, armour armor, parlour
parlor, organise organize, realise realize, organisation organization, sterilisation sterilization, oesophagus esophagus, anaesthesia anesthesia, caesarean cesarean,
diarrhoea diarrhea, orthopaedic orthopedic, faeces feces, defence defense, licence license, counselling counseling, traveller traveler, jewellery jewelry, programme
program, aluminium aluminum, plough plow, sceptical skeptical, storey story, grey gray, moustache mustache
"""
_W = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_MARK = "(!?B[0-9]+|!)"
_CHAR = f";?B[0-9]+(;{_MARK})*;?"
_WORD = f"^/?{_CHAR}(/{_CHAR})*/?(;;;*({_MARK}(;+{_MARK})*)?;*)?$"

_LEX = """
w0 as (select l_orderkey, list(concat('B', cast(l_partkey % 500 as varchar), case when l_orderkey % 53 = 0 then ';B423' when l_returnflag = 'R' and l_quantity > 45 then ';B97' else '' end) order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) g,
  first(l_partkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) first_part
  from lineitem group by l_orderkey having count(*) <= 5),
lex as (select concat('B', cast(100000 + w0.l_orderkey as varchar)) as id, 100000 + w0.l_orderkey as numeric_id,
  concat(array_to_string(w0.g,'/'), case o_orderstatus when 'F' then ';;B81' when 'P' then ';;B86' else '' end) as code,
  concat(case when o_orderstatus='F' then 'to ' else '' end, case w0.l_orderkey % 6 when 0 then p_name when 1 then concat(p_name, ', ', p_brand)
    when 2 then concat(p_name, ' (', lower(p_type), ')') when 3 then concat(split_part(p_name,' ',2), '(s)')
    when 4 then concat(p_name, ' - (', lower(p_type), ')') else concat('grey ', split_part(p_name,' ',2), '; centre ', p_brand) end) as gloss,
  case o_orderstatus when 'F' then 'action' when 'P' then 'description' else 'noun' end as pos,
  w0.l_orderkey % 37 = 0 as is_char, w0.l_orderkey % 23 <> 0 as is_word, w0.l_orderkey % 101 = 0 as is_indicator, w0.l_orderkey % 29 = 0 as is_non_preferred,
  concat(p_name, '_ from  ', p_brand) as explanation
  from w0 join orders on o_orderkey = w0.l_orderkey join part on p_partkey = w0.first_part
  union all
  select concat('B', cast(p_partkey as varchar)), p_partkey, concat('VL', cast(p_size as varchar), ':0,8'), p_name, 'noun', true, false, false, false, null from part where p_partkey < 500)
"""


def _parsed(name: str, source: str, column: str) -> str:
    """CTEs that end in ``name``: the source with plain parts of each spelling, null where it isn't a word."""
    return rf"""
{name}_a as (select *, regexp_replace(regexp_replace({column}, '{_W}', '', 'g'), '[Bb]0*([0-9]+)', 'B\1', 'g') as plain from {source}),
{name}_b as (select * exclude (plain), case when not contains(plain, '//') and regexp_matches(plain, '{_WORD}') then plain end as word from {name}_a),
{name}_c as (select * exclude (word), list_transform(list_filter(string_split(string_split(word, ';;')[1], '/'), lambda x: x <> ''), lambda p: list_filter(string_split(p, ';'), lambda x: x <> '')) as codes,
  list_filter(list_transform(string_split(substr(word, length(string_split(word, ';;')[1]) + 3), ';'), lambda x: regexp_replace(x, '^!', '')), lambda x: x <> '') as tail from {name}_b),
{name}_d as (select * exclude (codes, tail), list_transform(codes, lambda c: c[1]) as base, list_transform(codes, lambda c: list_filter(list_transform(c[2:], lambda x: regexp_replace(x, '^!', '')), lambda x: x <> '')) as m0,
  list_filter(tail, lambda x, i: list_position(tail, x) = i) as word_marks from {name}_c),
{name}_e as (select * exclude (m0), list_transform(m0, lambda l: list_filter(l, lambda x, i: list_position(l, x) = i)) as marks from {name}_d),
{name}_f as (select *, list_transform(range(1, len(base) + 1), lambda i: array_to_string(list_prepend(base[i], marks[i]), ';')) as chars, array_to_string(base, '/') as base_key from {name}_e),
{name} as (select *, case when base is not null then array_to_string(chars, '/') || case when len(word_marks) > 0 then ';;' || array_to_string(word_marks, ';') else '' end end as canonical from {name}_f)
"""


_ENTRY = f"""{_LEX}, {_parsed("parsed", "lex", "code")},
entry as (select *, coalesce(len(list_filter(flatten(marks), lambda m: m not in ('B81', 'B86', 'B97'))) > 0, false) as atomic from parsed),
shown as (select *, case when atomic or canonical is null then id else canonical end as shown, case when atomic or canonical is null then id else base_key end as shown_base from entry),
word as (select * from shown where canonical is not null),
keys as (select unnest(list_distinct([id, shown_base])) as key, id as helper_id, numeric_id as helper_no, gloss as helper_gloss from shown where not is_non_preferred),
spelling_keys as (select unnest(list_distinct(list_filter([id, canonical], lambda x: x is not null))) as key, id from shown where not is_non_preferred),
targets as (select id as target_id, base, base_key, chars as own_chars from word)
"""
_SET = _parsed("given", "(select * from set_300 where spelling is not null)", "spelling")
_ASKED = f"{_ENTRY}, {_SET}, asked as (select code as asked, canonical, base_key from word union select spelling, canonical, base_key from given where canonical is not null)"
_SUB = """
span as (select target_id, s.s as span_start, e.e as span_stop, array_to_string(base[s.s + 1:e.e], '/') as key from targets, lateral (select unnest(range(0, len(base))) as s) s, lateral (select unnest(range(s.s + 1, len(base) + 1)) as e) e where not (s.s = 0 and e.e = len(base))),
sub as (select target_id, span_start::integer as span_start, span_stop::integer as span_stop, key, helper_id, helper_no, helper_gloss from span join keys using (key) where helper_id <> target_id)
"""
_SIB = "sib as (select target_id, helper_id, helper_no, helper_gloss from targets join keys on key = base_key where helper_id <> target_id)"
_NEAR = """
cand as (select id as helper_id, numeric_id as helper_no, base as c, base_key as helper_key, shown as helper_spelling, gloss as helper_gloss, chars from shown where not is_non_preferred and not atomic and canonical is not null),
near0 as (select target_id, 'start' as side, helper_id, helper_no, c, chars, helper_gloss, base_key, helper_key, len(list_filter(range(1, least(len(base), len(c)) + 1), lambda i: base[1:i] = c[1:i])) as shared_len
  from targets join cand on base[1] = c[1] union all
  select target_id, 'end', helper_id, helper_no, c, chars, helper_gloss, base_key, helper_key, len(list_filter(range(1, least(len(base), len(c)) + 1), lambda i: base[len(base) - i + 1:] = c[len(c) - i + 1:]))
  from targets join cand on base[-1] = c[-1]),
near as (select *, len(c) as total, row_number() over (partition by target_id, side order by shared_len desc, len(c), helper_no) as rank from near0
  where helper_id <> target_id and len(c) - shared_len between 1 and case side when 'start' then 3 else 2 end and not contains('/' || base_key || '/', '/' || helper_key || '/'))
"""
_LEGEND = """
region as (select target_id, base_key, case side when 'start' then 0 else 1 end as side_no, rank, case side when 'start' then c[shared_len + 1:] else c[1:len(c) - shared_len] end as b, case side when 'start' then chars[shared_len + 1:] else chars[1:len(c) - shared_len] end as p from near where rank <= 8),
bit as (select target_id, base_key, side_no, rank, s.s as s, e.e as e, array_to_string(b[s.s + 1:e.e], '/') as key, array_to_string(p[s.s + 1:e.e], '/') as spelling, e.e - s.s as length from region, lateral (select unnest(range(0, len(b))) as s) s, lateral (select unnest(range(s.s + 1, len(b) + 1)) as e) e),
once as (select target_id, key, length, first(spelling order by side_no, rank, s, e) as spelling from bit where not contains('/' || base_key || '/', '/' || key || '/') group by target_id, key, length),
legend as (select target_id, spelling, key as base_spelling, length::integer as length, helper_id, helper_no, helper_gloss from once join keys using (key) where helper_id <> target_id)
"""
_SCAN = """
ref(spelling, n) as (values ('B9', 1), ('B10', 1), ('B11', 1), ('B10/B117', 2), ('B449', 1), ('B449/B401', 2), ('B368', 1), ('B368/B368', 2)),
hit as (select target_id as id, len(base) as size, i.i as spot, max_by(spelling, n) as spelling, max(n) as n from targets, lateral (select unnest(range(0, len(base))) as i) i join ref on array_to_string(base[i.i + 1:i.i + n], '/') = spelling
  where not (spelling = 'B10' and coalesce(base[i.i + 2], '') = 'B4') group by all),
scan(id, size, spot, stop, spelling, run) as (
  select id, size, spot, spot + n, spelling, spot = 0 from hit where spot = (select min(h.spot) from hit h where h.id = hit.id)
  union all
  select hit.id, hit.size, hit.spot, hit.spot + hit.n, hit.spelling, scan.run and hit.spot = scan.stop from scan join hit on hit.id = scan.id where hit.spot = (select min(h.spot) from hit h where h.id = scan.id and h.spot >= scan.stop))
"""
_GLOSS = f"""{_LEX},
glosses as (select id, pos, gloss from lex union all select 'C' || cast(curation_id as varchar), 'noun', coalesce(array_to_string(answers, '; '), '') from answer_alias_curation where answers is not null)
"""


_SPACED = "replace(gloss, '_', ' ')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_W}+', ' ', 'g'))"


def _untagged(x: str) -> str:
    return _collapse(rf"regexp_replace({x}, '{_W}*\([^)]*\){_W}*', ' ', 'g')")


def _head(x: str) -> str:
    return _collapse(rf"regexp_replace(regexp_replace(regexp_replace({_untagged(x)}, ' +- +', ' ', 'g'), ' +- *$', ''), '^ *- +', '')")


def _stray(x: str) -> str:
    return f"regexp_matches({_untagged(x)}, ' -( |$)|(^| )- ')"


def _tags(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '\(([^)]*)\)', 1), lambda t: lower(regexp_replace(t, '^{_W}+|{_W}+$', '', 'g')))"


def _normal(x: str, pos: str | None = None) -> str:
    s = _collapse(rf"regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9{_W[1:-1]}-]', ' ', 'g')")
    return s if pos is None else f"case when lower(trim({pos})) in ('action', 'verb') and {s} <> '' and not starts_with({s}, 'to ') then 'to ' || {s} else {s} end"


def _parts(source: str) -> str:
    """CTEs that end in ``part_of``: id, pos, k, part: the top-level alternatives. The depth of brackets is a running sum above its running minimum."""
    return f"""
ch as (select id, pos, gloss, i.i as i, gloss[i.i] as c from {source}, lateral (select unnest(range(1, length(gloss) + 1)) as i) i),
sums as (select *, sum(case c when '(' then 1 when ')' then -1 else 0 end) over (partition by id order by i) as s from ch),
depth as (select *, s - least(0, min(s) over (partition by id order by i)) as d from sums),
cuts as (select *, c in (',', ';', '|') and d = 0 as cut from depth),
pieces as (select *, sum(cut::integer) over (partition by id order by i) as k from cuts),
part_some as (select id, pos, k, coalesce(string_agg(c, '' order by i) filter (not cut), '') as part from pieces group by id, pos, k),
part_of as (select id, pos, k, part from part_some union all select p.id, any_value(p.pos), 0, '' from pieces p group by p.id having not exists (select 1 from part_some x where x.id = p.id and x.k = 0) union all select id, pos, 0, '' from {source} where gloss = '')
"""


_BASE = f"""{_GLOSS}, {_parts("glosses")},
base_form as (select id, pos, form, min(k) as k from (select id, pos, k, {_collapse("replace(part, '_', ' ')")} as form from part_of) where form <> '' group by id, pos, form)
"""
_DIALECT = " ".join(_PAIRS.replace(",", " ").split())
_SWAP = f"(select map_from_entries(list_transform(range(1, 67), lambda i: struct_pack(k := string_split('{_DIALECT}', ' ')[i], v := string_split('{_DIALECT}', ' ')[case when i % 2 = 1 then i + 1 else i - 1 end]))) as m)"


def _variant(x: str) -> str:
    """The other dialect's form of a collapsed text; ``m`` is the map of pairs."""
    return f"case when len(list_filter(string_split({x}, ' '), lambda w: m[lower(w)] is not null)) > 0 then array_to_string(list_transform(string_split({x}, ' '), lambda w: coalesce(m[lower(w)], w)), ' ') end"


_ANSWERS = f"""{_LEX}, {_parts("lex")}, swap as {_SWAP},
base_form as (select id, pos, form, min(k) as k from (select id, pos, k, {_collapse("replace(part, '_', ' ')")} as form from part_of) where form <> '' group by id, pos, form),
review as (select targetId as id, arg_max(answers, curation_id) as reviewed, arg_max(struct_pack(note := note), curation_id).note as note from answer_alias_curation where targetId is not null and answers is not null group by targetId),
ruled as (select id, k, 0 as j, {_head("form")} as form, case when {_stray("form")} then 'separator-clean' else 'disambiguator-strip' end as reason from base_form where id not in (select id from review)
  union all select id, k, j.j, {_head("form")} || case when {_tags("form")}[j.j] = 'es' then 'es' else 's' end, 'inflection' from base_form, lateral (select unnest(range(1, len({_tags("form")}) + 1)) as j) j
    where id not in (select id from review) and {_tags("form")}[j.j] in ('s', 'es', 'pl', 'plural') and {_head("form")} <> ''),
listed as (select id, k, 0 as j, {_collapse("form")} as form, 'curated' as reason from base_form where id in (select id from review) and not contains(form, '(') and not {_stray("form")}
  union all select id, 1000000, i.i, {_collapse("reviewed[i.i]")}, 'curated' from review, lateral (select unnest(range(1, len(reviewed) + 1)) as i) i where reviewed[i.i] is not null),
direct as (select id, form, reason, row_number() over (partition by id order by k, j) as n from (select * from ruled union all select * from listed) where form <> '' and id in (select id from lex)),
direct1 as (select id, form, first(reason order by n) as reason, min(n) as n from direct group by id, form),
everything as (select id, form, reason, 0 as stage, n from direct1 union all select id, {_variant("form")}, 'dialect', 1, n from direct1, swap where {_variant("form")} is not null),
accepted as (select id, form, first(reason order by stage, n) as reason, min((stage, n)) as seat from everything group by id, form),
added as (select a.id, a.form, a.reason from accepted a left join base_form b on a.id = b.id and a.form = b.form where b.form is null),
key as (select l.id as target_id, l.pos, coalesce((select list(form order by seat) from accepted a where a.id = l.id), []) as answers, case when l.id in (select id from review) then 'curated' else 'rule' end as source from lex l)
"""


def _guesses(source: str, key: str) -> str:
    """CTEs that end in ``guess_list``: key and guesses of a table with key and text."""
    return rf"""
txt as (select {key}, regexp_replace(text, '^{_W}+|{_W}+$', '', 'g') as t from {source}),
chr as (select {key}, t, i.i as i, t[i.i] as c from txt, lateral (select unnest(range(1, length(t) + 1)) as i) i where contains(t, '[')),
summed as (select *, sum(case c when '[' then 1 when ']' then -1 else 0 end) over (partition by {key} order by i) as s from chr),
deep as (select *, s - least(0, min(s) over (partition by {key} order by i)) as d from summed),
opened as (select *, coalesce(lag(d) over (partition by {key} order by i), 0) as before from deep),
numbered as (select *, sum((c = '[' and before = 0)::integer) over (partition by {key} order by i) as k from opened),
span as (select {key}, k, string_agg(c, '' order by i) as span from numbered where d > 0 or before > 0 group by {key}, k having max(case when d = 0 then 1 else 0 end) = 1),
whole as (select {key}, t, case when json_valid(t) then case json_type(t) when 'ARRAY' then t when 'OBJECT' then case when json_type(t, '$.candidates') = 'ARRAY' then json_extract(t, '$.candidates')::varchar end end end as j from txt),
way as (select {key}, j, 1000000 as k from whole where j is not null union all select {key}, span, k from span where {key} not in (select {key} from whole where j is not null) and json_valid(span)),
flatter as (select {key}, k, (e.o)::integer as a, json_type(x) as kind, x from way, lateral (select unnest(range(0, json_array_length(j)::bigint)) as o) e, lateral (select json_extract(j, '$[' || e.o || ']') as x) y),
deeper as (select {key}, k, a, 0 as b, x from flatter where kind = 'VARCHAR' union all select {key}, k, a, o, y from (select {key}, k, a, e.o as o, json_extract(x, '$[' || e.o || ']') as y from flatter, lateral (select unnest(range(0, json_array_length(x)::bigint)) as o) e where kind = 'ARRAY') where json_type(y) = 'VARCHAR'),
texts as (select {key}, k, a, b, regexp_replace(json_extract_string(x, '$'), '^{_W}+|{_W}+$', '', 'g') as g from deeper),
lists as (select {key}, k, list(g order by a, b) as guesses from texts where g <> '' group by {key}, k),
guess_list as (select {key}, arg_max(guesses, k) as guesses from lists group by {key})
"""


_EVENTS = f"""{_ANSWERS}, {_parsed("parsed", "lex", "code")},
sized as (select (select count(*) from orders) as n_orders, (select count(*) from part) as n_part),
ev as (select e.*, 100000 + (event_id * 7919) % n_orders as no, n_part from events e, sized),
ev2 as (select ev.*, p.p_name as b, coalesce(l.gloss, p.p_name) as a, 'B' || cast(no as varchar) as tid from ev join part p on p.p_partkey = event_id % n_part left join lex l on l.numeric_id = no),
sub1 as (select event_id as ord, case when event_type = 'error' then null else tid end as targetId, 'u' || cast(user_id % 5 as varchar) as runner, 'v' || cast(event_id % 3 as varchar) as "promptVersion",
  case event_id % 5 when 0 then concat('["', a, '","', b, '"]') when 1 then concat('Guess: ["', a, '"] Note: [x: y]') when 2 then concat('{{"candidates":["', b, '"]}}') when 3 then '[]' else concat('["', b, '",1,["', a, '"]]') end as candidates from ev2),
sub as (select * from sub1 union all select ord + 1000000000, targetId, runner, "promptVersion", '["unknown"]' from sub1 where ord % 10 = 0),
universe as (select id as target_id from parsed where canonical is not null and not is_non_preferred),
last as (select targetId, arg_max(candidates, ord) as text, arg_max(runner, ord) as runner, arg_max("promptVersion", ord) as "promptVersion" from sub where targetId is not null and targetId <> '' group by targetId)
"""
_SCORED = f"""{_EVENTS}, {_guesses("last", "targetId")},
pair as (select l.targetId as target_id, pos, coalesce(guesses, []) as guesses, answers, runner, "promptVersion" from last l left join guess_list g using (targetId) join key on key.target_id = l.targetId),
pair2 as (select *, list_filter(list_transform(answers, lambda x: {_normal("x", "pos")}), lambda x: x <> '') as good, list_transform(guesses[1:5], lambda x: {_normal("x", "pos")}) as g5 from pair),
pair3 as (select *, list_position(list_transform(g5, lambda x: list_contains(good, x)), true) as place from pair2),
score as (select target_id, pos, case when place > 0 then place::integer end as rank, coalesce(place, 0) = 1 as top1, coalesce(place, 0) > 0 as top5, case when place > 0 then 1.0::double / place else 0.0::double end as reciprocal_rank, len(guesses)::integer as n_candidates, array_to_string(g5, '|') as normalized, array_to_string(list_filter(good, lambda x, i: list_position(good, x) = i), '|') as accepted, runner, "promptVersion" from pair3)
"""
_MEANS = "count(*) as total, round(coalesce(avg(top1::integer::double), 0), 6) as top1, round(coalesce(avg(top5::integer::double), 0), 6) as top5, round(coalesce(avg(reciprocal_rank), 0), 6) as mrr"
_ITEMS = f"{_ENTRY}, items as (select id as target_id, numeric_id, pos, case when len(base) >= 5 then '5+' else cast(len(base) as varchar) end as length from word where not is_non_preferred)"


def _fnv(x: str) -> str:
    return f"list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({x}, ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


_FNV = _fnv("'order-1|tie|' || target_id")
_ORDER = f"""{_ITEMS},
strat as (select *, pos || '|' || length as stratum from items),
inside as (select *, (row_number() over (partition by stratum order by md5('order-1|' || target_id), target_id) - 0.5::double) / count(*) over (partition by stratum) as frac, {_FNV} as tie from strat),
ordered as (select *, row_number() over (order by frac, tie, target_id) as place from inside)
"""
# a stratum's shuffle as a list of places, one swap for each step from its end; the generator's state only grows by a constant, so its numbers are known beforehand
_SHUFFLE = f"""{_ITEMS},
strat as (select *, pos || '|' || length as stratum, (row_number() over (partition by pos || '|' || length order by numeric_id))::integer as at from items),
stratum_size as (select stratum, count(*)::integer as n, {_fnv("'order-1|' || stratum")} as seed from strat group by stratum),
drawn0 as (select stratum, n, i.i::integer as i, (seed + (n - i.i) * 1831565813::bigint) % 4294967296 as a from stratum_size, lateral (select unnest(range(1, n)) as i) i),
drawn1 as (select *, ((xor(a, a >> 15))::hugeint * (a | 1)::hugeint % 4294967296)::bigint as t from drawn0),
drawn2 as (select *, xor((t + ((xor(t, t >> 7))::hugeint * (t | 61)::hugeint % 4294967296)::bigint) % 4294967296, t) as u from drawn1),
drawn as (select stratum, i, floor(xor(u, u >> 14) / 4294967296.0::double * (i + 1))::integer as j from drawn2),
shuffling(stratum, i, places) as (
  select stratum, n - 1, range(1, n + 1)::integer[] from stratum_size union all
  select s.stratum, s.i - 1, list_transform(s.places, lambda x, k: case when k = s.i + 1 then s.places[d.j + 1] when k = d.j + 1 then s.places[s.i + 1] else x end) from shuffling s join drawn d on d.stratum = s.stratum and d.i = s.i),
seat as (select stratum, places, i.i as seat from shuffling s, lateral (select unnest(range(1, len(places) + 1)) as i) i where s.i = 0),
inside as (select t.*, (seat - 0.5::double) / n as frac, {_FNV} as tie from seat join stratum_size using (stratum) join strat t on t.stratum = seat.stratum and t.at = places[seat]),
ordered as (select *, row_number() over (order by frac, tie, target_id) as place from inside),
subset as (select size, target_id, pos, place from ordered, (select unnest([50, 100, 300, 1000])::integer as size) s where place <= size)
"""
_MARK_NAME = "case m when 'B81' then 'doing' when 'B86' then 'being' when 'B97' then 'thing' else '' end"
_EXPLAINED = _collapse("replace(coalesce(explanation, ''), '_', ' ')")
_VIEWS = f"""{_ANSWERS.split(_LEX, 1)[1].lstrip(", ")},
vw as (select s.id, concat_ws('~', s.id, shown, shown_base, gloss, s.pos, case when atomic or canonical is null then '' else array_to_string(list_transform(list_concat(flatten(marks), word_marks), lambda m: {_MARK_NAME}), ',') end, array_to_string(answers, '/'), {_EXPLAINED}) as txt from shown s join key on key.target_id = s.id)
"""
_CONTEXT_PARTS = f"""{_VIEWS}, {_SUB}, {_SIB}, {_NEAR}, {_LEGEND}, {_SCAN},
about(spelling, info) as (values ('B9', 'B9~many~many~number'), ('B10', 'B10~two~two~number'), ('B11', 'B11~three~three~number'), ('B10/B117', 'B10,B117~double~twice~number'), ('B449', 'B449~without~not,without~negation'),
  ('B449/B401', 'B449,B401~never~never~negation'), ('B368', 'B368~much~very~intensity'), ('B368/B368', 'B368,B368~most~most~intensity')),
mods as (select id as target_id, string_agg(spelling || '~' || info || '~' || spot || '~' || stop, '|' order by spot) as modifiers from scan join about using (spelling) group by id),
subs as (select target_id, string_agg(array_to_string(own_chars[span_start + 1:span_stop], '/') || ':' || key || ':' || txt, '|' order by span_start, span_stop, helper_no) as subwords from sub join targets using (target_id) join vw on vw.id = helper_id group by target_id),
sibs as (select target_id, string_agg(txt, '|' order by helper_no) as siblings from sib join vw on vw.id = helper_id group by target_id),
near_text as (select *, array_to_string(case side when 'start' then c[1:shared_len] else c[len(c) - shared_len + 1:] end, '/') || ':' || txt as line from near join vw on vw.id = helper_id where rank <= 8),
nears as (select target_id, greatest(count(*) filter (side = 'start') - 8, 0) as omitted_start, greatest(count(*) filter (side = 'end') - 8, 0) as omitted_end from near group by target_id),
near_lines as (select target_id, string_agg(line, '|' order by rank) filter (side = 'start') as shared_start, string_agg(line, '|' order by rank) filter (side = 'end') as shared_end from near_text group by target_id),
legs as (select target_id, string_agg(spelling || ':' || helper_id || '=' || helper_gloss, '|' order by length desc, list_transform(string_split(base_spelling, '/'), lambda x: substr(x, 2)::bigint), helper_no) as legend from legend group by target_id)
"""
_CONTEXT = """select t.target_id, t.canonical as spelling, t.base_key as base_spelling, len(t.base)::integer as char_count, coalesce(modifiers, '') as modifiers,
  array_to_string(list_transform(list_concat(flatten(t.marks), t.word_marks), lambda m: m || '=' || case m when 'B81' then 'doing' when 'B86' then 'being' when 'B97' then 'thing' else '' end), '|') as indicators,
  coalesce(subwords, '') as subwords, coalesce(siblings, '') as siblings, coalesce(shared_start, '') as shared_start, coalesce(shared_end, '') as shared_end, coalesce(omitted_start, 0) as omitted_start, coalesce(omitted_end, 0) as omitted_end, coalesce(legend, '') as legend,
  {exact} as exact_match
from {from_} t left join mods using (target_id) left join subs using (target_id) left join sibs using (target_id) left join nears using (target_id) left join near_lines using (target_id) left join legs using (target_id)"""

_LAST_SUB = "select targetId, max(ord) as ord, min(ord) as first_ord, count(*) - 1 as repeats from submission where targetId is not null and targetId <> '' group by targetId"
_BASELINE = f"""{_ENTRY}, {_SUB}, {_SIB}, {_ANSWERS.split(_LEX, 1)[1].lstrip(", ")},
helper as (select target_id, helper_id, 0 as g, 0 as n, 0 as s, helper_no from sib union all select target_id, helper_id, 1, span_start - span_stop, span_start, helper_no from sub),
said as (select h.target_id, lower(trim(k.answers[i.i])) as folded, k.answers[i.i] as answer, row_number() over (partition by h.target_id order by g, n, s, helper_no, i.i) as r from helper h join key k on k.target_id = h.helper_id, lateral (select unnest(range(1, len(k.answers) + 1)) as i) i where trim(k.answers[i.i]) <> ''),
once_said as (select target_id, folded, first(answer order by r) as answer, min(r) as r from said group by target_id, folded),
guess5 as (select target_id, answer, row_number() over (partition by target_id order by r) as q from once_said),
base_guess as (select t.target_id, coalesce(list(answer order by q) filter (q <= 5), ['unknown']) as guesses from targets t left join guess5 using (target_id) group by t.target_id)
"""


def _with(ctes: str, rest: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes.strip()} {rest}"


SQL: dict[str, str] = {
    "parse_spelling": _with(_SET, "select distinct spelling, canonical, base_key, len(base)::integer as n_chars, array_to_string(list_transform(marks, lambda m: array_to_string(m, ',')), '|') as char_marks, array_to_string(word_marks, ',') as word_marks from given where canonical is not null"),
    "normalize_spelling": _with(_ENTRY, "select id, canonical as spelling from word"),
    "filter_valid_words": _with(_SET, "select row_no, canonical is not null as is_word from given"),
    "contiguous_spans": _with(
        _SET,
        "select row_no, s.s::integer as span_start, e.e::integer as span_stop, array_to_string(chars[s.s + 1:e.e], '/') as spelling from given, lateral (select unnest(range(0, len(base))) as s) s, lateral (select unnest(range(s.s + 1, len(base) + 1)) as e) e where canonical is not null and not (s.s = 0 and e.e = len(base))",
    ),
    "common_prefix_len": _with(_ENTRY, ", p as (select id, base, lead(base) over (partition by base[1] order by numeric_id) as other from word) select id, len(list_filter(range(1, least(len(base), len(other)) + 1), lambda i: base[1:i] = other[1:i]))::integer as n from p where other is not null"),
    "common_suffix_len": _with(
        _ENTRY, ", p as (select id, base, lead(base) over (partition by base[1] order by numeric_id) as other from word) select id, len(list_filter(range(1, least(len(base), len(other)) + 1), lambda i: base[len(base) - i + 1:] = other[len(other) - i + 1:]))::integer as n from p where other is not null"
    ),
    "resolve_id": rf"with t as (select distinct targetId as asked, regexp_replace(targetId, '^{_W}+|{_W}+$', '', 'g') as t from submission where targetId is not null) select asked, case when regexp_full_match(t, '[Bb]?[0-9]+') then 'B' || regexp_extract(t, '^[Bb]?0*([0-9]+)$', 1) else t end as id from t",
    "normalize_entries": _with(_LEX, "select id, numeric_id, code, case when numeric_id % 13 <> 0 then gloss else '' end as gloss, case when pos <> 'noun' then pos else '' end as pos, coalesce(explanation, '') as explanation, is_char, is_word, is_indicator, is_non_preferred, false as is_dual_form, numeric_id as ordinal from lex"),
    "display_spelling": _with(_ENTRY, "select id, atomic, shown as spelling, shown_base as base_spelling from shown"),
    "get_entry": _with(_ENTRY, "select 'b' || lpad(cast(numeric_id as varchar), 8, '0') as asked, id, shown as spelling, gloss, pos from shown where not is_indicator"),
    "find_by_spelling": _with(_ASKED, "select asked, id from asked join spelling_keys on key = canonical"),
    "find_by_base_spelling": _with(_ASKED, "select asked, helper_id as id from asked join keys on key = base_key"),
    "derivation_of": _with(_ENTRY, "select w.id, i.i::integer as part_no, w.base[i.i + 1] as part_id, l.code as part_code, l.gloss as part_gloss from word w, lateral (select unnest(range(0, len(w.base))) as i) i left join lex l on l.id = w.base[i.i + 1]"),
    "sealed_targets": _with(_ENTRY, 'select id as "targetId", canonical as spelling, len(base)::integer as "charCount" from word'),
    "indicators_of": _with(
        _ENTRY,
        ", m as (select id, list_concat(flatten(list_transform(range(1, len(marks) + 1), lambda i: list_transform(marks[i], lambda x: struct_pack(s := x, p := i - 1)))), list_transform(word_marks, lambda x: struct_pack(s := x, p := null::bigint))) as m from word), one as (select id, i.i - 1 as mark_no, m[i.i].s as s, m[i.i].p as p from m, lateral (select unnest(range(1, len(m) + 1)) as i) i) select id, mark_no::integer as mark_no, s as spelling, case when p is null then 'whole word' else 'character' end as scope, p::integer as char_index, case s when 'B81' then 'doing' when 'B86' then 'being' when 'B97' then 'thing' else '' end as name, case s when 'B81' then 'verbal' when 'B86' then 'adjectival' when 'B97' then 'nominal' else '' end as \"group\", case s when 'B81' then 'marks an action' when 'B86' then 'marks a quality' when 'B97' then 'marks something concrete' else '' end as purpose from one",
    ),
    "subwords": _with(f"{_ENTRY}, {_SUB}", "select target_id, span_start, span_stop, key, helper_id from sub"),
    "subword_counts": _with(f"{_ENTRY}, {_SUB}", "select target_id, count(distinct (span_start, span_stop)) as spans, count(*) as helpers from sub group by target_id"),
    "siblings": _with(f"{_ENTRY}, {_SIB}", "select target_id, helper_id from sib"),
    "shared_start": _with(f"{_ENTRY}, {_NEAR}", "select target_id, helper_id, shared_len::integer as shared_len, total::integer as total from near where side = 'start'"),
    "shared_end": _with(f"{_ENTRY}, {_NEAR}", "select target_id, helper_id, shared_len::integer as shared_len, total::integer as total from near where side = 'end'"),
    "neighbours": _with(f"{_ENTRY}, {_NEAR}", "select target_id, side, count(*) as n, sum(shared_len)::bigint as shared, sum(helper_no)::bigint as checksum from near group by target_id, side"),
    "neighbours_capped": _with(f"{_ENTRY}, {_NEAR}", "select target_id, side, rank::integer as rank, helper_id, shared_len::integer as shared_len from near where rank <= 8"),
    "neighbours_omitted": _with(f"{_ENTRY}, {_NEAR}", "select target_id, side, greatest(count(*) - 8, 0) as omitted from near group by target_id, side"),
    "legend": _with(f"{_ENTRY}, {_NEAR}, {_LEGEND}", "select target_id, spelling, base_spelling, length, helper_id from legend"),
    "modifier_matches": _with(f"{_ENTRY}, {_SCAN}", "select id, spot::integer as span_start, stop::integer as span_stop, spelling from scan", True),
    "modifier_exceptions": _with(
        f"{_ENTRY}, {_SCAN}".replace(
            "select id as target_id, base, base_key, chars as own_chars from word",
            "select id as target_id, base, base_key, chars as own_chars from word where list_contains(base, 'B10') union all select id || '+', list_concat(base, ['B10', 'B4']), base_key || '/B10/B4', chars from word where list_contains(base, 'B10')",
        ),
        "select target_id as id, len(list_filter(base, lambda c: c = 'B10'))::integer as times, (select count(*) from scan s where s.id = target_id and s.spelling = 'B10')::integer as counted from targets",
        True,
    ),
    "leading_modifier_run": _with(f"{_ENTRY}, {_SCAN}", "select id, string_agg(spelling, ',' order by spot) as run, max(stop)::integer as rest, max(stop) = any_value(size) as consumed_all from scan where run group by id", True),
    "full_modifier": _with(f"{_ENTRY}, {_SCAN}", 'select target_id as id, spelling as "full" from targets join ref on spelling = base_key', True),
    "modifier_glosses": _with(
        f"{_ENTRY}, ref(spelling) as (values ('B9'), ('B10'), ('B11'), ('B10/B117'), ('B449'), ('B449/B401'), ('B368'), ('B368/B368'))",
        "select r.spelling, coalesce((select first(s.gloss order by case when s.id = r.spelling then 0 when s.canonical = r.spelling then 1 else 2 end, s.numeric_id) from shown s where s.id = r.spelling or s.canonical = r.spelling or s.base_key = r.spelling), '') as gloss from ref r",
    ),
    "clean_text": _with(_GLOSS, f"select id, {_collapse(_SPACED)} as text from glosses"),
    "split_gloss": _with(f"{_GLOSS}, {_parts('glosses')}", "select id, string_agg(part, '|' order by k) as parts, count(*)::integer as n from part_of group by id"),
    "base_answers": _with(_BASE, "select g.id, coalesce(string_agg(form, '|' order by k), '') as forms from glosses g left join base_form b using (id) group by g.id"),
    "inner_tags": _with(_GLOSS, f"select id, array_to_string({_tags('gloss')}, '|') as tags from glosses"),
    "bare_head": _with(_GLOSS, f"select id, {_head('gloss')} as head from glosses"),
    "stray_separator": _with(_GLOSS, f"select id, {_stray('gloss')} as stray from glosses"),
    "inflection": _with(_BASE, f", t as (select id, form, unnest({_tags('form')}) as tag from base_form) select distinct id, form, tag, case when {_head('form')} = '' then null when tag = 'es' then {_head('form')} || 'es' when tag in ('s', 'pl', 'plural') then {_head('form')} || 's' end as plural from t"),
    "needs_curation": _with(_BASE, f", n as (select id, bool_or({_stray('form')} or len(list_filter({_tags('form')}, lambda t: not regexp_full_match(t, '[0-9]+|s|es'))) > 0) as needed from base_form group by id) select id, coalesce(needed, false) as needed from glosses left join n using (id)"),
    "dialect_variants": _with(f"{_GLOSS}, swap as {_SWAP}, tidy as (select id, {_collapse('gloss')} as g from glosses), v as (select id, {_variant('g')} as variant from tidy, swap)", "select id, variant from v where variant is not null"),
    "answer_key": _with(_ANSWERS, "select target_id, pos, array_to_string(answers, '|') as answers, source from key"),
    "answer_aliases": _with(_ANSWERS, "select id as target_id, form, reason from added"),
    "alias_log": _with(
        _ANSWERS,
        "select k.target_id, k.source, coalesce((select string_agg(form, '|' order by b.k) from base_form b where b.id = k.target_id), '') as base, array_to_string(k.answers, '|') as answers, (select count(*) from added a where a.id = k.target_id)::integer as n_added, r.note from key k left join review r on r.id = k.target_id where k.source = 'curated' or exists (select 1 from added a where a.id = k.target_id)",
    ),
    "alias_stats": _with(
        _ANSWERS,
        f"select (select count(distinct id) from added) as changed, (select count(*) from added) as forms, (select count(*) from key where source = 'curated') as reviewed, (select count(distinct id) from base_form where id not in (select id from review) and ({_stray('form')} or len(list_filter({_tags('form')}, lambda t: not regexp_full_match(t, '[0-9]+|s|es'))) > 0)) as uncurated",
    ),
    "parse_candidates": _with(_guesses("(select ord, candidates as text from submission)", "ord"), "select ord, coalesce(array_to_string(guesses, '|'), '') as guesses from submission left join guess_list using (ord)"),
    "candidates_of": _with(_guesses('(select ord, coalesce(candidates, "rawResponseText") as text from submission)', "ord"), "select ord, coalesce(array_to_string(guesses, '|'), '') as guesses from submission left join guess_list using (ord)"),
    "array_spans": _with(
        _guesses('(select ord, "rawResponseText" as text from submission)', "ord").replace(f"regexp_replace(text, '^{_W}+|{_W}+$', '', 'g') as t", "text as t", 1),
        "select ord, (row_number() over (partition by ord order by k) - 1)::integer as span_no, span from span",
    ),
    "normalize_answers": _with(_GLOSS, f"select id, {_normal('gloss', 'pos')} as normal from glosses"),
    "dedup_last_wins": _LAST_SUB,
    "score_rows": _with(_SCORED, "select target_id, pos, rank, top1, top5, round(reciprocal_rank, 6) as reciprocal_rank, n_candidates, normalized, accepted, runner, \"promptVersion\" from score"),
    "score_summary": _with(_SCORED, f"select {_MEANS} from score"),
    "score_by_pos": _with(_SCORED, f"select pos, {_MEANS} from score group by pos"),
    "coverage_missing": _with(_EVENTS, "select target_id from universe where target_id not in (select targetId from sub where targetId is not null)"),
    "coverage_extra": _with(_EVENTS, "select distinct targetId as target_id from sub where targetId is not null and targetId not in (select target_id from universe)"),
    "coverage": _with(
        _SCORED,
        "select (select count(*) from universe) as universe_targets, (select count(*) from score where target_id in (select target_id from universe)) as scored, (select count(*) from score where n_candidates = 0 and target_id in (select target_id from universe)) as empty_candidates, (select count(*) from score where n_candidates > 5 and target_id in (select target_id from universe)) as overlong_candidates, (select count(*) from universe where target_id not in (select targetId from last)) as missing, (select count(*) from last where targetId not in (select target_id from universe)) as extra, (select count(*) from sub where targetId is null) as malformed, (select count(targetId) - count(distinct targetId) from sub) as duplicates",
    ),
    "official_gate": _with(_EVENTS, ", g as (select (select count(*) from universe where target_id not in (select targetId from last)) as missing, (select count(targetId) - count(distinct targetId) from sub) as duplicates, (select count(*) from sub where targetId is null) as malformed) select *, missing = 0 and duplicates = 0 and malformed = 0 as official from g"),
    "distinct_runners": "select runner, row_number() over (order by min(ord), runner)::integer as place from submission where runner is not null group by runner",
    "tie_hash": _with(_ITEMS, f"select target_id, {_FNV} as tie from items"),
    "char_bucket": 'select row_no, case when "charCount" >= 5 then \'5+\' else cast("charCount" as varchar) end as bucket from set_300',
    "stratified_order": _with(_ORDER, "select target_id, stratum, round(frac, 9) as frac, place from ordered"),
    "shuffled_order": _with(_SHUFFLE, "select target_id, stratum, round(frac, 9) as frac, tie from inside", True),
    "nested_subsets": _with(_SHUFFLE, "select size, target_id, place from subset", True),
    "set_balance": _with(
        _SHUFFLE,
        ", full_share as (select pos, count(*) / (select count(*) from items)::double as p from items group by pos), sizes as (select size, count(*) as n from subset group by size), grid as (select s.size, s.n, f.pos, f.p from sizes s cross join full_share f), got as (select size, pos, count(*) as k from subset group by size, pos) select size, round(max(abs(coalesce(k, 0) / n::double - p)), 6) as worst from grid left join got using (size, pos) group by size",
        True,
    ),
    "set_ci": _with(_SHUFFLE, "select size, count(*) as n, round(98.0::double / sqrt(count(*)), 1) as half_width from subset group by size", True),
    "build_context": _with(f"{_ENTRY}, {_CONTEXT_PARTS}", _CONTEXT.format(from_="(select id as target_id, * from word)", exact="''"), True),
    "context_from_spelling": _with(
        f"{_ENTRY.replace('targets as (select id as target_id, base, base_key, chars as own_chars from word)', '')} {_SET}, asked as (select distinct '?' || canonical as target_id, canonical, base, base_key, marks, word_marks, chars as own_chars from given where canonical is not null), targets as (select target_id, base, base_key, own_chars from asked), {_CONTEXT_PARTS}, exact as (select target_id, string_agg(txt, '|' order by substr(k.id, 2)::bigint) as exact_match from asked join spelling_keys k on k.key = canonical join vw on vw.id = k.id group by target_id)",
        _CONTEXT.format(from_="asked", exact="coalesce(exact_match, '')") + " left join exact using (target_id)",
        True,
    ),
    "exact_matches": _with(
        f"{_ENTRY}, {_SET}",
        ", both_ways as (select canonical from given where canonical is not null union select canonical from word where not contains(code, ';;')) select '?' || g.canonical as target_id, s.id, s.shown as spelling from both_ways g join spelling_keys k on k.key = g.canonical join shown s on s.id = k.id",
    ),
    "helper_views": _with(
        f"{_ENTRY}, {_VIEWS}",
        f"select s.id, shown as spelling, shown_base as base_spelling, gloss, s.pos, case when atomic or canonical is null then '' else array_to_string(list_concat(list_transform(flatten(marks), lambda m: m || '~' || {_MARK_NAME} || '~character'), list_transform(word_marks, lambda m: m || '~' || {_MARK_NAME} || '~whole word')), '|') end as indicators, array_to_string(answers, '|') as answers, {_EXPLAINED} as explanation from shown s join key on key.target_id = s.id",
    ),
    "answer_keys": _with(f"{_ENTRY}, {_VIEWS}", f"select w.id, canonical as spelling, w.pos, array_to_string(answers, '|') as answers, {_EXPLAINED} as explanation from word w join key on key.target_id = w.id"),
    "rule_verdicts": _with(
        _ENTRY,
        ", v as (select id, canonical is not null as a, coalesce(len(base) <= 3, false) as b, not is_non_preferred as c from shown), w as (select id, [a, b, c] as ok, ['is_a_word', 'short', 'preferred'] as n from v), x as (select id, list_filter(n, lambda y, i: ok[i]) as passed, list_filter(n, lambda y, i: not ok[i]) as failed from w) select id, array_to_string(passed, ',') as passed, array_to_string(failed, ',') as failed, failed[1] as \"primary\" from x",
    ),
    "rule_exclusions": _with(
        _ENTRY,
        ", f as (select case when canonical is null then 1 when len(base) > 3 then 2 when is_non_preferred then 3 end as first, canonical is null as a, canonical is null or len(base) > 3 as b, is_non_preferred as c from shown), r as (select 'is_a_word' as rule, 1 as k union all select 'short', 2 union all select 'preferred', 3) select rule, count(*) filter (first = k) as first_failures, count(*) as failures from f join r on case k when 1 then a when 2 then b else c end group by rule",
    ),
    "baseline_candidates": _with(_BASELINE, "select target_id, array_to_string(guesses, '|') as guesses from base_guess"),
    "baseline_scores": _with(
        _BASELINE,
        f", b1 as (select g.target_id, k.pos, list_filter(list_transform(k.answers, lambda x: {_normal('x', 'k.pos')}), lambda x: x <> '') as good, list_transform(g.guesses, lambda x: {_normal('x', 'k.pos')}) as g5 from base_guess g join key k using (target_id)), b2 as (select pos, list_position(list_transform(g5, lambda x: list_contains(good, x)), true) as place from b1), score as (select pos, coalesce(place, 0) = 1 as top1, coalesce(place, 0) > 0 as top5, case when place > 0 then 1.0::double / place else 0.0::double end as reciprocal_rank from b2) select pos, {_MEANS} from score group by pos",
    ),
}
