"""DuckDB SQL of the queries of this subpackage that SQL can express on whole tables."""

_BUCKET = "cast(('0x' || substr(md5('20240|' || k), 1, 4)) as integer)"
_BASKETS = """
records as (select distinct targetId, spelling from set_300 where targetId is not null and spelling is not null),
baskets as (select row_number() over () as r, list_sort(list_distinct(list_filter(list_transform(string_split(spelling, '/'),
    lambda g: try_cast(nullif(regexp_extract(g, '^B([0-9]+)(;|$)', 1), '') as integer)), lambda x: x is not null))) as items from records),
item as (select r, unnest(items) as i from baskets where len(items) > 0),
total as (select count(distinct r) as n from item),
each as (select i, count(*) as k from item group by i),
met as (select x.i as glyph_a, y.i as glyph_b, count(*) as c from item x join item y on x.r = y.r and x.i < y.i group by 1, 2),
pairs as (select glyph_a, glyph_b, c, ea.k as a, eb.k as b, n from met join each ea on ea.i = glyph_a join each eb on eb.i = glyph_b cross join total)
"""

_SHARED = """
glyph as (select row_no, targetId, unnest(string_split(spelling, '/')) as g, generate_subscripts(string_split(spelling, '/'), 1) as p
    from set_300 where targetId is not null and spelling is not null),
span as (select row_no, targetId, p, array_to_string(list(g) over (partition by row_no order by p rows between current row and 4 following), '/') as s,
    count(*) over (partition by row_no order by p rows between current row and 4 following) as k from glyph),
several as (select s from span where k = 5 group by s having min(targetId) <> max(targetId)),
shared_glyph as (select distinct row_no, p + d.d as p from span join several using (s), (select unnest([0, 1, 2, 3, 4]) as d) d where k = 5),
numbered as (select row_no, p, row_number() over (partition by row_no order by p) as k from shared_glyph)
"""

_QUOTA = """
supplied as (select distinct targetId as k, charCount::bigint as c from set_300 where targetId is not null and charCount is not null),
size_n as (select count(distinct k) // 4 as n from supplied),
line as (select q.char_count::bigint as c, share_pm::bigint as share, n, coalesce(s.supply, 0) as supply, greatest(min_rows::bigint, (share_pm::bigint * n + 999) // 1000) as wanted
    from sample_quota q cross join size_n left join (select c, count(*) as supply from supplied group by c) s on s.c = q.char_count),
sized as (select c, count(*) as size from supplied group by c),
weighted as (select k, own.c, wanted, least(4294967296::hugeint, share::hugeint * n * 4294967296::hugeint // (1000::hugeint * size))::bigint as w, md5('20240|' || k) as u from supplied own join line using (c) join sized using (c)),
summed as (select *, (sum(w) over (order by c, u, k))::bigint - cast(('0x' || substr(md5('start|20240'), 1, 8)) as bigint) as upto from weighted),
hit as (select *, floor(upto / 4294967296.0::double) > floor((upto - w) / 4294967296.0::double) as drawn from summed),
short as (select c, max(wanted) - count(*) filter (drawn) as short from hit group by c),
undrawn as (select *, row_number() over (partition by c order by u, k) as nth from hit where not drawn),
picked as (select k as targetId, c as charCount, 'systematic' as how from hit where drawn union all select k, undrawn.c, 'floor' from undrawn join short using (c) where nth <= short)
"""
_GRAMS = "array_to_string(ws[i.i:i.i + 11], ' ')"


# Fixed values, written apart from the operator's: letters and the Latin ones that they look like, and code points that aren't seen or are spaces.
_LETTERS = """
А A, В B, Е E, Ѕ S, І I, Ј J, К K, М M, Н H, О O, Р P, С C, Т T, У Y, Х X, Ѵ V, Ү Y, Ӏ I, а a, е e, ѕ s, і i, ј j, о o, р p, с c, у y, х x, һ h, ԁ d, ԛ q, ԝ w, ѵ v, ү y, ӏ l,
Α A, Β B, Ε E, Ζ Z, Η H, Ι I, Κ K, Μ M, Ν N, Ο O, Ρ P, Τ T, Υ Y, Χ X, Ϲ C, Ϳ J, ο o, α a, ν v, ι i, ρ p, υ u, γ y, ϲ c, ϳ j,
Ս U, Տ S, Օ O, Լ L, ս u, օ o, հ h, ո n, ց g, զ q, յ j, Ꭰ D, Ꭱ R, Ꭲ T, Ꭺ A, Ꭻ J, Ꭼ E, Ꮃ W, Ꮇ M, Ꮋ H, Ꮐ G, Ꮓ Z, Ꮥ S, Ꮩ V, Ꮮ L, Ꮯ C, Ꮲ P, Ꮶ K, Ᏼ B, Ꭹ Y, ɑ a, ɡ g
"""
_UNSEEN = "ad 34f 61c 180e 200b-200f 202a-202e 2060-2064 2066-206f fe00-fe0f feff"
_BLANK = "a0 1680 2000-200a 202f 205f 3000"


def _look() -> str:
    """The text with every letter in its Latin twin, where it has one: equal if two texts look the same."""
    import unicodedata as u

    points = lambda text: [c for part in text.split() for a, _, b in [part.partition("-")] for c in range(int(a, 16), int(b or a, 16) + 1)]
    quote = lambda chars: "'" + "".join(chars).replace("'", "''") + "'"
    twin = dict(pair.split() for pair in _LETTERS.replace("\n", " ").split(","))
    accented = {chr(c): u.normalize("NFC", twin[d[0]] + d[1:]) for c in range(0x370, 0x2000) if len(d := u.normalize("NFD", chr(c))) > 1 and d[0] in twin and ord(d[0]) > 0x36F}
    twin |= {c: x for c, x in accented.items() if len(x) == 1}
    width = {chr(c): u.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF) if u.decomposition(chr(c))[:5] in ("<wide", "<narr")}
    one = {chr(c): " " for c in points(_BLANK)} | width
    folded = f"nfc_normalize(translate(text, {quote([*one, *map(chr, points(_UNSEEN))])}, {quote(one.values())}))"
    return f"nfc_normalize(translate({folded}, {quote(twin)}, {quote(twin.values())}))"


SQL: dict[str, str] = {
    "p1_sample": f"""
with keys as (select distinct targetId as k from set_300 where targetId is not null),
b as (select k, {_BUCKET} as bucket from keys),
r1 as (select k, bucket, (bucket::bigint * 40503 + 20240) % 65536 as r from b),
r2 as (select k, bucket, xor(r, r >> 7) as r from r1),
r3 as (select k, bucket, (cast(r as bigint) * 30011 + 977) % 65536 as r from r2),
r4 as (select k, bucket, cast(xor(r, r >> 9) as integer) as bucket_rank from r3)
select k as targetId, bucket, bucket_rank from r4 where bucket_rank < 6554""",
    "p3_found": f"with {_SHARED} select row_no, min(p)::integer as first_glyph, max(p)::integer as last_glyph from numbered group by row_no, p - k",
    "p3_shares": f"""with {_SHARED}, held as (select row_no, count(*) as h from shared_glyph group by row_no)
select row_no, len(string_split(spelling, '/'))::integer as glyphs, coalesce(h, 0) as shared_glyphs
from set_300 left join held using (row_no) where targetId is not null and spelling is not null""",
    "p6_found": """with t as (select distinct targetId, charCount from set_300 where targetId is not null and charCount is not null),
n as (select count(distinct targetId) // 4 as n from t)
select char_count from sample_quota cross join n left join (select charCount, count(*) as k from t group by 1) on charCount = char_count
where coalesce(k, 0) < greatest(min_rows, (share_pm::bigint * n + 999) // 1000)""",
    "p6_sample": f"with {_QUOTA} select * from picked",
    "p6_report": f"with {_QUOTA} select l.c as char_count, supply, wanted, coalesce(d.n, 0) as drawn, coalesce(d.n, 0) >= wanted as met from line l left join (select charCount, count(*) as n from picked group by 1) d on d.charCount = l.c",
    "p7_found": f"with {_BASKETS} select glyph_a, glyph_b from pairs where c >= 3 and 1000 * c >= n and c * n >= 3 * a * b",
    "p7_pairs": f"""with {_BASKETS} select glyph_a, glyph_b, c, a, b, n,
    round((c + 0.5::double) * (n - a - b + c + 0.5::double) / ((a - c + 0.5::double) * (b - c + 0.5::double)), 3) as odds_ratio,
    round(c::double * n::double / (a::double * b::double), 3) as lift from pairs""",
    "p8_roundtrip": "select doc_id, md5(coalesce(text, '')) as digest from documents",
    "p9_found": f"""with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as ws from documents where text is not null),
v as (select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as ws from eval_item where text is not null),
a as (select doc_id, {_GRAMS} as g from w, lateral (select unnest(range(1, len(ws) - 10)) as i) i), b as (select distinct item_id, {_GRAMS} as g from v, lateral (select unnest(range(1, len(ws) - 10)) as i) i)
select distinct doc_id, item_id from a join b using (g)""",
    "p10_found": f"with k as (select doc_id, text, md5({_look()}) as k from documents where text <> '') select a.doc_id as doc_a, b.doc_id as doc_b from k a join k b on a.k = b.k and a.text <> b.text and a.doc_id < b.doc_id",
}
