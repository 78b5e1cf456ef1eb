"""Each operator against brute force on small tables, and its odd cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import json
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lexiloom.llm")

from lexiloom.llm import canonical, copies, encoding, leaks, lookalikes, nested, passages, quotas, replies, together  # noqa: E402

LONG = "word " * 60_000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 1


def targets(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "targetId string, bucket int")


def test_nested_sample(spark):
    keys = [f"B{i}" for i in range(5000)]
    old = rows(nested.sample(targets(spark, keys[:3000]), "targetId", 0.1))
    new = rows(nested.sample(targets(spark, keys + keys[:50]).repartition(9), "targetId", 0.1))
    assert set(old) <= set(new) and [r for r in new if int(r[0][1:]) < 3000] == old
    assert abs(len(new) - 500) < 100 and {r[0] for r in new} <= {r[0] for r in nested.sample(targets(spark, keys), "targetId", 0.2).collect()}
    order = spark.range(nested.BUCKETS).select(nested.rank_of(F.col("id")).alias("r")).agg(F.min("r"), F.max("r"), F.count_distinct("r")).first()
    assert tuple(order) == (0, nested.BUCKETS - 1, nested.BUCKETS)
    k = nested.buckets_for(targets(spark, keys), "targetId", 400)
    assert nested.sample(targets(spark, keys), "targetId", k / nested.BUCKETS).count() >= 400 and nested.buckets_for(targets(spark, keys), "targetId", 4, k) == k


def test_nested_sample_odd(spark):
    odd = targets(spark, [None, "", "", LONG, LONG])
    assert nested.sample(odd, "targetId", 1.0).count() == 2 and nested.sample(odd, "targetId", 0.0).count() == 0
    assert nested.sample(odd.limit(0), "targetId", 0.5).count() == 0
    with pytest.raises(ValueError, match="share"):
        nested.sample(odd, "targetId", 1.5)


# 2

SENT = "ord bigint, targetId string, candidates string, canon string"


def sent(spark, values):
    return spark.createDataFrame([(o, t, c, "clash") for o, t, c in values], SENT)


def brute_copies(values):
    def bare(s):
        return "".join(c for c in s.casefold() if c.isalnum())

    def form(v):
        if isinstance(v, str):
            return ("s", bare(v))
        if isinstance(v, list):
            return ("l", *map(form, v))
        if isinstance(v, dict):
            return ("d", *sorted((bare(k), form(x)) for k, x in v.items()))
        return ("o", repr(v))

    def has(v):
        return bool(bare(v)) if isinstance(v, str) else any(map(has, v if isinstance(v, list) else v.values())) if isinstance(v, (list, dict)) else False

    groups = defaultdict(list)
    for o, t, c in values:
        if o is None or t is None or c is None or not bare(t):
            continue
        try:
            v = json.loads(c)
        except ValueError:
            v = c
        if has(v):
            groups[bare(t), form(v)].append(o)
    return sorted((min(g), o) for g in groups.values() for o in g if o != min(g))


def test_copies(spark):
    rnd = random.Random(1)
    texts = ['["a b", 1]', '[ "A-B" ,1]', '["ab", 2]', '{"x": "a", "y": [1, null]}', '{"y":[1,null], "X":"A."}', "ab", "A b!", '["a","b"]', '[["a"],"b"]', '["a","b",""]', '["???"]', "[]", '["a', '["ä"]', '["Ä "]', '{"x": "a"}', '["a", true]', '["a", null]']
    values = [(i, rnd.choice(["B7", "b7 ", "B8", "?", None, "B-7"]), rnd.choice([*texts, None])) for i in range(600)]
    want = brute_copies(values)
    df = sent(spark, values).repartition(6)
    assert rows(copies.copies(df)) == want and rows(copies.copies(df, fits=500)) == want and rows(copies.copies(df, fits=0)) == want
    groups = Counter(k for k, _ in want)
    got = rows(copies.records(df, fits=1000))
    assert [(k, n) for k, n in got if n > 1] == sorted((k, n + 1) for k, n in groups.items())
    heads = copies.heads(df, "ord", "targetId", "candidates")
    table = copies.split_prefixes(heads, 900)
    size, under = Counter(), {}
    for r in heads.where("canon is not null").collect():
        assert r.prefixes == copies.prefixes(bytes(r.canon))
        for p in r.prefixes[:-1]:
            size[p] += len(r.canon) + copies.NODE
        under[bytes(r.canon)] = copies.bucket_of(r.prefixes, table)
    assert np.unpackbits(table).sum() == len({p % copies.BITS for p, n in size.items() if n > 900}) > 0
    assert all(size[b] <= 900 for c, b in under.items() if b != copies.prefixes(c)[-1])


def test_copies_hot_and_flushed(spark):
    values = [(i, "B1", f'["same"{" " * (i % 7)}]') for i in range(900)] + [(1000 + i, "B2", f'["other {i}"]') for i in range(300)]
    df = sent(spark, values).repartition(5)
    want = [(0, i) for i in range(1, 900)]
    assert rows(copies.copies(df)) == want
    small = copies.heads(df, "ord", "targetId", "candidates", local=3000)
    found = copies.groups(small, 1500)
    got = small.where("ord is not null").join(found, "head").where("ord <> kept_ord").select("kept_ord", "ord")
    assert rows(got) == want


def test_copies_odd(spark):
    assert copies.copies(sent(spark, [])).count() == 0
    deep = "[" * 50_000
    odd = [(1, "B1", f'["{LONG}"]'), (2, "b1", f'["{LONG.upper()}"]'), (None, "B1", '["x"]'), (3, "B1", '["x"]'), (3, "B1", '["x"]'), (4, "B1", deep + '"x"'), (5, "B1", deep + " x"), (6, "B1", '["a", 1.50]'), (7, "B1", '["a", 15e-1]'), (8, "B1", '["a", 1.5e999999999]'), (9, "B1", '["\\ud800a", 0]'), (10, "B1", '["a", -0.0]')]
    assert rows(copies.copies(sent(spark, odd))) == [(1, 2), (4, 5), (6, 7), (9, 10)]


def test_copies_long_common_beginning(spark):
    """Records that differ far behind a common beginning, and chains of beginnings, in a number of jobs that doesn't depend on its length."""
    same = "x" * 1200
    values = [(i, "B1", f'["{same}{i // 2}"]') for i in range(60)] + [(100 + i, "B2", '["' + "y" * (1 + i // 2 * 40) + '"]') for i in range(60)]
    df = sent(spark, values).repartition(3)
    spark.sparkContext.setJobGroup("long", "long")
    assert rows(copies.copies(df, fits=1000)) == [(i, i + 1) for k in (0, 100) for i in range(k, k + 60, 2)]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("long")) < 10
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_deep_json(spark):
    """Nesting beyond the depth of calls: fields in another order are the same, other values and broken texts aren't."""

    def nested(depth, inner, swap=False):
        a, b = ('{"a":1, "b":', "}") if not swap else ('{"B" :', ', "a":1.0}')
        return a * depth + inner + b * depth

    values = [(1, "B1", nested(1200, '"x"')), (2, "B1", nested(1200, '"X!"', True)), (3, "B1", nested(1201, '"x"')), (4, "B1", nested(1200, '"y"')), (5, "B1", nested(1200, '"x"')[:-1])]
    values += [(6, "B1", "[" * 5000 + '"x"' + "]" * 5000), (7, "B1", "[ " * 5000 + ' "X" ' + "]" * 5000), (8, "B1", "[" * 5000 + '"x", []' + "]" * 5000)]
    assert rows(copies.copies(sent(spark, values))) == [(1, 2), (6, 7)]
    atom = lambda v: repr(str(v))
    rnd = random.Random(3)

    def value(depth):
        k = rnd.randrange(7 if depth else 5)
        return [None, True, 1.5, "a\\n", 7][k] if k < 5 else [value(depth - 1) for _ in range(rnd.randrange(3))] if k == 5 else {rnd.choice("abc"): value(depth - 1) for _ in range(rnd.randrange(3))}

    for _ in range(300):
        text = json.dumps(value(4), indent=rnd.choice([None, 1]))
        form = copies._deep(text, lambda v: f'"{copies.bare(v)}' if type(v) is str else "#" + copies._number(v) if isinstance(v, str) else f"~{v}")
        assert copies.content('["x",' + text + "]") == '["x,' + form + "]"
        broken = text[: rnd.randrange(len(text))] + rnd.choice(["", "]", "}", ",", ":", "x"])
        try:
            json.loads(broken)
        except ValueError:
            assert copies._deep(broken, atom) is None, broken


def test_numbers():
    for a, b in (("1", "1.0"), ("100", "1e2"), ("0.10", "1E-1"), ("-0", "0"), ("12e0", "1.2e+1")):
        assert copies._number(a) == copies._number(b)
    assert len({copies._number(x) for x in ("1", "10", "-1", "0.1", "11", "0")}) == 6


def test_trie():
    words = [b"", b"a", b"abcdefgh", b"abcdefghi", b"abcdefgh", "é".encode() * 9]
    trie = copies.Trie()
    for w in words:
        trie.terminal(w).append(1)
    assert {s: len(t) for s, t in trie.terminals()} == Counter(words) and trie.bytes > 0
    rnd = random.Random(6)
    many = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    trie = copies.Trie()
    for w in many:
        trie.terminal(w).append(1)
    assert {s: len(t) for s, t in trie.terminals()} == Counter(many)


# 3

SET = "row_no bigint, targetId string, spelling string, signature string"


def spelled(spark, values):
    return spark.createDataFrame([(n, t, s, "clash") for n, t, s in values], SET)


def brute_runs(values, least=5):
    owners = defaultdict(set)
    ok = [(n, t, s.split("/")) for n, t, s in values if t is not None and s is not None]
    for _, t, g in ok:
        for i in range(len(g) - least + 1):
            owners[tuple(g[i : i + least])].add(t)
    out = []
    for n, _, g in ok:
        hit = sorted({k for i in range(len(g) - least + 1) if len(owners[tuple(g[i : i + least])]) > 1 for k in range(i + 1, i + least + 1)})
        start = 0
        for j, k in enumerate(hit):
            if j + 1 == len(hit) or hit[j + 1] != k + 1:
                out.append((n, hit[start], k))
                start = j + 1
    return sorted(out)


@pytest.mark.parametrize("hashes", [1, 3])
def test_runs(spark, hashes):
    rnd = random.Random(2)
    values = [(i, f"T{rnd.randrange(60)}", "/".join(rnd.choice(["B1", "B2", "B3;B81", "B4"]) for _ in range(rnd.choice([1, 4, 5, 6, 9, 14])))) for i in range(300)]
    values += [(1000, None, values[3][2]), (1001, "T1", None), (1002, "T2", ""), (1003, "T3", "//////"), (1004, "T4", "//////")]
    df = spelled(spark, values).repartition(5)
    assert rows(passages.runs(df, hashes=hashes)) == brute_runs(values)
    held = Counter()
    for n, a, b in brute_runs(values):
        held[n] += b - a + 1
    assert {(n, h) for n, _, h in rows(passages.shares(df, hashes=hashes)) if h} == set(held.items())


def test_windows():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 7, 300):
        for h in (rnd.integers(0, 6, n), np.arange(n), np.arange(n)[::-1].copy(), np.zeros(n, int)):
            low, high = passages.windows(h.astype(np.uint64), np.zeros(n, int), np.full(n, n - 1))
            for p in range(n):
                a, b = p, p
                while a > 0 and h[a - 1] > h[p]:
                    a -= 1
                while b < n - 1 and h[b + 1] >= h[p]:
                    b += 1
                assert (low[p], high[p]) == (a, b)


def test_runs_odd(spark):
    assert passages.runs(spelled(spark, [])).count() == 0
    long = "/".join(f"B{i % 977}" for i in range(5000))
    values = [(1, "a", long), (2, "b", long + "/B5"), (2, "b", long + "/B5"), (None, "c", "B1/B2/B3/B4/B5")]
    got = {tuple(r) for r in passages.runs(spelled(spark, values)).collect()}
    assert got == {(1, 1, 5000), (2, 1, 5000), (None, 1, 5)}
    same = [(1, "a", long), (2, "a", long)]
    assert passages.runs(spelled(spark, same)).where("row_no is not null").count() == len(brute_runs(same))


# 4


@pytest.fixture(scope="module")
def judge():
    field, lang = replies.fitted()
    return replies.Judge(field, lang.list({"red", "fox", "blue", "house", "bright", "river", "to", "carry", "stone", "small", "apple", "hammock", "thimble", "umbrella"}))


PROMPT = "Guess the English headword for these glyphs and give a JSON list.\n\nSpelling: B12/B34  (2 characters)\nHelpers found inside:\n  - B7: red fox"
PAIRS = [
    ('["red fox", "blue house"]', None), ('```json\n["red fox"]\n```', None), ('The best reading is "red fox"; another option is "blue river".', None), ("Here are my 2 guesses:\n1. red fox\n2. stone", None), ('Sorry for this; I read ["red fox"]', None),
    ('["red fox"]\nNote: a related word abroad is "Eichhörnchen".', None), ('{"candidates": ["red fox"], "note": "unsure of all"}', None), ("", "empty"), (None, "empty"), (" ​\n", "empty"), ("[]", "empty"), ('{"candidates": []}', "empty"), ("```\n```", "empty"), ('[null, " "]', "empty"),
    ("null", "empty"), ('["red fox", "blue ho', "truncated"), ('{"candidates": ["red fox"], "no', "truncated"), ("Here are my 3 guesses:\n1. red fox\n2.", "truncated"), ("I am sorry, but I cannot help with this request.", "refusal"), ('{"candidates": [], "note": "I must decline to answer this."}', "refusal"),
    ('["I won\'t provide an answer."]', "refusal"), (PROMPT, "copies_question"), (PROMPT.upper(), "copies_question"), ("Q: " + PROMPT.split("\n")[0], "copies_question"), ('["Schlüssel", "Fenster"]', "other_language"), ("Je crois que ce mot veut dire maison, ou bien nuage.", "other_language"), ('["белка", "облако"]', "other_language"),
]


@pytest.mark.parametrize(("text", "want"), PAIRS)
def test_defects(judge, text, want):
    assert judge.defect(text, PROMPT)[0] == want


# Other phrases than training replies are composed of. The list was read while these were changed, so it is a regression test rather than an untouched measure.
HELD_OUT = {
    None: [
        '["yacht", "xylophone"]', "It probably means happiness or joy.", '["gherkin"]', "lighthouse", "Umbrella, most likely.", "I would go for small river.", 'Possibly ["stone wall", "quarry"]?', '{"candidates": ["wheelbarrow"], "why": "a cart with one wheel"}',
        "1) red fox\n2) small fox\n3) blue fox", "- apple\n- pear tree\n- orchard", 'Tough one! "to carry water" fits best.', "Cannot promise anything, but it reads like a bright house.", '["to carry a stone uphill without help"]', "My money is on a thimble or a hammock.",
        '["Red Fox (animal)", "blue hous"]', 'Though I refused at first, here you go: ["river"]', "The two signs give house plus water, so a boat.", '["parsnip", "llama", "kayak"]', '["red fox"]\nIn Spanish you would say "zorro".', "The meaning is to walk slowly.",
    ],
    "empty": ["{}", '[""]', "...", "[[], []]", '{"candidates": [], "note": ""}', "``` ```", "?!", "—", '[" ", "-"]', "[null]"],
    "truncated": ['["red fox", "blu', '["red fox",', '{"candidates": ["stone", "ri', "1. red fox\n2. blue house\n3. ho", "The first sign shows a house while the second one looks like the", '```json\n["red fox", "small', 'I would go for ["bright riv', "It may be a stone or a sma", '{"candidates": [', "Five ideas:\n1. apple\n2. stone\n3."],
    "refusal": [
        "I'm going to have to turn this one down.", "Sadly I am prevented from deciphering such signs.", "I can't make out what these signs say, so I won't answer.", "Nope, I am not going to answer that.", "I don't have enough to go on, so no guess from me.", "Answering would break my rules.", '["I am unable to answer"]',
        "I must respectfully decline.", '{"candidates": [], "reason": "I cannot interpret these symbols"}', "It is not something I can help you with, I'm afraid.", "I do not know the answer to this.", "Regrettably I can offer no interpretation here.",
    ],
    "copies_question": [PROMPT, "  " + PROMPT.replace("\n", " "), PROMPT.split("\n")[0], "“" + PROMPT.split("\n")[0] + "”", "The question: " + PROMPT, PROMPT.title(), "Spelling: B12/B34  (2 characters)\nHelpers found inside:\n  - B7: red fox", json.dumps([PROMPT.split("\n")[0]]), PROMPT + "\n" + PROMPT, "* " + PROMPT.replace("\n", "\n* ")],
    "other_language": [
        '["perro", "gato"]', '["köpek", "kedi"]', '["chó", "mèo", "cây"]', '["kutya", "macska"]', '["anjing", "kucing"]', '["casa vieja", "puente"]', "Sanırım bu kelime ev veya ağaç demek.", "Tôi nghĩ từ này có nghĩa là ngôi nhà.", "Saya rasa perkataan ini bermaksud rumah.", "Szerintem ez a szó házat jelent.", '["σπίτι"]',
        "Questo segno vuol dire casa oppure chiesa.", "Dit woord betekent waarschijnlijk brug of rivier.", '["집", "나무"]', "Luulen että sana tarkoittaa taloa.", '{"candidates": ["Schmetterling", "Vogelhaus"]}', "1. mariposa\n2. pájaro\n3. flor", "Думаю, это дом.",
    ],
}


def test_held_out_accuracy(judge):
    """Replies of other phrases than the field was fitted on: nine tenths of each kind are right."""
    for want, texts in HELD_OUT.items():
        wrong = [(t, got) for t in texts if (got := judge.defect(t, PROMPT)[0]) != want]
        print(want, len(texts), wrong)
        assert len(wrong) <= 0.1 * len(texts), (want, wrong)


def test_composed_replies(judge):
    """Composed replies that weren't in training: another seed of the same composition."""
    sure, some, foreign = map(sorted, replies.vocabularies(encoding.TOKENIZERS))
    names = {"answer": None, "refusal": "refusal", "echo": "copies_question", "foreign": "other_language"}
    fresh = [(t, p, names[k]) for t, p, k, _ in replies.training(sure, sure[::40], some, foreign, 500, seed=8) if k in names]
    right = sum(judge.defect(t, p)[0] == want for t, p, want in fresh)
    assert right >= 0.95 * len(fresh)


def test_languages():
    lang = replies.Languages(*replies.vocabularies(encoding.TOKENIZERS))
    listed = lang.list({"vegetable", "damp"})
    assert listed("vegetable") == 0 and listed("vegetble") == listed("végetable") == listed("dampvegetable") == listed("dampp") == 0.1 and listed("мост") == 1 and listed("stone's") == 0
    assert listed("puente") > 0.5 and lang("thrombosis") < 0.5 and not listed.is_stub("stone") and listed.is_stub("vegetab")
    assert replies.Languages(set(), set(), set())("word") >= 0


def test_defects_of_a_table(spark):
    s = spark.createDataFrame([(1, None, '["red fox"]', 7, "x"), (2, "[]", None, 8, "x"), (None, None, None, None, "x"), (4, PROMPT, None, 7, "x"), (4, PROMPT, None, 7, "x"), (5, LONG + ".", None, 9, "x")], "ord bigint, rawResponseText string, candidates string, interaction_id bigint, prompt string")
    p = spark.createDataFrame([(7, PROMPT), (8, None), (None, "x")], "interaction_id bigint, prompt string")
    g = spark.createDataFrame([("red fox",), (None,)], "gloss string")
    got = {(r.ord, r.defect) for r in replies.found(s, p, g).where("ord <> 5 or ord is null").collect()}
    assert got == {(2, "empty"), (None, "empty"), (4, "copies_question")} and replies.pairs(s, p, g).count() == 6
    assert replies.found(s.limit(0), p.limit(0), g.limit(0)).count() == 0


def test_no_word_of_the_replies_counts(spark, judge):
    """Judgements of a reply depend on its own pair and the entries only, whatever other rows say and in which order they come."""
    texts = ['["Wolke", "Fenster"]', '["stone"]\nNote: a related word abroad is "stone".', '["storae", "storte"]']
    g = spark.createDataFrame([("stone apple",), ("red fox",)], "gloss string")
    p = spark.createDataFrame([(1, PROMPT)], "interaction_id bigint, prompt string")
    of = lambda rows: {r.ord: r.defect for r in replies.found(spark.createDataFrame(rows, "ord bigint, rawResponseText string, candidates string, interaction_id bigint"), p, g).collect()}
    every = [(i, t, None, 1 if i % 2 else None) for i, t in enumerate(texts)]
    got = of(every)
    assert got[0] == "other_language" and 1 not in got and got == of(every[::-1] * 2) == {k: d for row in every for k, d in of([row]).items()}
    with pytest.raises(ValueError, match="words"):
        replies.listed_words(g, 3)


# 5

LIST = [(1, "fancy vanilla"), (2, "to postpone carriage"), (3, "glove"), (4, "ancient river"), (5, "ancient volcano"), (6, "library"), (7, "Grey Wolf"), (8, None), (None, "x y")]
TYPED = {
    "Fancy Vanilla": 1, "vanilla, fancy": 1, "fancyvanilla": 1, "fabcy vvanilla": 1, "a fancy vanilla (food)": 1, "to pospone carriage!": 2, "postpone carriage": 2, "gloves": 3, "glove(s)": 3, "GLOVÉ": 3, "libraries": 6, "librarys": 6, "acnient rivre": 4, "ancient river": 4, "grey wolf": 7,
    "ancient": -1, "river": -1, "fancy glove": -1, "ancient mountain": -1, "photosynthesis glove": -1, "???": -1, "белка": -1, "to postpone": -1, "something used to glove": -1, "gr ey wolf": 7,
}


def entries(spark, values=LIST):
    return spark.createDataFrame(values, "gloss_id bigint, gloss string")


def test_mapping(spark):
    keys = list(TYPED)
    values = spark.createDataFrame([(i, k, "clash") for i, k in enumerate(keys)], "row_key int, value string, form string")
    got = {r.value: r.gloss_id for r in canonical.assign(values, entries(spark)).collect()}
    assert got == TYPED


def test_mapping_odd(spark):
    s = spark.createDataFrame([(1, '["glove", "Glove", "", null]'), (2, '["glove", "Glove", "", " "]'), (3, '{"a": "Glove"}'), (4, None), (5, "[1]"), (6, '["' + LONG + '"]'), (2, '["Glove"]'), (7, "x" * 9)], "ord bigint, candidates string")
    c = spark.createDataFrame([(1, ["Glove", None, " "]), (2, None), (3, [])], "curation_id bigint, answers array<string>")
    got = rows(canonical.found(s, c, entries(spark)))
    assert got == [("answers", 1, 1, 3), ("candidates", 2, 1, 3), ("candidates", 2, 2, 3), ("candidates", 6, 1, -1)]
    assert {r.gloss_id for r in canonical.found(s, c, entries(spark, []).limit(0)).collect()} == {-1}
    assert canonical.found(s.limit(0), c.limit(0), entries(spark)).count() == 0


def test_distance():
    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(7))) for _ in range(2))
        assert canonical.distance(a, b) == min(3, plain(a, b))
        if plain(a, b) <= canonical.edits_allowed(min(len(a), len(b))):
            for first in (2, 3, 5, 7):
                assert canonical.variants(a, first) & canonical.variants(b, first), (a, b, first)


def test_long_tokens(spark):
    """Long tokens with up to two edits anywhere, at the first letters that count too."""
    rnd = random.Random(5)
    for _ in range(400):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(5, 65)))
        b = a
        for _ in range(2):
            i, edit = rnd.randrange(len(b) - 1), rnd.randrange(4)
            b = b[:i] + (b[i + 1] + b[i] + b[i + 2 :], b[i + 1 :], "d" + b[i:], "d" + b[i + 1 :])[edit]
        if len(b) > 4:
            assert all(canonical.variants(b, n) & canonical.variants(a, n) for n in (5, 7, 14)), (a, b)
    word = "abcdefghijklmnopqrstuvwxyzbdfhjlnprtvxzacegik"
    swapped = word[1] + word[0] + word[2:30] + word[31] + word[30] + word[32:]
    title = "the annual proceedings of the international society"
    typed = {swapped: 1, word[:20] + word[21:]: 1, word[:3] + "z" + word[3:]: 1, word[:9] + word[12:]: -1, title.replace(" ", "").replace("proceed", "procede"): 2, "q" + word[:40]: 3, word[:41]: 3}
    values = spark.createDataFrame([(k,) for k in typed], "value string")
    assert {r.value: r.gloss_id for r in canonical.assign(values, entries(spark, [(1, word), (2, title), (3, word[:40])])).collect()} == typed


def test_many_forms_under_one_beginning(spark):
    """More first letters count where the list's forms begin alike; the result is the same."""
    names = [f"university of place{chr(97 + i // 26)}{chr(97 + i % 26)}x{i}" for i in range(600)]
    listed = canonical.Listed(entries(spark, list(enumerate(names))))
    assert listed.first > canonical.FIRST and listed.n == 600
    typed = {names[7].replace("university", "univresity"): 7, names[599].replace(" ", "").upper(): 599, "university of zzzzzzzz": -1, "universityofplaceaax0s": 0}
    values = spark.createDataFrame([(k,) for k in typed], "value string")
    assert {r.value: r.gloss_id for r in canonical.assign(values, entries(spark, list(enumerate(names)))).collect()} == typed


def test_assigned():
    """Partners at the least cost, against all ways to choose them."""
    from itertools import permutations

    rnd = random.Random(9)
    for _ in range(500):
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 6)
        ways = [{c: rnd.choice([0.0, 0.5, 1.0, 2.0, -1000.0]) for c in range(m) if rnd.random() < 0.6} for _ in range(n)]
        best = min((sum(ways[r][c] for r, c in enumerate(p)) for p in permutations(range(m), n) if all(c in ways[r] for r, c in enumerate(p))), default=None)
        got = canonical.assigned(ways)
        assert (got is None) == (best is None) and (got is None or abs(sum(ways[r][c] for c, r in got.items()) - best) < 1e-9 and sorted(got.values()) == list(range(n)))
    # a partner that is taken first can be given away
    assert canonical.likeness(["ab", "ac"], {"ab": {"x": 0.0, "y": 1.0}, "ac": {"x": 1.0}}, {"ab": 1.0, "ac": 1.0}, ["x", "y"], [1.0, 1.0]) is not None


# 6

ITEMS = "row_no bigint, targetId string, charCount int, wanted int"
QUOTA = "char_count int, share_pm int, min_rows int"


def quota_items(spark, n=4000):
    rnd = random.Random(6)
    return [(i, f"B{i}", rnd.choice([2, 2, 2, 2, 3, 3, 4, 5, 9]), 0) for i in range(n)]


def test_quotas(spark):
    items = quota_items(spark) + [(9001, "B1", 77, 0), (9005, "B2", 22, 0), (9006, "B3", 22, 0), (9007, "B3", 9, 0), (9002, None, 2, 0), (9003, "Bx", None, 0), (5, "B5", 2, 0)]
    q = [(2, 300, 10), (3, 300, 10), (4, 100, 10), (5, 250, 5), (9, 50, 450), (22, 0, 4), (6, 0, 0), (None, 5, 5)]
    df, qdf = spark.createDataFrame(items, ITEMS), spark.createDataFrame(q, QUOTA)
    got = quotas.draw(df, qdf).collect()
    assert {tuple(r) for r in quotas.draw(df.repartition(9), qdf).collect()} == {tuple(r) for r in got}
    n = len({k for _, k, c, _ in items if k is not None and c is not None}) // 4
    supply = Counter(c for c in {(k, c) for _, k, c, _ in items if k and c is not None} for c in [c[1]])
    wanted = {c: max(m, -(-s * n // 1000)) for c, s, m in q if c is not None}
    assert {r.char_count: (r.supply, r.wanted) for r in quotas.lines(df, qdf).collect()} == {c: (supply[c], w) for c, w in wanted.items()}
    unmet = sorted(c for c, w in wanted.items() if supply[c] < w)
    assert rows(quotas.unmet(df, qdf)) == [(c,) for c in unmet] == [(9,), (22,)] or rows(quotas.unmet(df, qdf)) == [(c,) for c in unmet]
    drawn = Counter(r.charCount for r in got)
    assert len({(r.targetId, r.charCount) for r in got}) == len(got)
    for c, w in wanted.items():
        assert drawn[c] == min(w, supply[c]) or w <= drawn[c] <= w + 1
    rep = {r.char_count: (r.drawn, r.met) for r in quotas.report(df, qdf).collect()}
    assert rep[22] == (2, False) and all(rep[c] == (drawn[c], drawn[c] >= wanted[c]) for c in rep)


def test_systematic_shares(spark):
    """Without floors, each category gets its expected number, rounded up or down."""
    df = spark.createDataFrame(quota_items(spark, 3000), ITEMS)
    q = spark.createDataFrame([(2, 400, 0), (3, 400, 0), (4, 200, 0)], QUOTA)
    got = Counter(r.charCount for r in quotas.draw(df, q).where("how = 'systematic'").collect())
    for c, share in ((2, 400), (3, 400), (4, 200)):
        assert abs(got[c] - share * 750 / 1000) <= 1


def test_quotas_odd(spark):
    empty, q = spark.createDataFrame([], ITEMS), spark.createDataFrame([(2, 1000, 3), (2, None, 1), (3, None, None)], QUOTA)
    assert quotas.draw(empty, q).count() == 0 and rows(quotas.unmet(empty, q)) == [(2,)]
    one = spark.createDataFrame([(1, "B1", 2, 0), (None, "B2", 2, 0), (2, "B3", 2, 0), (3, "B3", 2, 0)], ITEMS)
    assert {r.targetId for r in quotas.draw(one, q).collect()} == {"B1", "B2", "B3"}
    assert quotas.draw(one, q.limit(0)).count() == 0 and quotas.unmet(one, q.limit(0)).count() == 0


# 7


@pytest.mark.parametrize("large", [False, True])
def test_pairs(spark, large):
    rnd = random.Random(7)
    values = [(i, f"T{rnd.randrange(90)}", "/".join(rnd.choice(["B1", "B2;B81", "B3", "B04", "B5;;B9", "VL1:0", "B7x", "B99999999999", ""][: 9 if large else 7]) for _ in range(rnd.randrange(1, 7)))) for i in range(400)]
    values += values[:30] + [(1, None, "B1/B2"), (2, "T", None), (3, "T", "")]
    both, each, n = Counter(), Counter(), 0
    import re

    for _, s in {(t, s) for _, t, s in values if t is not None and s is not None}:
        items = sorted({int(m[1]) for g in s.split("/") if (m := re.match(r"^B0*(\d{1,18})(;|$)", g))})
        n += bool(items)
        each.update(items)
        both.update(combinations(items, 2))
    df = spelled(spark, values).repartition(4)
    got = {(r.glyph_a, r.glyph_b): (r.c, r.a, r.b, r.n) for r in together.pairs(df).collect()}
    assert got == {p: (c, each[p[0]], each[p[1]], n) for p, c in both.items()}
    assert {(r.glyph_a, r.glyph_b): r.c for r in together.pairs(df, largest=2).collect()} == both
    items = together.baskets(df)
    for buffer in () if large else (1, 3, 50):
        assert {r.code: r.n for r in together.pair_counts(items, buffer=buffer).collect()} == {(a << 32) | b: c for (a, b), c in both.items()}
    want = sorted(p for p, c in both.items() if c >= 3 and 1000 * c >= n and c * n >= 3 * each[p[0]] * each[p[1]])
    assert rows(together.found(df)) == want
    r = together.pairs(df).first()
    assert r.odds_ratio == (r.c + 0.5) * (r.n - r.a - r.b + r.c + 0.5) / ((r.a - r.c + 0.5) * (r.b - r.c + 0.5))


def test_pairs_odd(spark):
    assert together.pairs(spelled(spark, [])).count() == 0
    long = "/".join(f"B{i}" for i in range(700))
    assert together.pairs(spelled(spark, [(1, "a", long), (1, "a", long), (2, "b", "B5")])).agg(F.count("*"), F.max("c"), F.max("n")).first()[:] == (700 * 699 // 2, 1, 2)


# 8

TOKENIZERS = encoding.TOKENIZERS
TEXTS = ["", None, "Hello world's  end\n\n  x", "naïve café ½ Ⅷ ² 12345 678", "a b　c  d", "тест 東京 🙂 ‍", "<|endoftext|> ok", "\t\r\n ", "don't 'll 'LL", "x\x1cy\x1fz", "é क्षि", "under_score __init__", LONG[:30_000], "퟿ \U0010ffff", "  lead", "trail  "]


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rnd = random.Random(8)
    texts = TEXTS + ["".join(rnd.choice("ab 'sſ1½_.\n\t é東") for _ in range(rnd.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, [0]) for i, x in enumerate(texts)], "doc_id bigint, text string, ids array<int>").repartition(3)
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    for hot in (encoding.HOT_WORDS, 5):
        assert {r.doc_id: r.ids for r in encoding.encode(df, hot_words=hot).collect()} == want
    back = {r.doc_id: r.text for r in encoding.decode(encoding.encode(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}


def test_encoding_new_letters(spark):
    """Letters that the JVM, Python or the tokenizer's library don't know, alone and beside others, in texts with and without rare words."""
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    new = ["\u9fff", "\U00031350", "\U0002ebf0", "\ua7c0", "\U0001df00", "\u1c89", "\U00010d40", "\U000323b0", "\u088f"]
    texts = [f"東{c}京" for c in new] + [f"rare word{i} a{c}b {c} !{c}! 7{c}8 the end" for i, c in enumerate(new)] + ["東京", "rare plain", "", None, "".join(new)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    for hot in (encoding.HOT_WORDS, 5):
        assert {r.doc_id: r.ids for r in encoding.encode(df, hot_words=hot).collect()} == want


def test_encoding_odd(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "three"), (1, "same"), (1, "same")], "doc_id bigint, text string")
    got = [(r.doc_id, len(r.ids)) for r in encoding.encode(df, hot_words=2).collect()]
    assert Counter(got) == {(None, 2): 1, (None, 1): 1, (1, 1): 2}
    assert encoding.encode(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, [10**6]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in encoding.decode(bad).collect()} == {1: None, 2: None, 3: ""}


def test_split_is_whole():
    for t in TEXTS:
        if t:
            assert "".join(encoding.split_words(t)) == t


# 9


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")


def test_leaks(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, " ".join(some(40))) for i in range(20)] + [(90, "too short"), (91, None), (None, " ".join(some(40)))]
    texts = []
    for k in range(200):
        t = some(30)
        if k % 4 == 0:
            w = items[k % 20][1].split()
            a, n = rnd.randrange(20), rnd.choice([11, 12, 15])
            t[10:10] = [x.upper() if rnd.random() < 0.3 else x for x in w[a : a + n]]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(t))
    texts += [None, "", LONG]
    df, it = documents(spark, texts).repartition(4), spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, words string")
    grams = defaultdict(set)
    for i, t in items:
        if i is not None and t:
            w = leaks.words_of(t)
            for k in range(len(w) - 11):
                grams[tuple(w[k : k + 12])].add(i)
    want = sorted({(d, i) for d, t in enumerate(texts) if t for w in [leaks.words_of(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())})
    assert want and rows(leaks.found(df, it)) == want and rows(leaks.found(df, it, block_words=100)) == want
    spans = leaks.spans(df, it)
    assert all(len(leaks.words_of(texts[r.doc_id][r.start : r.stop])) == r.words >= 12 for r in spans.collect())
    several = leaks.spans(df, it, block_words=60)
    assert sorted(map(str, several.collect())) == sorted(map(str, spans.collect()))
    clean = {r.doc_id: r for r in leaks.cleaned(df, it).collect()}
    assert clean == {r.doc_id: r for r in leaks.cleaned(df, it, block_words=60).collect()}
    assert len(clean) == len(texts) and clean[len(texts) - 3].text is None and rows(leaks.found(documents(spark, [clean[i].text for i in range(len(texts))]), it)) == []
    hit = {d for d, _ in want}
    assert all((clean[i].text == t) == (i not in hit) for i, t in enumerate(texts))


def test_leaks_odd(spark):
    item = spark.createDataFrame([(1, " ".join(f"İx{i}" for i in range(12)))], "item_id bigint, text string")
    df = documents(spark, ["🙂 " + ", ".join(f"İX{i}" for i in range(12)) + " end", "plain"])
    r = leaks.spans(df, item).collect()
    assert [(x.doc_id, x.words) for x in r] == [(0, 12)] and leaks.cleaned(df, item).where("doc_id = 0").first().text == "🙂  end"
    assert leaks.found(df, item.limit(0)).count() == 0 and leaks.found(df.limit(0), item).count() == 0
    long = spark.createDataFrame([(5, " ".join(f"u{i}" for i in range(25_000)))], "item_id bigint, text string")
    edge = documents(spark, [" ".join(f"u{i}" for i in range(9_994, 10_008))])
    assert rows(leaks.found(edge, long)) == [(0, 5)]
    across = documents(spark, [" ".join(f"u{i}" for i in range(9_900, 10_100))])
    for words in (leaks.BLOCK_WORDS, 6_000):
        assert [(r.item_id, r.words) for r in leaks.spans(across, long, block_words=words).collect()] == [(5, 200)]
    # rows without key, or with one key, are cleaned each for itself
    said = " ".join(f"İx{i}" for i in range(12))
    loose = spark.createDataFrame([(None, f"a {said} b"), (None, "c"), (1, f"{said}."), (1, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text or "", r["items"], r.removed or 0) for r in leaks.cleaned(loose, item).collect()) == [(0, "a  b", [1], len(said)), (0, "c", [], 0), (1, "", [], 0), (1, ".", [1], len(said))]


# 10

SAME = [
    ["The cathedral index", "Thе cаthedral index", "The cathe​dral index", "Ｔｈｅ cathedral ｉndex", "The　cathedral index﻿"],
    ["café naïve", "café naïve", "сafé naïve"],
    ["is as xs25", "іѕ аѕ хѕ25"],
    ["Привет, а мир", "Пpивeт, а мир"],
    ["カﾞ", "ガ".replace("ガ", "ｶﾞ")],
]


def test_forms(spark):
    texts = [t for g in SAME for t in g] + ["cafe naive", "The Cathedral index", "x²", "x2", "a\tb", "a b", None, ""]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, form string").repartition(3)
    for limit in (lookalikes.CHOICES, -1):
        got = {r.doc_id: (r.text, bytes(r.look) if r.look is not None else None) for r in lookalikes.normalised(df, limit=limit).collect()}
        k = 0
        for g in SAME:
            assert len({got[k + j][1] for j in range(len(g))}) == 1, g
            # words of one script stay, though they look like another's
            assert len({got[k + j][0] for j in range(len(g))}) == (2 if g[0].startswith("is") else 1), g
            k += len(g)
        assert [got[i][0] for i in range(k, len(texts))] == texts[k:] and got[0][0] == "The cathedral index"
        looks = [got[i][1] for i in range(k, len(texts))]
        assert len(set(looks)) == len(looks) and looks[-2] is None
    assert "Привет" in got[sum(map(len, SAME[:3]))][0]
    want, k = set(), 0
    for g in SAME:
        want |= {(k + i, k + j) for i, j in combinations(range(len(g)), 2) if g[i] != g[j]}
        k += len(g)
    assert set(rows(lookalikes.pairs(df))) == want


def test_forms_odd(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (None, "sаme"), (3, "sаme"), (4, LONG + "а"), (4, LONG + "а")], "doc_id bigint, text string")
    assert rows(lookalikes.pairs(df)) == [(1, 3), (2, 3)]
    assert lookalikes.pairs(df.limit(0)).count() == 0 and lookalikes.normalised(df.limit(0)).count() == 0
    assert lookalikes.normalised(df).count() == 6


def test_every_twin_replaced(spark):
    """Cyrillic and Greek words whose letters with twins are all Latin."""
    texts = ["До", "Дo", "Ωο", "Ωo", "plain", "naïve"]
    for limit in (lookalikes.CHOICES, -1):
        got = {r.doc_id: r.text for r in lookalikes.normalised(documents(spark, texts), limit=limit).collect()}
        assert [got[i] for i in range(6)] == ["До", "До", "Ωο", "Ωο", "plain", "naïve"]
    assert set(rows(lookalikes.pairs(documents(spark, texts)))) == {(0, 1), (2, 3)}


def test_vocabulary_decides(spark):
    """Only tokens of several scripts are repaired, and only to words of the corpus."""
    of = lambda texts: [r.text for r in lookalikes.normalised(documents(spark, texts)).orderBy("doc_id").collect()]
    same = ["он и а с у нас", "a c y", "hеllо", "сор", "cop", None, ""]
    assert of(same) == same
    assert of(["hеllо", "say hello"])[0] == "hello" and of(["соp", "сор"])[0] == "сор" and of(["соp", "cop"])[0] == "cop" and of(["соp", "cop", "сор"])[0] == "сор"
    assert lookalikes.repairs(documents(spark, same)).count() == 0
    got = {r.doc_id: bytes(r.look) for r in lookalikes.normalised(documents(spark, ["hеllо", "hello", "ɡɑtе", "gate", "Ꭺсе ν", "Ace v", "օհо", "oho"])).collect()}
    assert all(got[i] == got[i + 1] for i in range(0, 8, 2))


def test_large_class(spark):
    """A class of many rows, in blocks: the pairs of any two rows that are stored differently."""
    texts = [f"same{' ' if i % 3 else chr(0xA0)}text" if i % 7 else "sаme text" for i in range(60)]
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if texts[i] != texts[j]]
    for block in (1000, 7):
        assert rows(lookalikes.pairs(documents(spark, texts), block=block)) == want
    assert lookalikes.classes(documents(spark, texts)).count() == 60
