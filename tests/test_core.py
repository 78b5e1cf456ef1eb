"""The reference's own fixtures and the edge cases of the core operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import candidates as C
from lexiloom.functions import hashing, spelling
from lexiloom.functions import text as T
from lexiloom.operators import answers, context, matching, modifiers, rules, sampling, scoring
from lexiloom.operators.lexicon import Lexicon, normalized
from lexiloom.operators.ranking import positions
from lexiloom.plans import builders, references, report
from lexiloom.sources import sinks, snapshot


def lexicon(spark, words, marks=("B81", "B86", "B97"), **more):
    rows = [(f"B{i}", i, i, code, gloss, "noun", False) for i, code, gloss in words]
    entries = spark.createDataFrame(rows, "id string, numeric_id bigint, ordinal bigint, code string, gloss string, pos string, is_non_preferred boolean")
    ind = spark.createDataFrame([(m, "g", f"name {m}", "p") for m in marks], "code string, group string, name string, purpose string")
    return Lexicon(entries, ind, **more)


NEAR = [
    (1, "B100/B200/B300", ""), (2, "B100/B999", ""), (3, "B100/B200/B777", ""), (4, "B100/B200/B300/B400", ""), (5, "B888/B300", ""), (6, "B777/B200/B300", ""), (7, "B100", ""), (8, "B300", ""),
    (9, "B100/B200/B300", ""), (10, "B500/B600", ""), (11, "B100/B201/B202/B203/B204", ""), (12, "B201/B202/B203/B300", ""), (13, "B100/B888;;B81", ""),
]


def parse(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return {r.s: r for r in spelling.with_parsed(df, "s").collect()}


def test_parse(spark):
    got = parse(spark, ["B398;B86/B688", "B398/B688;;B86", " b012 / B5;!B97;B97 ", "/B1/", "B1;;;B2", "B1;", "B1;;", "B1;!/B2", "B000"])
    one = got["B398;B86/B688"]
    assert one.canonical == "B398;B86/B688" and len(one.chars) == 2 and one.chars[0].indicators == ["B86"] and one.word_marks == []
    two = got["B398/B688;;B86"]
    assert two.canonical.endswith(";;B86") and two.word_marks == ["B86"] and two.base_key == "B398/B688"
    assert got[" b012 / B5;!B97;B97 "].canonical == "B12/B5;B97"
    assert got["/B1/"].canonical == "B1" and got["B1;"].canonical == "B1" and got["B1;;"].canonical == "B1" and got["B1;!/B2"].canonical == "B1/B2"
    assert got["B1;;;B2"].canonical == "B1;;B2" and got["B000"].canonical == "B0"


def test_no_words(spark):
    bad = ["", " ", None, "VL6:0,8;DOT:0,16", "B1//B2", "B1;;B81/B2", "not-a-bcode", "B1/;/B2", "!B1", "B", ";;B81", "/", "B1/B", "B1;x"]
    assert all(r.canonical is None and r.base is None for r in parse(spark, bad).values())


def test_tokens(spark):
    df = spark.createDataFrame([(x,) for x in ("12", " b0012 ", "B7", "x 1", "012")], "s string")
    assert [r[0] for r in df.select(spelling.resolve_id(F.col("s"))).collect()] == ["B12", "B12", "B7", "x 1", "B12"]
    assert [r[0] for r in df.select(spelling.code_token(F.col("s"))).collect()] == [None, "B12", "B7", None, None]


def test_spans_and_affixes(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "x", "c"]), (["a"], ["a"]), ([], ["a"]), (["a"], ["b"])], "a array<string>, b array<string>")
    rows = df.select(spelling.spans(F.col("a")).alias("s"), spelling.spans(F.col("a"), 2, True).alias("t"), spelling.common_prefix(F.col("a"), F.col("b")).alias("p"), spelling.common_suffix(F.col("a"), F.col("b")).alias("q")).collect()
    assert [s.key for s in rows[0].s] == ["a", "a/b", "b", "b/c", "c"] and [s.key for s in rows[0].t] == ["a/b", "a/b/c", "b/c"]
    assert [(r.p, r.q) for r in rows] == [(2, 1), (1, 1), (0, 0), (0, 0)] and rows[1].s == [] and rows[2].s == []


def test_neighbours(spark):
    lex = lexicon(spark, NEAR)
    found = matching.capped(matching.neighbours(lex)).where("target_id = 'B1'").orderBy("side", "rank").collect()
    assert [(r.helper_id, r.shared_len) for r in found if r.side == "start"] == [("B4", 3), ("B3", 2), ("B2", 1), ("B13", 1)]
    assert [(r.helper_id, r.shared_len) for r in found if r.side == "end"] == [("B6", 2), ("B5", 1)]
    assert {r.helper_id for r in matching.subwords(lex).where("target_id = 'B1'").collect()} >= {"B7", "B8"}
    assert [r.helper_id for r in matching.siblings(lex).where("target_id = 'B1'").collect()] == ["B9"]


def test_caps(spark):
    lex = lexicon(spark, NEAR)
    every = matching.neighbours(lex)
    start = lambda limit: [r.helper_id for r in matching.capped(every, limit).where("target_id = 'B1' and side = 'start'").orderBy("rank").collect()]
    assert start(2) == ["B4", "B3"] and start(float("inf")) == start(8) == start(float("nan")) and start(0) == start(-3) == []
    left = {(r.side): r.omitted for r in matching.omitted(matching.counts(lex), 2).where("target_id = 'B1'").collect()}
    assert left == {"start": 2, "end": 0}


def test_first_neighbours(spark):
    """Frequent affixes, equal words and spans inside the target: the same rows as the first of all pairs, and the same counts."""
    rnd = random.Random(11)
    words = [(i, "/".join(f"B{rnd.choice([100, 100, 100, 101, 102])}" for _ in range(rnd.randrange(1, 8))), "") for i in range(1, 500)]
    lex = lexicon(spark, words)
    every = matching.neighbours(lex)
    rows = lambda df: sorted(map(tuple, df.select("target_id", "side", "rank", "helper_id", "shared_len").collect()))
    for limit in (1, 8, 30):
        assert rows(matching.first_neighbours(lex, limit=limit)) == rows(matching.capped(every, limit))
    want = sorted(map(tuple, every.groupBy("target_id", "side").count().collect()))
    assert sorted(map(tuple, matching.counts(lex).select("target_id", "side", "n").collect())) == want


def test_first_neighbours_behind_spans(spark):
    """More spans of the target under one next character than a list has to spare, while others fill the limit."""
    words = [*((i, "B1/B2", "") for i in range(1, 13)), (13, "B1/B2/B7", ""), *((i, f"B1/B9/B{16 + i}", "") for i in range(14, 22)), (30, "B1/B3/B1/B2", "")]
    words += [(100 + i, "/".join(reversed(code.split("/"))), "") for i, code, _ in words]
    lex = lexicon(spark, words)
    rows = lambda df: sorted(map(tuple, df.select("target_id", "side", "rank", "helper_id", "shared_len").collect()))
    got = rows(matching.first_neighbours(lex))
    assert [r[3] for r in got if r[:2] == ("B30", "start")] == [f"B{i}" for i in range(13, 21)]
    assert got == rows(matching.capped(matching.neighbours(lex)))


@pytest.mark.parametrize("side", ["start", "end"])
def test_all_pairs_are_spread(spark, side):
    """All pairs as by brute force, spans of the target left out, in many partitions although few bytes are shuffled."""
    rnd = random.Random(7)
    words = {f"B{i}": [f"B{rnd.choice([10, 10, 1, 2, 100])}" for _ in range(rnd.randrange(1, 7))] for i in range(1000, 1150)}
    lex = lexicon(spark, [(int(i[1:]), "/".join(w), "") for i, w in words.items()])
    turn, most, want = (lambda x: x) if side == "start" else (lambda x: x[::-1]), 3 if side == "start" else 2, []
    for t, a in words.items():
        for h, b in words.items():
            n = next((i for i, (x, y) in enumerate(zip(turn(a), turn(b))) if x != y), min(len(a), len(b)))
            if t != h and n and 1 <= len(b) - n <= most and not any(a[i : i + len(b)] == b for i in range(len(a))):
                want.append((t, h, n, len(b)))
    found = getattr(matching, f"shared_{side}")(lex).select("target_id", "helper_id", "shared_len", "total")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.rdd.getNumPartitions() >= matching.SPREAD * spark.sparkContext.defaultParallelism


def test_legend(spark):
    lex = lexicon(spark, [(1, "B100/B200/B300", "t"), (2, "B100/B401/B402", "n"), (3, "B777/B300", "e"), (4, "B401", "alpha"), (5, "B402", "beta"), (6, "B401/B402", "widget"), (7, "B777", "omega"), (8, "B100", "first")])
    shown = matching.capped(matching.neighbours(lex))
    rows = context.build(lex).where("target_id = 'B1'").first().legend
    assert [r.base_spelling for r in rows] == ["B401/B402", "B401", "B402", "B777"] and rows[0].length == 2 and rows[0].gloss == "widget"
    assert matching.legend(lex, matching.capped(shown, 0)).count() == 0


def test_legend_of_repeated_targets(spark):
    """A target that is there twice has each part once, as in the SQL."""
    lex = lexicon(spark, [(1, "B100/B200/B300", ""), (2, "B100/B401/B402", ""), (3, "B401", ""), (4, "B402", ""), (5, "B401/B402", "")])
    targets, shown = matching.targets_of(lex), matching.capped(matching.neighbours(lex))
    once = sorted(map(tuple, matching.legend(lex, shown, targets).collect()))
    assert [r[2] for r in once if r[0] == "B1"] == ["B401", "B401/B402", "B402"]
    assert sorted(map(tuple, matching.legend(lex, shown, targets.unionByName(targets)).collect())) == once


def test_context_of_a_spelling(spark):
    lex = lexicon(spark, [(1, "B100/B200/B300", "known word"), (2, "B100/B200/B777", "n"), (3, "B100", "a"), (4, "B300", "b")])
    asked = spark.createDataFrame([("B100/B200/B999",), ("B100/B200/B300",), ("not-a-bcode",), (None,)], "spelling string")
    got = {r.spelling: r for r in context.build(lex, matching.targets_from(asked)).collect()}
    assert set(got) == {"B100/B200/B999", "B100/B200/B300"}
    new, known = got["B100/B200/B999"], got["B100/B200/B300"]
    assert [h.helper_id for h in new.subwords] == ["B3"] and {h.helper_id for h in new.shared_start} >= {"B1", "B2"}
    assert [h.helper_id for h in known.siblings] == ["B1"] and [h.helper_id for h in known.shared_start] == ["B2"]
    assert [(r.target_id, r.id) for r in context.exact_matches(lex, asked).collect()] == [("?B100/B200/B300", "B1")]
    assert "Spelling: B100/B200/B999" in context.prompt(context.build(lex, matching.targets_from(asked))).where("target_id = '?B100/B200/B999'").first().prompt


def test_sealed(spark):
    lex = lexicon(spark, [(1, "B2/B3", "secret-gloss"), (2, "B2", "a"), (3, "B3", "b")])
    assert lex.sealed().columns == ["targetId", "spelling", "charCount"]
    assert "secret-gloss" not in str(context.build(lex).where("target_id = 'B1'").first())


def test_atomic(spark):
    lex = lexicon(spark, [(1, "B5;B423/B6", "composed"), (2, "VL1:0,1", "shape"), (3, "B5/B6", "plain"), (4, "B5;B97/B6", "marked")])
    shown = {r.id: (r.atomic, r.shown, r.shown_base) for r in lex.entries.collect()}
    assert shown == {"B1": (True, "B1", "B1"), "B2": (False, "B2", "B2"), "B3": (False, "B5/B6", "B5/B6"), "B4": (False, "B5;B97/B6", "B5/B6")}
    asked = spark.createDataFrame([("B5/B6",), ("B2",)], "spelling string")
    assert sorted((r.asked, r.id) for r in lex.find_by_base(asked).collect()) == [("B2", "B2"), ("B5/B6", "B3"), ("B5/B6", "B4")]
    assert sorted((r.asked, r.id) for r in lex.find_by_spelling(asked).collect()) == [("B2", "B2"), ("B5/B6", "B3")]


def test_modifiers(spark):
    base = lambda *c: ([f"B{x}" for x in c],)
    df = spark.createDataFrame([base(10, 117, 9, 5), base(10, 4), base(368, 368, 368), base(5, 449, 401, 449), base(449, 401), base(10, 10, 4), ([],)], "base array<string>")
    rows = modifiers.with_modifiers(df, references.MODIFIERS, references.EXCEPTIONS).collect()
    found = [[(m.start, m.stop, m.spelling) for m in r.found] for r in rows]
    assert found[0] == [(0, 2, "B10/B117"), (2, 3, "B9")] and rows[0].rest == 3 and len(rows[0].run) == 2
    assert found[1] == [] and found[2] == [(0, 2, "B368/B368"), (2, 3, "B368")] and rows[2].full is None and rows[2].rest == 3
    assert found[3] == [(1, 3, "B449/B401"), (3, 4, "B449")] and rows[3].run == [] and rows[4].full == "B449/B401"
    assert found[5] == [(0, 1, "B10")] and found[6] == []
    with pytest.raises(ValueError, match="empty/missing codes"):
        modifiers.checked([{"codes": []}])
    with pytest.raises(ValueError, match="twice"):
        modifiers.checked([{"spelling": "B1"}, {"spelling": "B1"}])


def answers_of(spark, gloss, reviewed=None):
    df = spark.createDataFrame([(gloss, reviewed)], "gloss string, reviewed array<string>")
    return answers.with_answers(df, reviewed="reviewed").first()


@pytest.mark.parametrize(
    ("gloss", "want"),
    [
        ("ovum (1)", ["ovum"]), ("breast(s)", ["breast", "breasts"]), ("box(es)", ["box", "boxes"]), ("abortion (induced)", ["abortion"]), ("yuk - (exclamatory)", ["yuk"]), ("ugh, yuk - (exclamatory)", ["ugh", "yuk"]),
        ("doctor (rehab, hab)", ["doctor"]), ("marsupial (animal), pouched mammal", ["marsupial", "pouched mammal"]), ("cold-blooded (animal)", ["cold-blooded"]), ("behaviour", ["behaviour", "behavior"]), ("", []), (None, []), ("(only a tag)", []),
    ],
)
def test_answers(spark, gloss, want):
    assert answers_of(spark, gloss).answers == want


def test_reviewed_answers(spark):
    one = answers_of(spark, "ugh, yuk - (exclamatory)", ["yuk"])
    assert one.answers == ["ugh", "yuk"] and one.source == "curated" and [(a.form, a.reason) for a in one.added] == [("yuk", "curated")]
    assert "center" in answers_of(spark, "centre (sport)", ["centre"]).answers
    assert answers_of(spark, "cat (1)", []).answers == [] and answers_of(spark, "cat (1)", [None, " "]).source == "curated"


def test_gloss_functions(spark):
    df = spark.createDataFrame([("doctor (rehab, hab), x;y | z (a, b",), ("a)b,c",), ("_x_  y",), (None,)], "g string")
    rows = df.select(T.split_top_level(F.col("g")).alias("p"), T.base_answers(F.col("g")).alias("b")).collect()
    assert rows[0].p == ["doctor (rehab, hab)", " x", "y ", " z (a, b"] and rows[1].p == ["a)b", "c"] and rows[2].b == ["x y"] and rows[3].b == []
    need = spark.createDataFrame([(x,) for x in (["cat"], ["egg", "ovum (1)"], ["breast(s)"], ["abortion (induced)"], ["yuk - (exclamatory)"], ["apparent(ly)"])], "b array<string>")
    assert [r[0] for r in need.select(T.needs_curation(F.col("b"))).collect()] == [False, False, False, True, True, True]


def score(spark, pos, accepted, sent):
    key = spark.createDataFrame([("B1", pos, accepted)], "target_id string, pos string, answers array<string>")
    rows = spark.createDataFrame([("B1", sent if isinstance(sent, str) or sent is None else json.dumps(sent), None, 1)], "targetId string, candidates string, rawResponseText string, first_ord bigint")
    return scoring.scored(rows, key).first()


def test_scores(spark):
    assert score(spark, "noun", ["abortion (induced)"], ["abortion", "termination", "miscarriage", "abortion (induced)", "loss"]).rank == 4
    assert score(spark, "action", ["to drive"], ["drive"]).top1
    for a, b in (("lets", "let's"), ("let’s", "lets"), ("oclock", "o'clock"), ("drive", "drive."), ("ice cream", "ice_cream"), ("Ice  Cream", "ice cream")):
        assert score(spark, "noun", [a], [b]).rank == 1
    miss = score(spark, "noun", ["", "?"], ["?", ""])
    assert miss.rank is None and not miss.top5 and miss.reciprocal_rank == 0.0
    assert score(spark, "noun", ["f"], ["a", "b", "c", "d", "e", "f"]).rank is None


@pytest.mark.parametrize(
    ("sent", "want"),
    [
        ('x ["a","b"] y ["c","d"]', ["c", "d"]), ('Guesses: ["water","river","lake"]\nNote: [confidence: high]', ["water", "river", "lake"]), ('{"candidates":["x","y"]}', ["x", "y"]), ('["a",null,"b",{"x":1}]', ["a", "b"]), ('[["a","b"]]', ["a", "b"]),
        ('[{"x":1}]', []), ('["a"] junk', ["a"]), ('["a", NaN]', []), ("", []), (None, []), ('[" ", "a "]', ["a"]), ('["\\u00e9\\"x"]', ['é"x']), ("[" * 100_000, []), ('["[x]"]', ["[x]"]), ('{"candidates": "x"}', []), ('{"a":1,"a":2,"candidates":["z"]}', ["z"]),
    ],
)
def test_candidates(spark, sent, want):
    assert spark.createDataFrame([(sent,)], "c string").select(C.candidates(F.col("c")).alias("g")).first().g == want


def test_array_spans(spark):
    rnd = random.Random(12)
    texts = [None, "", "[", "]", "a]b[c]d", "x [a [b] c] y [d", "[[]", "[]" * 40, "[" * 20_000, "é[ü]🙂[z]"] + ["".join(rnd.choice("[]ab") for _ in range(rnd.randrange(14))) for _ in range(300)]

    def brute(t):
        out, opened = [], []
        for i, c in enumerate(t or ""):
            if c == "[":
                opened.append(i)
            elif c == "]" and opened:
                at = opened.pop()
                if not opened:
                    out.append(t[at : i + 1])
        return out

    got = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", C.array_spans(F.col("c")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [brute(t) for t in texts]


def test_report(spark):
    key = spark.createDataFrame([("B1", "noun", ["cat"]), ("B2", "action", ["to run"])], "target_id string, pos string, answers array<string>")
    schema = "ord bigint, targetId string, candidates string, rawResponseText string, runner string"
    sent = spark.createDataFrame([(1, "B1", '["cat","dog"]', None, "r"), (2, "B1", '["wrong"]', None, "r"), (3, "B2", None, 'so: ["run"]', "q")], schema)
    rows, s = report.score_report(sent, key, key.select("target_id"))
    assert s["coverage"]["scored"] == 2 and s["coverage"]["duplicates"] == 1 and not s["official"] and s["top1"] == 0.5 and s["runner"] == ["r", "q"]
    assert [r.target_id for r in rows.collect()] == ["B1", "B2"] and "Official: no" in report.report_text(s)
    bad = spark.createDataFrame([(1, None, '["x"]', None, "r"), (2, "", '["x"]', None, "r"), (3, "B1", "[[[[", None, None), (4, "B2", '["run"]', None, None)], schema)
    _, s = report.score_report(bad, key, key.select("target_id"))
    assert (s["coverage"]["malformed"], s["coverage"]["duplicates"], s["coverage"]["scored"], s["top1"]) == (2, 0, 2, 0.5)
    _, s = report.score_report(bad.limit(0), key, key.select("target_id"))
    assert s["total"] == 0 and s["mrr"] == 0.0 and s["coverage"]["missing"] == 2 and not s["official"]
    _, s = report.score_report(bad.where("ord > 2"), key, key.select("target_id"))
    assert s["official"]


def test_report_of_many_runners(spark):
    """As many names as a summary lists, and one more, which is an error."""
    key = spark.range(1, 1002).selectExpr("concat('B', id) as target_id", "'noun' as pos", "array('cat') as answers")
    sent = spark.range(1, 1002).selectExpr("id as ord", "concat('B', id) as targetId", "'[\"cat\"]' as candidates", "cast(null as string) as rawResponseText", "concat('r', id) as runner")
    _, s = report.score_report(sent.where("ord <= 1000"), key, key.select("target_id"))
    assert s["runner"] == [f"r{i}" for i in range(1, 1001)]
    with pytest.raises(ValueError, match="runner"):
        report.score_report(sent, key, key.select("target_id"))


def test_scored_columns(spark):
    """Runner and version are those of a target's last row, also where another target's row has its number."""
    key = spark.createDataFrame([("B1", "action", ["drive", "to drive", "go"]), ("B2", "noun", ["cat"])], "target_id string, pos string, answers array<string>")
    sent = spark.createDataFrame([(1, "B1", '["x"]', None, "a", "v1"), (7, "B1", '["Drive!"]', None, "b", None), (7, "B2", "[]", None, "c", "v2")], "ord bigint, targetId string, candidates string, rawResponseText string, runner string, promptVersion string")
    rows, s = report.score_report(sent, key, key.select("target_id"), provenance={"kitVersion": "1"})
    got = {r.target_id: (r.rank, r.accepted, r.normalized, r.runner, r.promptVersion) for r in rows.collect()}
    assert got == {"B1": (1, ["to drive", "to go"], ["to drive"], "b", None), "B2": (None, ["cat"], [], "c", "v2")}
    assert s["runner"] == ["b", "c"] and s["promptVersion"] == ["v2"] and s["kitVersion"] == "1" and s["coverage"]["duplicates"] == 1 and s["coverage"]["empty_candidates"] == 1


def test_whole_views(spark):
    """Helpers with their base, marks, answers and explanation; modifiers with their readings; known words of a spelling."""
    words = [(1, "B9/B200/B300", "own"), (2, "B200;B81", "two (1), deux"), (3, "B200;B4", "atomic"), (4, "B9/B200/B777;;B97", "near")]
    rows = [(f"B{i}", i, i, code, gloss, "noun", False, f"told_about  {i}") for i, code, gloss in words]
    entries = spark.createDataFrame(rows, "id string, numeric_id bigint, ordinal bigint, code string, gloss string, pos string, is_non_preferred boolean, explanation string")
    ind = spark.createDataFrame([(m, "g", f"name {m}", "p") for m in ("B81", "B97")], "code string, group string, name string, purpose string")
    reviews = spark.createDataFrame([("B4", ["close"], None)], "target_id string, reviewed array<string>, note string")
    lex = Lexicon(entries, ind, [{"spelling": "B9", "category": "c", "asPrefix": ["many", "much"]}], [], reviews)
    r = context.build(lex, matching.targets_from(spark.createDataFrame([("B009/B200/B300",)], "spelling string"))).first()
    assert [(m.spelling, m.codes, m.gloss, m.as_prefix, m.category, m.start, m.stop) for m in r.modifiers] == [("B9", ["B9"], "", ["many", "much"], "c", 0, 1)]
    assert [(m.helper_id, m.helper_spelling, m.helper_base, m.answers, m.explanation) for m in r.exact_match] == [("B1", "B9/B200/B300", "B9/B200/B300", ["own"], "told about 1")]
    two = r.subwords[0]
    assert (two.helper_id, two.spelling, two.key, two.helper_spelling, two.helper_base, two.answers, [m.name for m in two.indicators]) == ("B2", "B200", "B200", "B200;B81", "B200", ["two", "deux"], ["name B81"])
    assert [(n.helper_id, n.shared_len, n.shared_base, n.answers, n.explanation) for n in r.shared_start] == [("B4", 2, "B9/B200", ["near", "close"], "told about 4")]
    assert {v.id: v.indicators for v in lex.views.collect()}["B3"] == [] and lex.answer_keys().where("id = 'B4'").first().answers == ["near", "close"]
    own = context.build(lex).where("target_id = 'B1'").first()
    assert own.exact_match is None and "told about 1" not in str(own) and "Modifiers: B9" in context.prompt(context.build(lex)).where("target_id = 'B1'").first().prompt


def test_builders(spark, tmp_path):
    lex = lexicon(spark, [(1, "B5/B6", "five six"), (9, "B9", "nine")])
    lex = Lexicon(lex.raw.withColumn("is_indicator", F.lit(False)), lex.indicators)
    m = builders.modifier_reference({"entries": [{"spelling": "B9", "category": "a", "tier": "t"}, {"spelling": "B5/B6", "category": "b", "tier": "t", "gloss": "own", "asPrefix": ["x"]}, {"spelling": "B77", "category": "a", "tier": "u"}], "knownGaps": ["g"]}, lex)
    assert [(e["spelling"], e["codes"], e["gloss"], e["asPrefix"]) for e in m["entries"]] == [("B9", ["B9"], "nine", []), ("B5/B6", ["B5", "B6"], "own", ["x"]), ("B77", ["B77"], "", [])]
    assert m["tiers"] == {"t": ["B9", "B5/B6"], "u": ["B77"]} and m["categories"] == ["a", "b"] and m["count"] == 3 and m["knownGaps"] == ["g"]
    found, warnings = builders.indicator_reference({"groups": ["g"], "entries": [{"code": "B9", "group": "g", "name": "n"}, {"code": "B8", "group": "g", "name": "m"}]}, lex)
    assert found["count"] == 2 and warnings == ["B9 (n) isn't flagged as a mark", "B8 (m) isn't in the lexicon"]
    with pytest.raises(ValueError, match="unknown group"):
        builders.indicator_reference({"groups": [], "entries": [{"code": "B9", "group": "g"}]}, lex)
    (tmp_path / "r.json").write_text(json.dumps({"B9": {"answers": ["a", "b"], "note": "n"}}))
    assert snapshot.read_reviews(spark, str(tmp_path / "r.json")).first()[:] == ("B9", ["a", "b"], "n")


def test_subword_counts(spark):
    """Counts from keys, also where a target's own id is the key of one of its spans."""
    lex = lexicon(spark, [(1, "B1/B2/B1", ""), (2, "B2", ""), (3, "B2;B81", ""), (4, "B1/B2", ""), (5, "B9/B9", "")])
    want = {r.target_id: (r.spans, r.helpers) for r in matching.subwords(lex).groupBy("target_id").agg(F.count_distinct("start", "stop").alias("spans"), F.count("*").alias("helpers")).collect()}
    assert {r.target_id: (r.spans, r.helpers) for r in matching.subword_counts(lex).collect()} == want and len(want) == 2
    pairs = {(r.target_id, r.side): r[2:] for r in matching.neighbours(lex).groupBy("target_id", "side").agg(F.count("*"), F.sum("shared_len"), F.sum("helper_no")).collect()}
    assert {(r.target_id, r.side): r[2:] for r in matching.counts(lex).collect()} == pairs


def test_by_pos(spark):
    rows = spark.createDataFrame([("noun", True, True, 1.0), ("noun", False, False, 0.0), ("action", False, False, 0.0)], "pos string, top1 boolean, top5 boolean, reciprocal_rank double")
    got = {r.pos: r for r in scoring.summary(rows).collect()}
    assert got[None].total == 3 and got["noun"].top1 == 0.5 and got["action"].top5 == 0.0


def brute_order(items, seed):
    groups = {}
    for key, n, stratum in sorted(items, key=lambda x: x[1]):
        groups.setdefault(stratum, []).append(key)
    out = []
    for stratum, keys in groups.items():
        draw = hashing.mulberry32(hashing.fnv1a_of(f"{seed}|{stratum}"))
        for i in range(len(keys) - 1, 0, -1):
            j = int(next(draw) * (i + 1))
            keys[i], keys[j] = keys[j], keys[i]
        out += [((i + 0.5) / len(keys), hashing.fnv1a_of(f"{seed}|tie|{k}"), k) for i, k in enumerate(keys)]
    return [k for _, _, k in sorted(out)]


def test_orders(spark):
    items = [(f"B{i}", i, "noun" if i % 3 else "action", "2" if i % 5 else "5+") for i in range(1, 400)]
    df = spark.createDataFrame(items, "target_id string, numeric_id bigint, pos string, length string").repartition(7)
    got = [r.target_id for r in sampling.shuffled_order(df, ["pos", "length"], seed="s").orderBy("frac", "tie").collect()]
    assert got == brute_order([(k, n, f"{p}|{x}") for k, n, p, x in items], "s")
    one = {r.target_id: r.place for r in sampling.stratified_order(df, ["pos", "length"]).collect()}
    assert one == {r.target_id: r.place for r in sampling.stratified_order(df.repartition(3), ["pos", "length"]).collect()} and sorted(one.values()) == list(range(1, 400))
    placed = sampling.stratified_order(df, ["pos"])
    sets = sampling.nested_subsets(placed, [50, 100])
    assert sampling.imbalance(df, sets.join(df.select("target_id", "pos"), "target_id"), "pos").where("worst > 0.05").count() == 0
    assert sampling.stratified_order(df.limit(0), ["pos"]).count() == 0


def test_hashes(spark):
    texts = ["", "a", "B12|tie|x", "order-1"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hashing.fnv1a(F.col("t"))).collect()]
    assert got == [hashing.fnv1a_of(t) for t in texts] and hashing.fnv1a_of("a") == 0xE40C292C
    draw = hashing.mulberry32(1)
    assert abs(next(draw) - 0.6270739405881613) < 1e-12


def test_positions(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("abc"), rnd.random()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, u double").repartition(5)
    got = {(r.g, r.u): r.position for r in positions(df, [F.col("u")], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted(u for h, u in rows if h == g)
        assert [got[g, u] for u in mine] == list(range(1, len(mine) + 1))


def test_rules(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, False), (3, True, True)], "id int, a boolean, b boolean")
    out = rules.judged(df, {"a": F.col("a"), "b": F.col("b")})
    assert {r.id: (r.failed, r.primary) for r in out.collect()} == {1: (["b"], "b"), 2: (["a", "b"], "a"), 3: ([], None)}
    assert {r.rule: (r.first_failures, r.failures) for r in rules.exclusions(out).collect()} == {"a": (1, 1), "b": (1, 2)}


def test_files(spark, tmp_path):
    entries = [{"id": 1, "code": "B2/B3", "gloss": "one", "isWord": True, "filename": "f"}, {"id": 2, "code": "B2", "pos": "noun"}, {"id": 3, "code": "VL1:0,1", "isNonPreferred": True}]
    (tmp_path / "a.json").write_text(json.dumps(entries))
    (tmp_path / "o.json").write_text(json.dumps({"license": "x", "data": entries}))
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"spelling": "B2"}], "conditionalExceptions": [["B2", "B9"]]}))
    (tmp_path / "i.json").write_text(json.dumps({"entries": [{"code": "B81", "group": "g", "name": "n"}]}))
    for name in ("a.json", "o.json"):
        kit = snapshot.load_kit(spark, str(tmp_path / name), str(tmp_path / "m.json"), str(tmp_path / "i.json"))
        got = {r.id: r for r in kit.lexicon.entries.collect()}
        assert got["B1"].gloss == "one" and got["B2"].gloss == "" and got["B3"].is_non_preferred and not got["B1"].is_char and got["B2"].ordinal == 1
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(ValueError, match="neither"):
        snapshot.read_snapshot(spark, str(tmp_path / "bad.json"))
    (tmp_path / "no-id.json").write_text('[{"code": "B1"}]')
    with pytest.raises(Exception, match="whole number"):
        normalized(snapshot.read_snapshot(spark, str(tmp_path / "no-id.json"))).collect()
    (tmp_path / "s.jsonl").write_text('{"targetId":"B1","candidates":["a"]}\r\n\n{"targetId":"B2","candidates":"x [\\"y\\"]"}\n')
    rows = snapshot.read_submissions(spark, str(tmp_path / "s.jsonl")).orderBy("ord").collect()
    assert [(r.ord, r.targetId, r.candidates) for r in rows] == [(1, "B1", '["a"]'), (3, "B2", 'x ["y"]')]
    (tmp_path / "t.jsonl").write_text('{"targetId":"B1"}\nnot json\n')
    with pytest.raises(Exception, match="not a JSON object in line 2 of"):
        snapshot.read_submissions(spark, str(tmp_path / "t.jsonl")).collect()
    for label in ("../x", "a/b", "", ".."):
        with pytest.raises(ValueError, match="no name"):
            snapshot.set_path("d", label)
    with pytest.raises(ValueError, match="twice"):
        snapshot.checked_indicators([{"code": "B1", "group": "g"}] * 2, ["g"])


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError, match="frozen"):
        sinks.guarded(str(tmp_path / "x"), str(tmp_path))
    assert sinks.guarded(str(tmp_path / "out"), str(tmp_path / "data"))
    record = sinks.run_record("2026-06-04T03:40:41.846Z", "r", "v1", "100", 100, {"sha256": "s"}, method=[{"path": "p", "text": "é"}])
    assert record["method"][0]["bytes"] == 2 and record == sinks.run_record("2026-06-04T03:40:41.846Z", "r", "v1", "100", 100, {"sha256": "s"}, method=[{"path": "p", "text": "é"}])
    assert sinks.run_name("my-run", "2026-06-04T03:40:41.846Z") == "my-run.2026-06-04T034041846Z"
    got = sinks.record_run(str(tmp_path), "n", [], [{"targetId": "B1", "prompt": "p", "other": 1}], runner="r", prompt_version="v", set_name="s", count=1, snapshot={})
    assert got["interactions"] and len(list(tmp_path.glob("n.*"))) == 2
    lex = lexicon(spark, [(i, f"B{i + 1}/B{i + 2}", f"word {i} (1)") for i in range(1, 12)])
    (tmp_path / "snap.json").write_text("[]")
    (tmp_path / "f").mkdir()
    m = report.freeze(lex, lex.words.select(F.col("id").alias("target_id")), str(tmp_path / "snap.json"), str(tmp_path / "f"), [3, 5], "seed", "now")
    read = lambda n: [json.loads(x)["targetId"] for x in (tmp_path / "f" / n).read_text().splitlines()]
    assert read("targets.jsonl") == [f"B{i}" for i in range(1, 12)] and read("set-5.jsonl")[:3] == read("set-3.jsonl") and set(read("set-all.jsonl")) == set(read("answers.jsonl"))
    assert m["sha256"] == sinks.file_sha256(str(tmp_path / "snap.json")) and "± 56.6 %" in report.contract_text(m, report.SCORING_RULES)


def test_empty_tables(spark):
    lex = lexicon(spark, [])
    assert context.build(lex).count() == 0 and lex.sealed().count() == 0 and matching.neighbours(lex).count() == 0
    assert context.baseline(lex, answers.answer_key(lex.entries)).count() == 0


def test_baseline(spark):
    lex = lexicon(spark, [(1, "B50/B60/B70", "whole"), (2, "B50/B60/B70", "Same (1)"), (3, "B50/B60", "part"), (4, "B50", "PART"), (5, "B90/B80", "alone")])
    got = {r.target_id: r.guesses for r in context.baseline(lex, answers.answer_key(lex.entries)).collect()}
    assert got["B1"] == ["Same", "part"] and got["B5"] == ["unknown"]


def test_baseline_own_answers(spark):
    """The first of all helpers' answers for each target but its own, where helpers share answers, own many of them and lie under frequent keys."""
    rnd = random.Random(3)
    words = [(i, "/".join(f"B{rnd.choice([50, 60, 70])}" for _ in range(rnd.randint(1, 3))), "; ".join(rnd.choice("abcdefghij") + rnd.choice(["", " X", " x"]) for _ in range(rnd.choice([1, 2, 9])))) for i in range(1, 61)]
    lex = lexicon(spark, [*words, (50, "B60/B70", "k; l; m"), (200, "B50/B201", "n"), (201, "B70", "o"), (202, "B7000", "p; q; r; s; t; u; v"), (203, "B7000", "v; u")])
    key = answers.answer_key(lex.entries)
    given, entries, want = {}, {}, {}
    for r in key.collect():
        given.setdefault(r.target_id, []).append(r.answers)
    for r in lex.base_keys.collect():
        entries.setdefault(r.key, []).append(r)
    for r in matching.targets_of(lex).collect():
        n = len(r.base)
        for a in range(n):
            for b in range(a + 1, n + 1):
                for h in entries.get("/".join(r.base[a:b]), []):
                    if h.helper_id != r.target_id:
                        want.setdefault(r.target_id, []).extend((a - b, a, h.ordinal, h.helper_no, k, x) for said in given[h.helper_id] for k, x in enumerate(said) if x.strip())
    for most in (1, 2, 5):
        for r in context.baseline(lex, key, most=most).collect():
            first = {}
            for *_, x in sorted(want.get(r.target_id, [])):
                first.setdefault(x.strip().lower(), x)
            assert r.guesses == (list(first.values())[:most] or ["unknown"]), r.target_id


def test_baseline_lists_are_short(spark):
    """A frequent key gives its targets lists of bounded length."""
    lex = lexicon(spark, [(i, "B50", f"word {i}") for i in range(1, 40)])
    made = context._said(lex, answers.answer_key(lex.entries), 5).collect()
    assert {r.key: len(r.said) for r in made}["B50"] == 10


def test_counts_in_one_pass(spark):
    """Both sides share their joins; each for itself has five."""
    plan = matching.counts(lexicon(spark, NEAR))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 5


def test_context_counts_apart(spark, monkeypatch):
    """The counts of a context are written before its other blocks are planned."""
    labels, write = [], context.kept
    monkeypatch.setattr(context, "kept", lambda df, label="step": (labels.append(label), write(df, label))[1])
    context.build(lexicon(spark, NEAR))
    assert "counts" in labels


def test_counts_by_base(spark):
    """Equal bases are counted once, spans inside are found without a join of all spans, and no text of the entries is read; the sums are those of the pairs."""
    rnd = random.Random(5)
    words = [(i, "/".join(f"B{rnd.choice([1, 1, 2, 3])}" for _ in range(rnd.randint(1, 6))) + rnd.choice(["", ";;B81", ";B423"]), "") for i in range(1, 200)]
    lex = lexicon(spark, words)
    made = matching.counts(lex)
    assert made._jdf.queryExecution().sparkPlan().toString().count("Join") <= 3
    forms = matching._forms(lex, matching.targets_of(lex))
    assert forms.count() == forms.select("base_key").distinct().count() < 199 and "entries" not in lex.__dict__
    pairs = matching.neighbours(lex).groupBy("target_id", "side").agg(F.count("*"), F.sum("shared_len"), F.sum("helper_no"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, pairs.collect()))


def test_baseline_by_base(spark, monkeypatch):
    """Words of one base share one list of what its spans answer; one that has its own id, as a part or whole, has its own, and so has an id that is there twice."""
    tables, write = {}, context.kept
    monkeypatch.setattr(context, "kept", lambda df, label="step": tables.setdefault(label, write(df, label)))
    lex = lexicon(spark, [*((i, "B50/B60", f"word {i}") for i in range(101, 140)), (50, "B50", "fifty"), (60, "B60/B7", "sixty"), (7, "B8", "seven"), (70, "B50", "first"), (70, "B60/B50", "second")])
    got = {r.target_id: r.guesses for r in context.baseline(lex, answers.answer_key(lex.entries)).collect()}
    assert tables["forms"].count() == 5  # B50/B60; B50 with its id; B60/B7 with its id; B8; the two of B70
    assert got["B101"] == [f"word {i}" for i in range(102, 107)] and got["B109"] == [f"word {i}" for i in range(101, 106)]
    assert got["B50"] == ["first", "second"] and got["B60"] == ["seven"] and got["B7"] == ["unknown"] and got["B70"] == ["fifty", "sixty"]


def test_context_shuffles_keys(spark, monkeypatch):
    """A target is gathered with few keys, not with the many helpers under them; each partition gets a helper once under a key. Blocks have what their joins have, in order."""
    tables, write = {}, context.kept
    monkeypatch.setattr(context, "kept", lambda df, label="step": tables.setdefault(label, write(df, label)))
    monkeypatch.setattr(context, "MOST", 500)
    words = [*((i, "B50;B97/B60", f"word {i}") for i in range(101, 160)), *((i, "B50", f"part {i}") for i in range(201, 240)), (50, "B50/B60/B70", "its own"), (300, "B50/B61/B50", "near"), (301, "B900", "alone")]
    lex = lexicon(spark, words)
    got = {r.target_id: r for r in context.build(lex).collect()}
    assert len(got) == len(words) and max(len(r.refs) for r in tables["references"].collect()) < 30
    for block, df, order in (("subwords", matching.subwords(lex), ["start", "stop", "ordinal", "helper_no"]), ("siblings", matching.siblings(lex), ["ordinal", "helper_no"])):
        want = {}
        for r in df.orderBy("target_id", *order).collect():
            want.setdefault(r.target_id, []).append(r.helper_id)
        assert {t: [h.helper_id for h in r[block]] for t, r in got.items() if r[block]} == want
    assert len(got["B101"].siblings) == 58 and "B101" not in [h.helper_id for h in got["B101"].siblings] and "B50" not in [h.helper_id for h in got["B50"].subwords]
    first = got["B101"].subwords[0]
    assert (first.key, first.spelling, first.helper_id, first.gloss, first.answers) == ("B50", "B50;B97", "B50", "its own", ["its own"])
    assert got["B301"].siblings is None
    assert context.flat(context.build(lex, legend_view=["gloss"])).exceptAll(context.flat(context.build(lex))).count() == 0


def test_context_of_a_spelling_parses_once(spark, monkeypatch):
    """The entries are parsed once for given spellings too, candidates are looked up in full only under affixes that need it, and no view is written with the keys of the helpers."""
    tables, write = {}, context.kept
    again, under = [], matching._under
    for m in (context, matching):
        monkeypatch.setattr(m, "kept", lambda df, label="step": tables.setdefault(label, write(df, label)) if label == "met" else write(df, label))
    monkeypatch.setattr(matching, "_under", lambda held, a: (again.append((held.count(), (few := under(held, a)).count())), few)[1])
    labels = []
    monkeypatch.setattr("lexiloom.operators.lexicon.kept", lambda df, label: (labels.append(label), write(df, label))[1])
    words = [*((i, "B1/B2", "") for i in range(1, 13)), (13, "B1/B2/B7", ""), *((i, f"B1/B9/B{16 + i}", f"word {i}") for i in range(14, 22))]
    lex = lexicon(spark, words)
    got = context.build(lex, matching.targets_from(spark.createDataFrame([("B1/B3/B1/B2",), ("B5",)], "spelling string")))
    assert [h.helper_id for h in got.where("target_id = '?B1/B3/B1/B2'").first().shared_start] == [f"B{i}" for i in range(13, 21)]
    assert labels.count("lexicon") == 1 and "plain" not in labels
    assert again[0][0] > again[0][1] > 0 == again[1][1] and "h_gloss" not in tables["met"].columns
